"""Operators against brute force and against the values noted in FIXTURES.md."""

import random
import wave
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoflock.functions import labels as L
from sonoflock.functions import vectors as V
from sonoflock.operators import acquisition, feeds, platform, reduce, search, segment, stats, taxonomy, training, upsert
from sonoflock.plans.shared import shared_folder
from sonoflock.sources import media, tables
from sonoflock.streaming import feedback as stream


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "snippet_id long, vector array<float>")


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_search_orders_by_cosine(spark):
    rows = frame(spark, [[1, 0], [0, 1], [-1, 0]], 1)
    assert [tuple(r) for r in search.top_k(rows, [1, 0], 3).collect()] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert [r.snippet_id for r in search.similar_to(rows, 1, 5).collect()] == [2, 3]


@pytest.mark.parametrize("block", [4096, 37])
def test_nearest_equals_brute_force(spark, block):
    a, b = unit(120, 16, 1), unit(90, 16, 2)
    got = search.nearest(frame(spark, a), frame(spark, b, 1000), 3, block).collect()
    d = np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))
    assert len(got) == 360
    for r in got:
        assert abs(r.distance - np.sort(d[r.query_id])[r["rank"] - 1]) < 1e-5


def test_scores_of_no_and_few_vectors(spark):
    x = frame(spark, unit(10, 16, 3))
    none = x.limit(0)
    assert acquisition.diversity_scores(none, x).count() == 0
    assert {r.diversity for r in acquisition.diversity_scores(x, none).collect()} == {0.0}
    assert [r.density for r in acquisition.density_scores(x.limit(1)).collect()] == [0.0]
    same = frame(spark, [[1, 0]] * 4)
    assert {r.density for r in acquisition.density_scores(same).collect()} == {0.0}
    report = acquisition.error_report(search.nearest(x, x, 1), search.nearest(x, x, 1)).first()
    assert tuple(report) == (1.0, 0.0, 0.0, 0.0, 10)


def test_scalar_scores(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(
        spark, even=V.uncertainty(arr(0.5, 0.5)), sure=V.uncertainty(arr(0, 1)), either=V.noisy_or(arr(0.5, 0.2)), none=V.noisy_or(F.array().cast("array<double>")),
        zero=V.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0), (0, 0, 0)), w=V.pos_weight(F.lit(2), F.lit(10)), w0=V.pos_weight(F.lit(0), F.lit(10)),
    )
    assert abs(r.even - 1) < 1e-6 and abs(r.sure) < 1e-6 and abs(r.either - 0.6) < 1e-9
    assert (r.none, r.zero, r.w, r.w0) == (0.0, 0.0, 4.0, 1.0)


def test_label_expressions(spark):
    s = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    r = one(
        spark, norm=L.normalised(s(" b", None, "a", "", "String", "b")), null=L.normalised(F.lit(None).cast("array<string>")), hot=L.multi_hot(s("b", "z"), ["a", "b"]),
        back=L.from_multi_hot(F.array(F.lit(0), F.lit(1)), ["a", "b"]), no=L.from_multi_hot(F.array(F.lit(0), F.lit(0)), ["a", "b"]), neg=L.confirmed_negative(s("None", "None")),
        mod=L.resolved(F.lit("MODIFY"), s("x"), s(" ")), rej=L.resolved(F.lit("REJECT"), s("x"), s("y")), order=L.label_order([s("a"), s("a", "b")], 2), made=L.label_order([s("a")], 2),
        pick=L.picked(s("a", "b", "c"), F.array(F.lit(3), F.lit(9), F.lit(1), F.lit(3))), new=L.with_new(s("a"), "b"), old=L.with_new(s("a"), "a"), cut=L.without(s("a", "b"), "a"),
        merged=L.merged(F.create_map(F.lit("k"), F.lit(1), F.lit("l"), F.lit(1)), F.create_map(F.lit("k"), F.lit(2))),
    )
    assert r.norm == ["b", "a"] and r.null == [] and r.hot == [0, 1] and r.back == ["b"] and r.no == ["None"] and r.neg is True
    assert r["mod"] is None and r.rej == [] and r.order == ["a", "b"] and r.made == ["class_0", "class_1"]
    assert r.pick == ["c", "a"] and r.new == ["a", "b"] and r.old == ["a"] and r.cut == ["b"] and r.merged == {"k": 2, "l": 1}


@pytest.mark.parametrize(
    "duration,window,step,n", [(1.0, 0.5, 0.5, 2), (10.0, 3.0, 3.0, 3), (10.0, 3.0, 1.5, 5), (60.0, 3.0, 0.1, 570), (0.7, 0.1, 0.1, 7), (None, 3.0, 3.0, 0), (2.0, 3.0, 1.0, 0), (2.0, 0.1, 0.1, 19)]
)
def test_segmentation(spark, duration, window, step, n):
    rows = spark.createDataFrame([(1, duration)], "id long, duration double")
    got = sorted(r.start_time for r in segment.segment(rows, window, step).collect())
    want, t = [], 0.0
    while duration is not None and t + window <= duration:
        want.append(t)
        t += step
    assert got == want and len(got) == n


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.6, 0.7, 1.0, 1.1, -0.1, None)], "c double")
    got = [r.n for r in stats.histogram(rows, "c").orderBy("bin").collect()]
    assert got == np.histogram([0.0, 0.3, 0.6, 0.7, 1.0], bins=10, range=(0, 1))[0].tolist()
    assert stats.histogram(rows.limit(0), "c").count() == 0


def test_capped_classes_equal_a_greedy_scan(spark):
    rng = random.Random(1)
    rows = [(i, rng.sample(["a", "b", "c"], rng.randint(1, 3))) for i in range(60)]
    got = {r.snippet_id for r in training.cap_classes(spark.createDataFrame(rows, "snippet_id long, labels array<string>"), 5).collect()}
    import hashlib

    count, want = dict.fromkeys("abc", 0), set()
    for i, labels in sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:42".encode()).hexdigest(), r[0])):
        if any(count[x] < 5 for x in labels):
            want.add(i)
            for x in labels:
                count[x] += 1
    assert got == want


def test_alignment_falls_back_to_paths(spark):
    names = [(i, f"{c}.wav", f"x/{c}.wav") for i, c in enumerate("abcdef", 1)]
    v = spark.createDataFrame(names, "snippet_id long, file_name string, file_path string")
    # c: a file without events; d: an event without labels, which makes a negative; e: both, by name
    events = [("a.wav", ["s"]), ("a.wav", ["t", "s"]), ("x/b.wav", ["u"]), ("c.wav", None), ("x/c.wav", ["u"]), ("d.wav", []), ("x/d.wav", ["u"]), ("e.wav", []), ("e.wav", ["s"])]
    truth = spark.createDataFrame(events, "key string, labels array<string>")
    want = {1: ["s", "t"], 2: ["u"], 4: [], 5: ["s"]}
    assert {r.snippet_id: r.labels for r in training.align(v, truth).collect()} == want
    assert {r.snippet_id: r.labels for r in training.training_rows(v, truth).collect()} == want
    with pytest.raises(ValueError):
        training.training_rows(v, truth.where("key = 'z'"))


def test_models_learn_separable_data(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    rows = spark.createDataFrame(
        [(i, r.tolist(), [n for n, k in (("p", 0), ("q", 1)) if r[k] > 0]) for i, r in enumerate(x)], "snippet_id long, vector array<double>, labels array<string>"
    )
    truth = (x[:, :2] > 0).astype(int)
    for fit, kind in ((training.fit_linear, training.Linear), (training.fit_mlp, training.Mlp)):
        model = fit(rows, ["p", "q"], 4, steps=12, rate=0.3)
        assert model.losses[-1] < model.losses[0]
        assert ((model.probabilities(x) > 0.5).astype(int) == truth).mean() > 0.9
        path = f"file://{tmp_path}/{kind.__name__}"
        tables.save_model(spark, model, path)
        assert np.allclose(tables.load_model(spark, kind, path).probabilities(x), model.probabilities(x))
    got = training.apply_model(rows, model).orderBy("snippet_id").collect()
    assert np.allclose([[r.probs["p"], r.probs["q"]] for r in got], model.probabilities(x))


def test_pca_centres_and_clamps(spark):
    x = np.random.default_rng(5).normal(size=(60, 6)) @ np.diag([5, 3, 1, 0.1, 0.1, 0.1]) + 10
    rows, explained = reduce.pca(frame(spark, x), 6, 3)
    got = np.array([r.vector for r in rows.orderBy("snippet_id").collect()])
    c = x.astype(np.float32).astype(float)
    c = c - c.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-3) and explained > 0.95
    assert len(reduce.pca(frame(spark, x[:3]), 6, 50)[0].first().vector) == 2


def test_unsettled_ways_are_an_error(spark):
    graph = spark.createDataFrame([(k, k + 1, 1.0) for k in range(5)], "query_id long, snippet_id long, distance double")
    start = spark.createDataFrame([(0,)], "snippet_id long")
    assert {r.snippet_id: r.d for r in reduce.geodesics(graph, start, 6).collect()} == {k: float(k) for k in range(6)}
    with pytest.raises(RuntimeError):
        reduce.geodesics(graph, start, 2)


def test_isomap_unrolls_a_curve(spark):
    shared_folder(spark)
    t = np.linspace(0, 2.5, 30)
    x = np.stack([np.cos(t), np.sin(t)], 1)
    got = reduce.landmark_isomap(frame(spark, x), 5, 12, 1).orderBy("snippet_id").collect()
    y = np.array([r.coordinates[0] for r in got])
    assert abs(np.corrcoef(y, t)[0, 1]) > 0.99


def test_upserts_match_null_keys(spark):
    old = spark.createDataFrame([(1, None, "a", 1), (1, 2, "b", 2), (3, 3, "c", 3)], "k long, l long, x string, y long")
    new = spark.createDataFrame([(1, None, "A"), (9, None, "n")], "k long, l long, x string")
    got = sorted(map(tuple, upsert.upsert(old, new, ["k", "l"]).collect()), key=str)
    assert got == sorted([(1, None, "A", None), (1, 2, "b", 2), (3, 3, "c", 3), (9, None, "n", None)], key=str)
    assert upsert.insert_absent(old, new, ["k", "l"]).count() == 4
    assert upsert.delete(old, new, ["k", "l"]).count() == 2
    assert upsert.update(old, ["k", "l"], new).where("k = 1 and l is null").first().x == "A"


def test_taxonomies(spark):
    tree = '{"nodes":[{"id":"a","name":"Anura","children":[{"taxon_id":"b","canonical_name":"Rana","metadata":{"rank":"genus"}},{"x":1,"children":[{"name":"deep"}]}]},{"id":"c"}]}'
    rows = spark.createDataFrame([("t", tree, 0, "active")], "taxonomy_id string, j string, position int, status string").withColumn("tree", F.parse_json("j"))
    got = taxonomy.flatten(rows).orderBy("place").collect()
    assert [(r.id, r.name, r["rank"]) for r in got] == [("a", "Anura", None), ("b", "Rana", "genus"), (None, "deep", None), ("c", None, None)]
    assert taxonomy.find(rows, "b").first().name == "Rana"
    assert taxonomy.preview(rows, 2).first().asDict() == {"taxonomy_id": "t", "n_labels": 4, "preview": ["Anura", "Rana"], "has_more": True}
    assert [r.id for r in taxonomy.search(rows, "rana").collect()] == [] and taxonomy.search(rows, "ANU").first().id == "a"


def test_trees_of_any_depth_and_size(spark):
    deep = '{"nodes":[' + '{"id":"d","children":[' * 500 + '{"id":"end"}' + "]}" * 500 + "]}"
    wide = '{"nodes":[' + ",".join('{"id":"w%d","children":[%s]}' % (k, ",".join('{"id":"c%d"}' % j for j in range(50))) for k in range(400)) + "]}"
    rows = spark.createDataFrame([("deep", deep), ("wide", wide)], "taxonomy_id string, tree string")
    got = taxonomy.flatten(rows, 100)
    assert {r.taxonomy_id: r["count"] for r in got.groupBy("taxonomy_id").count().collect()} == {"deep": 501, "wide": 400 * 51}
    assert len(got.where("id = 'end'").first().place) == 501
    same = taxonomy.flatten(rows)
    variant = taxonomy.flatten(rows.where("taxonomy_id = 'wide'").withColumn("tree", F.parse_json("tree")), 7000)
    assert variant.exceptAll(same).count() == 0 and variant.count() == 400 * 51
    assert got.exceptAll(same).count() == 0 and same.exceptAll(got).count() == 0
    assert [r.preview for r in taxonomy.preview(rows, 2).orderBy("taxonomy_id").collect()] == [["d", "d"], ["w0", "c0"]]


def test_pages_and_bounds(spark):
    rows = spark.range(20)
    assert [r.id for r in feeds.page(rows, ["id"], 5, 3).collect()] == [5, 6, 7]
    for skip, limit in ((-1, 5), (0, 0), (0, 1001)):
        with pytest.raises(ValueError):
            feeds.page(rows, ["id"], skip, limit)
    with pytest.raises(ValueError):
        feeds.annotated(rows, rows, "some")


def tone(path, seconds, rate=16000, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.arange(int(seconds * rate) * channels, dtype="<i2").tobytes())


def test_scanning_files(spark, tmp_path):
    (tmp_path / "frog").mkdir()
    tone(tmp_path / "a.WAV", 0.5)
    tone(tmp_path / "frog" / "b.wav", 0.1, channels=2)
    (tmp_path / "frog" / "bad.wav").write_bytes(b"x")
    (tmp_path / "ignore.txt").write_text("x")
    found = media.scan(spark, str(tmp_path)).collect()
    assert [(r.file_path, r.duration, r.sample_rate) for r in found] == [("a.WAV", 0.5, 16000.0), ("frog/b.wav", 0.1, 16000.0)]
    assert all(len(r.audio_sha256) == 64 for r in found)
    assert media.scan(spark, str(tmp_path), spark.createDataFrame(found)).count() == 0
    paths = spark.createDataFrame([("a.wav", 1), ("frog/b.wav", 2), ("frog/x/c.wav", 3), (".h/d.wav", 4)], "file_path string, size long")
    assert [(r.species, r.n_files) for r in media.structure(paths).collect()] == [("Recordings", 1), ("frog", 1)]
    assert media.listing(spark, str(tmp_path)) == [("frog", False)]
    content = spark.read.format("binaryFile").load(str(tmp_path / "frog" / "b.wav")).select(F.lit(1).cast("long").alias("id"), "content")
    cuts = spark.createDataFrame([(1, 0.0, 0.05)], "recording_id long, start_time double, end_time double")
    cut = media.snippets(content, cuts)
    assert len(cut.first().samples) == 800
    vector = media.embed(cut, lambda x: x[:, :2], 2, 1000).first().vector
    assert len(vector) == 2


@pytest.mark.parametrize("delimiter", [",", ";", "\t"])
def test_ground_truth_files(spark, tmp_path, delimiter):
    path = tmp_path / "gt.csv"
    path.write_text("\n".join(delimiter.join(r) for r in (["﻿fname", "min_t", "max_t", "subset", "s1", "s2"], ["f", "3.0", "4.5", "Train", "1", "no"], ["g", "0", "3", "test", "", "yes"])))
    rows = tables.ground_truth(tables.read_csv(spark, str(path)), ["s1", "s2"], ["train"]).collect()
    assert [tuple(r) for r in rows] == [("f_3_4.5.wav", ["s1"])]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, x string")
    tables.write_export(rows, f"{tmp_path}/c", "csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).first().x == "a"
    (tmp_path / "l.json").write_text('{"labels": ["p", "q"]}')
    assert tables.species_of_config(spark, str(tmp_path / "l.json")) == ["p", "q"]


def test_streams_reach_the_state_of_the_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(k, k % 5, k % 3, ["ACCEPT", "MODIFY", "REJECT"][k % 3], f"sp{k % 4}", at + timedelta(minutes=k), k % 2) for k in range(60)]
    schema = "id long, snippet_id long, user_id long, action string, label string, created_at timestamp, model_checkpoint_id long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.label_state(events).writeStream.format("memory").queryName("label_state").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    final: dict = {}
    for r in rows:
        if r[3] != "REJECT":
            final.setdefault(r[1], {})[r[2]] = r[4]
    got = {r.snippet_id: r.labels for r in spark.sql("select * from label_state").collect()}
    assert got.keys() == final.keys()
    fired: list = []
    stream.gate(events, f"file://{tmp_path}/g", 5, fired.extend).awaitTermination()
    assert set(fired) == {0, 1}
    q = stream.counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.sql("select n from counts").collect()) == 60


def test_segments_of_many_recordings_are_running_sums(spark):
    rows = [(k, d) for k, d in enumerate([0.0, 0.5, 1.0, 7.3, None, float("nan"), 100.0, 33.3])]
    df = spark.createDataFrame(rows, "id long, duration double").coalesce(1)
    want = []
    for k, d in rows:
        t = 0.0
        while d is not None and t + 0.5 <= d:
            want.append((k, t, t + 0.5))
            t += 0.1
    for most in (7, 1_000_000):
        assert sorted(map(tuple, segment.segment(df, 0.5, 0.1, most=most).collect())) == want


def test_feedback_before_any_model_is_kept(spark):
    kinds = "model_checkpoint_id long, snippet_id long, user_id long, action string, label string"
    new = spark.createDataFrame([(None, 1, 7, "ACCEPT", "a"), (3, 2, 7, "ACCEPT", "b"), (4, 2, 7, "ACCEPT", "c")], kinds)
    labels = spark.createDataFrame([], "snippet_id long, label string, source string, user_id long")
    known = spark.createDataFrame([(3, 2)], "model_checkpoint_id long, snippet_id long")
    log, kept = platform.submitted(new.limit(0), labels, new, known)
    assert sorted((r.model_checkpoint_id or 0, r.label) for r in log.collect()) == [(0, "a"), (3, "b")]
    assert sorted(r.label for r in kept.collect()) == ["a", "b"]


def test_a_version_given_twice_is_registered_once(spark):
    kinds = "id long, dataset_id long, family string, version int, created_at int"
    new = spark.createDataFrame([(1, 5, "f", 1, 10), (2, 5, "f", 1, 11), (3, 5, "f", 2, 9)], kinds)
    states = spark.createDataFrame([], "dataset_id long, family string, active_model_checkpoint_id long")
    out, active = platform.registered(new.limit(0), states, new)
    assert sorted(r.id for r in out.collect()) == [2, 3] and [r.active_model_checkpoint_id for r in active.collect()] == [2]
