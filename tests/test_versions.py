"""Tables kept by fingerprint, rankings by slab, the store of predictions."""

import threading

import pytest

from sonoflock.plans.shared import materialise
from sonoflock.sources import versions as V


def test_hits_misses_and_invalidation(spark, tmp_path):
    path, made = f"file://{tmp_path}/t", []

    def make():
        made.append(1)
        return spark.range(5).selectExpr("id", "id * 2 AS twice")

    clock = [100.0]
    keep = lambda n, ttl=None: V.kept(spark, path, {"count": n}, make, ttl, now=lambda: clock[0])
    table, hit = keep(5)
    assert not hit and table.count() == 5
    again, hit = keep(5)
    assert hit and sorted(map(tuple, again.collect())) == [(k, 2 * k) for k in range(5)] and len(made) == 1
    assert not keep(6)[1] and not keep(5)[1]  # another fingerprint replaces it
    assert keep(5, 10)[1]
    clock[0] += 11
    assert not keep(5, 10)[1]
    V.forget(spark, path)
    assert again.count() == 5  # a reader goes on
    assert not keep(5)[1] and keep(5)[1]
    assert V.Versions(spark, path).sweep(1) > 0 and keep(5)[1] and keep(5)[0].count() == 5


def test_a_writer_that_is_gone_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    V.kept(spark, path, {"a": 1}, lambda: spark.range(3))
    table = V.Versions(spark, path)
    table.fs.create(table._at(f"{path}/manifests/{2:012d}"), False).close()  # made, but never written
    assert V.kept(spark, path, {"a": 1}, lambda: spark.range(9))[1]

    def fails():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        V.kept(spark, path, {"a": 2}, fails)
    assert V.kept(spark, path, {"a": 1}, lambda: spark.range(9))[0].count() == 3


def test_writers_at_the_same_time(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    rows = lambda k: spark.createDataFrame([(1, s, float(k)) for s in range(4 * k, 4 * k + 4)], "model_checkpoint_id long, snippet_id long, score double")
    threads = [threading.Thread(target=V.append, args=(rows(k), path)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.snippet_id for r in V.predictions(spark, path).collect()) == list(range(16))


def test_no_change_is_lost(spark, tmp_path):
    path = f"file://{tmp_path}/n"

    def add(k):
        for i in range(6):
            V.Versions(spark, path).swap(lambda old: {"folders": [*(old["folders"] if old else []), f"{k}-{i}"]})  # noqa: B023

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = V.Versions(spark, path).read()
    assert sorted(last["folders"]) == sorted(f"{k}-{i}" for k in range(6) for i in range(6))
    assert last["number"] == 36


def files(frame):
    scans = frame._jdf.queryExecution().executedPlan().toString()
    return scans, len(frame.inputFiles())


def test_predictions_are_appended_found_and_compacted(spark, tmp_path):
    path, schema = f"file://{tmp_path}/p", "model_checkpoint_id long, snippet_id int, score double"
    with pytest.raises(ValueError):
        V.predictions(spark, path)
    V.append(spark.createDataFrame([(1, s, s / 100) for s in range(100)], schema), path)
    V.append(spark.createDataFrame([(1, 7, 0.99), (2, 7, 0.5)], schema), path)
    one = V.predictions(spark, path, 1, 7)
    assert [tuple(r) for r in one.collect()] == [(1, 7, 0.99)]
    assert "PartitionFilters: [isnotnull(bucket" in files(one)[0]
    assert sorted(r.model_checkpoint_id for r in V.predictions(spark, path, snippet_id=7).collect()) == [1, 2]
    assert V.predictions(spark, path, 1).count() == 100 and V.predictions(spark, path).count() == 101
    V.compact(spark, path)
    assert len(V.Versions(spark, path).read()["folders"]) == 1
    assert V.predictions(spark, path).count() == 101 and V.predictions(spark, path, 1, 7).first().score == 0.99
    V.append(spark.createDataFrame([(1, 7, 0.1)], schema), path)
    assert V.predictions(spark, path, 1, 7).first().score == 0.1
    with pytest.raises(ValueError):
        V.append(spark.createDataFrame([(1, 7)], "model_checkpoint_id long, snippet_id long"), path)


def test_pages_of_a_kept_ranking(spark, tmp_path):
    rows = [(k, None if k % 10 == 0 else (k * 7 % 50) / 10) for k in range(200)]
    scored = spark.createDataFrame(rows, "id long, score double").repartition(5)
    path = f"file://{tmp_path}/r"
    ranking, _ = V.kept(spark, path, {"n": 200}, lambda: V.ranked(scored, "score", "id", materialise, 30), by="slab")
    want = [k for k, s in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for offset, limit in ((0, 10), (25, 10), (190, 20), (0, 200), (500, 5)):
        got = V.page(ranking, offset, limit, 30)
        assert [r.id for r in got.collect()] == want[offset : offset + limit]
    assert "PartitionFilters: [isnotnull(slab" in files(V.page(ranking, 25, 10, 30))[0]
