"""The inverted file of vectors: exact and approximate searches against brute force."""

import numpy as np
import pytest

from sonoflock.operators import acquisition, cells, search


def frame(spark, rows, first=0):
    return spark.createDataFrame([(k + first, list(map(float, r))) for k, r in enumerate(rows)], "snippet_id long, vector array<double>").repartition(3)


def groups(n, dim, k, spread, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, dim))[rng.integers(k, size=n)] + spread * rng.normal(size=(n, dim))


def brute(q, t, k, skip_self=False):
    q, t = (np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, x / np.maximum(n, 1e-12), 0) for x in (np.asarray(q, float), np.asarray(t, float)))
    d = np.round(np.sqrt(np.maximum(2 - 2 * q @ t.T, 0)), 9)
    if skip_self:
        np.fill_diagonal(d, np.inf)
    out = {}
    for i, row in enumerate(d):
        order = sorted(range(len(t)), key=lambda j: (row[j], j))[:k]
        out[i] = [(j, row[j]) for j in order if np.isfinite(row[j])]
    return out


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.snippet_id, r.distance))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose([d for _, d in a[k]], [d for _, d in b[k]], atol=2e-9)
        assert [i for i, _ in a[k]] == [i for i, _ in b[k]] or len({round(d, 7) for _, d in a[k]}) < len(a[k])


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_search_is_exact_and_visits_fewer_pairs(spark, block):
    q, t = groups(150, 12, 8, 0.2, 1), groups(700, 12, 8, 0.2, 1)
    index = cells.index(frame(spark, t), 24, block)
    found, cost = cells.exact(frame(spark, q), index, 4, probes=2, block=block)
    same(got(found), brute(q, t, 4))
    assert cost["pairs"] == 150 * 700 and cost["compared"] < 0.5 * cost["pairs"]
    assert index.rows.sum() == 700


def test_copies_and_vectors_without_direction(spark):
    rng = np.random.default_rng(2)
    t = np.vstack([rng.normal(size=(60, 5)), np.tile([1.0, 2, 3, 4, 5], (80, 1)), np.zeros((3, 5)), -np.ones((1, 5))])
    index = cells.index(frame(spark, t), 9, 32)
    found, _ = cells.exact(frame(spark, t), index, 6, probes=1, block=32, skip_self=True)
    same(got(found), brute(t, t, 6, True))
    assert index.rows[-1] == 3


def test_euclidean_distances(spark):
    q, t = groups(80, 6, 5, 0.3, 8), groups(300, 6, 5, 0.3, 8)
    t[:4] = 0
    found, cost = cells.exact(frame(spark, q), cells.index(frame(spark, t), 15, 40, metric="euclidean"), 3, probes=1, block=40)
    d = np.round(np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1)), 9)
    for i, rows in got(found).items():
        assert np.allclose([x for _, x in rows], np.sort(d[i])[:3], atol=1e-8)
    assert cost["compared"] < cost["pairs"]
    near = search.nearest(frame(spark, q), frame(spark, t), 3, metric="euclidean")
    assert np.allclose([x for r in got(near).values() for _, x in r], np.sort(d, axis=1)[:, :3].ravel(), atol=1e-8)


def test_approximate_search_recalls(spark):
    q, t = groups(300, 16, 30, 0.4, 3), groups(3000, 16, 30, 0.4, 3)
    index = cells.index(frame(spark, t))
    near = cells.approximate(frame(spark, q), index, 1, 8)
    report = acquisition.error_report(cells.exact(frame(spark, q), index, 1)[0], near).first()
    assert report.n == 300 and report.recall_at_1 > 0.9 and report.mean_error < 0.05 and report.least_error >= 0
    want = brute(q, t, 1)
    hits = [r.snippet_id == want[r.query_id][0][0] for r in near.collect()]
    assert abs(sum(hits) / 300 - report.recall_at_1) < 1e-9


def test_large_tables_are_searched_by_cells(spark):
    q, t = groups(40, 8, 5, 0.3, 4), groups(500, 8, 5, 0.3, 4)
    a, b = search.nearest(frame(spark, q), frame(spark, t), 3), search.nearest(frame(spark, q), frame(spark, t), 3, block=100)
    same(got(a), brute(q, t, 3))
    same(got(b), brute(q, t, 3))
    score = acquisition.diversity_scores(frame(spark, q), frame(spark, t), approximate_from=500)
    assert score.count() == 40 and score.where("diversity < 0 or diversity > 1 or nearest is null").count() == 0


def test_visits_are_not_written(spark):
    """Vectors of many dimensions without clusters visit all cells; what is written and shuffled follows the rows."""
    t = np.random.default_rng(9).normal(size=(3000, 48))
    rows = frame(spark, t)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executorList(False)))

    before = shuffled()
    found, cost = cells.exact(rows, cells.index(rows), 5, skip_self=True)
    same(got(found), brute(t, t, 5, True))
    assert cost["compared"] > 0.8 * cost["pairs"]
    # a vector for each visit would be 50 times the rows, twice
    assert shuffled() - before < 20 * t.nbytes


def test_found_rows_do_not_follow_the_shares(spark, monkeypatch):
    monkeypatch.setattr(cells, "SHARE", 64)
    q, t = groups(40, 12, 1, 1.0, 5), groups(700, 12, 1, 1.0, 6)
    index = cells.index(frame(spark, t), 24, 16)
    rows, blocks = cells._filed(frame(spark, q), index), cells._compact(index)
    assert blocks.rdd.getNumPartitions() > 1
    visitors = cells._visitors(rows, 40, index, 24, 16)
    monkeypatch.setattr(cells, "TASKS", 1, raising=False)
    monkeypatch.setattr(cells, "TURNS", 1, raising=False)
    found = cells._meet(visitors, 40, index, blocks, 4, False)
    assert found.count() == 40 * 4  # as many for each share of the index before
    same(got(cells._first(found, 4)), brute(q, t, 4))


def test_blocks_of_several_cells_are_read_together(spark):
    t = groups(700, 12, 8, 0.2, 1)
    index = cells.index(frame(spark, t), 24, 16)
    blocks = cells._compact(index)
    rows = blocks.collect()
    assert len(rows) < 5 < index.blocks.count()  # a row for each block before
    ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in rows])
    assert sorted(ids) == list(range(700))
    sizes = np.zeros(len(index.rows), int)
    for r in rows:
        np.add.at(sizes, r.cells, np.frombuffer(r.sizes, np.int32))
    assert (sizes == index.rows).all()


@pytest.mark.parametrize("scale, offset", [(1, 0), (1, 1e3), (1e-17, 0), (1e17, 0)])
def test_single_precision_loses_no_row(spark, scale, offset):
    """Bounds are as narrow as the vectors are near: far from 0, tiny and huge ones keep all their neighbours."""
    t = (groups(600, 6, 9, 0.1, 12) + offset) * scale
    t[300:350] = t[7]
    rows = frame(spark, t)
    got_ = got(cells.exact(rows, cells.index(rows, 20, 40, metric="euclidean"), 5, probes=1, block=40)[0])
    d = np.round(np.sqrt(((t[:, None] - t[None]) ** 2).sum(-1)), 9)
    for i, row in got_.items():
        order = sorted(range(len(t)), key=lambda j: (d[i, j], j))[:5]
        # equal ones are at 0 exactly, so that the smallest ids come first
        assert [x for x, v in row if v == 0] == [j for j in order if d[i, j] == 0]
        assert np.allclose([v for _, v in row], d[i, order], rtol=1e-9, atol=2e-9)


def test_probes_follow_a_sample_of_queries(spark):
    """Without clusters the nearest row often lies in a cell that few probes miss."""
    rng = np.random.default_rng(10)
    q, t = rng.normal(size=(200, 32)), rng.normal(size=(600, 32))
    score = acquisition.diversity_scores(frame(spark, q), frame(spark, t), 100, 2).collect()
    want = brute(q, t, 1)
    assert np.mean([abs(r.nearest - want[r.snippet_id][0][1]) < 1e-8 for r in score]) >= 0.9
    assert cells.enough_probes(frame(spark, q).limit(0), cells.index(frame(spark, t)), 3) == 3


def test_few_and_no_rows(spark):
    t = frame(spark, [[1, 0], [0, 1]])
    index = cells.index(t, 5)
    assert got(cells.exact(t, index, 4)[0]) == {0: [(0, 0.0), (1, 1.414213562)], 1: [(1, 0.0), (0, 1.414213562)]}
    assert cells.exact(t.limit(0), index, 2)[0].count() == 0
    none = cells.index(t.limit(0))
    assert cells.exact(t, none, 2)[0].count() == 0 and cells.approximate(t, none, 2).count() == 0


def test_a_lookup_reads_the_files_of_its_cells(spark):
    t = groups(400, 8, 10, 0.1, 5)
    index = cells.index(frame(spark, t), 10)
    found = cells.search(index, t[3].tolist(), 5, probes=1)
    assert found.first().snippet_id == 3 and found.first().distance == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
