import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sonoflock.llm import mixing


def reshared(sizes):
    """Targets by sharing out the excess again and again. sizes: by source, in order."""
    total, weights = sum(sizes.values()), {s: i % 3 + 1 for i, s in enumerate(sizes)}
    capped: dict = {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(capped.values())
        whole = sum(weights[s] for s in free)
        got = {s: rest * weights[s] / whole for s in free} if free else {}
        over = {s: 3 * sizes[s] for s, x in got.items() if x > 3 * sizes[s]}
        if not over:
            return capped | got
        capped |= over


def check(spark, docs):
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mix(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(d), str(s), words(t)) for d, t, s in docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += words(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    want = reshared({s: sizes[s] for s in names})
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in names:
        largest = max(words(t) for _, t, x in docs if x == s)
        assert abs(taken[s] - want[s]) <= 3 * largest + 1e-6
    again = mixing.mix(df.orderBy(F.rand(1))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_and_copies(spark):
    rng = random.Random(3)
    text = lambda: " ".join("w" for _ in range(rng.randint(0, 40)))
    docs = [(d, text(), rng.choice(["a", "b", "B", "é", "\U00010000", "￿", None, "hot", "hot", "hot", "hot"])) for d in range(600)]
    check(spark, docs + [(900, None, "a"), (901, "", "empty"), (None, "x y", "a"), (7, "x", "a"), (7, "x", "a"), (902, "w " * 5000, "tiny")])


def test_one_source_and_small_ones(spark):
    check(spark, [(d, "w " * (d % 7), "only") for d in range(50)])
    check(spark, [(1, "w", "a"), (2, "w " * 500, "b"), (3, "w", "c"), (4, "w w", "d")])


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()] == [0]
