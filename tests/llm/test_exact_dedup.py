import hashlib
import random
import re
from collections import defaultdict

import pytest

from sonoflock.llm import exact_dedup


def norm(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[norm(t)].append(d)
    out = []
    for d, t in docs:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[norm(t)]), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    texts = ["Éa", "éa", "A b", "a B", "", None, " ", "x" * 50_000] + [f"t{rng.randrange(40)}" for _ in range(150)]
    out = [(d, t) for d, t in enumerate(texts)]
    return [*out, (None, "only null"), (None, "T3"), (9, texts[9]), (9, texts[9])]


@pytest.mark.parametrize("capacity,hot_rows", [(4096, 10_000), (4, 3), (1, 1)])
def test_matches_brute_force(spark, docs, capacity, hot_rows):
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, h int, keep_id string").repartition(3)
    got = exact_dedup.dedup(df, capacity=capacity, hot_rows=hot_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


@pytest.mark.parametrize("capacity", [1, 4])
def test_overfull_buckets_are_split_without_end(spark, docs, capacity):
    rows = exact_dedup.hashed(spark.createDataFrame(docs, "doc_id long, text string"))
    top, slots, index = exact_dedup.build_index(rows, capacity=capacity)
    index = index.collect()
    sizes, depth = defaultdict(int), {}
    for r in index:
        sizes[r.bucket] += 1
        depth[r.bucket] = r.depth
        assert r.bucket == (1 << r.depth) | ((r.h % 2**64) >> (64 - r.depth) if r.depth else 0)
    assert max(sizes.values()) <= capacity and len(set(depth.values())) > 1 and max(depth.values()) == top
    # no bucket could be given back to a shorter prefix
    for b, d in depth.items():
        parent = [n for c, n in sizes.items() if c.bit_length() >= d and c >> (c.bit_length() - d) == b >> 1] if d else [capacity + 1]
        assert sum(parent) > capacity
    assert len(index) == len({norm(t) for _, t in docs}) and {r.chain for r in index} == {1}


def test_the_directory_leads_to_the_entries(spark, docs):
    rows = exact_dedup.hashed(spark.createDataFrame(docs, "doc_id long, text string"))
    top, slots, index = exact_dedup.build_index(rows, capacity=8)
    assert exact_dedup.probe(rows, top, slots, index).count() == len(docs)
    half = slots.where("slot % 2 = 0")
    assert 0 < exact_dedup.probe(rows, top, half, index).count() < len(docs)


def test_collisions_are_chained_and_bytes_decide(spark):
    rows = [(1, 5, "sa", "aa"), (2, 5, "sb", "bb"), (3, 5, "sa", "aa"), (4, 7, "sc", "cc"), (5, 5, "sb", "bb")]
    made = spark.createDataFrame(rows, "doc_id long, h long, text_sha256 string, t string")
    top, slots, index = exact_dedup.build_index(made, capacity=1)
    assert sorted((r.h, r.chain, r.text_sha256, r.keep_id) for r in index.collect()) == [
        (5, 1, "sa", 3), (5, 2, "sb", 5), (7, 1, "sc", 4)
    ]
    got = exact_dedup.probe(made, top, slots, index).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 3, 2), (2, 5, 2), (3, 3, 2), (4, 4, 1), (5, 5, 2)]


def test_empty_table(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
