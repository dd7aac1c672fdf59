import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoflock.llm import runs as R


def brute(w, least_words=6, least_exponent=4):
    """All runs, from the definition."""
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i:
                start, length = i, j - i + p
                part = w[start : start + length]
                if length >= max(least_words, least_exponent * p) and p == next(
                    q for q in range(1, p + 1) if all(part[k] == part[k + q] for k in range(length - q))
                ):
                    out.add((start, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_report(doc_id, text):
    words = (text or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    top = sorted(found, key=lambda x: (-x[1] / x[2], x[0], x[2]))[:1]
    first = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found).encode()
    kept = b" ".join(x for i, x in enumerate(words) if i not in drop)
    return (doc_id, len(found), *first, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(2, 4))
def test_runs_are_those_of_the_definition(w, e):
    assert R.runs(np.array(w, np.int64), 2, e) == brute(w, 2, e)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=6), st.integers(1, 9), st.lists(st.integers(0, 1), max_size=6), st.integers(1, 4))
def test_repeated_pieces(a, k, b, m):
    w = (a * k + b) * m + a * k
    assert R.runs(np.array(w, np.int64), 2, 2) == brute(w, 2, 2)


def strings(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    yield "fibonacci", b[:n]
    yield "thue-morse", [bin(k).count("1") % 2 for k in range(n)]
    yield "one word", [0] * n
    for p in (2, 3, 7, 50, n // 3):
        rng = random.Random(p)
        part = [rng.randrange(3) for _ in range(p)]
        yield f"period {p}", (part * (n // p + 1))[:n]
    for s in (2, 3, 50):
        rng = random.Random(s)
        yield f"random {s}", [rng.randrange(s) for _ in range(n)]
    yield "blocks", [x for k in range(n) for x in [0] * (k % 17) + [1]][:n]
    yield "growing", [x for k in range(n) for x in [0] * k + [1]][:n]
    yield "falling", [n - k for k in range(n)]
    part = [random.Random(5).randrange(2) for _ in range(n // 8)]
    yield "nested", (part * 3 + [2] + part * 3 + [1] + part * 2)[:n]


class Counting(list):
    reads = 0

    def __getitem__(self, k):
        self.reads += 1
        return list.__getitem__(self, k)


def test_reads_of_words_stay_in_proportion_to_the_text():
    n = 3000
    for name, w in strings(n):
        for sign in (1, -1):
            ranks = [sign * x for x in w]
            low = min(ranks)
            c = Counting([x - low + 1 for x in ranks] + [0])
            after, reach = R.next_smaller(c, len(w))
            assert c.reads < 12 * len(w), (name, sign, c.reads / len(w))
    w = next(iter(strings(300)))[1]
    c = [x + 1 for x in w] + [0]
    after, reach = R.next_smaller(c, len(w))
    for i, j in enumerate(after):
        suffix = c[i:-1]
        want = next((k for k in range(i + 1, len(w)) if c[k:-1] < suffix), len(w))
        assert j == want
        k = 0
        while j + k < len(w) and c[i + k] == c[j + k]:
            k += 1
        assert reach[i] == k


def test_report(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "a a a a a a", "a b " * 9, "x " + "la " * 40 + "y", "é ü " * 20 + "é"]
    texts += [" ".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["\x0b\x0ca\x1cb a  c\td\r\n" * 7, " ".join(rng.choices(["the", "of", "and", "to"], k=3000))]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(None, "b b b b b b b", "y", 1), (5, "a b " * 9, "z", 2), (5, "a b " * 9, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, start long").repartition(3)
    got = sorted((tuple(r)[:8] for r in R.report(docs, planted=True).collect()), key=str)
    assert got == sorted((brute_report(d, t) for d, t, _, _ in rows), key=str)
    assert any(r[1] for r in got) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)
    assert R.report(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    words = [str(k % 1000) for k in range(200_000)] + ["end"] + ["a", "b"] * 100_000
    docs = spark.createDataFrame([(3, " ".join(words))], "doc_id long, text string")
    (r,) = R.report(docs).collect()
    assert (r.n_runs, r.start, r.length, r.period, r.n_words) == (2, 200_001, 200_000, 2, 400_001)
    assert r.n_dropped == 199_000 + 199_998


def test_collapse_keeps_other_columns(spark):
    docs = spark.createDataFrame([("a b " * 5 + "c", 1, "q"), ("as  it is", 2, None), (None, 3, "r")], "text string, n_runs int, _k string")
    assert sorted(map(tuple, R.collapse(docs).collect()), key=lambda r: r[1]) == [("a b c", 1, "q"), ("as  it is", 2, None), (None, 3, "r")]
