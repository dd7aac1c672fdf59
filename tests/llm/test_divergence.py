import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sonoflock.llm import divergence as D
from sonoflock.llm import queries
from tests.conftest import SF

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least_docs, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(low))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least_docs}
        sources = [s for l, s in groups if l == lang]
        count = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def shares(c, v=len(kept)):
            n = sum(c.values())
            return {t: 1 + 10**9 * (k + 2) // (n + 2 * v) for t, k in c.items()}

        p, q = {s: shares(count[s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found[:most])]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = [*"abcdefghijklmnop", "Été", "éte", "日本", "the", "The", "x" * 50 + "a", "x" * 50 + "b", "x" * 50]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "hot", "hot", "hot", None])
        text = " ".join(rng.choices(words, k=rng.randint(0, 25)))
        rows.append((rng.choice([text, text, text.replace(" ", "1"), None]), lang, source))
    rows += [("", "de", "only"), (None, "it", "p"), ("rare words", "it", "q"), (" ".join(words) * 3000, "en", "long")] + [rows[0]] * 5
    docs = spark.createDataFrame([(*r, "t", 1, "i") for r in rows], "text string, lang string, source string, term string, n int, item string").repartition(4)
    for least in (1, 3, 10):
        got = sorted(map(tuple, D.audit(docs, least_docs=least).collect()))
        assert got == brute(rows, least)
    assert D.audit(docs.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    got = sorted(map(tuple, queries.op12_source_divergence(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op12_source_divergence"])
    names = [x[0] for x in cur.description]
    assert names == ["lang", "source", "part", "item", "value", "rank"]
    assert got == sorted(cur.fetchall())
    assert len(got) > 100


@pytest.mark.parametrize("step", [1, 4])
def test_radix_selection_with_ties(spark, step):
    rng = random.Random(2)
    rows = [("l", s, f"{'p' * rng.choice([0, 3, 9])}{k}é" + "z" * (k % 3), rng.choice([0, 7, 7, 7, 70000, 1 << 31])) for s in "abc" for k in range(80 if s != "c" else 4)]
    rows += [("m", "s", "q" * k, 5) for k in range(1, 40)]
    scored = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    got = sorted(map(tuple, D.first_ranks(scored, 10, step=step).collect()))
    want = []
    for g in {r[:2] for r in rows}:
        mine = sorted((r for r in rows if r[:2] == g), key=lambda r: (-r[3], r[2].encode()))[:10]
        want += [(*r, k + 1) for k, r in enumerate(mine)]
    assert got == sorted(want)
