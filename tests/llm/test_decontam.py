import hashlib
import random
import re

from sonoflock.llm import decontam
from tests.llm.test_textbytes import thue_morse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        words, hit, found = words_of(text), set(), set()
        for name, t in items:
            w = words_of(t)
            size = min(window, len(w))
            grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(words) - size + 1 if w else 0):
                if tuple(words[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(None if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["a", "B", "c", "é", "d1"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 6, 9, 10, 14, 25]))) for k in range(8, 13)] + [(1, ""), (2, None), (3, "?!")]
    items += [(None, "c B c"), (None, "d1 d1 a"), (8, "c é c")]
    docs = [(k, text(rng.randint(0, 80))) for k in range(120)] + [(500, None), (501, ""), (502, "Éa " * 3000)]
    docs += [(k + 600, f"xx {items[k][1].upper()} yy" if items[k][1] else "z") for k in range(8)]
    got = decontam.report(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    blocked = decontam.report(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        block_words=12,
        held_bytes=2000,
    )
    assert sorted(map(tuple, blocked.collect()), key=str) == brute(docs, items)


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in decontam.report(docs, none).collect()] == [(None, 3, 0, 0)]
    assert decontam.report(docs.limit(0), none).count() == 0


def test_words_that_a_polynomial_hash_takes_for_equal(spark):
    a, b = thue_morse(1024)
    docs = [(1, f"{a} {b}"), (2, f"{b} {a}"), (3, a)]
    items = [(1, a), (2, f"{b} x"), (3, f"{b} {a}")]
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_spans_are_cut_out_of_texts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rest = " ".join(f"k{i}" for i in range(30))
    rows = [(1, f"Say: {item.upper()}, {rest}", "x"), (2, rest, None), (3, item, "x"), (4, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for block_words in (1000, 5):
        got = {r.doc_id: r.text for r in decontam.remove_spans(docs, items, block_words=block_words).collect()}
        assert got == {1: f"Say: , {rest}", 2: rest, 4: None}
