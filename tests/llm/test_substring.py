import hashlib
import random
import re

import pytest

from sonoflock.llm import substring
from tests.llm.test_textbytes import thue_morse


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, width=13):
    first = {}
    for d, t in docs:
        w = words_of(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in docs:
        w, gone = words_of(t), set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_words,shard_bytes", [(10**6, 10**7), (300, 3000)])
def test_matches_brute_force(spark, batch_words, shard_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice([f"w{rng.randrange(300)}", "é", "A", "a\xa0b"])
    passages = [[word() for _ in range(rng.choice([5, 12, 13, 14, 40]))] for _ in range(12)]
    docs = []
    for d in rng.sample(range(1000), 150):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice([rng.choice(passages), [word() for _ in range(rng.randint(1, 30))]])
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(text)))
    docs += [(2000, docs[3][1]), (2001, docs[3][1]), (2001, docs[3][1]), (2002, None), (2003, ""), (None, docs[3][1])]
    tm = thue_morse(1024)
    docs += [(2007, f"{tm[0]} " + "q " * 12), (2008, f"{tm[1]} " + "q " * 12), (2009, f"{tm[1]} " + "q " * 12)]
    docs += [(2004, "x " * 60), (2005, "x " * 13), (2006, " ".join(passages[4] * 3)), (-5, " ".join(passages[4]))]
    df = spark.createDataFrame([(*x, "o") for x in docs], "doc_id long, text string, o string").repartition(3)
    got = substring.report(df, batch_words=batch_words, shard_bytes=shard_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert substring.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
