import random
import re

import pytest

from sonoflock.llm import jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    linked = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append((docs[i][0], min(ids, default=None), len(linked[i])))
    return sorted(out, key=str)


def make(rng, bases, copies, passage):
    docs = []
    for b in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(5, 150))]
        for _ in range(copies if b % 3 == 0 else 1):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            if b % 2:
                words[:0] = passage
            docs.append((len(docs), " ".join(words)))
    return docs


@pytest.mark.parametrize("small,block", [(32, 256), (4, 8)])
def test_finds_the_links_of_brute_force(spark, small, block):
    rng = random.Random(3)
    docs = make(rng, 40, 12, [f"p{i}" for i in range(25)])
    docs += [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a c"), (None, "a b"), (905, "  \n"), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string").repartition(3)
    got = jaccard.groups(df, small=small, block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(docs)


def test_empty_table(spark):
    assert jaccard.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_follow_the_recall():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.999) <= 8
