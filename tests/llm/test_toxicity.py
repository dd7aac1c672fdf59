import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sonoflock.llm import textbytes, toxicity

BAD = ["stupid", "moron", "worthless", "trash"]


def make(n, seed=1):
    rng = random.Random(seed)
    parts = ["the", "re", "and", "ing", "tion", "sta", "lo", "mer", "wor", "pid"]
    docs, labels = [], []
    for d in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "."]))
        docs.append((d, " ".join(words).capitalize()))
        labels.append((d, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def channel():
    docs, _ = make(500)
    n = np.full(toxicity.SYMBOLS**3, 0.1) + toxicity.count_characters(pa.array([t for _, t in docs]))
    n = n.reshape([toxicity.SYMBOLS] * 3)
    n[0, 0] = n.sum(axis=0)[0]
    return toxicity.Channel(-np.log(n / n.sum(axis=2, keepdims=True)))


def test_viterbi_finds_the_cheapest_path(channel):
    for token, spaced in (("m0r0n", False), ("5t|pid", False), ("moron", True), ("tr*sh", False), ("looo0", False)):
        places = [*channel.lattice(token, spaced), [(" ", 0.0)]]
        best = None
        for path in itertools.product(*places):
            cost, a, b = sum(c for _, c in path), 0, 0
            for z in map(toxicity.char_class, "".join(s for s, _ in path)):
                cost += channel.table[a][b][z]
                a, b = b, z
            best = min(best or (np.inf, ""), (cost, "".join(s for s, _ in path)))
        assert channel.decode(token, spaced) == best[1].strip()


def test_words_are_restored(channel):
    text = "Say w0rthless m.o.r.o.n and s t u p i d trrrash $$$ plain***"
    assert toxicity.restore(text, channel).split()[1:6] == ["worthless", "moron", "and", "stupid", "trash"]
    plain = "the loing merand, tionre\n12 é worpid***"
    (tokens,) = textbytes.pieces(pa.array([plain]), fold=True)
    odd, runs = toxicity.disguised(tokens)
    assert len(odd) == 0 and not runs


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("tra$$h", "trash"), ("m00ron", "moron"), ("m0r00n", "moron"), ("m**on", "moron"), ("tra$#", "trash"), ("tras#", "trash"),
        ("tra-sh", "trash"), ("mo--ron", "moron"), ("m 0 r 0 n", "moron"), ("$ t u p 1 d", "stupid"), ("7 r a 5 h", "trash"),
    ],
)
def test_doubled_final_and_spaced_look_alikes(channel, token, word):
    assert toxicity.restore(f"the {token}, and", channel).split()[1].strip(",") == word


@pytest.mark.parametrize("token", ["l00ser", "tra$$h", "m**on", "scu**", "tras#", "idio+", "sc-um"])
def test_disguises_are_searched(token):
    (tokens,) = textbytes.pieces(pa.array([f"the {token} and, {token}"]), fold=True)
    assert toxicity.disguised(tokens)[0].tolist() == [1, 3]


def test_runs_hold_a_letter():
    (tokens,) = textbytes.pieces(pa.array(["1 2 3 4 the 1 d 1 0 t and", "a b", "c"]), fold=True)
    assert toxicity.disguised(tokens)[1] == [(5, 10)]


def test_held_out_scores(spark):
    docs, labels = make(600)
    probes = [(9000, None), (9001, ""), (9002, "m0r0n and w o r t h l e s s"), (None, "the and"), (9003, "tra5h stup1d " + "the " * 40000)]
    df = spark.createDataFrame([(*d, 7) for d in docs + probes], "doc_id long, text string, toxic int").repartition(3)
    marks = spark.createDataFrame(labels + [(1, None), (None, 1), (99999, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) + len(probes)
    want = dict(labels)
    assert all(r.predicted == want[r.doc_id] for r in got if r.doc_id in want and r.held_out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (9000, 9001, 9002, 9003, None)} == {9000: 0, 9001: 0, 9002: 1, 9003: 1, None: 0}


def test_rare_evidence_counts(spark):
    docs, labels = make(900)
    rare = ["schwachkopf", "ordure", "basura", "vaurien"]
    for d in range(60):  # each word in 15 documents, 12 or so of them for training
        docs.append((2000 + d, f"{docs[d][1]} {rare[d % 4]}"))
        labels.append((2000 + d, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.score(df, toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert sum(r.held_out for r in got if r.doc_id >= 2000) >= 5
    want = dict(labels)
    assert {r.doc_id: r.predicted for r in got if r.held_out} == {r.doc_id: want[r.doc_id] for r in got if r.held_out}


def test_few_rows_are_enough(spark):
    docs, labels = make(40, 3)
    docs, labels = zip(*[(d, m) for d, m in zip(docs, labels, strict=True) if not m[1]], strict=True)
    docs, labels = [*docs, *((100 + d, f"the scum {d}") for d in range(6))], [*labels, *((100 + d, 1) for d in range(6))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.score(df, toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert all(r.predicted == (r.doc_id >= 100) for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [(1, False, 0.0, 0)]
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0
