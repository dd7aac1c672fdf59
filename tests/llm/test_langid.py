import random
import zlib

import numpy as np
import pyarrow as pa

from sonoflock.llm import langid


def make(n, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["tha", "ing", "er", "an"], "bb": ["eau", "ré", "eux", "la"], "cc": ["ción", "os", "ña", "el"]}
    docs = []
    for d in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40))]
        docs.append((d, " ".join(words).capitalize() + rng.choice([".", "!", " 12"]), lang))
    return docs


def test_held_out_accuracy_and_defined_cases(spark):
    docs = make(400) + [(9000, None, "aa"), (9001, "", "bb"), (9002, "12 !? 3", "cc"), (None, "eau eau ré", None), (9003, "eau la", None)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, lang string, score double").repartition(3)
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(docs)
    want = {d: (t, x) for d, t, x in docs}
    held = [r for r in got if r.held_out and want[r.doc_id][1] and r.doc_id < 9000]
    assert len(held) > 50 and np.mean([r.lang_pred == want[r.doc_id][1] for r in held]) > 0.98
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (9000, 9001, 9002)} == dict.fromkeys((9000, 9001, 9002), ("und", 0.0))
    assert [r.lang_pred for r in got if r.doc_id is None] == ["bb"]
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep(df, model).collect()
    assert len(kept) == len(docs) - 3 and kept[0].asDict().keys() == {"doc_id", "text", "lang", "score"}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.predict(df, langid.fit(df)).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0), langid.fit(df.limit(0))).count() == 0


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["abc dé", "", "İx straße", "z", "12 a"]
    ids, starts = langid.grams(texts)
    for k, t in enumerate(texts):
        assert sorted(ids[starts[k] : starts[k + 1]]) == sorted(langid.grams([t])[0])


def test_sparse_weights_and_calibration():
    rng = np.random.default_rng(1)
    rows = [(k % 2, np.array([k % 2, 10 + int(rng.integers(500))]), np.array([1.0, 0.05])) for k in range(400)]
    w, _ = langid.ftrl(rows, 2)
    assert (w != 0).mean() < 0.02 and w[0, 0] > 0 > w[0, 1]
    z = rng.normal(size=(3000, 2))
    y = (rng.random(3000) > langid.softmax(z / 0.5)[:, 0]).astype(int)
    assert abs(langid.temperature(z, y) - 0.5) < 0.1


def test_prediction_of_a_column():
    model = langid.Model([], np.zeros((langid.FEATURES, 0)), np.zeros(0), 1.0)
    assert model.predict(pa.array([None, "a"]))[0] == ["und", "und"]
