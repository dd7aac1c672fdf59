import random
from collections import Counter

import pytest

import corpus_pipeline
from sonoflock.llm.common import materialise
from tests.llm.test_jaccard import shingles
from tests.llm.test_token_files import plain


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("sf"))
    parts = {"aa": ["tha", "ing", "er", "an"], "bb": ["eau", "ré", "eux", "la"]}
    text = lambda x, n: " ".join("".join(rng.choices(parts[x], k=rng.randint(1, 4))) for _ in range(n))
    item = text("aa", 20)
    rows = []
    for d in range(300):
        lang = rng.choice(["aa", "bb"])
        t = text(lang, rng.randint(20, 60))
        rows.append((d, f"{t}\n{item}. {t[:40]}" if d % 30 == 7 else t, lang, f"s{d % 4}" if d % 9 else None))
    rows += [(400 + k, rows[k][1] + " eau", rows[k][2], "s0") for k in range(0, 40, 5)]
    rows += [(500, "12 34 !!", "aa", "s1"), (501, None, "bb", "s1"), (502, item, "aa", "s2")]
    docs = [(d, t, x, s, len(t or ""), 1) for d, t, x, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def test_stages(spark, sf_dir):
    path, rows, item = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, path), name)
        assert name == "write_tokens" or docs.columns == columns
        seen.append(docs.collect())
    ids = [[r.doc_id for r in s] for s in seen]
    assert sorted(ids[0]) == sorted(d for d, *_ in rows if d not in (500, 501))
    texts = {r.doc_id: r.text for r in seen[0]}
    gone = set(ids[0]) - set(ids[1])
    sets = {d: shingles(t) for d, t in texts.items()}
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert gone == {d for d in sets if any(e < d and close(d, e) for e in sets)} and len(gone) >= 8
    assert set(ids[1]) - set(ids[2]) <= {502} and 502 not in ids[2]
    before = {r.doc_id: r.text for r in seen[1]}
    for r in seen[2]:
        assert item not in r.text and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or item in before[r.doc_id]
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 3
    total = sum(len(r.text.split()) for r in seen[2])
    assert abs(sum(len(r.text.split()) for r in seen[3]) - total) < 0.1 * total
    final = {r.doc_id: r.text for r in seen[3]}
    assert Counter((r.doc_id, r.n_tokens) for r in seen[4]) == Counter((d, len(plain(final[d]))) for d in ids[3])
    assert all(set(r.asDict().items()) for r in seen[3])


def test_empty_documents(spark, sf_dir, tmp_path):
    path, *_ = sf_dir
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
