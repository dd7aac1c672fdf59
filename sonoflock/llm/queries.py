"""The queries of this subpackage, op1 to op13, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoflock.llm import (
    binpack,
    decontam,
    divergence,
    exact_dedup,
    hpylm,
    html_text,
    jaccard,
    langid,
    mixing,
    runs,
    substring,
    token_files,
    toxicity,
)
from sonoflock.llm.common import LOWER, UPPER, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.roundtrip(table(spark, sf_dir, "documents"), token_files.default_tokenizer())


def op3_hpy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"), planted=True)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_texts(table(spark, sf_dir, "documents"), binpack.default_tokenizer())


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_files": op2_token_files,
    "op3_hpy_score": op3_hpy_score,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_source_mix": op9_source_mix,
    "op10_main_text": op10_main_text,
    "op11_word_runs": op11_word_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_packed_sequences": op13_packed_sequences,
}

ORACLE_SQL = {
    "op1_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM t JOIN g USING (t)""",
    "op9_source_mix": f"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size::DOUBLE AS lim,
         sum(source_size) OVER ()::DOUBLE AS total FROM s),
v AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM l),
x AS (
  SELECT source, source_size,
         least(lim, coalesce(w * (SELECT arg_min(level, lim / w) FROM v v2 WHERE v2.level * v2.w <= v2.lim), lim)) AS target
  FROM v),
r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST)::DOUBLE AS i FROM d),
y AS (
  SELECT r.doc_id, r.size, x.source_size, x.target, r.i,
         CASE WHEN x.source_size > 0 THEN x.target / x.source_size ELSE 0 END AS rate
  FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target,
       size * least((floor(i * rate + {mixing.offset(9)}) - floor((i - 1) * rate + {mixing.offset(9)}))::BIGINT, 3) AS taken
FROM y""",
    "op12_source_divergence": divergence.SQL.replace("{0}", UPPER).replace("{1}", LOWER),
}
