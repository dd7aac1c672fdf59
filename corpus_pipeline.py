"""The corpus pipeline: from documents to files of token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage
returns as Parquet in the shared folder and reads it back as the next one's docs. All stages
but the last return the columns of documents. Rows that share a doc_id count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoflock.llm import decontam, jaccard, langid, mixing, token_files
from sonoflock.llm.common import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that is at all likely, go."""
    return langid.keep(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of five-word runs of 0.8 or
    more the one with the smallest id stays."""
    groups = jaccard.groups(docs)
    drop = materialise(groups.where("doc_id != class_id").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    return docs.join(drop, docs["doc_id"] == drop["_dropped"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that is mostly such passages goes."""
    clean = decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).where("copies > 0")
    taken = materialise(
        taken.select(F.col("doc_id").alias("_taken_id"), F.col("source").alias("_taken_source"), "copies"), "taken"
    ).withColumnRenamed("copies", "_taken_copies")
    met = docs["doc_id"].eqNullSafe(taken["_taken_id"]) & docs["source"].eqNullSafe(taken["_taken_source"])
    # one row for each document: as large as the corpus, so never broadcast
    return docs.join(taken.hint("merge"), met).select(
        *[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_taken_copies"))).alias("_copy")
    ).drop("_copy")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and what the files hold of each document."""
    return token_files.roundtrip(docs, token_files.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("write_tokens", write_tokens),
]

#: Language ID, chosen paths and token ids have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
