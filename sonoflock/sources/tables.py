"""Ground truth and label files in; annotations, models and measurements out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoflock.functions import text as T

TRUE = ("1", "true", "yes")
FILE_COLUMNS = ("file_name", "recording_file", "recording_name", "file_path", "fname", "sample_name")
DELIMITERS = (",", ";", "\t")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; the delimiter is what the header has most of."""
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("﻿")
    best = max(DELIMITERS, key=line.count)
    rows = spark.read.csv(path, header=True, sep=best if line.count(best) else ",", encoding="UTF-8")
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])


def ground_truth(rows: DataFrame, species: list[str], subsets: list[str] | None = None) -> DataFrame:
    """(key, labels), one row for each event, from a table with a column for each species, or
    one named species or label. Rows without a file name are left out; those without a label of
    `species` have an empty list, as negatives."""
    if subsets and "subset" in rows.columns:
        rows = rows.where(F.lower("subset").isin(*[s.lower() for s in subsets]))
    key: Column
    if {"fname", "min_t", "max_t"} <= set(rows.columns):
        times = [T.plain_number(F.col(c).cast("double")) for c in ("min_t", "max_t")]
        rows = rows.where(F.trim("fname") != "")
        key = F.concat_ws("_", F.trim("fname"), times[0], F.concat(times[1], F.lit(".wav")))
    else:
        key = F.trim(F.col(next(c for c in FILE_COLUMNS if c in rows.columns)))
    there = [s for s in species if s in rows.columns]
    if there:
        labels = F.filter(
            F.array(*[F.when(F.lower(F.trim(F.col(f"`{s}`").cast("string"))).isin(*TRUE), F.lit(s)) for s in there]), lambda x: x.isNotNull()
        )
    else:
        named = next((c for c in ("species", "label") if c in rows.columns), None)
        if named is None:
            raise ValueError("there must be a column for each species, or one named species or label")
        labels = F.filter(F.array(F.trim(named)), lambda x: x.isin(*species))
    return rows.select(key.alias("key"), labels.alias("labels")).where("key != ''")


def codes(rows: DataFrame, column: str = "Code", ignore: str = "IGNORE") -> DataFrame:
    """The labels of a dataset's metadata."""
    code = F.trim(F.col(column))
    return rows.select(code.alias("label")).where((F.col("label") != "") & (F.col("label") != ignore)).distinct().orderBy("label")


def species_of_config(spark: SparkSession, path: str) -> list[str]:
    """The labels of a model's label file."""
    rows = spark.read.schema("species_list array<string>, labels array<string>").json(path, multiLine=True)
    found = rows.select(F.coalesce("species_list", "labels").alias("x")).first()
    if not found or not found.x:
        raise ValueError(f"no labels in {path}")
    return list(found.x)


def annotation_export(annotations: DataFrame, snippets: DataFrame, recordings: DataFrame, taxon_id: str | None = None, user_id: int | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Annotations with where they are, in 13 columns; bounds of time are inclusive."""
    rows = annotations
    rows = rows if taxon_id is None else rows.where(F.col("taxon_id") == taxon_id)
    rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
    rows = rows if after is None else rows.where(F.col("created_at") >= F.lit(after).cast("timestamp"))
    rows = rows if before is None else rows.where(F.col("created_at") <= F.lit(before).cast("timestamp"))
    placed = rows.join(snippets.select(F.col("id").alias("snippet_id"), "recording_id", "start_time", "end_time"), "snippet_id")
    where = recordings.select(F.col("id").alias("recording_id"), F.col("file_path").alias("recording_file_path"), "dataset_id")
    whole = placed.join(where, "recording_id")
    return whole.select(
        F.col("id").alias("annotation_id"), "snippet_id", "recording_id", "dataset_id", "recording_file_path", "start_time", "end_time",
        (F.col("end_time") - F.col("start_time")).alias("snippet_duration"), "taxon_id", "resolved_name_snapshot", "user_id", "confidence",
        T.iso(F.col("created_at")).alias("created_at"),
    )


def write_export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    if kind == "csv":
        rows.write.csv(path, header=True)
    elif kind == "json":
        rows.write.json(path)
    else:
        raise ValueError(f"no such format: {kind}")


def append_measurements(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Measurements added to a folder of CSV files. The first ones settle the columns; later
    ones have these columns, others are left out and missing ones empty. Each file has its header,
    so that any number of tasks can add files."""
    spark = rows.sparkSession
    try:
        columns = spark.read.csv(path, header=True).columns or columns
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    known = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*known).write.mode("append").csv(path, header=True)


def save_model(spark: SparkSession, model, path: str) -> None:
    """A model as one Parquet row: its labels in order and its parts as arrays."""
    parts = {k: v for k, v in vars(model).items() if hasattr(v, "shape")}
    row = [(model.labels, {k: [float(x) for x in v.ravel()] for k, v in parts.items()}, {k: list(v.shape) for k, v in parts.items()})]
    spark.createDataFrame(row, "labels array<string>, parts map<string,array<double>>, shapes map<string,array<int>>").write.parquet(path)


def load_model(spark: SparkSession, kind: type, path: str):
    import numpy as np

    r = spark.read.parquet(path).first()
    return kind(labels=list(r.labels), losses=[], **{k: np.array(v).reshape(r.shapes[k]) for k, v in r.parts.items()})
