"""Filtered and paginated listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.functions import text as T

SOURCES = ("ground_truth", "user")


def page(rows: DataFrame, order: list, skip: int = 0, limit: int = 100, most: int = 1000) -> DataFrame:
    """A page of a totally ordered listing."""
    if skip < 0 or not 1 <= limit <= most:
        raise ValueError(f"skip must not be negative, limit be within 1 and {most}")
    return rows.orderBy(*order).offset(skip).limit(limit)


def list_snippets(snippets: DataFrame, recordings: DataFrame, dataset_id: int, set_id: int | None = None, recording_id: int | None = None) -> DataFrame:
    """P1"""
    rows = snippets if set_id is None else snippets.where(F.col("snippet_set_id") == set_id)
    rows = rows if recording_id is None else rows.where(F.col("recording_id") == recording_id)
    mine = recordings.where(F.col("dataset_id") == dataset_id).select(F.col("id").alias("r"))
    return rows.join(mine, rows["recording_id"] == F.col("r"), "left_semi")


def annotated(snippets: DataFrame, labels: DataFrame, status: str = "any") -> DataFrame:
    """Snippets with, without, or regardless of labels of a trusted source."""
    if status not in ("any", "annotated", "unannotated"):
        raise ValueError(f"no such annotation status: {status}")
    if status == "any":
        return snippets
    trusted = labels.where(F.col("source").isin(*SOURCES)).select(F.col("snippet_id").alias("s"))
    return snippets.join(trusted, snippets["id"] == F.col("s"), "left_semi" if status == "annotated" else "left_anti")


def with_location(recordings: DataFrame, noted: str = "noted") -> DataFrame:
    return recordings.withColumn("location", T.location(F.col(noted), F.col("file_name")))


def at_locations(recordings: DataFrame, wanted: str) -> DataFrame:
    """Recordings of a comma list of locations."""
    names = [x.strip() for x in wanted.split(",") if x.strip()]
    return with_location(recordings).where(F.col("location").isin(*names)) if names else with_location(recordings)


def locations(recordings: DataFrame) -> DataFrame:
    """P6"""
    return with_location(recordings).select("location").where(F.col("location") != "").distinct().orderBy("location")


def of_species(snippets: DataFrame, labels: DataFrame, wanted: list[str]) -> DataFrame:
    """P5: snippets that have any of some labels from a trusted source."""
    hit = labels.where(F.col("label").isin(*wanted) & F.col("source").isin(*SOURCES)).select(F.col("snippet_id").alias("s"))
    return snippets.join(hit, snippets["id"] == F.col("s"), "left_semi")


def read_annotations(annotations: DataFrame, ids: str | None = None, snippet_id: int | None = None, user_id: int | None = None, taxon_id: str | None = None, limit: int = 100) -> DataFrame:
    """A list of ids (numbers only, the first 400) goes before a single id and allows 2000
    rows instead of 500."""
    listed = [int(x) for x in (ids or "").split(",") if x.strip().isdigit()][:400]
    rows = annotations
    if listed:
        rows = rows.where(F.col("snippet_id").isin(*listed))
    elif snippet_id is not None:
        rows = rows.where(F.col("snippet_id") == snippet_id)
    rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
    rows = rows if taxon_id is None else rows.where(F.col("taxon_id") == taxon_id)
    return rows.orderBy("snippet_id", "taxon_id", "user_id").limit(min(limit, 2000 if listed else 500))


def visible(value: Column, low: float | None, high: float | None) -> Column:
    """Within a closed range; no bounds let all pass, no value passes no bounds."""
    if low is None or high is None:
        return F.lit(True)
    return F.coalesce(value.between(low, high), F.lit(False))


def coloured(rows: DataFrame, by: str) -> DataFrame:
    """The value that a point is coloured by, and whether it is a category or a number."""
    if by == "predicted_label":
        return rows.withColumn("colour", F.get("labels", F.lit(0))).withColumn("mode", F.lit("categorical"))
    if by in ("uncertainty", "diversity", "density", "composite"):
        return rows.withColumn("colour", F.col(by).cast("string")).withColumn("mode", F.lit("continuous"))
    return rows.withColumn("colour", F.lit(None).cast("string")).withColumn("mode", F.lit(None).cast("string"))


def last_feeds(feeds: DataFrame, most: int = 5) -> DataFrame:
    """The latest feeds of each user and method, which are kept."""
    latest = Window.partitionBy("user_id", "method").orderBy(F.desc("created_at"), F.desc("id"))
    return feeds.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= most)


def history(feeds: DataFrame, user_id: int, dataset_id: int | None = None, most: int = 5) -> DataFrame:
    """A user's latest of each method, newest first; the dataset is looked at last."""
    rows = last_feeds(feeds.where(F.col("user_id") == user_id), most)
    rows = rows if dataset_id is None else rows.where(F.col("dataset_id") == dataset_id)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def in_order(ranked: DataFrame, rows: DataFrame, key: str = "snippet_id") -> DataFrame:
    """Rows of a ranking, in its order."""
    return ranked.join(rows, key).orderBy("rank")


def access(datasets: DataFrame, user_id: int, is_admin: bool, members: DataFrame, grants: DataFrame) -> DataFrame:
    """J9, SET1: all for admins, else those of the user's teams and those granted."""
    if is_admin:
        return datasets
    teams = members.where(F.col("user_id") == user_id).select(F.col("team_id").alias("t"))
    given = grants.where(F.col("user_id") == user_id).select(F.col("dataset_id").alias("d"))
    of_team = datasets.join(teams, datasets["team_id"] == F.col("t"), "left_semi")
    granted = datasets.join(given, datasets["id"] == F.col("d"), "left_semi")
    return of_team.unionByName(granted).dropDuplicates(["id"])


def relevance(rows: DataFrame, query: str) -> DataFrame:
    """Names that begin with the query, then those that hold it, then the rest."""
    name = F.coalesce(F.nullif(F.col("canonical_name"), F.lit("")), F.nullif(F.col("scientific_name"), F.lit("")), F.lit(""))
    low, q = F.lower(name), query.lower()
    tier = F.when(low.startswith(q), 0).when(F.contains(low, F.lit(q)), 1).otherwise(2)
    return rows.withColumn("tier", tier).orderBy("tier", low, "id")
