"""Acquisition scores and the suggestions ranked by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoflock.functions import labels as L
from sonoflock.functions.vectors import clamp, composite, noisy_or, uncertainty
from sonoflock.operators import cells
from sonoflock.operators.search import nearest

WEIGHTS = (0.5, 0.25, 0.25)
NEIGHBOURS = 15


def uncertainty_scores(predictions: DataFrame) -> DataFrame:
    """V4: (snippet_id, uncertainty)."""
    return predictions.select("snippet_id", uncertainty(F.map_values("probs")).alias("uncertainty"))


def diversity_scores(unlabelled: DataFrame, labelled: DataFrame, approximate_from: int | None = None, probes: int = cells.PROBES) -> DataFrame:
    """V5: (snippet_id, nearest, diversity), the distance to the nearest labelled vector and
    the same within 0 to 1; 0 where nothing is labelled. From `approximate_from` labelled vectors
    on (None: never) only the nearest cells of an inverted file are searched: `probes` of them, or more
    where a sample of the unlabelled needs more to find the nearest (see cells.enough_probes)."""
    if approximate_from is not None and len(labelled.select("snippet_id").head(approximate_from)) == approximate_from:
        index = cells.index(labelled)
        near = cells.approximate(unlabelled, index, 1, cells.enough_probes(unlabelled, index, probes))
    else:
        near = nearest(unlabelled, labelled, 1)
    found = near.select(F.col("query_id").alias("snippet_id"), F.col("distance").alias("nearest"))
    whole = unlabelled.select("snippet_id").join(found, "snippet_id", "left")
    return whole.withColumn("diversity", F.coalesce(clamp(F.col("nearest")), F.lit(0.0)))


def density_scores(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """V6: (snippet_id, density): the inverse mean distance of the k nearest others, scaled
    between its 5 and 95 per cent quantiles; 0 for one vector or for equal quantiles."""
    near = nearest(vectors, vectors, k, skip_self=True).groupBy("query_id").agg(F.avg("distance").alias("d"))
    raw = vectors.select("snippet_id").join(near, vectors["snippet_id"] == near["query_id"], "left")
    raw = raw.select("snippet_id", (1 / (F.col("d") + 1e-8)).alias("raw"))
    # the exact quantiles of one number for each vector
    ends = raw.agg(F.expr("percentile(raw, 0.05)").alias("lo"), F.expr("percentile(raw, 0.95)").alias("hi"))
    flat = F.abs(F.col("lo") - F.col("hi")) <= 1e-8 + 1e-5 * F.abs(F.col("hi"))
    scaled = clamp((F.col("raw") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    score = F.when(flat | F.col("raw").isNull(), 0.0).otherwise(scaled)
    return raw.crossJoin(F.broadcast(ends)).select("snippet_id", score.alias("density"))


def inference_rows(predictions: DataFrame, vectors: DataFrame, labelled: DataFrame, threshold: float = 0.3, weights=WEIGHTS) -> DataFrame:
    """M9: labels, confidence and scores of each prediction; scores are NULL where labelled."""
    open_ones = vectors.join(labelled.select("snippet_id").distinct(), "snippet_id", "left_anti")
    known = vectors.join(labelled.select("snippet_id").distinct(), "snippet_id", "left_semi")
    scored = (
        uncertainty_scores(predictions.join(open_ones, "snippet_id", "left_semi"))
        .join(diversity_scores(open_ones, known), "snippet_id")
        .join(density_scores(open_ones), "snippet_id")
        .withColumn("composite", composite(F.col("uncertainty"), F.col("diversity"), F.col("density"), weights))
    )
    named = predictions.select("snippet_id", L.above(F.col("probs"), threshold).alias("labels"))
    return named.join(scored, "snippet_id", "left")


def suggest(scored: DataFrame, labelled: DataFrame, by: str, k: int) -> DataFrame:
    """Unlabelled snippets by a score, NULL last, ties by id."""
    rows = scored.join(labelled.select("snippet_id").distinct(), "snippet_id", "left_anti")
    return rows.select("snippet_id", F.round(by, 6).alias("score")).orderBy(F.desc_nulls_last("score"), "snippet_id").limit(k)


def suggest_confident(predictions: DataFrame, labelled: DataFrame, k: int, scope: list[str] | None = None) -> DataFrame:
    """By the chance that any label of the scope is there."""
    scored = predictions.select("snippet_id", noisy_or(L.in_scope(F.col("probs"), scope)).alias("confidence"))
    return suggest(scored, labelled, "confidence", k)


def shuffled(rows: DataFrame, seed: int, id_col: str = "snippet_id") -> DataFrame:
    """In an order that depends on the seed only, so that pages fit together."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col)


def error_report(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Recall at 1, mean and largest error of nearest distances, over shared queries."""
    a = exact.where("rank = 1").select("query_id", F.col("snippet_id").alias("x"), F.col("distance").alias("dx"))
    b = approximate.where("rank = 1").select("query_id", F.col("snippet_id").alias("y"), F.col("distance").alias("dy"))
    error = F.abs(F.col("dx") - F.col("dy"))
    # an approximate distance can't be below the exact one
    least = F.min(F.col("dy") - F.col("dx"))
    return a.join(b, "query_id").agg(
        F.avg((F.col("x") == F.col("y")).cast("double")).alias("recall_at_1"),
        F.avg(error).alias("mean_error"),
        F.max(error).alias("max_error"),
        least.alias("least_error"),
        F.count(F.lit(1)).alias("n"),
    )
