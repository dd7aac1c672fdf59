"""Counts, summaries and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoflock.functions.numbers import round_half_even


def annotation_stats(datasets: DataFrame, recordings: DataFrame, snippets: DataFrame, annotations: DataFrame) -> DataFrame:
    """A1: for each dataset snippets, annotated ones, annotations and the share annotated. Each
    side is summed up before it is joined."""
    per_snippet = annotations.groupBy("snippet_id").agg(F.count(F.lit(1)).alias("n"))
    of = snippets.join(per_snippet, snippets["id"] == F.col("snippet_id"), "left").groupBy("recording_id")
    per_recording = of.agg(F.count(F.lit(1)).alias("total"), F.count("n").alias("annotated"), F.sum("n").alias("n"))
    joined = recordings.join(per_recording, recordings["id"] == F.col("recording_id")).groupBy("dataset_id")
    sums = joined.agg(*[F.sum(c).alias(c) for c in ("total", "annotated", "n")])
    whole = datasets.select(F.col("id").alias("dataset_id")).join(sums, "dataset_id", "left").na.fill(0, ["total", "annotated", "n"])
    pct = F.when(F.col("total") > 0, round_half_even(F.col("annotated") / F.col("total") * 100, 2)).otherwise(0.0)
    return whole.select(
        "dataset_id",
        F.col("total").alias("total_snippets"),
        F.col("annotated").alias("annotated_snippets"),
        F.col("n").alias("total_annotations"),
        (F.col("total") - F.col("annotated")).alias("not_annotated"),
        pct.alias("pct"),
    )


def set_stats(snippets: DataFrame, annotations: DataFrame) -> DataFrame:
    """A2: the same for snippet sets."""
    per_snippet = annotations.groupBy("snippet_id").agg(F.count(F.lit(1)).alias("n"))
    joined = snippets.join(per_snippet, snippets["id"] == F.col("snippet_id"), "left").groupBy("snippet_set_id")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("annotation_count"),
        F.count("n").alias("annotated_snippets"),
        F.count(F.lit(1)).alias("total_snippets"),
    ).withColumn("has_annotations", F.col("annotation_count") > 0)


def recordings_per_dataset(datasets: DataFrame, recordings: DataFrame) -> DataFrame:
    """A3: 0 where a dataset has none."""
    n = recordings.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_recordings"))
    return datasets.select(F.col("id").alias("dataset_id")).join(n, "dataset_id", "left").na.fill(0, ["n_recordings"])


def histogram_bin(x: Column, bins: int = 10) -> Column:
    """The bin of [0, 1] that a value is in: its edges are k / bins in binary, the last one is
    closed; NULL outside."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: k * F.lit(1.0 / bins))
    n = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return F.when(x.between(0.0, 1.0), F.least(n, F.lit(bins - 1)))


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of the values within [0, 1]; no values, no bins."""
    counts = rows.select(histogram_bin(F.col(column), bins).alias("bin")).where("bin is not null")
    counts = counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    some = F.broadcast(counts.agg((F.count(F.lit(1)) > 0).alias("some")))
    whole = all_bins.join(counts, "bin", "left").na.fill(0, ["n"]).crossJoin(some).where("some")
    return whole.select("bin", F.round(F.col("bin") / bins, 4).alias("low"), F.round((F.col("bin") + 1) / bins, 4).alias("high"), "n")


def mil_pool(rows: DataFrame, bag: str, p: str) -> DataFrame:
    """Probabilities of instances pooled for each bag, and the logit of each pooling."""
    x = F.col(p)
    pooled = rows.groupBy(bag).agg(
        F.max(x).alias("p_max"),
        F.avg(x).alias("p_avg"),
        (F.sum(x * F.exp(x)) / F.sum(F.exp(x))).alias("p_exp"),
        (F.sum(x * x) / (F.sum(x) + 1e-8)).alias("p_lin"),
    )
    for c in ("max", "avg", "exp", "lin"):
        q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(f"p_{c}")))
        pooled = pooled.withColumn(f"logit_{c}", F.ln(q / (1 - q)))
    return pooled


def job_rollup(chunks: DataFrame) -> DataFrame:
    """The outcome of a job from those of its chunks."""
    failed = F.sum(F.when(F.col("status") != "success", 1).otherwise(0))
    out = chunks.groupBy("job_id").agg(failed.alias("failed"))
    bad = F.col("failed") > 0
    return out.select(
        "job_id",
        F.when(bad, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(bad, "FAILED").otherwise("READY").alias("set_status"),
        F.when(bad, F.concat(F.col("failed").cast("string"), F.lit(" snippet failures"))).alias("message"),
    )


def timings(runs: DataFrame) -> DataFrame:
    """Mean, sample deviation and throughput of repeated timings."""
    return runs.groupBy("stage").agg(
        F.avg("seconds").alias("mean_s"), F.stddev_samp("seconds").alias("stdev_s"), (F.max("n") / F.avg("seconds")).alias("per_s")
    )


def focal_count(datasets: DataFrame) -> DataFrame:
    """A22"""
    return datasets.where("dataset_type = 'FOCAL_RECORDINGS'").agg(F.count(F.lit(1)).alias("n_focal"))


def focal_access(users: DataFrame, datasets: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """For each user (user_id, is_admin) how many focal datasets they can read, by a team or a
    grant, each once, and whether they may work on them: admins may without any."""
    focal = datasets.where("dataset_type = 'FOCAL_RECORDINGS'").select(F.col("id").alias("dataset_id"), "team_id")
    # each membership and grant once, of the users asked for: else repeats would meet every dataset of a team
    asked = users.select("user_id").distinct()
    teams = members.select("user_id", "team_id").distinct().join(asked, "user_id", "left_semi")
    given = grants.select("user_id", "dataset_id").distinct().join(asked, "user_id", "left_semi")
    mine = teams.join(focal, "team_id").select("user_id", "dataset_id").unionByName(given.join(focal, "dataset_id", "left_semi").select("user_id", "dataset_id"))
    counts = mine.distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("_mine"))
    all_focal = focal.agg(F.count(F.lit(1)).alias("_all"))
    out = users.join(counts, "user_id", "left").crossJoin(F.broadcast(all_focal))
    n = F.when(F.col("is_admin"), F.col("_all")).otherwise(F.coalesce("_mine", F.lit(0)))
    return out.select("user_id", n.alias("n_focal"), (F.col("is_admin") | (n > 0)).alias("enabled"))


def scalar_counts(**rows: DataFrame) -> DataFrame:
    """A4: how many rows each of some tables has, by name."""
    counted = [frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, frame in rows.items()]
    return reduce(DataFrame.unionByName, counted)


def fingerprint(vectors: DataFrame) -> DataFrame:
    """What tells whether a cached copy is still good."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max("snippet_id"), F.lit(0)).alias("max_id"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"),
    )
