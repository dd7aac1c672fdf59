"""From the log of feedback to the state of labels, and the gate for retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETRAIN_TRIGGERS = ("manual", "auto_feedback")


def label_union(labels: DataFrame) -> DataFrame:
    """Each snippet's labels of all rows, sorted; a row without a label counts for the
    snippet but not for its labels."""
    return labels.groupBy("snippet_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def label_detail(labels: DataFrame, users: DataFrame) -> DataFrame:
    """Labels with who set them, in order of label, source and user."""
    named = labels.dropDuplicates(["snippet_id", "label", "source", "user_id"]).join(users, "user_id", "left")
    who = F.when(F.col("source") == "ground_truth", "Ground truth").otherwise(F.coalesce("username", F.lit("Unknown")))
    entry = F.struct("label", "source", F.coalesce("user_id", F.lit(0)).alias("user"), who.alias("labeled_by"))
    return named.groupBy("snippet_id").agg(F.array_sort(F.collect_list(entry)).alias("detail"))


def last_writes(feedback: DataFrame) -> DataFrame:
    """The latest labels of each user for each snippet. Only ACCEPT and MODIFY with labels
    compete: a later REJECT doesn't cancel them."""
    competing = feedback.where("action in ('ACCEPT', 'MODIFY') and label is not null")
    latest = Window.partitionBy("snippet_id", "user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return competing.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")


def replace_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """users' labels of the snippets that they wrote about anew are replaced."""
    mine = new.select("snippet_id", "user_id").distinct()
    others = labels.where("source != 'user' or user_id is null")
    kept = labels.where("source = 'user' and user_id is not null").join(mine, ["snippet_id", "user_id"], "left_anti")
    added = new.select("snippet_id", "label", F.lit("user").alias("source"), "user_id")
    return others.unionByName(kept.select(*others.columns)).unionByName(added)


def feedback_counts(feedback: DataFrame, jobs: DataFrame) -> DataFrame:
    """A5: for each checkpoint the snippets with feedback since its last completed retrain.
    Feedback without a checkpoint is counted by bootstrap_counts."""
    feedback = feedback.where("model_checkpoint_id is not null")
    done = jobs.where((F.col("status") == "COMPLETED") & F.col("trigger").isin(*RETRAIN_TRIGGERS))
    cutoff = done.groupBy("model_checkpoint_id").agg(F.max("completed_at").alias("cutoff"))
    open_ones = feedback.join(cutoff, "model_checkpoint_id", "left").where("cutoff is null or created_at > cutoff")
    return open_ones.groupBy("model_checkpoint_id").agg(F.countDistinct("snippet_id").alias("n_snippets"))


def events_since_retrain(feedback: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each checkpoint how many events, of every action, have come since its last completed
    retrain; NULL is the checkpoint of feedback from before there was one."""
    done = jobs.where((F.col("status") == "COMPLETED") & F.col("trigger").isin(*RETRAIN_TRIGGERS))
    cutoff = done.groupBy(F.col("model_checkpoint_id").alias("_of")).agg(F.max("completed_at").alias("cutoff"))
    met = feedback["model_checkpoint_id"].eqNullSafe(cutoff["_of"])
    open_ones = feedback.join(cutoff, met, "left").where("cutoff is null or created_at > cutoff")
    return open_ones.groupBy("model_checkpoint_id").agg(F.count(F.lit(1)).alias("n_events"))


def bootstrap_counts(feedback: DataFrame, jobs: DataFrame, threshold: int = 100) -> DataFrame:
    """For each dataset the snippets with feedback from before it had a checkpoint, since
    the last retrain without one, and whether a first model is to be trained."""
    done = jobs.where((F.col("status") == "COMPLETED") & F.col("trigger").isin(*RETRAIN_TRIGGERS) & F.col("model_checkpoint_id").isNull())
    cutoff = done.groupBy("dataset_id").agg(F.max("completed_at").alias("cutoff"))
    open_ones = feedback.where("model_checkpoint_id is null").join(cutoff, "dataset_id", "left").where("cutoff is null or created_at > cutoff")
    counts = open_ones.groupBy("dataset_id").agg(F.countDistinct("snippet_id").alias("n_snippets"))
    return counts.withColumn("train", F.col("n_snippets") >= threshold)


def retrain_gate(counts: DataFrame, jobs: DataFrame, threshold: int = 100) -> DataFrame:
    """ST1, W5: which checkpoints are to be retrained: enough feedback and no child retrain that
    waits, runs or was the last to fail; the count reads 0 while a child waits or runs."""
    children = jobs.where(F.col("trigger").isin(*RETRAIN_TRIGGERS)).groupBy("model_checkpoint_id").agg(
        F.max(F.col("status").isin("PENDING", "RUNNING")).alias("busy"),
        (F.max_by("status", F.struct("created_at", "id")) == "FAILED").alias("failed"),
    )
    whole = counts.join(children, "model_checkpoint_id", "left").na.fill(False, ["busy", "failed"])
    return whole.select(
        "model_checkpoint_id",
        F.when(F.col("busy"), 0).otherwise(F.col("n_snippets")).cast("long").alias("shown"),
        ((F.col("n_snippets") >= threshold) & ~F.col("busy") & ~F.col("failed")).alias("retrain"),
    )


def stale_jobs(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs that take too long have failed."""
    since, at = F.coalesce("started_at", "created_at"), F.lit(now).cast("timestamp")
    limit = F.when(F.col("trigger").isin(*RETRAIN_TRIGGERS), at - F.expr("INTERVAL 6 HOURS")).otherwise(at - F.expr("INTERVAL 2 HOURS"))
    stale = F.col("status").isin("RUNNING", "PENDING") & (since < limit)
    return jobs.withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status")))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The latest job of each checkpoint."""
    return jobs.groupBy("model_checkpoint_id").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("status"), F.max_by("id", F.struct("created_at", "id")).alias("id")
    )


def vocabulary(labels: DataFrame, none: str = "None") -> DataFrame:
    """SET3: all labels but the one that says there is none."""
    return labels.select("label").where((F.col("label") != none) & F.col("label").isNotNull()).distinct().orderBy("label")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """A19"""
    one = lambda a: F.sum(F.when(F.col("action") == a, 1).otherwise(0))
    return feedback.groupBy("model_checkpoint_id").agg(
        one("ACCEPT").alias("accepted"), one("REJECT").alias("rejected"), one("MODIFY").alias("modified")
    )


def predicted_labels(predictions: DataFrame) -> DataFrame:
    """F8: the labels of all predictions (id, snippet_id, predicted_labels) of each snippet, in the
    order of predictions and places, trimmed, each once, none empty. Each label is first brought
    down to the place where it first stands, so what is gathered is as long as the result."""
    one = predictions.select("snippet_id", "id", F.posexplode("predicted_labels").alias("pos", "label"))
    one = one.withColumn("label", F.trim("label")).where("label != ''")
    first = one.groupBy("snippet_id", "label").agg(F.min(F.struct("id", "pos")).alias("at"))
    rows = first.groupBy("snippet_id").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("x"))
    return rows.select("snippet_id", F.col("x.label").alias("labels"))
