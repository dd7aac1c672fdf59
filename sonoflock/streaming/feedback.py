"""Feedback as a stream: counts of reviewed snippets and the labels they settle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "labels map<string,string>, at map<string,timestamp>"


def counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Feedback of each checkpoint and action in windows of event time."""
    return (
        events.withWatermark("created_at", late)
        .groupBy(F.window("created_at", width), "model_checkpoint_id", "action")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("day"), "model_checkpoint_id", "action", "n")
    )


def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """W4 over a stream: the labels of a snippet by the latest ACCEPT or MODIFY of each user."""
    labels, at = state.get if state.exists else ({}, {})
    labels, at = dict(labels), dict(at)
    for batch in batches:
        for r in batch[batch["action"].isin(["ACCEPT", "MODIFY"]) & batch["label"].notna() & batch["user_id"].notna()].itertuples():
            user = str(r.user_id)
            if user not in at or pd.Timestamp(at[user]) <= r.created_at:
                labels[user], at[user] = r.label, r.created_at.to_pydatetime()
    state.update((labels, at))
    yield pd.DataFrame({"snippet_id": [key[0]], "labels": [sorted(set(labels.values()))]})


def label_state(events: DataFrame) -> DataFrame:
    """(snippet_id, labels) whenever a snippet's feedback changes."""
    return events.groupBy("snippet_id").applyInPandasWithState(
        settle, "snippet_id long, labels array<string>", STATE, "update", GroupStateTimeout.NoTimeout
    )


class Gate(StatefulProcessor):
    """ST1 for one checkpoint. Kept are the snippets reviewed since the last completed retrain, with
    the time of their last review, whether a child retrain waits or runs or was the last to fail,
    and how many retrains were asked for. A review counts if it is later than that retrain's end,
    so what came in meanwhile counts again should the retrain fail. A child that hasn't ended
    after `stale` seconds has failed: a timer tells. Snippets go when a retrain completes, and
    `ttl` days after their last review."""

    def __init__(self, threshold: int, stale: int, ttl: int):
        self.threshold, self.stale, self.ttl = threshold, stale, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "snippet_id long", "at timestamp", ttlDurationMs=self.ttl * 86_400_000)
        self.flags = handle.getValueState("flags", "busy boolean, failed boolean, cutoff timestamp, asked long, n long")

    def _flags(self) -> list:
        return list(self.flags.get()) if self.flags.exists() else [False, False, None, 0, 0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        busy, failed, cutoff, asked, n = self._flags()
        batch = pd.concat(list(rows)).sort_values("created_at", kind="stable")
        for r in batch.itertuples():
            at = pd.Timestamp(r.created_at).to_pydatetime()
            if r.kind == "job":
                if r.status == "COMPLETED":
                    busy, failed = False, False
                    cutoff = at if cutoff is None else max(cutoff, at)
                    old = [k for k, v in self.seen.iterator() if v[0] <= cutoff]
                    for k in old:
                        self.seen.removeKey(k)
                    n -= len(old)
                else:
                    busy, failed = r.status in ("PENDING", "RUNNING"), r.status == "FAILED"
            elif cutoff is None or at > cutoff:
                snippet = (int(r.snippet_id),)
                known = self.seen.getValue(snippet) if self.seen.containsKey(snippet) else None
                n += known is None
                if known is None or known[0] < at:
                    self.seen.updateValue(snippet, (at,))
        fires = n >= self.threshold and not busy and not failed
        shown = 0 if busy or fires else n
        if fires:
            busy, asked = True, asked + 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if busy:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.stale)
        self.flags.update((busy, failed, cutoff, asked, n))
        yield pd.DataFrame({"model_checkpoint_id": [key[0]], "shown": [shown], "retrain": [fires], "asked": [asked]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        busy, failed, cutoff, asked, n = self._flags()
        if busy:
            self.flags.update((False, True, cutoff, asked, n))
            yield pd.DataFrame({"model_checkpoint_id": [key[0]], "shown": [n], "retrain": [False], "asked": [asked]})

    def close(self) -> None:
        pass


GATE = "model_checkpoint_id long, shown long, retrain boolean, asked long"


def gate_state(feedback: DataFrame, jobs: DataFrame | None = None, threshold: int = 100, stale: int = 6 * 3600, ttl: int = 365) -> DataFrame:
    """(model_checkpoint_id, shown, retrain, asked) whenever a checkpoint's feedback or child
    retrains change: the count to show, whether a retrain is due, and how many were asked for.
    jobs: a stream of (model_checkpoint_id, status, created_at) of child retrains."""
    rows = feedback.where("model_checkpoint_id is not null and snippet_id is not null").select(
        F.col("model_checkpoint_id").cast("long").alias("model_checkpoint_id"), F.lit("review").alias("kind"), F.col("snippet_id").cast("long").alias("snippet_id"), F.lit("").alias("status"), "created_at"
    )
    if jobs is not None:
        rows = rows.unionByName(
            jobs.where("model_checkpoint_id is not null").select(F.col("model_checkpoint_id").cast("long").alias("model_checkpoint_id"), F.lit("job").alias("kind"), F.lit(0).cast("long").alias("snippet_id"), "status", "created_at")
        )
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("model_checkpoint_id").transformWithStateInPandas(Gate(threshold, stale, ttl), GATE, "Update", "ProcessingTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def gate(feedback: DataFrame, path: str, threshold: int, trigger=None, jobs: DataFrame | None = None, every: str | None = None, **params) -> StreamingQuery:
    """ST1: writes the retrains that are due to `path`/triggers, a folder for each batch that a
    replay of the batch writes anew, so that none is lost or there twice; then calls trigger with
    the checkpoint ids of the batch. A replay calls it again: (checkpoint, asked) tells which one
    it is. `every` is the time between batches, at which timers run out as well; None takes what
    is there and ends, and timers wait for the next such run."""

    def each(batch: DataFrame, number: int) -> None:
        folder = f"{path}/triggers/batch={number}"
        batch.where("retrain").select("model_checkpoint_id", "asked").write.mode("overwrite").parquet(folder)
        if trigger:
            due = batch.sparkSession.read.schema("model_checkpoint_id long, asked long").parquet(folder)
            trigger([r.model_checkpoint_id for r in due.collect()])

    state = gate_state(feedback, jobs, threshold, **params)
    writer = state.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
    if every:
        return writer.trigger(processingTime=every).start()
    # with timers, batches without data would go on for ever
    conf, idle = state.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(idle)
    conf.set(idle, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(idle, before)


def triggers(spark: SparkSession, path: str) -> DataFrame:
    """(model_checkpoint_id, asked, batch) of all retrains that were due so far."""
    return spark.read.schema("model_checkpoint_id long, asked long, batch long").parquet(f"{path}/triggers")


def periodic(spark: SparkSession, action, seconds: float, path: str) -> StreamingQuery:
    """ST3: calls action(spark) every so many seconds until the query is stopped. A run that
    takes longer delays the next; none is made up for."""

    def each(batch: DataFrame, _: int) -> None:
        action(batch.sparkSession)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", path).trigger(processingTime=f"{int(1000 * seconds)} milliseconds").start()
