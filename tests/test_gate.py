"""The retrain gate as a stream: resets, failures, replays, timers."""

import time
from datetime import datetime, timedelta

import pandas as pd

from sonoflock.streaming import feedback as stream

AT = datetime(2024, 1, 1)
FEEDBACK = "id long, snippet_id long, model_checkpoint_id long, created_at timestamp"
JOBS = "model_checkpoint_id long, status string, created_at timestamp"


def minute(k):
    return AT + timedelta(minutes=k)


class Run:
    """Feeds files to the gate, one call after the other."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n, self.fired = spark, f"file://{path}", 0, []
        spark.createDataFrame([], FEEDBACK).write.parquet(f"{self.path}/in")
        spark.createDataFrame([], JOBS).write.parquet(f"{self.path}/jobs")

    def step(self, reviews=(), jobs=(), fails=False, **params):
        for rows, schema, name in ((list(reviews), FEEDBACK, "in"), (list(jobs), JOBS, "jobs")):
            if rows:
                self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        read = lambda schema, name: self.spark.readStream.schema(schema).parquet(f"{self.path}/{name}")

        def call(ids):
            if fails:
                raise RuntimeError("between write and commit")
            self.fired += ids

        q = stream.gate(read(FEEDBACK, "in"), self.path + "/gate", 5, call, read(JOBS, "jobs"), **params)
        try:
            q.awaitTermination()
        except Exception:
            if not fails:
                raise
        return self

    def asked(self):
        return sorted((r.model_checkpoint_id, r.asked) for r in stream.triggers(self.spark, self.path + "/gate").collect())


def reviews(snippets, at, checkpoint=1):
    return [(k, s, checkpoint, minute(at)) for k, s in enumerate(snippets)]


def test_the_gate_resets_when_a_retrain_completes(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.step(reviews([1, 2, 3, 3, 3], 1) + reviews([7], 1, 2) + [(9, 9, None, minute(1))])
    assert run.asked() == []
    run.step(reviews([1, 4, 5], 2))
    assert run.asked() == [(1, 1)] and run.fired == [1]
    run.step(reviews(range(10, 20), 3))  # the child waits: nothing is due
    run.step(reviews([30, 31], 11), [(1, "RUNNING", minute(4)), (1, "COMPLETED", minute(10))])
    assert run.asked() == [(1, 1)]  # reviews before its end don't count
    run.step(reviews([31, 32, 33, 34], 12))
    assert run.asked() == [(1, 1), (1, 2)]
    run.step(jobs=[(1, "FAILED", minute(20))])
    run.step(reviews(range(50, 70), 21))
    assert run.asked() == [(1, 1), (1, 2)]  # after a failure only a person starts another
    run.step(reviews(range(70, 75), 31), [(1, "COMPLETED", minute(30))])
    assert run.asked() == [(1, 1), (1, 2), (1, 3)]


def test_a_replayed_batch_neither_loses_nor_repeats_a_retrain(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.step(reviews([1, 2, 3], 1))
    run.step(reviews([4, 5, 6], 2), fails=True)
    run.step(reviews([7], 3))
    assert run.asked() == [(1, 1)] and run.fired == [1]


class Values:
    """What a processor keeps, without Spark."""

    def __init__(self):
        self.held, self.value, self.timers = {}, None, []

    def getMapState(self, *_, **__):
        return self

    def getValueState(self, *_, **__):
        return self

    def iterator(self):
        return iter(list(self.held.items()))

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        del self.held[k]

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_a_child_that_never_ends_has_failed():
    kept = Values()
    gate = stream.Gate(3, 60, 10)
    gate.init(kept)
    columns = ["kind", "snippet_id", "status", "created_at"]

    def feed(*rows):
        (out,) = gate.handleInputRows((1,), iter([pd.DataFrame(rows, columns=columns)]), kept)
        return out.iloc[0]

    first = feed(*[("review", k, "", pd.Timestamp(minute(1))) for k in range(3)])
    assert first.retrain and first.shown == 0 and kept.timers == [61_000]
    kept.timers.clear()
    (out,) = gate.handleExpiredTimer((1,), kept, None)
    assert out.iloc[0].shown == 3
    later = feed(("review", 9, "", pd.Timestamp(minute(2))))
    assert not later.retrain and later.shown == 4 and kept.timers == []
    done = feed(("job", 0, "COMPLETED", pd.Timestamp(minute(3))))
    assert done.shown == 0 and kept.held == {} and not done.retrain


def test_periodic_jobs(spark, tmp_path):
    calls = []
    q = stream.periodic(spark, lambda s: calls.append(s.range(3).count()), 0.5, f"file://{tmp_path}/ticks")
    began = time.time()
    while len(calls) < 3 and time.time() - began < 60:
        time.sleep(0.2)
    q.stop()
    assert calls[:3] == [3, 3, 3]
