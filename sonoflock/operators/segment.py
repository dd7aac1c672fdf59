"""Segmentation of recordings into snippets of fixed length and stride."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starts(longest: float, window: float, step: float) -> np.ndarray:
    """Starts 0, step, step + step, ... up to the last window that fits, summed up in floating
    point one after another (k * step would give other windows)."""
    if step <= 0:
        raise ValueError("the step must be positive")
    n = max(0, int((longest - window) / step)) + 3
    return np.add.accumulate(np.concatenate([[0.0], np.full(n, step)]))


def segment(recordings: DataFrame, window: float, step: float, most: int = 1_000_000) -> DataFrame:
    """M1, ST2: (recording_id, start_time, end_time) from (id, duration). The starts are the same
    sums for all recordings, so a batch's come from one array; at most `most` rows at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = batch.column("id").to_numpy(zero_copy_only=False), batch.column("duration")
            duration = np.nan_to_num(lengths.fill_null(-1.0).to_numpy(zero_copy_only=False), nan=-1.0)
            t = starts(float(duration.max(initial=0.0)), window, step)
            n = np.searchsorted(t + window, duration, side="right")
            upto = np.cumsum(n)
            for a in range(0, int(upto[-1]) if len(n) else 0, most):
                place = np.arange(a, min(a + most, int(upto[-1])))
                of = np.searchsorted(upto, place, side="right")
                begin = t[place - (upto[of] - n[of])]
                columns = [pa.array(ids[of].astype(np.int64)), pa.array(begin), pa.array(begin + window)]
                yield pa.RecordBatch.from_arrays(columns, ["recording_id", "start_time", "end_time"])

    return recordings.select("id", F.col("duration").cast("double").alias("duration")).mapInArrow(
        cut, "recording_id long, start_time double, end_time double"
    )


def new_snippets(segments: DataFrame, existing: DataFrame) -> DataFrame:
    """Segments that aren't snippets yet. Spark takes the size of recordings for that of the segments
    cut from them, so what is there is never broadcast."""
    return segments.join(existing.hint("merge"), ["recording_id", "start_time", "end_time"], "left_anti")


def resolved_parameters(models: DataFrame, window: float | None, step: float | None, overlap: float | None) -> DataFrame:
    """A model's own value where it is fixed, else the one asked for, else the model's;
    0 counts as not asked for."""
    out = [F.col("id")]
    for name, asked in (("window", window), ("step", step), ("overlap", overlap)):
        own = F.col(f"{name}_size" if name != "overlap" else name)
        wish = F.nullif(F.lit(asked).cast("double"), F.lit(0.0))
        out.append(F.when(F.col(f"requires_fixed_{name}") == 1, own).otherwise(F.coalesce(wish, own)).alias(name))
    return models.select(*out)
