"""Audio files as a table, read by Spark from any store that it can read."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoflock.functions.text import AUDIO_SUFFIXES, relative_path
from sonoflock.sources import headers


def files(spark: SparkSession, root: str) -> DataFrame:
    """All audio files below a folder."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    low = F.lower("path")
    return paths.where(F.array_contains(F.transform(F.array(*map(F.lit, AUDIO_SUFFIXES)), lambda s: low.endswith(s)), True))


def scan(spark: SparkSession, root: str, known: DataFrame | None = None, dataset_id: int = 1) -> DataFrame:
    """S1, S3, SET4: (dataset_id, file_path, file_name, duration, sample_rate, audio_sha256) of the
    audio files that aren't known yet, in order of paths. Only new files are read. Files whose
    header can't be read are left out."""
    base = F.lit("file:" + root if root.startswith("/") else root)
    rows = files(spark, root).withColumn("file_path", relative_path(F.regexp_replace("path", "^file:/+", "file:/"), base))
    if known is not None:
        rows = rows.join(known.select("file_path"), "file_path", "left_anti")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [headers.read(p, bytes(c)) for p, c in zip(batch["file_path"], batch["content"], strict=True)]
            batch["duration"], batch["sample_rate"] = ([f[i] for f in found] for i in (0, 1))
            yield batch[["file_path", "duration", "sample_rate", "audio_sha256"]].astype({"duration": float, "sample_rate": float})

    content = rows.select("file_path", "content", F.sha2("content", 256).alias("audio_sha256"))
    out = content.mapInPandas(read, "file_path string, duration double, sample_rate double, audio_sha256 string")
    out = out.where(F.col("duration").isNotNull() & ~F.isnan("duration"))
    name = F.element_at(F.split("file_path", "/"), -1)
    return out.select(F.lit(dataset_id).cast("long").alias("dataset_id"), "file_path", name.alias("file_name"), "duration", "sample_rate", "audio_sha256").orderBy("file_path")


def structure(paths: DataFrame) -> DataFrame:
    """From (file_path, size): files of each first-level folder that isn't hidden, those at
    the root as `Recordings`; deeper ones don't count."""
    parts = F.split("file_path", "/")
    rows = paths.select(F.when(F.size(parts) == 1, "Recordings").when(F.size(parts) == 2, F.get(parts, F.lit(0))).alias("species"), F.element_at(parts, -1).alias("name"), "size")
    rows = rows.where(F.col("species").isNotNull() & ~F.col("species").startswith("."))
    grouped = rows.groupBy("species").agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list(F.struct("name", "size"))).alias("files"))
    return grouped.orderBy(F.when(F.col("species") == "Recordings", 0).otherwise(1), "species")


def listing(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """Names of the folders in a folder, and whether they hold folders; by Hadoop's file
    system, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(path):
        if s.isDirectory():
            out.append((s.getPath().getName(), any(c.isDirectory() for c in fs.listStatus(s.getPath()))))
    return sorted(out, key=lambda x: x[0].lower())


def snippets(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """(recording_id, start_time, samples) of 16-bit WAV content cut to segments, channels
    averaged. recordings has (id, content)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                with wave.open(io.BytesIO(bytes(r.content))) as f:
                    rate, channels = f.getframerate(), f.getnchannels()
                    first = round(r.start_time * rate)
                    f.setpos(min(first, f.getnframes()))
                    raw = np.frombuffer(f.readframes(round(r.end_time * rate) - first), "<i2").reshape(-1, channels)
                out.append(raw.mean(axis=1).round().astype(int).tolist())
            yield pd.DataFrame({"recording_id": batch["recording_id"], "start_time": batch["start_time"], "samples": out})

    joined = segments.join(recordings.select(F.col("id").alias("recording_id"), "content"), "recording_id")
    return joined.mapInPandas(cut, "recording_id long, start_time double, samples array<int>")


def embed(cut: DataFrame, model, dim: int, width: int = 144_000) -> DataFrame:
    """M2: (recording_id, start_time, vector): samples padded or cut to a width and given to a
    model in batches; NULL for snippets without samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), width), np.float32)
            for i, s in enumerate(batch["samples"]):
                x[i, : min(len(s), width)] = np.asarray(s, np.float32)[:width]
            v = np.asarray(model(x), np.float32).reshape(len(batch), dim)
            some = [len(s) > 0 for s in batch["samples"]]
            yield pd.DataFrame({"recording_id": batch["recording_id"], "start_time": batch["start_time"], "vector": [list(a) if k else None for a, k in zip(v, some, strict=True)]})

    return cut.mapInPandas(run, "recording_id long, start_time double, vector array<float>")
