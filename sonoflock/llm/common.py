"""Helpers shared by the operators: scratch tables in the shared folder, reading of inputs."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where a local
    session names none (a test), one is made and named for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sonoflock-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and what
    is read later doesn't change when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path within it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, object] = {}
_at_work = [""]


def tidy() -> None:
    """Give memory that arrays have left back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_keeps(name: str, make: Callable[[], object]) -> object:
    """What make() gives, kept in a worker process from task to task. A process keeps one thing
    only: what another operator kept there goes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def lean(f: Callable, keeps: str | None = None) -> Callable:
    """f, a function for mapInArrow or applyInArrow, that drops what other operators kept in the
    worker process when it starts, and gives back memory at the end of a stream, or where another
    function was at work before."""
    name = f"{f.__module__}.{f.__qualname__}"

    def before() -> None:
        if keeps not in _kept:
            _kept.clear()
        if _at_work[0] != name:
            _at_work[0] = name
            tidy()

    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def stream(batches):
            before()
            yield from f(batches)
            tidy()

        return stream

    def whole(*args):
        before()
        return f(*args)

    # Spark tells by the number of arguments whether the key, or a second table, is wanted
    takes = len(inspect.signature(f).parameters)
    return [lambda a: whole(a), lambda a, b: whole(a, b), lambda a, b, c: whole(a, b, c)][takes - 1]
