"""Tables in versions: a manifest names the folders that make up a table, and is swapped whole.

A manifest is a small file with a number; the highest that can be read counts. Who wants to change
a table writes new folders first, then the manifest with the next number, which only one writer
can make: another sees it, and tries again upon it. Readers keep to the folders they have found,
and what failed tasks or lost writers leave behind is in no manifest.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a ranking that lie in one folder.
SLAB = 10_000
#: Buckets of a store of predictions.
BUCKETS = 64


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        return sorted((int(s.getPath().getName()) for s in self.fs.listStatus(folder) if s.getPath().getName().isdigit()), reverse=True)

    def read(self) -> dict | None:
        return next((x for x in map(self._load, self._numbers()) if x), None)

    def swap(self, change: Callable[[dict | None], dict]) -> dict:
        """Make change(the manifest there is) the manifest."""
        while True:
            # one listing says both what to change and the next number: who comes between takes it
            numbers = self._numbers()
            now = next((x for x in map(self._load, numbers) if x), None)
            new = change(now)
            number = (numbers[0] if numbers else 0) + 1
            if self._create(f"{self.path}/manifests/{number:012d}", json.dumps(new).encode()):
                return new | {"number": number}

    def _create(self, path: str, content: bytes) -> bool:
        """Make a file that isn't there yet; False if it is. It is written under another name first,
        so that whoever sees it sees all of it; the file system must not rename over a file."""
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local files would be renamed over
            plain, hidden = (self._at(x).toUri().getPath() for x in (path, draft))
            os.makedirs(os.path.dirname(plain), exist_ok=True)
            with open(hidden, "xb") as f:
                f.write(content)
            try:
                os.link(hidden, plain)
            except FileExistsError:
                return False
            finally:
                os.unlink(hidden)
            return True
        stream = self.fs.create(self._at(draft), False)
        stream.write(bytearray(content))
        stream.close()
        try:
            made = self.fs.rename(self._at(draft), self._at(path))
        except Py4JJavaError as e:
            if "exist" not in str(e):
                raise
            made = False
        if not made:
            self.fs.delete(self._at(draft), False)
            if not self.fs.exists(self._at(path)):
                raise OSError(f"{path} could not be made")
        return made

    def _load(self, number: int) -> dict | None:
        stream = self.fs.open(self._at(f"{self.path}/manifests/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text) | {"number": number}
        except ValueError:  # no manifest of ours
            return None

    def folder(self) -> str:
        """The name of a new folder, for one writer."""
        return f"{self.path}/data={uuid.uuid4().hex}"

    def sweep(self, keep: int = 2) -> int:
        """Drop manifests but the last `keep`, and folders that none of these names. Not while
        others write."""
        numbers = self._numbers()
        named: set[str] = set()
        for n in numbers[:keep]:
            named |= {x.rsplit("/", 1)[-1] for x in (self._load(n) or {"folders": []})["folders"]}
        for n in numbers[keep:]:
            self.fs.delete(self._at(f"{self.path}/manifests/{n:012d}"), False)
        old = [s.getPath() for s in self.fs.listStatus(self._at(self.path)) if s.getPath().getName().startswith("data=") and s.getPath().getName() not in named]
        return sum(bool(self.fs.delete(p, True)) for p in old)


# --- derived tables, kept by fingerprint ----------------------------------------------------------


def kept(
    spark: SparkSession,
    path: str,
    fingerprint: dict,
    make: Callable[[], DataFrame],
    ttl: float | None = None,
    by: str | None = None,
    now: Callable[[], float] = time.time,
) -> tuple[DataFrame, bool]:
    """S10, CA1 to CA3: the table kept at `path` if it was made from what has this fingerprint, less
    than ttl seconds ago, and whether it was; else what make() gives, written there. `by` is a
    column whose values have folders of their own."""
    table = Versions(spark, path)
    there = table.read()
    if there and there["folders"] and there["fingerprint"] == fingerprint and (ttl is None or now() - there["at"] < ttl):
        return _read(spark, path, there).drop("data"), True
    made = make()
    folder = table.folder()
    made.write.partitionBy(*[by] if by else []).parquet(folder)
    columns = [f for f in made.schema.fields if f.name != by] + [f for f in made.schema.fields if f.name == by]
    entry = {"folders": [folder], "fingerprint": fingerprint, "at": now(), "schema": StructType(columns).json()}
    return _read(spark, path, table.swap(lambda _: entry)).drop("data"), False


def _read(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """The table, with the folder of each row as column `data`."""
    schema = StructType.fromJson(json.loads(manifest["schema"])).add("data", "string")
    return spark.read.schema(schema).option("basePath", path).parquet(*manifest["folders"])


def forget(spark: SparkSession, path: str) -> None:
    """What is kept at `path` no longer counts; those who read it go on reading."""
    table = Versions(spark, path)
    if table.read():
        table.swap(lambda old: old | {"folders": []})


def ranked(rows: DataFrame, score: str, tie: str, materialise: Callable[[DataFrame, str], DataFrame], slab: int = SLAB) -> DataFrame:
    """Rows with their place by score, highest first, NULL last, then by tie; and the slab of
    rows that a place lies in. Rows go to ranges of scores; a small table of the ranges' sizes
    tells where each starts."""
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    whole = placed.join(sizes.select("part", start.alias("start")), "part")
    place = F.col("start") + F.col("place") - 1
    return whole.withColumn("place", place.cast("long")).withColumn("slab", F.floor(F.col("place") / slab).cast("long")).drop("part", "start")


def page(ranking: DataFrame, offset: int, limit: int, slab: int = SLAB) -> DataFrame:
    """A page of a ranking that is kept by slab: only the folders of its slabs are read."""
    here = F.col("slab").between(offset // slab, (offset + limit - 1) // slab)
    return ranking.where(here & (F.col("place") >= offset) & (F.col("place") < offset + limit)).orderBy("place")


# --- a store of predictions -------------------------------------------------------------------------


def bucket(snippet_id, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(snippet_id), F.lit(buckets)).cast("int")


def _bucketed(rows: DataFrame) -> DataFrame:
    """Sorted files by bucket. One task writes a bucket, or a part of it if it is large."""
    return rows.withColumn("bucket", bucket(F.col("snippet_id").cast("long"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "snippet_id")


def append(predictions: DataFrame, path: str) -> None:
    """Add predictions (model_checkpoint_id, snippet_id, ...) to the store at `path`."""
    table = Versions(predictions.sparkSession, path)
    folder = table.folder()
    typed = predictions.withColumn("snippet_id", F.col("snippet_id").cast("long"))
    _bucketed(typed).write.partitionBy("bucket").parquet(folder)
    schema = StructType([*typed.schema.fields]).add("bucket", "integer").json()

    def add(old: dict | None) -> dict:
        if old and old["schema"] != schema:
            raise ValueError("these predictions have other columns than the store")
        return {"folders": [*(old["folders"] if old else []), folder], "schema": schema}

    table.swap(add)


def _latest(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of the predictions of one checkpoint for one snippet those of the folder added last."""
    added = F.array_position(F.array(*map(F.lit, names)), F.col("data"))
    with_age = rows.select("*", added.alias("_age"))
    newest = Window.partitionBy("model_checkpoint_id", "snippet_id")
    return with_age.withColumn("_newest", F.max("_age").over(newest)).where("_age = _newest").drop("_age", "_newest", "data")


def predictions(spark: SparkSession, path: str, checkpoint: int | None = None, snippet_id: int | None = None) -> DataFrame:
    """The predictions of the store, of one checkpoint, of one snippet. For one snippet
    only the files of its bucket are read."""
    manifest = Versions(spark, path).read()
    if not manifest or not manifest["folders"]:
        raise ValueError(f"no predictions at {path}")
    rows = _read(spark, path, manifest)
    if snippet_id is not None:
        rows = rows.where((F.col("bucket") == bucket(F.lit(snippet_id).cast("long"))) & (F.col("snippet_id") == snippet_id))
    if checkpoint is not None:
        rows = rows.where(F.col("model_checkpoint_id") == checkpoint)
    return _latest(rows, [x.rsplit("=", 1)[-1] for x in manifest["folders"]]).drop("bucket")


def compact(spark: SparkSession, path: str) -> None:
    """Bring the folders of a store into one, with the latest predictions only."""
    table = Versions(spark, path)
    seen = table.read()
    folder = table.folder()
    _bucketed(predictions(spark, path)).write.partitionBy("bucket").parquet(folder)
    # what others have added meanwhile stays
    table.swap(lambda now: now | {"folders": [folder, *[f for f in now["folders"] if f not in seen["folders"]]]})
