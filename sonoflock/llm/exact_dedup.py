"""Exact dedup by an extendible-hash index on shared files. DataFrame operations only.

The directory is addressed by the leading bits of a 64-bit hash of the normalised text. It
doubles until no bucket has more than `capacity` different hashes; then buckets that don't need
all of its bits are given back to fewer (local depth). Rows find their bucket through the slot
of the directory that their hash falls in. A bucket is a range of hashes and belongs to one
owner task, which gathers the entries of its range: rows of equal hash are chained, and told
apart by comparing the texts themselves. The index has one row for each different text, by
bucket, hash and place in the chain. Probes go the same way, slot and bucket first, then hash,
then the entry of the chain with the same SHA-256.

A text with very many copies is known from the counts of hashes: its slot names it, with a number
of salts. Its copies are added up in each map task before they are sent to the owner, and probes
for it are spread over copies of its entry. The directory has about one row for each `capacity`
different texts; Spark broadcasts it only if its size on files is below the session's threshold.

Defined results: null text counts as empty; tables may be empty; of rows with equal text and
equal doc_id all are `kept` or none; a group whose doc_ids are all null keeps all its rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.llm.common import LOWER, UPPER, materialise

CAPACITY = 4096
#: A hash of more rows than this is a hot one.
HOT_ROWS = 10_000
#: Hashes that share so many leading bits are taken for one: their bucket isn't split.
BITS = 62


def normalised(text: Column) -> Column:
    """A-Z lower-cased. Where all is ASCII, lower() does the same and is faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def prefix(h: Column, depth: int) -> Column:
    """The leading `depth` bits of h, as a number."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, text_sha256, t) of every row, on shared files."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    return materialise(
        rows.select("doc_id", F.xxhash64("t").alias("h"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), "t"),
        "dedup-hashed",
    )


def directory(counts: DataFrame, capacity: int = CAPACITY, hot_rows: int = HOT_ROWS) -> tuple[int, DataFrame]:
    """The global depth, and (slot, depth, bucket, hot) for each slot that has entries: the local
    depth of its bucket, the bucket's number (a leading 1, then the bucket's bits), and the hot
    hashes of the slot with their numbers of salts. counts: (h, n), one row for each hash."""
    different = counts.count()
    top = max(0, math.ceil(math.log2(max(different, 1) / capacity)))
    hot = F.map_from_entries(
        F.collect_list(F.when(F.col("n") > hot_rows, F.struct("h", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts"))))
    )
    while True:  # double the directory until no bucket is overfull
        slots = counts.groupBy(prefix(F.col("h"), top).alias("slot")).agg(F.count(F.lit(1)).alias("n"), hot.alias("hot"))
        slots = materialise(slots, "dedup-slots")
        if top >= BITS or slots.where(F.col("n") > capacity).isEmpty():
            break
        top += 1
    up = F.lit(top) - F.col("d")
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max(top - 1, 0)))).alias("d")).withColumn(
        "bits", F.expr(f"shiftrightunsigned(slot, {top} - d)")
    )
    overfull = levels.groupBy("d", "bits").agg(F.sum("n").alias("all")).where((F.col("all") > capacity) & (up > 0))
    depths = (
        levels.join(overfull, ["d", "bits"], "left")
        .groupBy("slot")
        .agg(F.coalesce(F.max(F.when(F.col("all").isNotNull(), F.col("d") + 1)), F.lit(0)).alias("depth"))
    )
    named = slots.select("slot", "hot").join(depths, "slot")
    bucket = F.expr(f"shiftleft(1L, depth) | shiftrightunsigned(slot, {top} - depth)")
    return top, materialise(named.withColumn("bucket", bucket), "dedup-directory")


def routed(rows: DataFrame, top: int, slots: DataFrame) -> DataFrame:
    """rows with the bucket of their hash and, for a hot hash, its number of salts."""
    found = rows.withColumn("slot", prefix(F.col("h"), top)).join(slots.select("slot", "depth", "bucket", "hot"), "slot")
    return found.withColumn("salts", F.element_at("hot", F.col("h"))).drop("slot", "hot")


def entries(rows: DataFrame) -> DataFrame:
    """(bucket, depth, h, t, text_sha256, keep_id, group_size), one row for each different text,
    gathered by the owners of buckets; rows: routed rows."""
    where = ["bucket", "depth", "h", "t"]
    each = rows.where("salts is null").select(
        *where, "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    # copies of hot texts are added up in map tasks, and arrive as a row or few
    hot = rows.where("salts is not null").groupBy(*where).agg(
        F.first("text_sha256").alias("text_sha256"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    owned = each.unionByName(hot).repartition("bucket")
    return owned.groupBy(*where).agg(
        F.first("text_sha256").alias("text_sha256"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def build_index(rows: DataFrame, capacity: int = CAPACITY, hot_rows: int = HOT_ROWS) -> tuple[int, DataFrame, DataFrame]:
    """The global depth, the directory, and the index (bucket, depth, h, chain, text_sha256,
    keep_id, group_size) on shared files, by bucket; rows: hashed documents."""
    counts = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "dedup-counts")
    top, slots = directory(counts, capacity, hot_rows)
    gathered = entries(routed(rows, top, slots))
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256"))
    index = gathered.drop("t").withColumn("chain", chain)
    index = index.select("bucket", "depth", "h", "chain", "text_sha256", "keep_id", "group_size")
    return top, slots, materialise(index, "dedup-index")


def probe(rows: DataFrame, top: int, slots: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every hashed row."""
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)).cast("long"))
    keyed = routed(rows.select("doc_id", "h", "text_sha256"), top, slots).withColumn("salt", salt).drop("depth", "salts")
    spread = routed(index.drop("depth", "bucket"), top, slots).select(
        "bucket", "h", "text_sha256", "keep_id", "group_size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"),
    )
    found = keyed.join(spread.hint("merge"), ["bucket", "h", "text_sha256", "salt"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """Which document stays of each group of equal texts: the one with the largest id."""
    rows = hashed(docs, id_col, text_col)
    return probe(rows, *build_index(rows, **index))
