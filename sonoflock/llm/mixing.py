"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Each source gets a share of the whole by its weight, up to `most` times its own size; what
it can't take is shared out among the others by weight, until no target is above its limit.
This is water-filling: with level x, target = min(most * size, weight * x), and x follows
from sums over the sources in order of most * size / weight.

Within a source each document expects target / source size copies. Documents stand in order
of size and doc_id, so that small and large ones alike are met evenly. Their expected copies
are summed up, one random offset is added, and a document is emitted once for each whole
number that the sum passes. The running sum needs no single task for a large source: rows
are range-partitioned by (source, size, doc_id) and written, a small table of counts for each
(source, range) gives where each range starts, and rows are numbered within their range.

Defined results: size of null text is 0; null is a source of its own and comes last; a source
of size 0 takes nothing; repeated rows are documents of their own; tables may be empty.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def offset(seed: int) -> float:
    """The one random offset, between 0 and 1, with few enough digits to be exact in sums."""
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size). The table of sources is
    an aggregate, one row for each source; its running sums are taken in one sort."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(by_name) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (position + 1).cast("int"))
    weighed = sources.withColumn("w", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    rest = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    leveled = weighed.withColumn("level", rest / F.sum("w").over(onward))
    # the first source that stays below its limit sets the level of all
    level = F.first(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return leveled.withColumn("x", level).select(
        "source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("w") * F.col("x"), F.col("limit"))).alias("target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 9,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    ranged = sized.repartitionByRange(F.col("source").asc_nulls_last(), "size", "doc_id")
    rows = materialise(ranged.withColumn("part", F.spark_partition_id()), "mix-sizes")

    parts = materialise(
        rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "mix-parts"
    )
    sources = targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most)
    start = F.coalesce(
        F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    starts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), start.alias("start"))
    plan = starts.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")

    within = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id"))
    placed = rows.withColumn("i", within).join(
        plan, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("start") + F.col("i")).cast("double")
    u = F.lit(offset(seed))
    copies = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    return placed.withColumn("copies", F.least(copies, F.lit(most)).cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
