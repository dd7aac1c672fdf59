"""Vector search: exact top-k, similarity feeds, nearest-neighbour joins.

A join of vectors with vectors broadcasts a table of at most one block of rows; a larger one is
indexed by cells (see cells.py), and bounds tell which cells each query must visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.functions.vectors import cosine
from sonoflock.operators import cells


def top_k(vectors: DataFrame, query: list[float], k: int, exclude: int | None = None, offset: int = 0) -> DataFrame:
    """O1 to O3: (snippet_id, similarity) of the k nearest by cosine, ties by id. The query
    snippet itself is left out first, so that a page is full."""
    rows = vectors if exclude is None else vectors.where(F.col("snippet_id") != exclude)
    sim = F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), 6)
    return rows.select("snippet_id", sim.alias("similarity")).orderBy(F.desc("similarity"), "snippet_id").offset(offset).limit(k)


def similar_to(vectors: DataFrame, snippet_id: int, k: int, offset: int = 0) -> DataFrame:
    """The nearest of one snippet; its vector is looked up by the same plan."""
    query = F.broadcast(vectors.where(F.col("snippet_id") == snippet_id).limit(1).select(F.col("vector").alias("q")))
    sim = F.round(cosine(F.col("vector"), F.col("q")), 6)
    rows = vectors.where(F.col("snippet_id") != snippet_id).crossJoin(query)
    return rows.select("snippet_id", sim.alias("similarity")).orderBy(F.desc("similarity"), "snippet_id").offset(offset).limit(k)


def nearest(queries: DataFrame, table: DataFrame, k: int, block: int = cells.BLOCK, skip_self: bool = False, metric: str = "cosine") -> DataFrame:
    """(query_id, snippet_id, distance, rank) by Euclidean distance of unit vectors (or
    of vectors as they are, by the metric "euclidean"), ties by id. A table of one block is compared with all queries; of a larger one only the cells
    that can hold a nearer row. Both give the same rows."""
    if len(table.select("snippet_id").head(block + 1)) > block:
        found, _ = cells.exact(queries, cells.index(table, block=block, metric=metric), k, block=block, skip_self=skip_self)
        return found
    held = sorted((r.snippet_id, r.vector) for r in table.select("snippet_id", "vector").collect())  # a block at most
    ids = np.array([x for x, _ in held], np.int64)
    rows = queries.sparkSession.sparkContext.broadcast((ids, cells.prepared(pd.Series([np.array(v) for _, v in held]), metric) if held else None))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, t = rows.value
        for batch in batches:
            for at in range(0, len(batch) if len(ids) else 0, 1024):
                part = batch.iloc[at : at + 1024]
                yield cells.ranked(part["snippet_id"].to_numpy(np.int64), cells.prepared(part["vector"], metric), ids, t, k, skip_self, metric)

    found = queries.select("snippet_id", "vector").mapInPandas(best, cells.FOUND)
    by_query = Window.partitionBy("query_id").orderBy("distance", "snippet_id")
    return found.withColumn("rank", F.row_number().over(by_query))
