"""Shortest ways along a graph of points from a few landmarks, in rounds over blocks.

Points lie in blocks by a hash, in order of their ids. The edges between two blocks are a row for
each direction, with places in the blocks instead of ids; these rows stay with the tasks, those
into a block together. The distances of a block from a part of the landmarks are a row too, in
files by part. In a round every block meets, for every part, the blocks that changed in the round
before, as they lie in their files: no row is made for a landmark, a point or an edge, and nothing
is shuffled. A round writes the new distances (8 bytes for each point and landmark), and those
before them go, so that disk follows the points and not the rounds.

A task has the edges into a block or a few, and reads the distances of one part of the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoflock.plans.shared import discard, materialise, scratch_path

#: Points of a block; landmarks of a part, and bytes that a part may have (one landmark at least); edges met at once.
BLOCK, GROUP, HELD, CHUNK = 16_384, 8, 1 << 24, 1 << 18
STATE = "block int, d binary, changed long"


@dataclass
class Ways:
    """The landmarks in order, the parts they are dealt into, (block, ids) of all points, and the
    folder of (block, d, changed) by part: distances of each point of the block from each landmark
    of the part, infinite where there is no way."""

    landmarks: np.ndarray
    parts: list[slice]
    points: DataFrame
    path: str

    def state(self) -> DataFrame:
        """A partition for each part."""
        read = self.points.sparkSession.read.schema(STATE)
        each = [read.parquet(f"{self.path}/part={g}").coalesce(1).withColumn("part", F.lit(g)) for g in range(len(self.parts))]
        return reduce(DataFrame.unionAll, each)

    def rows(self) -> DataFrame:
        """(landmark, snippet_id, d) of all ways."""
        names, parts = self.landmarks, self.parts

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for ids, part, d in zip(batch["ids"], batch["part"], batch["d"], strict=True):
                    ids, d = np.frombuffer(ids, np.int64), np.frombuffer(d).reshape(-1, parts[part].stop - parts[part].start)
                    point, landmark = np.nonzero(np.isfinite(d))
                    yield pd.DataFrame({"landmark": names[parts[part]][landmark], "snippet_id": ids[point], "d": d[point, landmark]})

        found = beside(self.state(), self.points, "block").select("ids", "part", "d")
        return found.mapInPandas(run, "landmark long, snippet_id long, d double")

    def between(self) -> np.ndarray:
        """The distances of all landmarks (columns) from each other, not a number where there is no way."""
        names, parts = self.landmarks, self.parts

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for ids, part, d in zip(batch["ids"], batch["part"], batch["d"], strict=True):
                    ids, d = np.frombuffer(ids, np.int64), np.frombuffer(d).reshape(-1, parts[part].stop - parts[part].start)
                    _, mine, at = np.intersect1d(ids, names, return_indices=True)
                    yield pd.DataFrame({"part": part, "at": at, "d": [d[i].tobytes() for i in mine]})

        square = np.full((len(names), len(names)), np.nan)
        found = beside(self.state(), self.points, "block").select("ids", "part", "d")
        for r in found.mapInPandas(run, "part int, at int, d binary").collect():
            d = np.frombuffer(r.d)
            square[r.at, parts[r.part]] = np.where(np.isfinite(d), d, np.nan)
        return square

    def placed(self, pseudo: np.ndarray, mean: np.ndarray, far: float) -> DataFrame:
        """(snippet_id, coordinates): -pseudo (x^2 - mean) / 2 of each point's distances x, of which
        those without a way are `far`. Each part of the landmarks gives a share, and shares add up
        in order."""
        parts, dims = self.parts, len(pseudo)

        def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for block, part, d in zip(batch["block"], batch["part"], batch["d"], strict=True):
                    d = np.frombuffer(d).reshape(-1, parts[part].stop - parts[part].start)
                    x = np.where(np.isfinite(d), d, far) ** 2 - mean[parts[part]]
                    yield pd.DataFrame({"block": [block], "part": [part], "share": [(-0.5 * x @ pseudo[:, parts[part]].T).tobytes()]})

        def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in group.sort_values("part")["share"])
            return pd.DataFrame({"block": [key[0]], "total": [total.tobytes()]})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, total in zip(batch.column(0), batch.column(1), strict=True):
                    ids = np.frombuffer(ids.as_py(), np.int64)
                    each = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dims)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(each, pa.array(np.frombuffer(total.as_py())))], ["snippet_id", "coordinates"])

        shares = self.state().select("block", "part", "d").mapInPandas(share, "block int, part int, share binary")
        totals = shares.groupBy("block").applyInPandas(add, "block int, total binary")
        return beside(totals, self.points, "block").select("ids", "total").mapInArrow(run, "snippet_id long, coordinates array<double>")


def beside(rows: DataFrame, points: DataFrame, column: str, name: str = "ids") -> DataFrame:
    """rows with the ids of the block that a column names, read from their files by each task."""
    ids = points.select(F.col("block").alias("its"), F.col("ids").alias(name)).coalesce(1)
    return rows.hint("shuffle_replicate_nl").join(ids, F.col(column) == F.col("its")).drop("its")


def blocks_of(points: DataFrame, n: int, block: int) -> DataFrame:
    """(block, ids): the points of each of n / block blocks, in order and once."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "ids": [np.unique(group["snippet_id"].to_numpy(np.int64)).tobytes()]})

    rows = points.select("snippet_id", block_of("snippet_id", n, block).alias("block"))
    return materialise(rows.groupBy("block").applyInPandas(pack, "block int, ids binary"), "points")


def block_of(column: str, n: int, block: int):
    return F.pmod(F.xxhash64(column), F.lit(max(1, -(-n // block)))).cast("int")


def edges_of(graph: DataFrame, points: DataFrame, n: int, block: int) -> DataFrame:
    """(dst, src, a, b, w): the edges into one block from another, both directions of each, as places
    in the blocks, in order of a; a row, maybe an empty one, for each block from itself."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (group[c].to_numpy(kind).tobytes() for c, kind in (("x", np.int64), ("y", np.int64), ("distance", np.float64)))
        return pd.DataFrame({"lo": [key[0]], "hi": [key[1]], "x": [x], "y": [y], "w": [w]})

    def places(ids: bytes, wanted: bytes) -> np.ndarray:
        ids, wanted = np.frombuffer(ids, np.int64), np.frombuffer(wanted, np.int64)
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        if not np.array_equal(ids[at], wanted):
            raise ValueError("the graph has points that aren't among those given")
        return at.astype(np.int32)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x, y, w = places(r.lo_ids, r.x), places(r.hi_ids, r.y), np.frombuffer(r.w)
                both = [(r.lo, r.hi, x, y, w), (r.hi, r.lo, y, x, w)]
                if r.lo == r.hi:
                    both = [(r.lo, r.lo, np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w]))]
                for dst, src, a, b, w in both:
                    order = np.argsort(a, kind="stable")
                    yield pd.DataFrame({"dst": [dst], "src": [src], "a": [a[order].tobytes()], "b": [b[order].tobytes()], "w": [w[order].tobytes()]})

    q, s = block_of("query_id", n, block), block_of("snippet_id", n, block)
    pairs = graph.where("query_id != snippet_id").select("distance", "query_id", "snippet_id", q.alias("q"), s.alias("s"))
    swap = F.col("q") > F.col("s")
    x, y = (F.when(swap, F.col(one)).otherwise(F.col(other)) for one, other in (("snippet_id", "query_id"), ("query_id", "snippet_id")))
    pairs = pairs.select(F.least("q", "s").alias("lo"), F.greatest("q", "s").alias("hi"), x.alias("x"), y.alias("y"), "distance")
    packed = materialise(pairs.groupBy("lo", "hi").applyInPandas(pack, "lo int, hi int, x binary, y binary, w binary"), "pairs")
    rows = beside(beside(packed, points, "lo", "lo_ids"), points, "hi", "hi_ids").mapInPandas(number, "dst int, src int, a binary, b binary, w binary")
    empty = F.lit(b"")
    return rows.unionAll(points.select(F.col("block").alias("dst"), F.col("block").alias("src"), empty.alias("a"), empty.alias("b"), empty.alias("w")))


def relaxed(ways: Ways, edges: DataFrame) -> DataFrame:
    """The state after another edge of each way, changed where it is shorter by it."""
    widths = [p.stop - p.start for p in ways.parts]

    def done(dst: int, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = [(dst, new.tobytes(), int(np.count_nonzero(new < old)), part) for part, (old, new) in held.items()]
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "d", "changed", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                dst, part = batch.column(0)[i].as_py(), batch.column(4)[i].as_py()
                a, b, w, d = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((1, np.int32), (2, np.int32), (3, float), (5, float)))
                d = d.reshape(-1, widths[part])
                if dst != at:
                    if held:
                        yield done(at, held)
                    at, held = dst, {}
                if part not in held:  # a block's own distances come first
                    held[part] = (d, d.copy())
                new = held[part][1]
                for k in range(0, len(a), CHUNK):
                    to = a[k : k + CHUNK]
                    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                    short = np.minimum.reduceat(d[b[k : k + CHUNK]] + w[k : k + CHUNK, None], first)
                    new[to[first]] = np.minimum(new[to[first]], short)
        if held:
            yield done(at, held)

    met = edges.hint("shuffle_replicate_nl").join(ways.state(), (F.col("src") == F.col("block")) & ((F.col("changed") > 0) | (F.col("src") == F.col("dst"))))
    return met.select("dst", "a", "b", "w", "part", "d").mapInArrow(run, STATE + ", part int")


def shortest(graph: DataFrame, landmarks: list[int], points: DataFrame, most_rounds: int = 200, block: int = BLOCK) -> Ways:
    """The ways from some landmarks, which the driver knows, to all points (snippet_id) along a graph
    of (query_id, snippet_id, distance) in both directions; of `most_rounds` edges less one at most."""
    spark, names = graph.sparkSession, np.unique(np.array(landmarks, np.int64))
    n = points.count()
    size = max(1, min(GROUP, HELD // (8 * max(n, 1))))
    parts = [slice(at, min(at + size, len(names))) for at in range(0, len(names), size)]
    ids = blocks_of(points, n, block)
    n_blocks = max(1, -(-n // block))
    edges = edges_of(graph, ids, n, block).repartitionByRange(n_blocks, "dst").sortWithinPartitions("dst", F.col("src") != F.col("dst"), "src").persist()

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, its in zip(batch["block"], batch["ids"], strict=True):
                its = np.frombuffer(its, np.int64)
                for g, part in enumerate(parts):
                    _, at, which = np.intersect1d(its, names[part], return_indices=True)
                    d = np.full((len(its), part.stop - part.start), np.inf)
                    d[at, which] = 0
                    yield pd.DataFrame({"block": [block], "d": [d.tobytes()], "changed": [len(at)], "part": [g]})

    def written(state: DataFrame) -> Ways:
        path = scratch_path(spark, "ways")
        state.write.partitionBy("part").parquet(path)
        return Ways(names, parts, ids, path)

    ways = written(ids.mapInPandas(start, STATE + ", part int"))
    try:
        for _ in range(most_rounds):
            before, ways = ways, written(relaxed(ways, edges))
            discard(spark, before.path)
            if not spark.read.schema(STATE).parquet(ways.path).agg(F.sum("changed")).first()[0]:
                return ways
    finally:
        edges.unpersist()
    raise RuntimeError(f"the ways along the graph weren't settled after {most_rounds} rounds")
