"""An inverted file of vectors: cells around centroids, probed nearest first.

Centroids are fitted by rounds of k-means: each task assigns its rows and adds them up by cell,
and Spark adds up the tasks. Every row of the table then goes to the cell of its nearest
centroid. A cell is cut into blocks of bounded size, each a row of packed numbers, and the blocks
lie in Parquet files by cell, so that a search reads the files of the cells it probes.

An approximate search probes the few cells whose centroids are nearest to a query and ranks all
rows there by their true distance. An exact search goes on from there: the kth distance found is
a bound, and by the triangle inequality no row of a cell is nearer than its centroid's distance
less the cell's radius; only cells that could still hold a nearer row are probed. Queries lie in
blocks too; a task meets a share of their blocks with a share of the cells' blocks, both read from
their files, so that disk and shuffles follow the rows, not the visits. Products of single precision
tell which rows may lie within the bound, by a margin that covers their rounding; the distances of
those are worked out in double precision. A task's own kth best tightens the bound, and only the k
best leave it.

By the metric "cosine" distances are Euclidean ones of unit vectors. A vector of zeros has no
direction then: all its distances are the root of two, as is that of a cosine of 0; such rows
have a cell of their own. By "euclidean" vectors are taken as they are.

What the driver and each task hold is the centroids: MOST_CELLS times the dimension at most.
Fitting may use a sample of rows (FIT_ROWS for each cell); the index holds every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.plans.shared import materialise, scratch_path

MOST_CELLS, FIT_ROWS, ROUNDS = 4096, 256, 5
BLOCK = 4096
#: Rows of queries, and of the index, that a task of a search has; queries in a row of many cells.
SHARE, GATHER = 8192, 2048
#: Tasks of a search for each share of queries, and at least; each goes over its part of the index share by share.
TURNS, TASKS = 1, 32
#: Queries that are compared at a time, and pairs whose distances are worked out at a time.
STRIP, PAIRS = 64, 8192
PROBES = 4
#: The share of queries whose nearest row is to be found, and the queries that tell how many probes it takes.
RECALL, SAMPLE = 0.95, 1000
ROOT_TWO = math.sqrt(2.0)
#: Bounds give way by so much, as distances are rounded.
SLACK = 1e-8
FOUND = "query_id long, snippet_id long, distance double"


@dataclass
class Cells:
    """centroids[c] of each cell; the cell after the last is that of rows without direction.
    radius and rows of each; blocks, a table of (cell, block, ids, data) in files by cell."""

    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    blocks: DataFrame | None
    metric: str = "cosine"

    def reach(self, x: np.ndarray) -> np.ndarray:
        """How near a row of each cell can be to each of x, prepared vectors."""
        bound = np.empty((len(x), len(self.centroids) + 1))
        bound[:, :-1] = np.maximum(to_centroids(x, self.centroids) - self.radius, 0)
        bound[:, -1] = ROOT_TWO
        if self.metric == "cosine":
            bound[~x.any(axis=1)] = ROOT_TWO
        bound[:, self.rows == 0] = np.inf
        return bound

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells with rows that each of x probes first."""
        d = np.empty((len(x), len(self.centroids) + 1))
        d[:, :-1] = to_centroids(x, self.centroids)
        d[:, -1] = ROOT_TWO
        d[:, self.rows == 0] = np.inf
        n = min(n, int(np.count_nonzero(self.rows)))
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def prepared(column: pd.Series, metric: str = "cosine") -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    if metric == "euclidean":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 1e-12, x / np.maximum(norm, 1e-12), 0.0)


def to_centroids(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(square, 0))


def cell_of(x: np.ndarray, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance; of rows without direction, the last
    cell and 0."""
    d = to_centroids(x, centroids)
    cell = d.argmin(axis=1)
    near = d[np.arange(len(x)), cell]
    if metric == "cosine":
        empty = ~x.any(axis=1)
        cell[empty], near[empty] = len(centroids), 0.0
    return cell, near


def fit(table: DataFrame, n_cells: int | None = None, rounds: int = ROUNDS, seed: int = 42, metric: str = "cosine") -> np.ndarray:
    """Centroids of a table of (snippet_id, vector). The first ones are rows that a hash picks;
    a cell that gets no row keeps its centroid."""
    n = table.count()
    if not n:
        return np.zeros((0, 0))
    n_cells = max(1, min(n_cells or math.isqrt(n), MOST_CELLS, n))
    mark = F.pmod(F.xxhash64("snippet_id", F.lit(seed)), F.lit(1 << 30))

    def share(rows: float):
        return table.where(mark <= math.ceil((1 << 30) * min(1.0, rows / n)))

    # a few more rows than cells are asked for, and the first by hash are taken
    first = share(2 * n_cells + 100).withColumn("mark", mark).orderBy("mark", "snippet_id").limit(n_cells)
    centroids = prepared(pd.Series([np.array(r.vector) for r in first.select("vector").collect()]), metric)
    sample = share(FIT_ROWS * n_cells).select("vector")
    for _ in range(rounds):
        held = table.sparkSession.sparkContext.broadcast(centroids)

        def add(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(held.value), held.value.shape[1] + 1))
            for batch in batches:
                if len(batch):
                    x = prepared(batch["vector"], metric)
                    x = x[x.any(axis=1)] if metric == "cosine" else x
                    if len(x):
                        cell, _ = cell_of(x, held.value, metric)
                        order = np.argsort(cell, kind="stable")
                        some, start = np.unique(cell[order], return_index=True)
                        total[some] += np.add.reduceat(np.hstack([x, np.ones((len(x), 1))])[order], start)
            met = np.flatnonzero(total[:, -1])
            yield pd.DataFrame({"cell": met, "total": [total[c].tobytes() for c in met]})

        def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in group["total"])
            return pd.DataFrame({"cell": [key[0]], "total": [total.tobytes()]})

        sums = sample.mapInPandas(add, "cell int, total binary").groupBy("cell").applyInPandas(gather, "cell int, total binary")
        centroids = centroids.copy()
        for r in sums.collect():  # a row for each cell at most
            total = np.frombuffer(r.total)
            centroids[r.cell] = total[:-1] / total[-1]
        held.unpersist()
    return centroids[_order(centroids)]


def _order(x: np.ndarray) -> np.ndarray:
    """An order in which near ones lie near each other: halves along the direction of largest variance, again and again."""
    if len(x) < 3:
        return np.arange(len(x))
    away = x - x.mean(axis=0)
    along = np.argsort(away @ np.linalg.eigh(away.T @ away)[1][:, -1], kind="stable")
    return np.concatenate([part[_order(x[part])] for part in np.array_split(along, 2)])


def build(table: DataFrame, centroids: np.ndarray, block: int = BLOCK, metric: str = "cosine") -> Cells:
    """Every row of a table of (snippet_id, vector) in its cell, written to the shared folder."""
    spark = table.sparkSession
    held = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = prepared(batch["vector"], metric)
                cell, near = cell_of(x, held.value, metric)
                yield pd.DataFrame({"snippet_id": batch["snippet_id"], "data": [r.tobytes() for r in x], "cell": cell, "near": near})

    rows = materialise(table.select("snippet_id", "vector").mapInPandas(assign, "snippet_id long, data binary, cell int, near double"), "cell-rows")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("radius"))
    radius, count = np.zeros(len(centroids)), np.zeros(len(centroids) + 1, np.int64)
    for r in sizes.collect():  # a row for each cell
        count[r.cell] = r.n
        if r.cell < len(radius):
            radius[r.cell] = r.radius

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("snippet_id")
        ids = group["snippet_id"].to_numpy(np.int64)
        return pd.DataFrame({"cell": [key[0]], "block": [key[1]], "ids": [ids.tobytes()], "data": [b"".join(group["data"])]})

    # a cell of many rows is cut by a hash of the id, into as many blocks as it needs
    cuts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // block))) for n in count]), F.col("cell") + 1)
    cut = rows.withColumn("block", F.pmod(F.xxhash64("snippet_id"), cuts).cast("int"))
    packed = cut.groupBy("cell", "block").applyInPandas(pack, "cell int, block int, ids binary, data binary")
    path = scratch_path(spark, "cells")
    packed.write.partitionBy("cell").parquet(path)
    blocks = spark.read.schema("block int, ids binary, data binary, cell int").parquet(path)
    return Cells(centroids, radius, count, blocks, metric)


def index(table: DataFrame, n_cells: int | None = None, block: int = BLOCK, rounds: int = ROUNDS, seed: int = 42, metric: str = "cosine") -> Cells:
    return build(table, fit(table, n_cells, rounds, seed, metric), block, metric)


def _filed(queries: DataFrame, cells: Cells) -> DataFrame:
    """(snippet_id, data, home): prepared queries and the cell that each would lie in."""
    held, metric = queries.sparkSession.sparkContext.broadcast(cells.centroids), cells.metric

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = prepared(batch["vector"], metric)
                home = cell_of(x, held.value, metric)[0] if len(held.value) else np.zeros(len(x), int)
                yield pd.DataFrame({"snippet_id": batch["snippet_id"], "data": [r.tobytes() for r in x], "home": home})

    rows = queries.select("snippet_id", "vector").mapInPandas(assign, "snippet_id long, data binary, home int")
    return materialise(rows, "queries")


def _visitors(rows: DataFrame, n: int, cells: Cells, probes: int, block: int) -> DataFrame:
    """The n queries in rows of a block at most, of homes that follow each other, and the cells that
    any of them visits: its first ones; or, where rows have a `bound`, all further ones that can
    hold a row within it. Bits tell which query visits which of the cells; compared is the number
    of pairs that follow."""
    more, n_cells = "bound" in rows.columns, len(cells.rows)
    reach = rows.sparkSession.sparkContext.broadcast(Cells(cells.centroids, cells.radius, cells.rows, None, cells.metric))
    stretch = -(-n_cells // max(1, -(-n // GATHER)))
    rows = rows.withColumn("home", F.floor(F.col("home") / stretch).cast("int"))
    counted = rows.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each cell at most
    parts = {r.home: -(-r.n // block) for r in counted}
    cuts = F.element_at(F.array(*[F.lit(parts.get(c, 1)) for c in range(n_cells)]), F.col("home") + 1)

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        at = reach.value
        x = np.frombuffer(b"".join(group["data"])).reshape(len(group), -1)
        visits = np.zeros((len(x), n_cells), bool)
        first = at.probes(x, probes)
        if more:
            bound = group["bound"].fillna(np.inf).to_numpy(np.float64)
            visits = at.reach(x) <= bound[:, None] + SLACK
            visits[:, at.rows == 0] = False
            np.put_along_axis(visits, first, False, axis=1)
        else:
            bound = np.full(len(x), np.inf)
            np.put_along_axis(visits, first, True, axis=1)
        some = np.flatnonzero(visits.any(axis=0)).astype(np.int32)
        row = {"home": key[0], "part": key[1], "q_ids": group["snippet_id"].to_numpy(np.int64).tobytes(), "q_data": x.tobytes(), "bound": bound.tobytes()}
        row |= {"visits": np.packbits(visits[:, some], axis=0).tobytes(), "open": some.tolist(), "some": some.tobytes(), "compared": int(visits.sum(axis=0) @ at.rows)}
        return pd.DataFrame([row] if len(some) else [], columns=list(row))

    cut = rows.withColumn("part", F.pmod(F.xxhash64("snippet_id", F.lit(7)), cuts).cast("int"))
    packed = cut.groupBy("home", "part").applyInPandas(
        pack, "home int, part int, q_ids binary, q_data binary, bound binary, visits binary, open array<int>, some binary, compared long"
    )
    return materialise(packed, "visitors")


def _dealt(blocks: DataFrame, rows: int) -> DataFrame:
    """As many partitions as there are shares of the rows, so that tasks don't grow."""
    return blocks.coalesce(max(1, -(-rows // SHARE)))


def _meet(visitors: DataFrame, n: int, cells: Cells, blocks: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(query_id, snippet_id, distance): the k best of each query, within its bound, of each of TURNS
    parts of the blocks (more for few queries), for n queries. Every share of visitors meets every share of blocks as they lie in their
    files: nothing is written or shuffled for a visit. A task meets one share after the other and keeps the best
    so far, so that the rows that leave it follow the queries, not the shares."""
    left, right = _dealt(visitors, n), _dealt(blocks, int(cells.rows.sum()))
    pairs = left.hint("shuffle_replicate_nl").join(right, F.arrays_overlap("open", "cells"))
    metric = cells.metric

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best_of = None, {}
        for batch in batches:
            home, part, *columns = (batch.column(i) for i in range(batch.num_columns))
            for i in range(batch.num_rows):
                q_ids, q_data, limit, bits, open_ones, of, sizes, ids, data = (c[i] for c in columns)
                if at != (home[i].as_py(), part[i].as_py()):
                    at = (home[i].as_py(), part[i].as_py())
                    # copies: a batch may go while its visitors stay
                    qi, bound, q, some = (np.frombuffer(x.as_py(), kind) for x, kind in ((q_ids, np.int64), (limit, float), (q_data, float), (open_ones, np.int32)))
                    q = q.reshape(len(qi), -1)
                    visits = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8).reshape(-1, len(some)), axis=0, count=len(qi)).astype(bool)
                    mine = best_of.setdefault(at, Best(qi, bound.copy(), k))
                size, ti = np.frombuffer(sizes.as_buffer(), np.int32), np.frombuffer(ids.as_buffer(), np.int64)
                t = np.frombuffer(data.as_buffer()).reshape(len(ti), -1)
                _visited(mine, q, visits, some, np.array(of.as_py()), size, ti, t, skip_self, metric)
        for one in best_of.values():
            yield from one.rows()

    columns = ("home", "part", "q_ids", "q_data", "bound", "visits", "some", "cells", "sizes", "ids", "data")
    return pairs.select(*columns).coalesce(max(TASKS, TURNS * -(-n // SHARE))).mapInArrow(best, FOUND)


class Best:
    """The k best rows so far of each of some queries, and the distance within which a better one must lie."""

    def __init__(self, ids: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.bound, self.k, self.n = ids, bound, k, 0
        self.kind = np.uint16 if len(ids) < 1 << 16 else np.int64  # short ones are sorted by radix
        self.found = [(np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, query: np.ndarray, row: np.ndarray, d: np.ndarray) -> None:
        """Rows at distances d of the queries at these places."""
        self.found.append((query.astype(self.kind), row, d))
        self.n += len(d)
        if self.n > 2 * self.k * len(self.ids):
            self.keep()

    def keep(self) -> None:
        query, row, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.argsort(d)
        order = order[np.argsort(query[order], kind="stable")]
        query, row, d = query[order], row[order], d[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(self.ids)))])
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.bound[full] = np.minimum(self.bound[full], d[first[full] + self.k - 1])
        kept = d <= self.bound[query]
        query, row, d = query[kept], row[kept], d[kept]
        over = np.flatnonzero((np.bincount(query, minlength=len(self.ids)) > self.k)[query])
        if len(over):  # of rows as far as the kth those of the smallest ids
            order = over[np.lexsort((row[over], d[over], query[over]))]
            rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            kept = np.ones(len(query), bool)
            kept[order[rank >= self.k]] = False
            query, row, d = query[kept], row[kept], d[kept]
        self.found, self.n = [(query, row, d)], len(d)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.keep()
        query, row, d = self.found[0]
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[query], row, d)], ["query_id", "snippet_id", "distance"])


def _visited(best: Best, q: np.ndarray, visits: np.ndarray, some: np.ndarray, of: np.ndarray, size: np.ndarray, ti: np.ndarray, t: np.ndarray, skip_self: bool, metric: str) -> None:
    """Rows t, size[i] of them from cell of[i], are offered to those queries that visit their cells: all at once
    where most do, else cell by cell."""
    place = np.minimum(np.searchsorted(some, of), len(some) - 1)
    asks = visits[:, place] & (some[place] == of)
    if np.isfinite(best.bound).all() and asks.sum(axis=0) @ size > 0.3 * len(q) * len(t):
        _offer(best, np.flatnonzero(asks.any(axis=1)), q, ti, t, skip_self, metric, None if asks.all() else (asks, np.repeat(np.arange(len(of)), size)))
        return
    ends = np.cumsum(size)
    for i in np.flatnonzero(asks.any(axis=0)):
        part = slice(ends[i] - size[i], ends[i])
        _offer(best, np.flatnonzero(asks[:, i]), q, ti[part], t[part], skip_self, metric)


def _offer(best: Best, asked: np.ndarray, q: np.ndarray, ti: np.ndarray, t: np.ndarray, skip_self: bool, metric: str, asks: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Rows t, of ids ti, that lie within the bounds of the queries at the places asked, if they ask for them."""
    cosine, dim = metric == "cosine", t.shape[1]
    centre = 0.0 if cosine else np.nan_to_num(t.mean(axis=0), posinf=0.0, neginf=0.0)  # products lose fewer digits near it
    away = t - centre
    tt = np.full(len(t), 2.0) if cosine else (away * away).sum(axis=1)
    whole = np.column_stack([away, tt])
    tables = {np.float32: whole.astype(np.float32), np.float64: whole}
    for at in range(0, len(asked), STRIP):
        mine = asked[at : at + STRIP]
        x = q[mine] - centre
        qq = np.zeros(len(mine)) if cosine else (x * x).sum(axis=1)
        scale = max(y.max(where=np.isfinite(y), initial=0.0) for y in (tt, qq))
        kind = np.float32 if 1e-30 < scale < 1e30 else np.float64
        margin = (2 * dim + 16) * float(np.finfo(kind).eps) * scale
        value = np.column_stack([-2 * x, np.ones(len(x))]).astype(kind) @ tables[kind].T
        most = (best.bound[mine] + SLACK) ** 2 + 1e-14 - qq + margin
        least = best.k - 1 + skip_self
        if least + 1 < len(t) and not np.isfinite(most).all():
            kth = np.partition(value, least, axis=1)[:, least] + qq + margin
            most = np.fmin(most, (np.sqrt(np.maximum(kth, 0)) + SLACK) ** 2 - qq + margin)
        rows, places = np.divmod(_true(value <= most.astype(kind)[:, None]), len(ti))
        rows = mine[rows]
        asked_for = np.ones(len(rows), bool) if asks is None else asks[0][rows, asks[1][places]]
        if skip_self:
            asked_for &= best.ids[rows] != ti[places]
        if not asked_for.all():
            rows, places = rows[asked_for], places[asked_for]
        d = distances(q, rows, t, places, cosine)
        fits = d <= best.bound[rows] + SLACK
        best.add(rows[fits], ti[places[fits]], d[fits])


def _true(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask that has few, eight places at a time."""
    mask = mask.ravel()
    end = len(mask) // 8 * 8
    words = np.flatnonzero(mask[:end].view(np.uint64))
    bits = np.flatnonzero(mask[:end].reshape(-1, 8)[words])
    return np.concatenate([words[bits >> 3] * 8 + (bits & 7), end + np.flatnonzero(mask[end:])])


def distances(q: np.ndarray, rows: np.ndarray, t: np.ndarray, places: np.ndarray, cosine: bool) -> np.ndarray:
    """The distances of q[rows] and t[places], rounded."""
    square = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS):
        a, b = q[rows[at : at + PAIRS]], t[places[at : at + PAIRS]]
        if cosine:
            square[at : at + PAIRS] = 2 - 2 * np.einsum("ij,ij->i", a, b)
        else:
            a -= b
            square[at : at + PAIRS] = np.einsum("ij,ij->i", a, a)
    return np.round(np.sqrt(np.maximum(square, 0)), 9)


def ranked(qi: np.ndarray, q: np.ndarray, ti: np.ndarray, t: np.ndarray, k: int, skip_self: bool, metric: str = "cosine") -> pd.DataFrame:
    """The k nearest of rows t, in order of their ids ti, for each row of q; ties by id."""
    return pd.DataFrame(dict(zip(("query_id", "snippet_id", "distance"), near_ones(qi, q, ti, t, k, skip_self, metric), strict=True)))


def near_ones(qi: np.ndarray, q: np.ndarray, ti: np.ndarray, t: np.ndarray, k: int, skip_self: bool, metric: str) -> tuple[np.ndarray, ...]:
    if metric == "cosine":
        d = np.round(np.sqrt(np.maximum(2 - 2 * (q @ t.T), 0)), 9)
    else:
        d = np.round(to_centroids(q, t), 9)
    if skip_self:
        d[qi[:, None] == ti[None, :]] = np.inf
    if k < d.shape[1]:  # all up to the kth distance, ties too
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        rows, places = np.nonzero(d <= edge)
    else:
        rows, places = np.divmod(np.arange(d.size), d.shape[1])
    order = np.lexsort((ti[places], d[rows, places], rows))
    rows, places = rows[order], places[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (rank < k) & np.isfinite(d[rows, places])
    rows, places = rows[keep], places[keep]
    return qi[rows], ti[places], d[rows, places]


def _first(found: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("query_id").orderBy("distance", "snippet_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _compact(cells: Cells) -> DataFrame:
    """The blocks in few files, which all shares of visitors read: in rows of several cells, of as many rows of the
    table as a block has at most."""

    def pack(held: list[tuple]) -> pa.RecordBatch:
        of, ids, data = zip(*held, strict=True)
        sizes = np.array([len(x) // 8 for x in ids], np.int32)
        columns = (pa.array([list(of)], pa.list_(pa.int32())), *(pa.array([b], pa.binary()) for b in (sizes.tobytes(), b"".join(ids), b"".join(data))))
        return pa.RecordBatch.from_arrays(list(columns), ["cells", "sizes", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += len(row[1]) // 8
                if held and n > BLOCK:
                    yield pack(held)
                    held, n = [], len(row[1]) // 8
                held.append(row)
        if held:
            yield pack(held)

    n = max(1, -(-int(cells.rows.sum()) // SHARE))
    by_cell = cells.blocks.repartitionByRange(n, "cell", "block").sortWithinPartitions("cell", "block").select("cell", "ids", "data")
    return materialise(by_cell.mapInArrow(run, "cells array<int>, sizes binary, ids binary, data binary"), "blocks")


def _none(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], FOUND)


def approximate(queries: DataFrame, cells: Cells, k: int, probes: int = PROBES, block: int = BLOCK, skip_self: bool = False) -> DataFrame:
    """(query_id, snippet_id, distance, rank): the k nearest rows among the probed cells."""
    if not cells.rows.any():
        return _first(_none(queries), k)
    rows = _filed(queries, cells)
    n = rows.count()
    return _first(_meet(_visitors(rows, n, cells, probes, block), n, cells, _compact(cells), k, skip_self), k)


def exact(queries: DataFrame, cells: Cells, k: int, probes: int = PROBES, block: int = BLOCK, skip_self: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The k nearest of all rows, and how many pairs of a query and a row were compared, out of
    how many."""
    if not cells.rows.any():
        return _first(_none(queries), k), {"compared": 0, "pairs": 0}
    rows, blocks = _filed(queries, cells), _compact(cells)
    n = rows.count()
    visitors = _visitors(rows, n, cells, probes, block)
    near = materialise(_first(_meet(visitors, n, cells, blocks, k, skip_self), k), "near")
    bound = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    bounded = rows.join(bound, rows["snippet_id"] == bound["query_id"], "left").select("snippet_id", "data", "home", "bound")
    more = _visitors(bounded, n, cells, probes, block)
    further = materialise(_meet(more, n, cells, blocks, k, skip_self), "further")
    compared = visitors.select("compared").unionByName(more.select("compared")).agg(F.sum("compared").alias("n")).first().n or 0
    return _first(near.drop("rank").unionByName(further), k), {"compared": compared, "pairs": int(cells.rows.sum()) * n}


def enough_probes(queries: DataFrame, cells: Cells, least: int = PROBES, recall: float = RECALL) -> int:
    """How many cells to probe so that the share `recall` of queries finds its nearest row: `least`,
    or more where a sample of queries (SAMPLE at most, picked by hash) needs more. For each of it the
    nearest row is searched exactly, and the place of its cell among the query's probes counts."""
    n = queries.count()
    mark = F.pmod(F.xxhash64("snippet_id", F.lit(11)), F.lit(1 << 30))
    share = queries.where(mark <= math.ceil((1 << 30) * min(1.0, 2 * SAMPLE / max(n, 1)))) if n > SAMPLE else queries
    some = materialise(share.select("snippet_id", "vector").orderBy(mark, "snippet_id").limit(SAMPLE), "sample")
    near = {r.query_id: r.snippet_id for r in exact(some, cells, 1)[0].select("query_id", "snippet_id").collect()}
    if not near:
        return least
    wanted = queries.sparkSession.sparkContext.broadcast(np.unique(np.fromiter(near.values(), np.int64)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, cell in zip(batch["ids"], batch["cell"], strict=True):
                yield pd.DataFrame({"snippet_id": np.intersect1d(np.frombuffer(ids, np.int64), wanted.value)}).assign(cell=cell)

    home = {r.snippet_id: r.cell for r in cells.blocks.select("ids", "cell").mapInPandas(find, "snippet_id long, cell int").collect()}
    rows = [r for r in some.collect() if r.snippet_id in near]
    order = cells.probes(prepared(pd.Series([np.array(r.vector) for r in rows]), cells.metric), len(cells.rows))
    place = np.sort((order == np.array([home[near[r.snippet_id]] for r in rows])[:, None]).argmax(axis=1)) + 1
    return max(least, int(place[math.ceil(recall * len(place)) - 1]))


def search(cells: Cells, vector: list[float], k: int, probes: int = PROBES) -> DataFrame:
    """(snippet_id, distance) of the k nearest of one vector among the probed cells: only their
    files are read."""
    x, metric = prepared(pd.Series([np.array(vector, float)]), cells.metric), cells.metric
    near = cells.blocks.where(F.col("cell").isin(cells.probes(x, probes)[0].tolist()))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ti = np.frombuffer(r.ids, np.int64)
                yield ranked(np.zeros(1, np.int64), x, ti, np.frombuffer(r.data).reshape(len(ti), -1), k, False, metric)

    found = near.select("ids", "data").mapInPandas(best, FOUND)
    return found.select("snippet_id", "distance").orderBy("distance", "snippet_id").limit(k)
