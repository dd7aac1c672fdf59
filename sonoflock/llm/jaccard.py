"""N-gram Jaccard self-join by chosen paths.

The set of a document is its different runs of five words (of fewer words: all of them).
Documents of equal sets are one class; what follows works on one set for each class.

In each run, a set of n shingles chooses those whose salted hash is below choose / n of the
range: about `choose` of them, and the same ones as a similar set does. Sets meet in the
bucket of a chosen token. A bucket with more than `small` members is split by further tokens
that its members have chosen, and so on, down to `depth` tokens; of the ways on from a path a
share of `follow` is sampled, the same for all. Sets that share a passage only part ways,
similar sets stay together. Runs are repeated with new salts until a pair at
the threshold is missed with a chance of no more than 1 - `recall`, even where it has to be
followed to full depth: the tokens that both choose are nearly Poisson distributed.

Buckets are then compared by brute force: first by the tokens that two members have chosen
(a pair at the threshold has `choose` * runs * threshold of them in common, and fewer than
`least` with a chance of some 1e-4), then by their whole sets of 64-bit shingles. A pair is looked at only in
the first bucket that it meets in, so that each link is counted once, without listing pairs.
A bucket of more than `block` members, or with very many shingles, is cut into blocks, and two
blocks at a time make a cell of bounded size; a cell gives one row for each of its members.

Groups are connected components of links, found by rounds of star operations on tables.

Defined results: words are runs of other characters than ASCII white space, with A-Z lower-
cased; null is empty; a document without words has no links and is a group of its own, and
so are all rows of null id together with what they link to (class_id is the smallest id of
the group, null if it has none); repeated rows are linked documents. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoflock.llm import textbytes
from sonoflock.llm.common import lean, materialise

WORDS, THRESHOLD = 5, 0.8
CHOOSE, DEPTH, SMALL, BLOCK, LEAST, FOLLOW = 6, 3, 32, 2000, 6, 0.6
#: Shingles of the sets in a block at most (but for a single larger set), about 8 MB.
BLOCK_SHINGLES = 1_000_000
#: The run is kept in the lowest bits of a token.
RUN_BITS = 4
SKETCH = "doc_id long, key binary, n int, pool array<long>"


def runs_for(
    recall: float, choose: int = CHOOSE, depth: int = DEPTH, threshold: float = THRESHOLD, follow: float = FOLLOW
) -> int:
    """Runs after which a pair at the threshold, followed to full depth, has met in one with the
    chance `recall`. Sets with k tokens in common meet if one of the paths of `depth` of them is
    followed; the chance is estimated by trials from a fixed seed."""
    common, rng, trials = choose * threshold, np.random.default_rng(1), 2000
    miss = 0.0
    for k in range(4 * choose):
        alive = np.ones((trials, k), bool)  # whether a path ends at each token
        for _ in range(depth - 1):
            # a path to token j goes on from one to an earlier token i
            step = np.zeros((trials, k), bool)
            for j in range(k):
                step[:, j] = (alive[:, :j] & (rng.random((trials, j)) < follow)).any(axis=1)
            alive = step
        miss += math.exp(-common) * common**k / math.factorial(k) * (1 - alive.any(axis=1).mean())
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(miss)))
    if runs > 1 << RUN_BITS:
        raise ValueError(f"a recall of {recall} takes {runs} runs; {1 << RUN_BITS} is the most")
    return runs


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, texts, text index, shingle) of each piece: the sets, sorted by text."""
    for words in textbytes.pieces(column, textbytes.BLANK, fold=True):
        hashes, counts = words.hashes(), words.counts()
        of, grams = words.text_of(), textbytes.windows(hashes, width)
        whole = textbytes.whole_windows(words, width)
        texts, shingles = [of[: len(grams)][whole]], [grams[whole]]
        for t in np.flatnonzero((counts > 0) & (counts < width)).tolist():
            few = hashes[words.first[t] : words.first[t + 1]]
            texts.append(np.array([t]))
            shingles.append(textbytes.windows(few, len(few)) ^ np.uint64(len(few)))
        t, s = np.concatenate(texts), np.concatenate(shingles)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        yield words.first_row, words.texts, t[new], s[new]


def keys_of(texts: int, t: np.ndarray, s: np.ndarray) -> tuple[list[bytes | None], np.ndarray]:
    """A 128-bit name of each set (None: empty), and the sets' sizes."""
    n = np.bincount(t, minlength=texts)
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64)
    keys: list[bytes | None] = [None] * texts
    if len(some):
        a = np.add.reduceat(textbytes.mix(s), first)
        b = np.add.reduceat(textbytes.mix(s ^ np.uint64(0xD1B54A32D192ED03)), first)
        raw = np.stack([a, b + n[some].astype(np.uint64)], axis=1)
        for k, i in enumerate(some.tolist()):
            keys[i] = raw[k].tobytes()
    return keys, n


def sketches(docs: DataFrame, width: int, choose: int, runs: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, texts, t, s in shingle_sets(batch.column("text"), width):
                keys, n = keys_of(texts, t, s)
                limit = np.minimum(choose / np.maximum(n, 1), 1.0)[t]
                at, tokens = [], []
                for r in range(runs):
                    h = textbytes.mix(s ^ np.uint64((r + 1) * 0x9FB21C651E98DF25 & ((1 << 64) - 1)))
                    k = np.flatnonzero((h >> np.uint64(11)).astype(np.float64) / 2.0**53 < limit)
                    at.append(t[k])
                    tokens.append(h[k] >> np.uint64(RUN_BITS) << np.uint64(RUN_BITS) | np.uint64(r))
                at, tokens = np.concatenate(at), np.concatenate(tokens)
                order = np.argsort(at, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=texts))]).astype(np.int32)
                pools = pa.ListArray.from_arrays(offsets, pa.array(tokens[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, texts), pa.array(keys, pa.binary()), pa.array(n.astype(np.int32)), pools],
                    ["doc_id", "key", "n", "pool"],
                )

    return docs.mapInArrow(lean(sketch), SKETCH)


def leaves(classes: DataFrame, depth: int, small: int, follow: float) -> DataFrame:
    """(path, size, weight, key): the buckets that aren't split further, of two members or more,
    with the number of members and of all their shingles."""
    pools = classes.select("key", "pool")
    level = classes.select(F.explode("pool").alias("path"), "key", "n")  # a path of one token is the token
    out = None
    for k in range(1, depth + 1):
        rows = materialise(level, f"paths-{k}")
        sizes = materialise(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1"), f"sizes-{k}")
        met = rows.join(sizes.hint("merge"), "path")
        leaf = met if k == depth else met.where(F.col("size") <= small)
        leaf = leaf.select("path", "size", "weight", "key")
        out = leaf if out is None else out.unionByName(leaf)
        if k == depth or sizes.where(F.col("size") > small).isEmpty():
            break
        last = F.col("last") if k > 1 else F.col("path")
        large = met.where(F.col("size") > small).select("path", last.alias("last"), "key", "n")
        level = (
            large.join(pools.hint("merge"), "key")
            .select("path", "last", "key", "n", F.explode("pool").alias("token"))
            .where("token > last and (token & {0}) = (last & {0})".format((1 << RUN_BITS) - 1))
            .where(F.pmod(F.xxhash64("token", "path"), F.lit(1000)) < int(1000 * follow))
            .select(F.xxhash64("path", "token").alias("path"), F.col("token").alias("last"), "key", "n")
        )
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """The sizes of the intersections of each list on the left with each on the right (lists
    without repeats), by products of slices of 0-1 matrices; values of one list are left out."""
    same = left is right
    every = left if same else [*left, *right]
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    values, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    often = count > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(often.sum()), chunk):
        i, j = np.searchsorted(column, [a, a + chunk])
        m = np.zeros((len(every), chunk), np.float32)
        m[row[i:j], column[i:j] - a] = 1
        out += m @ m.T if same else m[: len(left)] @ m[len(left) :].T
    return out


def pairs_here(
    path: int, left: np.ndarray, right: np.ndarray, paths: list[np.ndarray], n: np.ndarray, threshold: float
) -> np.ndarray:
    """Which pairs of a cell (members on the left x on the right) are to be looked at here: of
    two members, of sizes that allow the threshold, and not met before by a smaller path."""
    a, b = n[left].astype(np.float32)[:, None], n[right].astype(np.float32)[None, :]
    ok = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-4
    ok &= left[:, None] != right[None, :]
    if ok.any():
        earlier = [p[p < path] for p in paths]
        ok &= cross(earlier, left, right) == 0
    return ok


def sides_of(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The members on the left and on the right: all and all in a cell of one block."""
    side = cell.column("side").to_numpy()
    if (side == side[0]).all():
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])


def cross(values: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    first = [values[i] for i in left]
    return overlaps(first, first if left is right else [values[i] for i in right])


def n_blocks(block: int) -> Column:
    """Into how many blocks a leaf is cut, by its members and by their shingles."""
    return F.ceil(F.greatest(F.col("size") / block, F.col("weight") / BLOCK_SHINGLES)).cast("int")


def cells(leaf: DataFrame, block: int) -> DataFrame:
    """(cell, path, side, key): leaves cut into blocks, two blocks at a time."""
    blocks = n_blocks(block)
    mine = F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")
    # in the cell of one block with itself all are of side 0; a bucket of two blocks or more
    # has a cell for each block and for each two blocks
    cut = leaf.withColumn("blocks", blocks).withColumn("mine", mine)
    spread = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return spread.select(F.xxhash64("path", low, high).alias("cell"), "path", side.cast("int").alias("side"), "key")


def by_cell(rows: pa.Table) -> Iterator[list[dict]]:
    """The members of each cell of a table that holds whole cells."""
    rows = rows.sort_by([("cell", "ascending"), ("key", "ascending")])
    cell = rows.column("cell").to_numpy()
    cuts = np.flatnonzero(np.diff(cell)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
        if b - a > 1:
            yield rows.slice(a, b - a)


def lists(column: pa.ChunkedArray, kind=np.int64) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a - offsets[0] : b - offsets[0]].astype(kind) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = 0.999,
    choose: int = CHOOSE,
    depth: int = DEPTH,
    follow: float = FOLLOW,
    small: int = SMALL,
    block: int = BLOCK,
    least: int = LEAST,
    rows_per_task: int = 5_000,
    shingles_per_task: int = 2_000_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (doc_id, key), classes (key, rep, copies, n) and found (key, root, n_links):
    for each class with links a class that it is linked to, at some steps, and the number of
    documents of other classes linked to it; a class can have several rows."""
    runs = runs_for(recall, choose, depth, threshold, follow)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialise(sketches(read, width, choose, runs), "sketches")
    members = sketched.select("doc_id", "key")
    classes = materialise(
        sketched.where("key is not null")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("pool").alias("pool"),
        ),
        "classes",
    )
    leaf = materialise(leaves(classes, depth, small, follow), "leaves")
    paths = leaf.groupBy("key").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    known = materialise(paths.join(classes.hint("merge"), "key"), "known")

    def tasks(n_rows: int) -> int:
        return max(1, -(-n_rows // rows_per_task))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        keep = [rows.schema.empty_table().select(["cell", "path", "side", "key", "n"])]
        for cell in by_cell(rows):
            n, (left, right) = cell.column("n").to_numpy(), sides_of(cell)
            ok = pairs_here(cell.column("path")[0].as_py(), left, right, lists(cell.column("paths")), n, threshold)
            if ok.any():
                enough = np.minimum(least, 0.6 * runs * np.minimum(n[left][:, None], n[right][None, :]))
                ok &= cross(lists(cell.column("pool")), left, right) >= enough
                near = np.zeros(len(n), bool)
                near[left[ok.any(axis=1)]] = near[right[ok.any(axis=0)]] = True
                if near.any():
                    keep.append(cell.filter(pa.array(near)).select(["cell", "path", "side", "key", "n"]))
        return pa.concat_tables(keep)

    cut = cells(leaf, block)
    n_cut = leaf.select(F.sum(n_blocks(block))).first()[0] or 0
    near = cut.join(known.select("key", "n", "pool", "paths").hint("merge"), "key")
    near = near.withColumn("task", F.pmod("cell", F.lit(tasks(n_cut))))
    kept = materialise(
        near.groupBy("task").applyInArrow(lean(compare), "cell long, path long, side int, key binary, n int"), "candidates"
    )

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts, t, s in shingle_sets(batch.column("text"), width):
                keys, n = keys_of(texts, t, s)
                cut = np.concatenate([[0], np.cumsum(n)])
                sets = [s[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])

    wanted = materialise(
        kept.select("key").distinct().join(known.select("key", "rep", "n", "copies", "paths").hint("merge"), "key"), "wanted"
    )
    texts = read.join(
        wanted.select(F.col("rep").alias("r")).distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("r")), "left_semi"
    )
    sets = texts.select("text").mapInArrow(lean(read_sets), "key binary, set binary")
    sets = sets.where("key is not null").groupBy("key").agg(F.first("set").alias("set"))
    wanted_sets = materialise(wanted.drop("rep").join(sets, "key"), "sets")

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for cell in by_cell(rows):
            sets = [np.frombuffer(x, np.uint64) for x in cell.column("set").to_pylist()]
            n = np.array([len(x) for x in sets])
            copies, keys = cell.column("copies").to_numpy(), cell.column("key").to_pylist()
            left, right = sides_of(cell)
            ok = pairs_here(cell.column("path")[0].as_py(), left, right, lists(cell.column("paths")), n, threshold)
            common = cross(sets, left, right)
            ok &= common >= threshold * (n[left][:, None] + n[right][None, :] - common) - 1e-4
            label, n_links = np.arange(len(n)), np.zeros(len(n), np.int64)
            n_links[left] += ok @ copies[right]
            if left is not right:
                n_links[right] += copies[left] @ ok
            while True:
                new = label.copy()
                new[left] = np.minimum(new[left], np.where(ok, label[right][None, :], len(n)).min(axis=1))
                new[right] = np.minimum(new[right], np.where(ok, new[left][:, None], len(n)).min(axis=0))
                if (new == label).all():
                    break
                label = new
            out += [(keys[i], keys[label[i]], int(n_links[i])) for i in np.flatnonzero(n_links).tolist()]
        kinds = [pa.binary(), pa.binary(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)]
        return pa.table(columns, ["key", "root", "n_links"])

    final = kept.drop("n").join(wanted_sets.hint("merge"), "key")
    members_in, shingles_in = kept.select(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_tasks = max(tasks(members_in), -(-shingles_in // shingles_per_task))
    final = final.withColumn("task", F.pmod("cell", F.lit(n_tasks)))
    found = materialise(final.groupBy("task").applyInArrow(lean(verify), "key binary, root binary, n_links long"), "links")
    return members, classes.drop("pool"), found


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(key, root) from edges (u, v): root is the smallest key of the connected component.
    Large-star and small-star by turns, until nothing changes."""

    def star(e: DataFrame, large: bool, name: str) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        if not large:
            both = both.where("v < u")
        both = materialise(both, f"{name}-neighbours")
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        met = both.join(least.hint("merge"), "u")
        if large:
            new = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return materialise(new.where("u != v").distinct(), name)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(edges.where("u != v").distinct(), "edges")
    now = mark(edges)
    for _ in range(most_rounds):
        edges = star(star(edges, True, "large-star"), False, "small-star")
        before, now = now, mark(edges)
        if now == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    raise RuntimeError("the components didn't settle")


def groups(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, class_id, copies, n_links) for every row of docs: the smallest doc_id of its
    group, the number of rows with its set, and the number of other rows that it is linked to."""
    members, classes, found = links(docs, **params)
    roots = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    n_links = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    rooted = classes.join(roots, "key", "left").join(n_links, "key", "left")
    rooted = materialise(
        rooted.select("key", F.coalesce("root", "key").alias("root"), "rep", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "rooted",
    )
    smallest = materialise(rooted.groupBy("root").agg(F.min("rep").alias("class_id")), "smallest")
    named = materialise(rooted.join(smallest.hint("merge"), "root").drop("root", "rep"), "named")
    whole = members.where("key is not null").join(named.hint("merge"), "key")
    empty = members.where("key is null")
    return whole.select(
        "doc_id", "class_id", "copies", (F.col("copies") - 1 + F.col("n_links")).alias("n_links")
    ).unionByName(
        empty.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    )
