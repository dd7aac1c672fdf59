"""Substring dedup: passages that a document with a smaller id has are cut out.

A word goes if it lies in a run of `width` consecutive words that also occurs in a document of
smaller id, judged on the texts as they come. What is cut is found by suffix automata: the
automaton of a document's reference passages is built, the document is streamed through it,
and all words of matches of at least `width` words are marked. This is exact, word by word.

To send every document through automata of the whole corpus takes work that grows with the
square of it. So each document gets the passages that it can match, and no others:

1. Each task hashes the windows of its documents. Of equal windows within a batch all but
   those of the smallest id are known to be repeats at once; the rest go, packed, to the owner
   of their hash, so that a window with a third of all rows is one entry for each batch. A
   message holds the documents whose windows it carries, and there is none without a window.
2. The owner of a range of hashes finds the smallest id for each and names it to the others.
3. What a document is told is put together: runs of windows with one origin are one passage.
4. Each different passage is cut once from its origin's text, however many documents were told
   of it, and sent to them; Spark splits a passage that very many want (adaptive execution).
   Windows are matched by 96 bits of hashes; equal hashes of different windows can't remove
   anything, they could only hide a repeat: among 10**13 windows the chance that any two of
   different words agree is below 0.001.

Defined results: null text has no words; rows of null id stay whole and no other is cut for
their sake; rows of equal id aren't smaller than one another; repeated windows within one
document stay; empty tables give no rows. Words are runs of other characters than ASCII white
space, unchanged. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoflock.llm import textbytes
from sonoflock.llm.common import lean, materialise
from sonoflock.llm.decontam import Automaton
from sonoflock.llm.packing import pack, small, unpack

WIDTH = 13
BATCH_WORDS = 1_000_000
SHARD_BYTES = 12_000_000
SENT = "to int, ids binary, doc binary, keys binary, checks binary, place binary, origin binary, origin_place binary"
CUT = "o long, at int, n int, passage string"
RUNS = "d long, o long, at int, n int"


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    named = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named]
    )


def messages(d: np.ndarray, place: np.ndarray, o: np.ndarray, o_place: np.ndarray, parts: int) -> list[tuple]:
    """Rows that tell documents d that their window at `place` is that of o at `o_place`."""
    to = (textbytes.mix(d.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((place, d, to))
    d, place, o, o_place, to = (x[order] for x in (d, place, o, o_place, to))
    cuts = np.searchsorted(to, np.arange(parts + 1))
    out = []
    for k in range(parts):
        s = slice(cuts[k], cuts[k + 1])
        if s.start < s.stop:
            empty = pack(np.zeros(0, np.int64))
            out.append((k, pack(d[s]), empty, empty, empty, pack(small(place[s])), pack(o[s]), pack(small(o_place[s]))))
    return out


def passages(docs: DataFrame, width: int, batch_words: int, shard_bytes: int) -> DataFrame:
    """(d, o, at, n): document d holds the n windows of document o from its at-th word on."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_docs = n_words = 0

        def flush() -> pa.RecordBatch:
            ids, first, h, check, place, of = (np.concatenate(x) for x in zip(*held, strict=True))
            place -= first[of]
            d = ids[of]
            order = np.lexsort((place, d, check, h))
            h, check, d, place, of = (x[order] for x in (h, check, d, place, of))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
            repeat = d > d[head]
            k, src = np.flatnonzero(repeat), head[repeat]
            rows = [
                (shards + r[0], *r[1:])
                for r in messages(d[k], place[k], d[src], place[src], shards)
            ]
            keep = ~repeat
            h, check, place, of = h[keep], check[keep], place[keep], of[keep]
            to = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            empty = pack(np.zeros(0, np.int64))
            some, cuts = np.unique(to, return_index=True)  # h is sorted, so are the owners
            for s, a, b in zip(some.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True):
                here, doc = np.unique(of[a:b], return_inverse=True)
                ids_here = pack(np.diff(ids[here], prepend=0))
                rows.append((s, ids_here, pack(small(doc)), pack(h[a:b]), pack(check[a:b]), pack(small(place[a:b])), empty, empty))
            return table_of(rows, SENT)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for words in textbytes.pieces(batch.column("text"), textbytes.BLANK):
                whole = textbytes.whole_windows(words, width)
                names = words.hashes()
                h = textbytes.windows(names, width)[whole]
                check = (textbytes.windows(textbytes.mix(names), width)[whole] >> np.uint64(32)).astype(np.uint32)
                of = words.text_of()[: len(whole)][whole]
                rows = slice(words.first_row, words.first_row + words.texts)
                place = np.flatnonzero(whole) + n_words
                held.append((doc_ids[rows].astype(np.int64), words.first[:-1] + n_words, h, check, place, of + n_docs))
                n_docs += words.texts
                n_words += len(words.start)
                if n_words >= batch_words:
                    yield flush()
                    held, n_docs, n_words = [], 0, 0
        if held:
            yield flush()

    def own(key: tuple, rows: pa.Table) -> pa.Table:
        to = int(key[0].as_py())
        if to >= shards:  # known already: pass on
            return rows.set_column(0, "to", pa.array(np.full(rows.num_rows, to - shards, np.int32)))
        h, check, d, place = [], [], [], []
        for r in rows.to_pylist():
            h.append(unpack(r["keys"]))
            check.append(unpack(r["checks"]))
            d.append(np.cumsum(unpack(r["ids"]))[unpack(r["doc"])])
            place.append(unpack(r["place"]).astype(np.int64))
        h, check, d, place = (np.concatenate(x) for x in (h, check, d, place))
        order = np.lexsort((place, d, check, h))
        h, check, d, place = (x[order] for x in (h, check, d, place))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        k = np.flatnonzero(d > d[head])
        return pa.Table.from_batches([table_of(messages(d[k], place[k], d[head[k]], place[head[k]], shards), SENT)])

    def put_together(key: tuple, rows: pa.Table) -> pa.Table:
        told = rows.to_pylist()
        d, place, o, o_place = (
            np.concatenate([unpack(r[c]).astype(np.int64) for r in told]) for c in ("ids", "place", "origin", "origin_place")
        )
        order = np.lexsort((o_place, o, d))
        d, o, o_place = d[order], o[order], o_place[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (o_place[1:] > o_place[:-1] + 1)
        at = np.flatnonzero(new)
        n = np.maximum.reduceat(o_place, at) - o_place[at] + 1
        d, o, start = d[at], o[at], o_place[at]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(x.astype(np.int64), pa.int64()).cast(t) for x, t in zip((d, o, start, n), kinds, strict=True)], ["d", "o", "at", "n"])

    told = docs.mapInArrow(lean(send), SENT).groupBy("to").applyInArrow(lean(own), SENT)
    return told.groupBy("to").applyInArrow(lean(put_together), RUNS)


def covered(words: list[bytes], references: list[str], width: int) -> np.ndarray:
    """Which words lie in a match of at least `width` words with one of the passages."""
    automaton = Automaton([("", p.split(" ")) for p in references], width)
    codes = [automaton.vocabulary.get(w.decode(), -1) for w in words]
    hit = np.zeros(len(words) + 1, np.int64)
    for end, (_, length) in enumerate(automaton.matches(codes), 1):
        if length >= width:
            hit[end - length] += 1
            hit[end] -= 1
    return np.cumsum(hit[:-1]) > 0


def kept_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    batch_words: int = BATCH_WORDS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: kept is the words that stay, joined by
    single blanks."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = read.where("doc_id is not null")
    told = materialise(passages(named, width, batch_words, shard_bytes), "passages")

    def cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, cuts = batch.column("text"), batch.column("cuts").to_pylist()
            for k, (o, some) in enumerate(zip(batch.column("o").to_pylist(), cuts, strict=True)):
                words = (texts[k].as_py() or "").encode().split()
                # of rows that share the id o each has passages of its own
                ends = [(c["at"], c["n"], c["at"] + c["n"] + width - 1) for c in some]
                rows += [(o, at, n, b" ".join(words[at:end]).decode()) for at, n, end in ends if end <= len(words)]
            yield table_of(rows, CUT)

    wanted = told.groupBy("o").agg(F.collect_set(F.struct("at", "n")).alias("cuts"))
    origins = named.join(wanted.hint("merge"), F.col("doc_id") == F.col("o")).select("o", "cuts", "text")
    cut = origins.mapInArrow(lean(cut_passages), CUT)
    references = told.join(cut.hint("merge"), ["o", "at", "n"]).groupBy("d").agg(F.collect_set("passage").alias("references"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, refs in zip(batch.column("text"), batch.column("references").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = covered(words, refs, width) if refs else None
                kept = words if gone is None else list(compress(words, ~gone))
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            n, removed, kept = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    met = named.join(references.hint("merge"), F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "references")
    rest = read.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<string>").alias("references"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return met.mapInArrow(lean(remove), schema).unionByName(rest.mapInArrow(lean(remove), schema))


def report(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs."""
    found = kept_words(docs, **params)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

