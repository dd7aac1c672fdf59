"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. Documents are streamed
through it word by word; the longest match that ends at a word says whether one of the item
windows ends there, and all words of such a window are hit. Only runs of words that all occur
in some item can hold a window, so the other words needn't be walked one by one.

The items are written to shared files in blocks of about `block_words` words, each with an
automaton of its own. With one block, as test sets are small beside the corpus, each worker
process builds the automaton once and keeps it. With more, a task takes `held_bytes` of
documents at a time through one block after another, so that it never holds two automata,
however many items there are; an automaton is then built for each block and `held_bytes`.

Defined results: null has no words; an item without words never occurs; an item of fewer
words than the window is one window as a whole; repeated items count by their ids; items of
null id hit words, count as one item, and aren't named in items_sha256; a document of few or
no words is never crashed on; with no items nothing is hit. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoflock.llm import textbytes
from sonoflock.llm.common import LOWER, UPPER, filesystem, lean, scratch_path, worker_keeps

WINDOW = 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words before lower-casing.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLDED = str.maketrans(UPPER, LOWER)
BLOCK_WORDS = 200_000
HELD_BYTES = 1 << 26


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(FOLDED))


class Automaton:
    """A generalised suffix automaton over words. State 0 is the root."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.ids = [name for name, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, set[int]] = {}  # items of fewer words than the window, by state
        self.holds: dict[int, set[int]] = {}  # items that hold the window-long string of a state
        for k, (_, words) in enumerate(items):
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            state = 0
            for code in codes:
                state = self._extend(state, code)
        # the automaton is whole now: walk each item again to note where its windows end
        for k, (_, words) in enumerate(items):
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][self.vocabulary[w]]
                if i + 1 >= window:
                    self.holds.setdefault(self._at_window(state), set()).add(k)
            if 0 < len(words) < window:
                self.whole.setdefault(state, set()).add(k)
        self.shortest = min([window, *(len(w) for _, w in items if w)])

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:  # the string is there already, from an earlier item
            q = self.next[last][code]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, code, q)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][code]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, code, q)
        return state

    def _split(self, p: int, code: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = copy
            p = self.link[p]
        return copy

    def _at_window(self, state: int) -> int:
        """The state of the last `window` words of a state's strings."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word: matching statistics."""
        state, length = 0, 0
        for code in codes:
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if code in self.next[state]:
                state = self.next[state][code]
                length += 1
            yield state, length

    def hits(self, codes: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, length, items) of each window that occurs."""
        for i, (state, length) in enumerate(self.matches(codes)):
            if length >= self.window:
                state = self._at_window(state)
                yield i + 1, self.window, self.holds[state]
                state = self.link[state]
            elif self.length[state] > length:  # part of a state's strings: shorter than its own
                state = self.link[state]
            while state > 0:
                if state in self.whole:
                    yield i + 1, self.length[state], self.whole[state]
                state = self.link[state]


class Matcher:
    """An automaton with its words' hashes, to find where to walk it."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.automaton = Automaton(items, window)
        words = list(self.automaton.vocabulary)
        column = pa.array(words, pa.large_string())
        data, offsets = textbytes.buffers(column)
        self.seed = 0
        while True:  # under some seed the item words' hashes all differ
            hashes = textbytes.span_hashes(data, offsets[:-1], offsets[1:], self.seed)
            if len(np.unique(hashes)) == len(hashes):
                break
            self.seed += 1
        order = np.argsort(hashes)
        self.hashes, self.codes, self.words = hashes[order], order, [w.encode() for w in words]

    def find(self, words: textbytes.Words) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, end, items) of windows that occur, as indexes into words."""
        if not len(self.hashes):
            return
        hashes = textbytes.span_hashes(words.data, words.start, words.end, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        # runs of known words within one text, of the shortest window's length at least
        inner = np.ones(len(known), dtype=bool)
        inner[words.first[:-1][words.first[:-1] < len(known)]] = False
        joined = known[1:] & known[:-1] & inner[1:]
        starts = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        ends = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = ends - starts >= self.automaton.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            codes = self.codes[at[a:b]].tolist()
            # words are told apart by their bytes, not by hashes alone
            codes = [c if self.words[c] == words.word(a + i) else -1 for i, c in enumerate(codes)]
            for end, length, items in self.automaton.hits(codes):
                yield a + end - length, a + end, items


class Items:
    """The items on shared files, in blocks."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
        rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
        n_words = rows.select(F.sum(F.regexp_count("t", F.lit(ANY_CASE)))).first()[0] or 0
        self.n_blocks, self.window = max(1, -(-n_words // block_words)), window
        self.path = scratch_path(benchmark.sparkSession, "items")
        block = F.pmod(F.xxhash64("t", "id"), F.lit(self.n_blocks))
        rows.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(self.path)

    def _block(self, k: int) -> Matcher:
        fs, name = filesystem(f"{self.path}/block={k}")
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            return Matcher([], self.window)
        rows = pq.read_table(name, columns=["id", "t"], filesystem=fs, partitioning=None).to_pylist()
        return Matcher([(r["id"], item_words(r["t"])) for r in rows], self.window)

    @property
    def kept(self) -> str:
        return f"items {self.path}"

    def matchers(self) -> Iterator[Matcher]:
        if self.n_blocks == 1:
            yield worker_keeps(self.kept, lambda: self._block(0))
        else:
            for k in range(self.n_blocks):
                yield self._block(k)

    def in_turns(self, batches: Iterator[pa.RecordBatch], held_bytes: int) -> Iterator[list[pa.RecordBatch]]:
        """The batches to be taken through all blocks together."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if self.n_blocks == 1 or sum(b.nbytes for b in held) >= held_bytes:
                yield held
                held = []
        if held:
            yield held

    def found_in(self, columns: list[pa.Array]) -> tuple[list[np.ndarray], dict[tuple[int, int], tuple[np.ndarray, set]]]:
        """The numbers of words of all texts, and for (column, row) with hits the maximal hit
        spans, first and last-plus-one word of each, and the ids of the items."""
        n_words = [np.zeros(len(c), np.int64) for c in columns]
        spans: dict[tuple[int, int], list[np.ndarray]] = {}
        items: dict[tuple[int, int], set] = {}
        for m in self.matchers():
            for c, column in enumerate(columns):
                for words in textbytes.pieces(column, textbytes.NOT_ALNUM, fold=True):
                    row, of = words.first_row, words.text_of()
                    n_words[c][row : row + words.texts] = words.counts()
                    hit = np.zeros(len(of) + 1, np.int64)
                    for a, b, found in m.find(words):
                        hit[a] += 1
                        hit[b] -= 1
                        items.setdefault((c, row + int(of[a])), set()).update(m.automaton.ids[k] for k in found)
                    covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                    text, place = of[covered], covered - words.first[of[covered]]
                    cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(place) != 1)) + 1
                    for part in np.split(np.arange(len(covered)), cuts) if len(covered) else ():
                        span = (place[part[0]], place[part[-1]] + 1)
                        spans.setdefault((c, row + int(text[part[0]])), []).append(span)
        return n_words, {k: (join(v), items[k]) for k, v in spans.items()}


def join(spans: list[tuple[int, int]]) -> np.ndarray:
    """Spans as maximal ones, in order."""
    x = np.array(sorted(spans), np.int64)
    end = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.append(True, x[1:, 0] > end[:-1]))
    return np.stack([x[new, 0], np.append(end[new[1:] - 1], end[-1])], axis=1)


def spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """For each document: doc_id, n_words, starts and ends (first and last-plus-one word of
    maximal hit spans), items (ids, sorted, null last)."""
    shared = Items(benchmark, item_id_col, item_text_col, window, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shared.in_turns(batches, held_bytes):
            n_words, found = shared.found_in([b.column("text") for b in held])
            for c, batch in enumerate(held):
                hits = [found.get((c, i), (np.zeros((0, 2), np.int64), set())) for i in range(batch.num_rows)]
                columns = [
                    batch.column("doc_id"),
                    pa.array(n_words[c]),
                    pa.array([x[:, 0] for x, _ in hits], pa.list_(pa.int64())),
                    pa.array([x[:, 1] for x, _ in hits], pa.list_(pa.int64())),
                    pa.array([sorted(x, key=lambda i: (i is None, i or "")) for _, x in hits], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "starts", "ends", "items"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(
        lean(scan, shared.kept), f"doc_id {kind}, n_words long, starts array<long>, ends array<long>, items array<string>"
    )


def report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = spans(docs, benchmark, **params)
    n_hit = F.expr("aggregate(zip_with(ends, starts, (b, a) -> b - a), 0L, (x, y) -> x + y)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without(text: str, spans: np.ndarray) -> str:
    """A text without the words of spans."""
    (words,) = textbytes.pieces(pa.array([text]), textbytes.NOT_ALNUM, fold=True)
    raw, out, at = text.encode(), [], 0
    for a, b in spans.tolist():
        out.append(raw[at : words.start[a]])
        at = int(words.end[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    most_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """docs, all columns, with hit words cut out of the text. A document of which more than
    `most_coverage` is hit goes. A text without hits stays as it is, to the byte."""
    shared = Items(benchmark, item_id_col, item_text_col, window, block_words)
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shared.in_turns(batches, held_bytes):
            n_words, found = shared.found_in([b.column(place) for b in held])
            for c, batch in enumerate(held):
                mine = {i: x for (k, i), (x, _) in found.items() if k == c}
                if mine:
                    gone = {i for i, x in mine.items() if (x[:, 1] - x[:, 0]).sum() > most_coverage * n_words[c][i]}
                    texts = batch.column(place).to_pylist()
                    values = [without(t, mine[i]) if i in mine and i not in gone else t for i, t in enumerate(texts)]
                    columns = [pa.array(values, x.type) if i == place else x for i, x in enumerate(batch.columns)]
                    keep = pa.array([i not in gone for i in range(batch.num_rows)])
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)
                yield batch

    return docs.mapInArrow(lean(cut, shared.kept), docs.schema)
