"""Periodic runs of words, found from Lyndon words in linear time.

A run is a stretch of words with a smallest period that can't be extended on either side. For
each run one of two orders of the words, one the reverse of the other, makes some stretch of one
period the longest Lyndon word from its place on (the end of the text is smaller than all words
in both). So for each order the next smaller suffix of every place is computed, left to right
over the chain of previous smaller suffixes: a suffix that is greater than the new one leaves
the chain. Words are compared as ranks among the document's own sorted words.

Suffixes that begin alike are compared by extension. What has been matched is used again in two
ways: along a chain the extensions of neighbours tell that of the next pair, and left of the
rightmost place matched so far a pair has the extension of its mirror image, which was stored
when that pair was met. Only beyond that place words are compared one by one, so their number
stays in proportion to the text. No suffix array, tree or hash is built.

Where the extension of a Lyndon word and its copy goes on long enough, a backward match of less
than a period gives the run's start. Each document is searched by itself, where Spark has read it.

Defined results: null text has no words; a null doc_id counts as an empty id where `periodic`
takes a hash of it; repeated rows each have their result; empty tables give none. A document
without a run has n_runs 0, nulls for the best run and the hash of no text. Extra columns are
ignored, whatever their names. A text of n words takes some 300 n bytes while it is searched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoflock.llm.common import lean

LEAST_WORDS, LEAST_EXPONENT = 6, 4
REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)
_NAMES = [c.split()[0] for c in REPORT.split(", ")]
_KINDS = [pa.string() if c.endswith("string") else pa.int64() for c in REPORT.split(", ")]


def next_smaller(w: list[int], n: int) -> tuple[list[int], list[int]]:
    """For each of the n places the place of the next smaller suffix (n if there is none), and
    how far the two suffixes match. w has one more item at its end, smaller than all others."""
    after, reach = [n] * n, [0] * n
    before, back = [-1] * n, [0] * n  # the previous smaller suffix, and how far it matches
    # the match that ends rightmost: w[right:end] == w[left:left + end - right]
    left = right = end = 0
    for r in range(1, n):
        c, i = w[r], r - 1
        while True:
            x = w[i]  # w[-1] is the smallest item: the chain's end
            if x > c:
                after[i] = r
                i = before[i]
            elif x < c:
                before[r] = i
                break
            else:
                k = 1
                while True:
                    # the extension of (i, r), which is k at least
                    if r + k < end:
                        q, known = r - right + left, -1
                        if i >= right:
                            m = i - right + left
                            if after[m] == q:
                                known = reach[m]
                            elif before[q] == m:
                                known = back[q]
                        if known < 0 and before[q] == i:
                            known = back[q]
                        if known >= 0:
                            k = known if known < end - r else end - r
                        if known < 0 or r + k == end:
                            while w[i + k] == w[r + k]:
                                k += 1
                    else:
                        while w[i + k] == w[r + k]:
                            k += 1
                    if r + k > end:
                        left, right, end = i, r, r + k
                    if w[i + k] < w[r + k]:
                        before[r], back[r] = i, k
                        break
                    after[i], reach[i] = r, k
                    # along the chain: a longer match of the next with this one leaves k as it
                    # is and the next is greater too; a shorter one makes the next smaller
                    b, i = back[i], before[i]
                    while i >= 0 and b > k:
                        after[i], reach[i] = r, k
                        b, i = back[i], before[i]
                    if i < 0 or b < k:
                        before[r] = i
                        back[r] = b if i >= 0 else 0
                        break
                break
    return after, reach


def runs(ranks: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least so many words and periods (2 or more),
    ordered by start, then period. ranks: whole numbers, equal for equal words only."""
    n = len(ranks)
    if n < max(least_words, 2):
        return []
    low = ranks.astype(np.int64) - int(ranks.min()) + 1
    found = set()
    for order in (low, int(low.max()) + 1 - low):
        w = [*order.tolist(), 0]
        after, reach = (np.array(x, np.int64) for x in next_smaller(w, n))
        at = np.arange(n)
        period = after - at
        # a run's first such Lyndon word starts within its first period, so less than a period
        # lies before it; the later ones are copies of the one before
        good = reach > (least_exponent - 2) * period
        i = np.flatnonzero(good)
        j = np.maximum(i - period[i], 0)
        first = (i < period[i]) | (after[j] != i) | (reach[j] < period[i])
        for s in i[first].tolist():
            p, start = int(period[s]), s
            while start and w[start - 1] == w[start - 1 + p]:
                start -= 1
            length = s + p + int(reach[s]) - start
            if length >= max(least_words, least_exponent * p):
                found.add((start, length, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def ranked(words: list[bytes]) -> np.ndarray:
    """The rank of each word among the different words, by their bytes."""
    rank = {x: k for k, x in enumerate(sorted(set(words)))}
    return np.fromiter(map(rank.__getitem__, words), np.int64, len(words))


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def best_run(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties by start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by a hash of its id, repeats itself from some word on."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def describe(doc_id: int | None, words: list[bytes], least_words: int, least_exponent: int) -> tuple:
    """A row of report()."""
    found = runs(ranked(words), least_words, least_exponent)
    best = best_run(found)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    n_kept = len(words)
    if found:
        stay = collapsed(len(words), found)
        n_kept = int(stay.sum())
        kept = b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])
    else:
        kept = b" ".join(words)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    hashes = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    return doc_id, len(found), *top, *hashes, len(words), len(words) - n_kept


def report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_exponent: int = LEAST_EXPONENT,
    planted: bool = False,
) -> DataFrame:
    """One row for each document: its best run, digests of all its runs and of the words that
    stay. planted: the words go through periodic() first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                # split() cuts bytes at exactly the separators \x20 and \x09 to \x0D
                words = (text.as_py() or b"").split()
                rows.append(describe(doc_id, periodic(words, doc_id) if planted else words, least_words, least_exponent))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(find), REPORT)


def collapse(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """docs with each repeated stretch cut down to its first period. A text without a run stays
    as it is; of others the kept words are joined by one space."""
    schema = docs.schema
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(place):
                words = (text.as_py() or "").encode().split()
                found = runs(ranked(words), least_words, least_exponent)
                stay = np.flatnonzero(collapsed(len(words), found)).tolist() if found else []
                texts.append(b" ".join([words[k] for k in stay]).decode() if found else text.as_py())
            columns = [pa.array(texts, c.type) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(cut), schema)
