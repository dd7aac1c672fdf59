"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Words are maximal runs of bytes that aren't separators. The separators used are ASCII, so
that runs of bytes are runs of characters. Words are hashed eight bytes at a time, all words
of a piece together: no Python object for a word. Where equal hashes decide a result, the
operators compare the bytes as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in pieces of so many bytes (a longer text is a piece of its own).
PIECE = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 0x2545F4914F6CDD1D
#: Spans of more bytes are hashed one by one.
LONG = 64
#: Masks of the first k of eight bytes.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: [^\x20\x09-\x0D]+
BLANK = separators((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: lower-cases A-Z
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # bytes, folded if asked for
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more at the end
    first_row: int  # the index in the column of the first text of this piece
    texts: int
    offsets: np.ndarray  # of each text, in data; one more at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text in this piece."""
        return np.repeat(np.arange(self.texts), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: eight bytes at a time, mixed in between, so that spans of up
    to eight bytes and equal length never clash; XXH3 for the few longer than LONG."""
    eights, n = _eights(data), end - start
    h = mix(n.astype(np.uint64) * np.uint64(_BASE) + np.uint64(_SEED + seed & _MASK))
    h = mix(h ^ (eights[start] & _HEAD[np.minimum(n, 8)]))
    todo, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(todo):
        part = eights[start[todo] + at] & _HEAD[np.minimum(n[todo] - at, 8)]
        h[todo] = mix(h[todo] * np.uint64(_BASE) ^ part)
        at += 8
        todo = todo[n[todo] > at]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each span has the very bytes of the span whose index `like` gives."""
    eights, n = _eights(data), end - start
    same = n == n[like]
    todo, at = np.flatnonzero(same & (like != np.arange(len(n)))), 0
    while len(todo):
        a, b = eights[start[todo] + at], eights[start[like[todo]] + at]
        differ = ((a ^ b) & _HEAD[np.minimum(n[todo] - at, 8)]) != 0
        same[todo[differ]] = False
        at += 8
        todo = todo[~differ & (n[todo] > at)]
    return same


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, the place of one of each, and for each place the index of
    its value: np.unique by the quicker sort, as it doesn't matter which place is named."""
    order = np.argsort(a)
    new = np.ones(len(a), bool)
    new[1:] = a[order[1:]] != a[order[:-1]]
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[order[new]], order[new], which


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never goes on from one text to the next."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~separator[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edge] |= inside[1:-1][edge]
    closes[edge - 1] |= inside[1:-1][edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def pieces(column: pa.Array, separator: np.ndarray = BLANK, fold: bool = False, limit: int = PIECE) -> Iterator[Words]:
    """The words of a column, a piece of whole texts at a time."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        if fold:
            part = FOLD[part]
        at = offsets[row : stop + 1] - offsets[row]
        start, end = find_words(part, at, separator)
        yield Words(part, start, end, np.searchsorted(start, at), row, stop - row, at)
        row = stop


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive words, by its first word: runs of 1, 2, 4 ...
    words are joined two and two, mixed each time."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, hashes, 1
    while True:
        if width & size:
            part = power[done : done + n]
            out = mix(part + np.uint64(size)) if out is None else mix(out * np.uint64(_BASE) ^ part)
            done += size
        if done == width:
            return out
        power = mix(power[:-size] * np.uint64(_BASE) ^ power[size:])
        size *= 2


def whole_windows(words: Words, width: int) -> np.ndarray:
    """Which windows of windows() lie within one text."""
    n = len(words.start) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    of = words.text_of()
    return of[:n] == of[width - 1 :]
