"""Packing of examples into sequences: vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces of examples) and loss-bearing
tokens. A task packs the examples that it reads, in pools of bounded size. An open sequence has
a vector of what is left of each limit; of all examples of the pool that fit, it takes the one
whose demand has the greatest dot product with that vector, each dimension weighed by the pool's
mean demand, so that the dimension that is scarce counts most. Examples longer than a sequence
are first cut into whole sequences and a rest. Where no example fits and tokens are left, the
best of the others is cut to what fits, and its rest goes back to the pool.

A sequence is padded to its full length, except where its tokens are a power of two. One that
ends otherwise (by its limits, or because the task has nothing more) gives the tokens beyond the
last power of two back to the pool; so there is no padding at all, whatever the limits.

Texts aren't shuffled: a pool needs no more than some thousand examples of any kind, and a task's
examples are always the same, so a lost task is simply run again. sequence_id is the task's
number times 2 to the 32, plus the sequence's number within the task; the pieces are written to
the shared folder, so that what is done with them later doesn't change the tasks.

Ids come from a table of chunks that a worker has met: texts are cut at white space and between
letters, digits and signs, where the tokenizer's pattern cuts too, and each different chunk is
encoded once.

Defined results: null text is empty and gets the end id alone; null doc_ids stay null; repeated
rows are examples of their own; very long texts are cut; empty tables give nothing. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.llm import textbytes
from sonoflock.llm.common import lean, materialise, worker_keeps
from sonoflock.llm.token_files import inner_cuts

END_ID = 1
CHUNKS_KEPT = 400_000
#: Examples that wait to be packed; half of them are packed when so many wait.
POOL = 2048
#: Chunks of one kind: letters (those of U+00C0 to U+00FF as well), digits, signs without apostrophe.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+")
DIGITS = b"0123456789"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


@dataclass
class Example:
    """What is left of one example from `start` on. loss: whether each id bears loss, or None
    for all."""

    key: tuple
    ids: np.ndarray
    loss: np.ndarray | None
    start: int = 0

    def __len__(self) -> int:
        return len(self.ids) - self.start

    def bearing(self, n: int | None = None) -> int:
        """Loss-bearing ids among the next n."""
        n = len(self) if n is None else n
        return n if self.loss is None else int(np.count_nonzero(self.loss[self.start : self.start + n]))

    def most(self, tokens: int, loss: int) -> int:
        """How many of the next ids keep to both limits."""
        n = min(len(self), tokens)
        if self.loss is None:
            return min(n, loss)
        beyond = np.flatnonzero(np.cumsum(self.loss[self.start : self.start + n]) > loss)
        return int(beyond[0]) if len(beyond) else n


Piece = tuple[Example, int, int, int, int]  # example, start, length, sequence, offset


class Packer:
    def __init__(self, limits: Limits = Limits(), pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("each limit must be 1 at least")
        self.limits, self.room = limits, pool
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Example] = []
        self.sequences = 0

    def add(self, example: Example) -> Iterator[Piece]:
        # whole sequences first; what is left is below the limits
        while len(example) >= self.limits.tokens and example.bearing(self.limits.tokens) <= self.limits.loss:
            yield example, example.start, self.limits.tokens, self.sequences, 0
            self.sequences += 1
            example.start += self.limits.tokens
        if len(example):
            self.pool.append(example)
        if len(self.pool) >= self.room:
            yield from self.pack(self.room // 2)

    def pack(self, leave: int = 0) -> Iterator[Piece]:
        """Pack until at most so many examples wait."""
        pool = self.pool
        tokens, loss = np.array([len(x) for x in pool], float), np.array([x.bearing() for x in pool], float)
        while (waiting := np.count_nonzero(tokens)) > leave:
            # demand and room count as shares of the limits
            weight = np.array([tokens.sum(), waiting, loss.sum()]) / waiting / self.cap**3
            taken = self._fill(pool, tokens, loss, weight)
            yield from self._close(pool, tokens, loss, taken)
            if waiting < len(pool) // 2:
                stay = np.flatnonzero(tokens)
                pool, tokens, loss = [pool[k] for k in stay.tolist()], tokens[stay], loss[stay]
        self.pool = [pool[k] for k in np.flatnonzero(tokens).tolist()]

    def _fill(self, pool: list[Example], tokens: np.ndarray, loss: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
        """(index in pool, length) of the pieces of one sequence; what they take is gone from
        the pool. An example of which nothing is left has no tokens."""
        left, taken = self.cap.copy(), []
        while left.min() >= 1:
            w = weight * left
            value = np.where(tokens > 0, w[0] * tokens + w[1] + w[2] * loss, -1)
            k = int(np.argmax(np.where((tokens <= left[0]) & (loss <= left[2]), value, -1)))
            n = int(tokens[k])
            if not n or n > left[0] or loss[k] > left[2]:  # none fits: a piece of the best of the others
                k = int(np.argmax(value))
                n = pool[k].most(int(left[0]), int(left[2]))
                if not n:
                    break
            left -= (n, 1, pool[k].bearing(n))
            taken.append((k, n))
            self._take(pool, tokens, loss, k, n)
        return taken

    def _take(self, pool: list[Example], tokens: np.ndarray, loss: np.ndarray, k: int, n: int) -> None:
        pool[k].start += n
        tokens[k], loss[k] = len(pool[k]), pool[k].bearing()

    def _close(self, pool: list[Example], tokens: np.ndarray, loss: np.ndarray, taken: list[tuple[int, int]]) -> Iterator[Piece]:
        """The pieces of a sequence; ids beyond the last power of two go back."""
        total = sum(n for _, n in taken)
        room = total if total == self.limits.tokens else 1 << total.bit_length() - 1
        starts: list[tuple[int, int]] = []
        for k, n in reversed(taken):  # an example can be there twice: its later piece goes first
            starts.append((k, pool[k].start - n))
            pool[k].start -= n
        offset = 0
        for (k, n), (_, start) in zip(taken, reversed(starts), strict=True):
            m = min(n, room - offset)
            if m:
                yield pool[k], start, m, self.sequences, offset
                self._take(pool, tokens, loss, k, m)
                offset += m
            else:
                self._take(pool, tokens, loss, k, 0)
        self.sequences += 1


class Encoder:
    """Ids of whole texts, from those of their chunks. For tokenizers that drop white space and
    never join letters, digits and signs."""

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # what repeats is kept below
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[list(vocabulary.values())] = [x.endswith("</w>") for x in vocabulary]
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        # chunks met of late and before: the older half goes when the newer one is full
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in found]

    def _joined(self, chunks: list[bytes]) -> Iterator[bytes]:
        """The ids of chunks of one kind each, encoded in a row: letters and signs are a word for
        the tokenizer, of digits each is one, and the last token of a word shows that it is."""
        ids = np.frombuffer(self._encode([b" ".join(chunks).decode()])[0], np.uint32)
        words = np.cumsum([len(x) if x[0] in DIGITS else 1 for x in chunks])
        cuts = (4 * (np.searchsorted(np.cumsum(self.ends_word[ids]), words) + 1)).tolist()
        flat = ids.tobytes()
        return (flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False))

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, chunks))
        missing = []
        for k in [k for k, x in enumerate(found) if x is None]:
            x = found[k] = self.before.get(chunks[k])
            if x is None:
                missing.append(k)
            else:
                self.known[chunks[k]] = x
        plain = [k for k in missing if PLAIN.fullmatch(chunks[k])]
        for i in range(0, len(plain), 2048):
            some = plain[i : i + 2048]
            for k, x in zip(some, self._joined([chunks[k] for k in some]), strict=True):
                found[k] = self.known[chunks[k]] = x
        odd = [k for k in missing if found[k] is None]
        for k, x in zip(odd, self._encode([chunks[k].decode() for k in odd]), strict=True):
            found[k] = self.known[chunks[k]] = x
        if len(self.known) > CHUNKS_KEPT // 2:
            self.before, self.known = self.known, {}
        return found

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, with the end id."""
        for words in textbytes.pieces(column, textbytes.BLANK, limit=2 * textbytes.PIECE):
            data = words.data
            inside = np.zeros(len(data) + 1, np.int8)
            inside[words.start] += 1
            inside[words.end] -= 1
            cut = np.zeros(len(data) + 1, bool)
            cut[words.start] = cut[words.end] = cut[inner_cuts(data)] = True
            edges = np.flatnonzero(cut)
            starts = edges[:-1][np.cumsum(inside)[edges[:-1]] > 0] if len(edges) else edges
            ends = edges[1:][np.cumsum(inside)[edges[:-1]] > 0] if len(edges) else edges
            first = np.searchsorted(starts, words.offsets)
            _, index, which = textbytes.distinct(textbytes.span_hashes(data, starts, ends))
            clash = np.flatnonzero(~textbytes.same_spans(data, starts, ends, index[which])) if len(starts) else index
            if len(clash):  # chunks of equal hash and other bytes stand for themselves
                which[clash] = len(index) + np.arange(len(clash))
                index = np.concatenate([index, clash])
            raw = data.tobytes()
            odd = [s for s in self.special if s in raw]
            found = self._chunks([raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), np.uint32)
            at, n = np.cumsum(sizes) - sizes, sizes[which]
            through = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(at[which] - through[:-1], n) + np.arange(through[-1])]
            edge, offsets = through[first].tolist(), words.offsets.tolist()
            for k in range(words.texts):
                text = raw[offsets[k] : offsets[k + 1]] if odd else b""
                if any(s in text for s in odd):  # a special token's own text isn't cut
                    yield np.concatenate([np.frombuffer(self._encode([text.decode()])[0], np.uint32), self.end])
                else:
                    yield np.concatenate([ids[edge[k] : edge[k + 1]], self.end])


def _batch(rows: list[Piece], base: int, keys: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = [pa.array([r[0].key[i] for r in rows], t) for i, (_, t) in enumerate(keys)]
    crc = [zlib.crc32(r[0].ids[r[1] : r[1] + r[2]].astype("<u4", copy=False).tobytes()) for r in rows]
    loss = [r[2] if r[0].loss is None else int(np.count_nonzero(r[0].loss[r[1] : r[1] + r[2]])) for r in rows]
    numbers = [[r[1] for r in rows], [r[2] for r in rows], crc, [len(r[0].ids) for r in rows], [base + r[3] for r in rows], [r[4] for r in rows], loss]
    names = [k for k, _ in keys] + ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]
    return pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int64()) for x in numbers], names)


#: What _batch() gives besides the keys of an example.
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


def _packed(examples: Iterator[Example], limits: Limits, pool: int, keys: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    packer, rows, base = Packer(limits, pool), [], (task.partitionId() if task else 0) << 32
    for example in examples:
        rows.extend(packer.add(example))
        if len(rows) >= 8192:
            yield _batch(rows, base, keys)
            rows = []
    rows.extend(packer.pack())
    if rows:
        yield _batch(rows, base, keys)


def pack_texts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    limits: Limits = Limits(),
    pool: int = POOL,
) -> DataFrame:
    """One row for each piece of each text: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, n_loss. Every id of a text bears loss."""
    kept = f"word encoder {tokenizer} {end_id}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[Example]:
            for batch in batches:
                encoder = worker_keeps(kept, lambda: Encoder(tokenizer, end_id))
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                    yield Example((doc_id,), ids, None)

        yield from _packed(examples(), limits, pool, [("doc_id", pa.int64())])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(source.mapInArrow(lean(pack, kept), f"doc_id long, {PIECES}"), "packed")


def pack_conversations(
    turns: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    limits: Limits = Limits(),
    pool: int = POOL,
    answers: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """The same for conversations, rows of (conv_id, turn, role, text): an example is a
    conversation, its turns in order, each with an end id; the ids of answers bear loss. What is
    brought together is the turns of one conversation, never more."""
    kept = f"word encoder {tokenizer} {end_id}"
    # where a conversation has turns of equal number they go by role and text
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    flat = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[Example]:
            for batch in batches:
                encoder = worker_keeps(kept, lambda: Encoder(tokenizer, end_id))
                ids = encoder.encode(batch.column("texts").flatten())
                for conv, roles in zip(batch.column("conv_id").to_pylist(), batch.column("roles").to_pylist(), strict=True):
                    parts = [next(ids) for _ in roles]
                    bears = np.repeat([r in answers for r in roles], [len(p) for p in parts])
                    yield Example((conv,), np.concatenate(parts), bears)

        yield from _packed(examples(), limits, pool, [("conv_id", pa.int64())])

    source = flat.select(F.col("conv_id").cast("long").alias("conv_id"), "roles", "texts")
    return materialise(source.mapInArrow(lean(pack, kept), f"conv_id long, {PIECES}"), "packed")


def padding(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(sequences, tokens, padded): how much of all sequences is padding."""
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    lengths = pieces.select("sequence_id", "offset", total.alias("n")).where("offset = 0")
    exact = F.expr("n = shiftleft(1L, cast(floor(log2(n)) as int))")
    return lengths.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("n").alias("tokens"),
        F.sum(F.when(exact, 0).otherwise(limits.tokens - F.col("n"))).alias("padded"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
