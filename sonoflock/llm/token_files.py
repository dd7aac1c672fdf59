"""Token-ID files: independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames, each with the ids of one document (or, if asked for,
of a few consecutive ones) as little-endian unsigned 32-bit integers; then a skippable frame with the
table of documents; then a skippable frame with the seek table in the public zstd seekable
format: for each frame its compressed and decompressed sizes and the low 32 bits of its
XXH64, then the number of frames, a descriptor byte (0x80: checksums) and 0x8F92EAB1.
Decompressed as a whole the file is the plain sequence of ids. A reader gets the tables from
the end of the file and decompresses only the frames that hold the documents it wants.

Documents are range-partitioned by doc_id and sorted within each range; a task writes its
range to files of bounded size in the shared folder, under a name of its own for each
attempt, and returns one manifest row for each finished file. The manifest is written by
Spark, which takes the rows of one attempt of each task only: files of failed or speculative
attempts are never read. Where a file starts in the whole follows from the manifest.

Words repeat, so a text is cut where the tokenizer's own pattern always cuts too: before white
space that follows other characters, and between letters, digits and signs. Each different
chunk is encoded once for many texts; chunks are equal if their bytes are. Texts for which
the cuts aren't certain (other white space than ASCII, text of a special token) are encoded whole.

Defined results: null text is empty and gets the end id alone; null doc_ids come first;
repeated doc_ids are documents of their own, ordered by the hash of their text; empty tables
give no files. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.llm import textbytes
from sonoflock.llm.common import filesystem, lean, materialise, scratch_path, worker_keeps

END_ID = 2
#: A frame takes one more document as long as it stays within so many ids; 0: a frame for each.
FRAME_IDS = 0
FILE_IDS = 32_000_000
CHUNKS_KEPT = 400_000
AHEAD = 1 << 22
SKIPPABLE, SEEK_SKIPPABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: One document in the table: has an id, doc_id, frame, first id within the frame, ids.
DOC = np.dtype([("known", "<u1"), ("doc_id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"
BLANKS = b" \t\n\v\f\r"
#: White space that the tokenizer's pattern knows beyond space and \t to \r.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class Writer:
    """Writes one file, frame by frame; nothing but the tables is held in memory."""

    def __init__(self, path: str, frame_ids: int = FRAME_IDS, level: int = 3):
        self.path, self.frame_ids = path, frame_ids
        fs, name = filesystem(path)
        self.out = fs.open_output_stream(name, compression=None)
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_held and self.n_held + len(ids) > self.frame_ids:
            self._flush()
        self.docs.append((doc_id is not None, doc_id or 0, len(self.frames), self.n_held, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)

    def _flush(self) -> None:
        raw = (self.held[0] if len(self.held) == 1 else np.concatenate(self.held)).astype("<u4", copy=False).tobytes()
        packed = self.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        table = np.array(self.docs, DOC).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        seek = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(seek)) + seek)
        self.out.close()


class Reader:
    """Random access to the documents of one file. A reader of all documents in order asks for
    `ahead` bytes at a time."""

    def __init__(self, path: str, ahead: int = 0):
        self.ahead, self.block = ahead, (0, b"")
        fs, name = filesystem(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        n_frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"no seek table with checksums at the end of {path}")
        at = size - 9 - 12 * n_frames
        self.frames = np.frombuffer(self.file.read_at(12 * n_frames, at), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        magic, length = struct.unpack("<II", self.file.read_at(8, int(self.starts[-1])))
        if magic != SKIPPABLE:
            raise ValueError(f"no table of documents in {path}")
        self.docs = np.frombuffer(self.file.read_at(length, int(self.starts[-1]) + 8), DOC)
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            packed, size, check = (int(x) for x in self.frames[k])
            raw = self.decompress(self._bytes(packed, int(self.starts[k])), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.last = (k, np.frombuffer(raw, "<u4"))
        return self.last[1]

    def _bytes(self, n: int, at: int) -> bytes:
        if n > self.ahead:
            return self.file.read_at(n, at)
        start, block = self.block
        if at < start or at + n > start + len(block):
            start, block = self.block = at, self.file.read_at(self.ahead, at)
        return block[at - start : at - start + n]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        d = self.docs[i]
        return self.frame(int(d["frame"]))[int(d["first"]) : int(d["first"]) + int(d["n"])]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of that doc_id; other frames aren't decompressed."""
        return [self.ids(i) for i in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["known"] == 1))]


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for byte in range(33, 127):
        c = chr(byte)
        kind[byte] = LETTER if c.isalpha() else DIGIT if c.isdigit() else 0 if c == "'" else SIGN
    return kind


LETTER, DIGIT, SIGN = 1, 2, 3
KIND = _kinds()


def inner_cuts(data: np.ndarray) -> np.ndarray:
    """The places in a word where letters, digits and signs meet: those of ASCII, with the
    letters of two bytes that begin with 0xC3. An apostrophe is of no kind, as what follows it
    may belong to it."""
    kind = KIND[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = LETTER
    a, b = kind[:-1], kind[1:]
    return np.flatnonzero((a != b) & (a != 0) & (b != 0)) + 1


class Encoder:
    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # what repeats is kept below
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id = end_id
        # chunks met of late and before: the older half goes when the newer one is full
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        # bytes of each token: the vocabulary writes a byte as one character
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end_id], np.uint32)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, with the end id."""
        for words in textbytes.pieces(column, textbytes.BLANK, limit=2 * textbytes.PIECE):
            texts = column.slice(words.first_row, words.texts)
            yield from self._piece(words, [x or "" for x in texts.to_pylist()])

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of different chunks, known ones from before."""
        found = list(map(self.known.get, chunks))
        missing = []
        for k in [k for k, x in enumerate(found) if x is None]:
            x = found[k] = self.before.get(chunks[k])
            if x is None:
                missing.append(k)
            else:
                self.known[chunks[k]] = x
        # chunks that end without white space are encoded in a row, each after white space
        joined = [k for k in missing if chunks[k][-1] not in BLANKS]
        for i in range(0, len(joined), 2048):
            some = joined[i : i + 2048]
            parts = [chunks[k] if chunks[k][0] in BLANKS else b"\n" + chunks[k] for k in some]
            ids = np.array(self._ids(b"".join(parts).decode()), np.uint32)
            cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x) for x in parts]), side="left") + 1
            flat, at = ids.tobytes(), 0
            for k, part, cut in zip(some, parts, cuts.tolist(), strict=True):
                found[k] = flat[4 * (at + (len(part) != len(chunks[k]))) : 4 * cut]
                at = cut
        for k in missing:
            if found[k] is None:
                found[k] = np.array(self._ids(chunks[k].decode()), np.uint32).tobytes()
        for k in missing:
            self.known[chunks[k]] = found[k]
        if len(self.known) > CHUNKS_KEPT // 2:
            self.before, self.known = self.known, {}
        return found

    def _piece(self, words: textbytes.Words, texts: list[str]) -> Iterator[np.ndarray]:
        # a chunk goes from one cut to the next: where texts start, words end, kinds meet
        data, offsets = words.data, words.offsets
        cut = np.zeros(len(data) + 1, bool)
        cut[words.end] = cut[offsets] = cut[inner_cuts(data)] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)  # of each text, its first chunk
        _, index, which = textbytes.distinct(textbytes.span_hashes(data, starts, ends))
        clash = np.flatnonzero(~textbytes.same_spans(data, starts, ends, index[which]))
        if len(clash):  # chunks of equal hash and other bytes stand for themselves
            which[clash] = len(index) + np.arange(len(clash))
            index = np.concatenate([index, clash])
        raw = data.tobytes()
        found = self._chunks([raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        at = np.cumsum(sizes) - sizes
        # the ids of all chunks in order, with an end id after each text
        n = sizes[which]
        out_at = np.concatenate([[0], np.cumsum(n)])
        from_ = flat[np.repeat(at[which] - out_at[:-1], n) + np.arange(out_at[-1])]
        ids = np.full(out_at[-1] + words.texts, self.end_id, np.uint32)
        text_of = np.repeat(np.arange(words.texts), np.diff(first))
        ids[np.arange(out_at[-1]) + np.repeat(text_of, n)] = from_
        edge = (out_at[first] + np.arange(words.texts + 1)).tolist()
        for k, text in enumerate(texts):
            if ODD_SPACE.search(text) or any(s in text for s in self.special):
                yield self.whole(text)
            else:
                yield ids[edge[k] : edge[k + 1]]


def write(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    file_ids: int = FILE_IDS,
    frame_ids: int = FRAME_IDS,
) -> DataFrame:
    """Encode and write all texts to files in `folder`, a URI that the executors can write to.
    Returns the manifest, one row for each file in order: path, n_docs, n_ids, start."""

    kept = f"encoder {tokenizer} {end_id}"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder, writer, number, done = None, None, 0, []

        def finish(w: Writer) -> tuple:
            w.close()
            return part, number, w.path, len(w.docs), w.n_ids

        for batch in batches:
            encoder = encoder or worker_keeps(kept, lambda: Encoder(tokenizer, end_id))
            ids = encoder.encode(batch.column("text"))
            for doc_id, row in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                if writer and writer.n_ids and writer.n_ids + len(row) > file_ids:
                    done.append(finish(writer))
                    writer, number = None, number + 1
                writer = writer or Writer(f"{folder}/ids-{part:06d}-{number:04d}-{attempt}.zst", frame_ids)
                writer.add(doc_id, row)
        if writer:
            done.append(finish(writer))
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "file", "path", "n_docs", "n_ids"])

    fs, name = filesystem(folder)
    fs.create_dir(name, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    manifest = materialise(ordered.mapInArrow(lean(save, kept), MANIFEST), "token-manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def one_by_one(files: DataFrame) -> DataFrame:
    """About a file for each task; a number given isn't lowered for the few bytes of the rows."""
    return files.repartition(max(1, min(files.count(), 100_000)), "path")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves."""

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(path, AHEAD)
                n = reader.docs["n"].astype(np.int64)
                crc = np.fromiter((zlib.crc32(reader.ids(i).tobytes()) for i in range(len(n))), np.int64, len(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.docs["doc_id"].astype(np.int64), mask=reader.docs["known"] == 0),
                        pa.array(start + np.concatenate([[0], np.cumsum(n)[:-1]])),
                        pa.array(n),
                        pa.array(crc),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = one_by_one(manifest.select("path", "start"))
    return spread.mapInArrow(lean(load), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: Iterable[int]) -> DataFrame:
    """(doc_id, ids) of some documents; only the frames that hold them are decompressed."""
    wanted = sorted(set(doc_ids))

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                reader = Reader(path)
                found = [(d, ids) for d in wanted for ids in reader.find(d)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in found], pa.int64()),
                        pa.array([ids.astype(np.int64) for _, ids in found], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "ids"],
                )

    return one_by_one(manifest.select("path")).mapInArrow(lean(load), "doc_id long, ids array<long>")


def roundtrip(docs: DataFrame, tokenizer: str, **params) -> DataFrame:
    """Write all documents to the shared folder and read the files back."""
    return read(write(docs, tokenizer, scratch_path(docs.sparkSession, "token-files"), **params))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
