import random
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from tokenizers import Tokenizer

from sonoflock.llm import token_files as tf
from tests.llm.test_textbytes import thue_morse

TEXTS = [
    "Hello world,  it's  fine\n\n\tnow ",
    "",
    None,
    "  lead",
    "a  b  c",
    "x <|endoftext|> y<|endoftext|>",
    " \n ",
    "tab\t\tend\t",
    "éè ñ 12 34!!  $$$ '",
    "word " * 30000,
    "\x1c a \x85 b",
    "it's we'll 'd",
    "\n\na\n b",
]


TOKENIZER = Tokenizer.from_file(tf.default_tokenizer())


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_chunks_encode_like_whole_texts():
    got = list(tf.Encoder(tf.default_tokenizer()).encode(pa.array(TEXTS * 2)))
    assert [x.tolist() for x in got] == [plain(t) for t in TEXTS] * 2


def test_chunks_that_a_polynomial_hash_takes_for_equal():
    texts = [*thue_morse(1024), " ".join(thue_morse(1024))]
    got = tf.Encoder(tf.default_tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [plain(t) for t in texts]


def test_random_signs_and_letters_encode_like_whole_texts():
    rng = random.Random(2)
    signs = [*"abZ019 \n\t.,!$()-_'\"éÉ×÷ß", "'s", "'ll", "—", "語", "ö", " ", "  ", "café,", "it's"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    got = tf.Encoder(tf.default_tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [plain(t) for t in texts]


def test_round_trip(spark, tmp_path):
    rows = [(100 - k, t, k) for k, t in enumerate(TEXTS)] + [(None, "no id", 0), (7, "same", 0), (7, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    manifest = tf.write(docs, tf.default_tokenizer(), f"file://{tmp_path}/ids", file_ids=2000)
    got = tf.read(manifest).orderBy("start").collect()
    want, start = [], 0
    for d, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = plain(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    found = {r.doc_id: r.ids for r in tf.lookup(manifest, [100, 91, 4]).collect()}
    assert found == {100: plain(TEXTS[0]), 91: plain(TEXTS[9])}
    # a file is also a plain zstandard stream
    files = [r.path for r in manifest.orderBy("start").collect()]
    assert len(files) > 1
    raw = b"".join(
        zstandard.ZstdDecompressor().stream_reader(open(f[7:], "rb"), read_across_frames=True).read() for f in files
    )
    assert len(raw) == 4 * start


def test_a_damaged_frame_is_found(tmp_path):
    path = f"{tmp_path}/a.zst"
    w = tf.Writer(path)
    w.add(1, np.arange(100, dtype=np.uint32))
    w.close()
    r = tf.Reader(path)
    r.frames = r.frames.copy()
    r.frames[0, 2] ^= 1
    try:
        r.ids(0)
        raise AssertionError
    except ValueError:
        pass


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.roundtrip(docs, tf.default_tokenizer()).count() == 0
