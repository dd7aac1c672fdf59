import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonoflock.llm import binpack as B
from tests.conftest import SF
from tests.llm.test_textbytes import thue_morse
from tests.llm.test_token_files import TEXTS

TOKENIZER = Tokenizer.from_file(B.default_tokenizer())


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("texts", [TEXTS * 2, [*thue_morse(1024), " ".join(thue_morse(1024))], [], [None, ""]])
def test_chunks_encode_like_whole_texts(texts):
    got = list(B.Encoder(B.default_tokenizer()).encode(pa.array(texts, pa.string())))
    assert [x.tolist() for x in got] == [plain(t) for t in texts]


def test_random_signs_and_letters_encode_like_whole_texts():
    rng = random.Random(2)
    signs = [*"abZ019 \n\t.,!$()-_'\"éÉ×÷ß=", "'s", "'ll", "—", "語", "ö", " ", "  ", "café,", "it's", "̸", "́", "Σ", "ς", "İ", "ﬁ", " ", "\xa0", "٣", "<|endoftext|>", "ǅ", "가", "가"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    got = B.Encoder(B.default_tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [plain(t) for t in texts]


def sound(pieces, docs, limits):
    """Every id lies in exactly one piece, sequences keep to their limits and have no padding."""
    of, inside = defaultdict(list), defaultdict(list)
    for key, start, length, crc, doc_tokens, seq, offset, loss in pieces:
        of[key].append((start, length, crc, doc_tokens))
        inside[seq].append((offset, length, loss))
    assert set(of) == set(docs)
    for key, copies in docs.items():
        mine, at = sorted(of[key]), 0
        if len(copies) == 1:
            ids = copies[0]
            for start, length, crc, doc_tokens in mine:
                assert start == at and length > 0 and doc_tokens == len(ids)
                assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
        else:
            assert sum(m[1] for m in mine) == sum(map(len, copies))
    for parts in inside.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == limits.tokens or at & (at - 1) == 0 and at < limits.tokens
        assert len(parts) <= limits.segments and sum(p[2] for p in parts) <= limits.loss


@pytest.mark.parametrize("limits", [B.Limits(), B.Limits(64, 3, 64), B.Limits(100, 200, 30), B.Limits(1, 1, 1), B.Limits(2048, 1, 2048)])
@pytest.mark.parametrize("pool", [2, 64, 4096])
def test_packer(limits, pool):
    rng = random.Random(4)
    packer, pieces, docs = B.Packer(limits, pool), [], {}
    for k in range(300):
        n = rng.choice([1, 1, 2, 5, 30, 64, 150, rng.randint(1, 500)])
        loss = None if rng.random() < 0.3 else np.array([rng.random() < 0.6 for _ in range(n)], bool)
        ids = np.array(rng.choices(range(1 << 16), k=n), np.uint32)
        docs[k] = [ids.tolist()]
        pieces += packer.add(B.Example((k,), ids, loss))
    pieces += packer.pack()
    rows = [
        (e.key[0], s, n, zlib.crc32(e.ids[s : s + n].tobytes()), len(e.ids), seq, off, n if e.loss is None else int(e.loss[s : s + n].sum()))
        for e, s, n, seq, off in pieces
    ]
    sound(rows, docs, limits)


def test_the_greatest_dot_product_goes_first():
    # room is left for both, and the pool is short of segments rather than tokens
    packer = B.Packer(B.Limits(10, 2, 10))
    for k, n in enumerate([3, 7, 4, 6, 2]):
        list(packer.add(B.Example((k,), np.zeros(n, np.uint32), None)))
    first = [(e.key[0], n) for e, _, n, seq, _ in packer.pack() if seq == 0]
    assert first == [(1, 7), (0, 3)]


def test_whole_examples_are_mostly_kept_whole():
    rng = random.Random(5)
    packer, pieces = B.Packer(), []
    for k in range(3000):
        pieces += packer.add(B.Example((k,), np.zeros(rng.randint(20, 900), np.uint32), None))
    pieces += packer.pack()
    assert len(pieces) < 1.1 * 3000


def test_texts(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(TEXTS)] + [(None, "no id", "x", 0), (7, "same", "y", 0), (7, "same", "y", 0), (99, "long word " * 200_000, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, length int").repartition(3)
    pieces = list(map(tuple, B.pack_texts(docs, B.default_tokenizer()).collect()))
    want = defaultdict(list)
    for d, t, _, _ in rows:
        want[d].append(plain(t))
    sound(pieces, want, B.Limits())
    assert B.pack_texts(docs.limit(0), B.default_tokenizer()).count() == 0


def test_documents_without_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = B.pack_texts(docs, B.default_tokenizer())
    (r,) = B.padding(packed).collect()
    assert r.padded == 0 and r.tokens == sum(len(plain(x.text)) for x in docs.select("text").collect())
    assert packed.exceptAll(B.pack_texts(docs, B.default_tokenizer())).count() == 0


def test_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    limits = B.Limits(512, 16, 256)
    pieces = list(map(tuple, B.pack_conversations(turns, B.default_tokenizer(), limits=limits).collect()))
    want, loss = {}, 0
    rows = sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or ""))
    for r in rows:
        ids = plain(r.text)
        want.setdefault(r.conv_id, [[]])[0].extend(ids)
        loss += len(ids) * (r.role == "assistant")
    sound(pieces, want, limits)
    assert sum(p[7] for p in pieces) == loss > 0
