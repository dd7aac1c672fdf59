import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoflock.llm import textbytes
from sonoflock.llm.packing import pack, unpack

TEXT = st.text(st.sampled_from("aB \t\n\x0b\x0c\r\x1cé0Z_-\xa0語"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    for table, pattern in ((textbytes.BLANK, r"[^\x20\x09-\x0D]+"), (textbytes.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = [[] for _ in texts]
        for w in textbytes.pieces(pa.array(texts, pa.string()), table, fold=True, limit=limit):
            for i, t in enumerate(w.text_of().tolist()):
                got[w.first_row + t].append(w.word(i).decode())
            h = w.hashes()
            names = [w.word(i) for i in range(len(h))]
            assert len({*zip(names, h.tolist(), strict=True)}) == len(set(names)) == len(set(h.tolist()))
        fold = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        assert got == [re.findall(pattern, t) for t in fold]


@given(st.lists(st.integers(0, 2**63)))
def test_packing(values):
    for kind in (np.uint64, np.int64):
        a = np.array(values, np.uint64).astype(kind)
        assert (unpack(pack(a)) == a).all() and unpack(pack(a)).dtype == kind


def thue_morse(n, a="a", b="b"):
    """A word and its complement, whose polynomial hashes modulo 2^64 are equal for any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_complements_differ():
    for n in (8, 16, 64, 1024, 4096):
        column = pa.array(thue_morse(n))
        data, offsets = textbytes.buffers(column)
        h = textbytes.span_hashes(data, offsets[:-1], offsets[1:])
        assert h[0] != h[1]
        assert textbytes.same_spans(data, offsets[:-1], offsets[1:], np.array([0, 0])).tolist() == [True, False]
    words = next(textbytes.pieces(pa.array([" ".join(x) for x in thue_morse(1024)])))
    for width in (1, 2, 5, 10, 13, 1024):
        got = textbytes.windows(words.hashes(), width)
        seen = {}
        w = [words.word(i) for i in range(len(words.start))]
        for i, h in enumerate(got.tolist()):
            assert seen.setdefault(h, w[i : i + width]) == w[i : i + width]
        assert len(seen) == len({tuple(w[i : i + width]) for i in range(len(got))})


@given(st.lists(st.binary(max_size=70), min_size=1, max_size=6), st.data())
def test_same_spans_compares_bytes(spans, data):
    like = np.array([data.draw(st.integers(0, len(spans) - 1)) for _ in spans])
    raw = np.frombuffer(b"".join(spans), np.uint8)
    at = np.cumsum([0, *map(len, spans)])
    assert textbytes.same_spans(raw, at[:-1], at[1:], like).tolist() == [s == spans[k] for s, k in zip(spans, like, strict=True)]
