"""Byte kernels against regular expressions, on any text."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gatewright.llm import kernels

from .helpers import PLAIN, WHITE, lower

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85 　aBz09.,!?-_é\U0001f600K"), max_size=60), st.text(max_size=40)), max_size=6)


def found(texts, size, separators, raw):
    out = [[] for _ in texts]
    tail = None
    for p in kernels.pieces(pa.array(texts, pa.string()), size, raw):
        data = kernels.LOWER[p.data]
        starts, ends = kernels.words(data, p.bounds, separators)
        hashes = kernels.word_hashes(data, starts, ends)
        row = p.rows[np.searchsorted(p.bounds, starts, "right") - 1] if len(starts) else []
        for r, a, b, h in zip(row, starts, ends, hashes):
            word = data[a:b].tobytes()
            assert h == kernels.word_hash(word)
            out[r].append(word.decode())
        assert p.goes_on == (tail is not None and tail == p.rows[0])
        tail = p.rows[-1] if p.cut else None
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 50))
def test_words_are_those_of_the_patterns(texts, size):
    assert found(texts, size, kernels.WHITE, kernels.WHITE) == [WHITE.findall(lower(t)) for t in texts]
    assert found(texts, size, kernels.PUNCT, kernels.PUNCT_RAW) == [PLAIN.findall(lower(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_pieces_hold_all_bytes_in_order(texts, size):
    for separators in (None, kernels.WHITE):
        out = [b""] * len(texts)
        for p in kernels.pieces(pa.array(texts, pa.string()), size, separators):
            for k, r in enumerate(p.rows):
                out[r] += p.data[p.bounds[k] : p.bounds[k + 1]].tobytes()
        assert out == [(t or "").encode() for t in texts]


def test_hashes_differ():
    words = [f"{a}{b}".encode() for a in "abcdefgh" for b in range(5000)]
    assert len({kernels.word_hash(w) for w in words}) == len(words)
    assert kernels.word_hash(b"ab") != kernels.word_hash(b"ba") != kernels.word_hash(b"a")
