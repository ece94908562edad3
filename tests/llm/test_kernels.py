"""NumPy kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.tables import UPPER
from tillmark.llm.kernels import (
    ALNUM, NOT_SPACE, Lookup, gram_hashes, pieces, sliding_argmin, span_hashes, words,
)

TEXTS = ["", None, "  Two words\n", "x", "ÉTÉ, été 12-ab", "end", " ", "naïve\x0bcafé"]
PATTERNS = [(NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


@pytest.mark.parametrize("table, pattern", PATTERNS)
@pytest.mark.parametrize("limit", [1, 12, 1 << 20])
def test_words_are_the_runs_of_the_pattern(table, pattern, limit):
    found = []
    for texts in pieces(pa.array(TEXTS), limit):
        w = words(texts, table)
        for row in range(len(texts)):
            cut = slice(w.offsets[row], w.offsets[row + 1])
            raw = [bytes(texts.data[a:b]).decode().translate(UPPER) for a, b in zip(w.starts[cut], w.ends[cut])]
            found.append(list(zip(raw, w.hashes[cut].tolist())))
    assert [[x for x, _ in row] for row in found] == [
        re.findall(pattern, (t or "").translate(UPPER)) for t in TEXTS
    ]
    by_word = {}
    for word, h in sum(found, []):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_pieces_of_a_sliced_column_cover_it():
    column = pa.array(["skip", "ab", None, "cdef", "g"]).slice(1)
    seen = [(t.first, bytes(t.data), t.offsets.tolist()) for t in pieces(column, 3)]
    assert seen == [(0, b"ab", [0, 2, 2]), (2, b"cdef", [0, 4]), (3, b"g", [0, 1])]


def test_equal_spans_hash_equal_across_pieces(monkeypatch):
    import tillmark.llm.kernels as kernels

    data = np.frombuffer(b"abcabcabcabc" * 40, dtype=np.uint8)
    starts = np.arange(len(data) - 5)
    whole = span_hashes(data, starts, starts + 5)
    monkeypatch.setattr(kernels, "PIECE", 50)
    assert (span_hashes(data, starts, starts + 5) == whole).all()
    assert len(np.unique(whole)) == 3


def test_gram_hashes_depend_on_order_and_length():
    h = np.array([1, 2, 3, 1, 2], dtype=np.uint64)
    two, three = gram_hashes(h, 2), gram_hashes(h, 3)
    assert two[0] == two[3] and len(set(two.tolist())) == 3
    assert len(three) == 3 and not len(gram_hashes(h, 6)) and two[0] != three[0]


@pytest.mark.parametrize("width", [1, 2, 5, 6, 9])
def test_sliding_argmin_takes_the_rightmost(width):
    values = np.array([5, 3, 3, 8, 1, 1, 9, 2], dtype=np.uint64)
    wanted = [
        max(range(i, i + width), key=lambda k: (-int(values[k]), k)) for i in range(len(values) - width + 1)
    ]
    assert sliding_argmin(values, width).tolist() == wanted


def test_lookup_finds_all_keys_and_no_other():
    keys = np.arange(0, 3000, 3, dtype=np.int64)
    table = Lookup(keys, keys.astype(np.float32) + 1)
    value, known = table(np.arange(3000, dtype=np.int64))
    assert (known == (np.arange(3000) % 3 == 0)).all()
    assert (value[known] == keys + 1).all() and (value[~known] == 0).all()
    assert not Lookup(keys[:0], np.zeros(0, np.float32))(keys)[1].any()
