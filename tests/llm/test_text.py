import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from lociframe.llm.text import chunks, shingles

np.seterr(over="ignore")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\té .\U0001f600", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes(texts, size):
    seen = {}
    rows = 0
    for c in chunks(pa.array(texts, pa.string()), size):
        for i in range(c.hi - c.lo):
            words = WORD.findall((texts[c.lo + i] or "").translate(LOW))
            own = range(c.words[i], c.words[i + 1])
            assert [bytes(c.low[c.starts[k] : c.ends[k]]).decode() for k in own] == words
            assert c.n_chars()[i] == len(texts[c.lo + i] or "")
            for k, w in zip(own, words):
                assert seen.setdefault(w, c.hashes[k]) == c.hashes[k]
            rows += 1
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles(texts, k):
    by_hash, by_words = {}, {}
    for c in chunks(pa.array(texts, pa.string())):
        h, offsets = shingles(c.hashes, c.words, k)
        for i in range(c.hi - c.lo):
            w = WORD.findall((texts[c.lo + i] or "").translate(LOW))
            expected = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
            got = h[offsets[i] : offsets[i + 1]].tolist()
            assert len(got) == len(expected)
            for a, b in zip(got, expected):
                assert by_hash.setdefault(a, b) == b and by_words.setdefault(b, a) == a


def test_palindromic_shingles_differ():
    for c in chunks(pa.array(["a b b a", "b a a b"])):
        h, _ = shingles(c.hashes, c.words, 4)
        assert h[0] != h[1]


def test_empty_and_sliced_columns():
    assert list(chunks(pa.array([], pa.string()))) == []
    col = pa.array(["x", "y z", None, "w"]).slice(1, 3)
    assert [c.words.tolist() for c in chunks(col)] == [[0, 2, 2, 3]]
