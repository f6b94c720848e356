from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corvane.llm import words as W
from tests.llm.conftest import ALNUM, WORD, low

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAZ09 \t\n\x0b\x00é漢%-", max_size=60)), max_size=20)


@pytest.mark.parametrize("rule, pattern, fold", [(W.PLAIN, WORD, False), (W.FOLDED, WORD, True), (W.ALNUM, ALNUM, True)])
@settings(max_examples=60, deadline=None)
@given(texts=TEXTS, block=st.sampled_from([8, 64, 1 << 19]))
def test_words_are_those_of_the_pattern(rule, pattern, fold, texts, block):
    old, W.BLOCK = W.BLOCK, block
    try:
        data, offsets = W.column(pa.array(texts, pa.string()))
        start, end, h, first = W.words(data, offsets, rule)
    finally:
        W.BLOCK = old
    seen: dict[str, int] = {}
    for i, text in enumerate(texts):
        expected = pattern.findall(low(text or "") if fold else text or "")
        got = [rule.lower[data[a:b]].tobytes().decode() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
        assert got == expected
        for w, x in zip(expected, h[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def other(s: str) -> str:
    return s.translate(str.maketrans("ab", "ba"))


def test_structured_words_differ():
    """Words whose hashes are equal under any polynomial modulo a power of two, and words apart by one byte or their length."""
    lengths = [*range(1, 140), 1024, 4096, 70_000]
    texts = [thue_morse(n) for n in lengths] + [other(thue_morse(n)) for n in lengths]
    texts += ["a" * n for n in range(2, 140)] + ["a" * n + "\0" for n in range(1, 140)] + ["a" * 100 + "b" + "a" * n for n in range(100)]
    data, offsets = W.column(pa.array([" ".join(texts)]))
    for rule in (W.PLAIN, W.FOLDED):
        h = W.words(data, offsets, rule)[2]
        assert len(h) == len(texts) and len(np.unique(h)) == len(set(texts))


def test_grams_depend_on_their_words_alone():
    h = np.arange(1, 40, dtype=np.uint64) ** np.uint64(3)
    twice = np.concatenate((h, h[5:15], h))
    for n in (1, 2, 5, 6, 7):
        grams = W.grams(twice, n)
        assert len(grams) == len(twice) - n + 1
        assert (grams[: 40 - n] == grams[49 : 89 - n]).all() and grams[39] == grams[5]
        assert len(np.unique(grams[: 40 - n])) == 40 - n
    assert len(W.grams(h, 40)) == 0 and len(W.grams(h, 39)) == 1


@pytest.mark.parametrize("n", [64, 1000, 1024, 2048])
def test_structured_runs_of_words_differ(n):
    h = np.array([3, 1 << 40], np.uint64)[np.array([i.bit_count() & 1 for i in range(n)])]
    assert W.grams(h, n)[0] != W.grams(np.array([1 << 40, 3], np.uint64)[(h != 3).astype(int)], n)[0]


def test_digests_are_of_the_words():
    text = " ab\tc  d\u00e9 ab c "
    data, offsets = W.column(pa.array([text, "ab c"]))
    start, end, _, first = W.words(data, offsets, W.PLAIN)
    own = W.Words(data, start, end)
    assert own.bytes.decode() == "ab c d\u00e9 ab c ab c "
    lo, hi = own.digests(np.array([0, 3, 5, 1]), np.array([2, 5, 7, 3]))
    assert lo[0] == lo[1] == lo[2] != lo[3] and hi[0] == hi[1] == hi[2] != hi[3]
