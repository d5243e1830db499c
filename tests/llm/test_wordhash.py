import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import wordhash as wh

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t. x", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_words_are_those_of_split(texts, piece):
    data, offsets = wh.strings(pa.array(texts, pa.string()))
    kept, wh.PIECE = wh.PIECE, piece
    try:
        h, row, start = wh.words(data, offsets)
    finally:
        wh.PIECE = kept
    expected = [(r, w) for r, t in enumerate(texts) for w in (t or "").encode().split()]
    assert row.tolist() == [r for r, _ in expected]
    names: dict = {}
    for (_, w), x, s, r in zip(expected, h.tolist(), start.tolist(), row.tolist(), strict=True):
        assert names.setdefault(w, x) == x and bytes(data[s : s + len(w)]) == w and offsets[r] <= s
    assert len(set(names.values())) == len(names)


def test_grams_depend_on_the_words_alone():
    h = np.arange(1, 200, dtype=np.uint64) ** 7
    both = np.concatenate([h, h])
    for size in (1, 5, 8, 35):
        g = wh.grams(both, size)
        assert len(g) == len(both) - size + 1 and (g[: len(h) - size + 1] == g[len(h) : 2 * len(h) - size + 1]).all()
        assert len(np.unique(g[: len(h)])) == len(h)
    assert len(wh.grams(h[:3], 5)) == 0


def test_slices_and_chunks():
    column = pa.array(["a b", None, "", "c " * 100, "d"], pa.string()).slice(1)
    assert [(r, len(o) - 1) for r, _, o in wh.chunks(column, 50)] == [(0, 2), (2, 1), (3, 1)]
