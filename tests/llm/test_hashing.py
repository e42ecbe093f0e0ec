import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnspark.llm import _text

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabAé .", max_size=40)), max_size=8)


def plain_sets(text, k):
    w = (text or "").encode().lower().split()
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 5))
def test_shingle_sets_agree_with_plain_ones(rows, k):
    got = list(_text.row_shingle_sets(pa.array(rows, pa.string()), k))
    want = [plain_sets(t, k) for t in rows]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(rows)):
        for j in range(len(rows)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_slices_and_sliced_arrays_change_nothing(monkeypatch):
    rows = pa.array(["a b c d e", None, "x " * 500, "a b c d e", ""], pa.string())
    whole = list(_text.row_shingle_sets(rows, 3))
    monkeypatch.setattr(_text, "SLICE", 16)
    for got in (list(_text.row_shingle_sets(rows, 3)), [*_text.row_shingle_sets(rows.slice(0, 2), 3), *_text.row_shingle_sets(rows.slice(2), 3)]):
        assert all((a == b).all() for a, b in zip(whole, got, strict=True))
