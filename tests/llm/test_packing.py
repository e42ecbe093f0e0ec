import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnspark.llm import packing


def check_bins(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        end = 0
        for a, n in spans:
            assert a == end
            end += n
        assert end <= capacity
    return len(at)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=50))
def test_best_fit_and_bound(lengths):
    place, offset, free = packing.best_fit_decreasing(np.array(lengths, np.int64), 32)
    used = np.zeros(len(free), int)
    for i in np.argsort(-np.array(lengths, np.int64), kind="stable"):
        assert offset[i] == used[place[i]]
        used[place[i]] += lengths[i]
    assert (32 - used == free).all() and (free >= 0).all()
    assert packing.lower_bound(np.bincount(np.array(lengths, int), minlength=33)) <= len(free)


def test_bound_beats_the_sum():
    h = np.zeros(101, int)
    h[51] = 10
    assert packing.lower_bound(h) == 10
    h[:] = 0
    h[34] = 9  # two fit, so five bins; the sum alone says four
    assert packing.lower_bound(h) == 5


def test_rounds_only_improve(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 900, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    one = check_bins(packing.pack_pieces(df, 2048, items=100, rounds=1).collect(), 2048)
    many = packing.pack_pieces(df, 2048, items=100).collect()
    assert len(many) == len(rows) and {r.doc_id for r in many} == set(range(4000))
    assert check_bins(many, 2048) <= one
    least = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=2049))
    assert {(r.sequences, r.least_sequences) for r in many} == {(check_bins(many, 2048), least)}
    assert check_bins(many, 2048) <= least + 3
    assert check_bins(packing.pack_pieces(df).collect(), 2048) <= least + 1


def test_a_run_of_white_space_too_long_for_the_faster_encoder():
    text = "a" + " " * 1_000_000 + "b"
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.public_tokenizer()(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    texts = ["", None, "one two three", "x y <|endoftext|> z", "ab " * 6000, "café 你好\n\n  end", "ab " * 2047, "ab " * 2048]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(2, "one two three", 0), (None, "q", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(df).collect()
    check_bins(got, 2048)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert packing.pack_documents(df.limit(0)).count() == 0
