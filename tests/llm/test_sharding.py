import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tarnspark.llm import sharding


def plain_best_fit(sizes, capacity):
    rooms, want = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= size]
        room, b = min(fits) if fits else (max(capacity, size), len(rooms))
        if not fits:
            rooms.append(room)
        rooms[b] = room - size
        want.append((size, b))
    return want


def histogram(sizes):
    kinds = sorted(set(sizes), reverse=True)
    return kinds, [sizes.count(k) for k in kinds]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(30, 120))
def test_best_fit_of_a_histogram_is_that_of_its_items(sizes, capacity):
    kinds, counts = histogram(sizes)
    got = sharding.best_fit_decreasing(kinds, counts, capacity)
    assert [(k, b) for k, runs in zip(kinds, got) for b, n in runs for _ in range(n)] == plain_best_fit(sizes, capacity)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=80), st.integers(1, 9))
def test_no_more_shards_than_asked(sizes, shards):
    kinds, counts = histogram(sizes)
    got = sharding.pack_into(kinds, counts, shards)
    assert [sum(n for _, n in runs) for runs in got] == counts and all(0 <= b < shards for runs in got for b, _ in runs)
    loads = [0] * shards
    for k, runs in zip(kinds, got):
        for b, n in runs:
            loads[b] += k * n
    assert max(loads) <= max(max(sizes), sum(sizes) / shards + max(sizes))


def test_size_classes(spark):
    got = spark.range(1, 200_000, 7).union(spark.range(2**40, 2**40 + 3)).select("id", sharding.size_class(F.col("id")).alias("k")).collect()
    assert all(r.k == r.id for r in got if r.id < 8192) and all(r.id <= r.k <= r.id * (1 + 2**-12) for r in got)


def test_shards_of_many_equal_sizes_are_even(spark):
    """Groups of one size go to several shards, by number; the query against its own law."""
    rows = [(k, f"{k:06d}") for k in range(5000)] + [(9000 + k, "the hot text " * 3) for k in range(2500)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and got[got["doc_id"] >= 9000]["shard"].nunique() == 1
    light = sums.drop(got[got["doc_id"] >= 9000]["shard"].iloc[0])
    assert len(sums) == 8 and light.max() <= 5000 + 7  # as even as groups of 7 bytes can be


def test_documents(spark):
    rows = [(k, f"text {k} " + "w " * (k % 50), 1) for k in range(600)] + [(9000 + k, "copy of all " * 40, 1) for k in range(60)] + [(1, None, 1), (1, None, 1), (None, "text", 1), (2, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows)
    place = {}
    texts = {i: t for i, t, _ in rows}
    for r in got:
        raw = None
        if r.doc_id not in (None, 1, 2):
            raw = texts[r.doc_id].encode()
            assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
            assert place.setdefault(raw, r.shard) == r.shard
        assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    nulls = [r for r in got if r.size == 1 and r.doc_id == 1]
    assert len(nulls) == 2 and len({r.shard for r in nulls}) == 1
    sums = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    largest = 60 * (len("copy of all " * 40) + 1)
    assert max(sums) <= max(largest, sum(sums) / 8 * 1.05)
    assert sharding.shard_documents(df.limit(0)).count() == 0
