import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.llm import topk


def plain(rows, k):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in np.float32(rng.normal(size=6) * rng.integers(0, 2, 6))]) for k in range(150)]
    rows += [(200 + k, rows[5][1]) for k in range(30)]  # ties
    rows += [(300, None), (320, [1.0, None]), (340, [float("nan")]), (360, [float("inf")]), (380, []), (400, [0.5, 0.25]), (None, [1.0]), (401, [1e4] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).collect())
    assert got == plain(rows, 20)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_fewer_candidates_than_k_and_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).collect())
    assert got == sorted(2 * [(0, 1, 1, 8192), (0, 2, 2, -4096)])


def test_finite_vectors_of_any_size_take_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2e15, 1.0]), (2, [-2e15, 3.0]), (3, [2.0**50, 0.5]), (20, [1e-3, 2.0**40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).collect()) == plain(rows, 20)
    for huge in ([1e18, 0.0], [1e17, 0.0]):  # a component, and a product, over 64 bits
        wide = spark.createDataFrame([(0, [200.0, 0.0]), (1, huge)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64-bit"):
            topk.exact_topk(wide, F.col("vec_id") % 20 == 0).collect()
