"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt to blocks; each block is inverted into postings, one list
of (row, weight) for each term.  A block of sparse query rows meets every block of
candidates once: for each term of a query the weighted postings are scattered into a dense
array of scores, and a partition selection keeps the block's k best.  A window
merges the blocks.  Queries and candidates meet through an equi-join on grid cells; a cell holds a
bounded number of either, and only k rows for each query and block are shuffled on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 8192, 4096
#: Entries of the array of scores that is filled at once.
TILE = 1 << 17


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as longs; null for a vector that takes no part.  A component that no long holds raises an error."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) * scale >= F.lit(2.0**63))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(vector.isNotNull() & ~bad, F.when(large, F.raise_error(F.lit("a scaled component doesn't fit a 64-bit integer"))).otherwise(whole))


def _by_integers(queries: pa.Table, ids: np.ndarray, weights: list[list[int]], k: int) -> list[tuple[np.ndarray, ...]]:
    """The best rows by integers of any size, for weights whose products may not fit 64 bits; a best score that doesn't fit raises."""
    found = []
    for key, own, q in zip(*(queries[c].to_pylist() for c in ("query_row", "query_id", "w")), strict=True):
        scores = [sum(a * b for a, b in zip(q, w)) for w in weights]  # noqa: B905
        best = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-scores[i], i))[:k]  # noqa: B023
        if any(not -(2**63) <= scores[i] < 2**63 for i in best):
            raise OverflowError("a score doesn't fit a 64-bit integer")
        if best:
            found.append((np.full(len(best), key), np.full(len(best), own), ids[best], np.array([scores[i] for i in best], np.int64)))
    return found


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of the entries other than 0."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    weights = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = weights != 0
    return rows[keep], terms[keep], weights[keep]


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        candidates = candidates.sort_by("vec_id")
        ids = candidates["vec_id"].to_numpy()
        m, keep = len(ids), min(k, len(ids))
        rows, terms, weights = _matrix(candidates["w"])
        q_rows, q_terms, q_weights = _matrix(queries["w"])
        dims = int(max(terms.max(initial=-1), q_terms.max(initial=-1))) + 1
        largest = [float(np.abs(w.astype(float)).max(initial=0)) for w in (weights, q_weights)]
        bound = largest[0] * largest[1] * max(1, dims) * (1 + 1e-9)
        if bound >= 2**63:
            found = _by_integers(queries, ids, candidates["w"].to_pylist(), k)
            return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=schema) if found else schema.empty_table()
        kind = np.int32 if bound < 2**31 - 1 else np.int64
        least = np.iinfo(kind).min
        order = np.argsort(terms, kind="stable")
        cuts = np.searchsorted(terms[order], np.arange(dims + 1))
        postings = []
        for o in np.split(order, cuts[1:-1]) if dims else []:
            at, w = rows[o], weights[o].astype(kind)
            if 4 * len(at) > m:  # a long list is held as a dense one, with weight 0 for the absent
                dense = np.zeros(m, kind)
                dense[at] = w
                at, w = None, dense
            postings.append((at, w))
        q_ids, q_keys = queries["query_id"].to_numpy(), queries["query_row"].to_numpy()
        q_cuts = np.searchsorted(q_rows, np.arange(len(q_ids) + 1))
        found: list[tuple[np.ndarray, ...]] = []
        high = max(1, TILE // m)
        for a in range(0, len(q_ids), high):
            b = min(a + high, len(q_ids))
            s = slice(q_cuts[a], q_cuts[b])
            table = np.zeros((dims, b - a), kind)  # the tile's query weights by term
            table[q_terms[s], q_rows[s] - a] = q_weights[s]
            scores, weighted = np.zeros((b - a, m), kind), np.empty((b - a, m), kind)
            for term in np.flatnonzero(table.any(1)):
                at, w = postings[term]
                if at is None:
                    np.multiply(table[term][:, None], w, out=weighted)
                    scores += weighted
                elif len(at):
                    live = np.flatnonzero(table[term])
                    scores[np.ix_(live, at)] += table[term][live][:, None] * w
            own_from, own_to = np.searchsorted(ids, q_ids[a:b], "left"), np.searchsorted(ids, q_ids[a:b], "right")
            for i in range(b - a):
                row, own = scores[i], slice(own_from[i], own_to[i])
                n = min(keep, m - (own.stop - own.start))
                if not n:
                    continue
                wide = row if kind is np.int64 else row.astype(np.int64)
                wide[own] = least - 1 if kind is np.int32 else least
                kth = np.partition(wide, m - n)[m - n]
                above = np.flatnonzero(wide > kth)
                ties = np.flatnonzero(wide == kth)
                if kind is np.int64 and kth == least:
                    ties = ties[(ties < own.start) | (ties >= own.stop)]
                best = np.concatenate([above, ties[: n - len(above)]])  # ids ascend, so ties go to the smaller
                found.append((np.full(len(best), q_keys[a + i]), np.full(len(best), q_ids[a + i]), ids[best], wide[best]))
        if not found:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=schema)

    return search


def exact_topk(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row its ``k`` highest integer inner products: query_id, rank, vec_id, score.

    A vector that is null or holds a null or a non-finite component takes no
    part, nor does a row without id.  What no 64-bit integer holds, a scaled component or one of the scores asked for, raises an error.  A shorter vector has weight 0 in the missing terms; an empty
    one scores 0.  Ties go to the smaller id.  Candidates are all rows but those with the query's id; repeated rows
    count one by one, as candidates and as queries.  Scores are exact in 64 bits.  Other columns are ignored.
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("w"), is_query.alias("_q"))
    vectors = vectors.where(F.col("w").isNotNull() & F.col("vec_id").isNotNull())
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(F.col("_q"), 1))).first()
    by_c, by_q = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    keyed = vectors.withColumn("_row", F.monotonically_increasing_id())
    spread = F.xxhash64("_row")
    grid = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    queries = keyed.where("_q").select(
        F.pmod(spread, F.lit(by_q)).cast("int").alias("qb"), grid(by_c).alias("cb"), F.col("_row").alias("query_row"), F.col("vec_id").alias("query_id"), "w"
    )
    candidates = keyed.select(grid(by_q).alias("qb"), F.pmod(spread, F.lit(by_c)).cast("int").alias("cb"), "vec_id", "w")
    best = (
        queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))
        .applyInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
