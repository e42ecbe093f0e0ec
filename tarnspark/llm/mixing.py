"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic).  The cells' token totals are raked, with no
probability above 1, until the marginals of all three dimensions meet their targets; a document is then kept with
the calibrated probability of its cell, decided by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm import _text
from tarnspark.llm._scratch import drop, free_names, save

#: Cells that raking takes, at most: the rows that the driver holds and broadcasts.  More raise an error, as nobody states targets for so many.
CELLS = 200_000
#: Rounds of raking, error of a share at which targets count as met, and halvings of the way from the shares that are there to the targets.
ROUNDS, TOLERANCE, HALVINGS = 400, 2e-4, 10
#: The part of all tokens that is kept.
SHARE = 0.8
#: Dimensions of a document's vector; topics; rounds of k-means at most.
TOPIC_SPACE, TOPICS, TOPIC_ROUNDS = 512, 6, 20
#: Vectors are kept as whole numbers of this part of one, a byte each, so that sums don't depend on the order of rows; movement at which centres count as settled.
GRAIN, SETTLED = 255, 1e-3
DIMENSIONS = ("source", "lang", "topic")
#: Stands for null in a dimension.
NONE = "\x00none"


# --- topics -----------------------------------------------------------------
def _vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Square-rooted hashed word counts of unit length, and the numbers of words."""
    data, at = _text.buffers(column)
    out, n_words = np.zeros((len(at) - 1, TOPIC_SPACE)), np.zeros(len(at) - 1, np.int64)
    for i, j in _text.slices(at):
        hashes, first = _text.word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        counts = np.diff(first)
        n_words[i:j] = counts
        bins = (hashes % _text.U(TOPIC_SPACE)).astype(np.int64) + TOPIC_SPACE * np.repeat(np.arange(j - i), counts)
        out[i:j] = np.bincount(bins, minlength=TOPIC_SPACE * (j - i)).reshape(j - i, TOPIC_SPACE)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), n_words


def _stacked(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Pieces of a column of saved vectors, the whole numbers in them as rows, and the same as unit vectors."""
    for i in range(0, len(column), 1024):
        part = column.slice(i, 1024)
        data, at = _text.buffers(part)
        x = data[at[0] : at[-1]].reshape(-1, TOPIC_SPACE).astype(np.float32)
        yield part, x, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)


def _farthest(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The vector least like those given, of equals the least by bytes; each task sends one."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[float, bytes] | None = None
        for batch in batches:
            for part, _, x in _stacked(batch["v"]):
                near = np.round((x @ centers.T).max(1), 6)
                found = min((float(near[k]), part[int(k)].as_py()) for k in np.flatnonzero(near == near.min()))
                best = found if best is None else min(best, found)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary())], ["d", "v"])
        _text.trim()

    found = vectors.mapInArrow(least, "d double, v binary").agg(F.min(F.struct("d", "v")).alias("m")).first()["m"]
    return _unit(found["v"])


def _unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(float)
    return x / np.linalg.norm(x)


def _sums(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """For each centre the sum of the vectors that are nearest to it; each task sends one row a centre and dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centers), TOPIC_SPACE))  # whole numbers below 2**53, so exact
        for batch in batches:
            for _, whole, x in _stacked(batch["v"]):
                own = np.round(x @ centers.T, 6).argmax(1)
                total += (own == np.arange(len(centers))[:, None]).astype(np.float32) @ whole  # at most 1024 * 255 in single precision
        _text.trim()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at].astype(np.int64))], ["at", "s"])

    got = vectors.mapInArrow(add, "at long, s long").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(len(centers) * TOPIC_SPACE)
    out[got["at"].to_numpy()] = got["s"].to_numpy()
    return out.reshape(len(centers), TOPIC_SPACE)


def fit_topics(docs: DataFrame, topics: int = TOPICS) -> np.ndarray:
    """Centroids by spherical k-means over all documents that have words; what reaches the driver doesn't grow with them."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches):
            v, n = _vectors(batch["text"])
            whole = np.rint(v[n > 0] * GRAIN).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in whole], pa.binary())], ["v"])
        _text.trim()

    vectors = save(docs.select("text").mapInArrow(extract, "v binary"), "vectors")
    first = vectors.agg(F.min("v").alias("v")).first()["v"]
    if first is None:
        drop(vectors)
        return np.zeros((1, TOPIC_SPACE))
    centers = _unit(first)[None]
    for _ in range(topics - 1):  # the next centre is the vector least like those so far
        centers = np.vstack([centers, _farthest(vectors, centers)])
    for _ in range(TOPIC_ROUNDS):
        sums, last = _sums(vectors, centers), centers
        centers = np.where(sums.any(1, keepdims=True), sums, centers)
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        if np.abs(centers - last).max() < SETTLED:
            break
    drop(vectors)
    _text.trim()
    return centers


def topic_column(centers: np.ndarray):
    """A column function from text to (topic, tokens): the nearest centroid, and the number of words and one."""

    @F.arrow_udf("topic string, tokens long")
    def topic(text: pa.Array) -> pa.Array:
        names, sizes = [], []
        for i in range(0, len(text), 1024):
            v, n = _vectors(text[i : i + 1024])
            names += [f"t{k}" for k in (v @ centers.T).argmax(1)]
            sizes.append(n + 1)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))], ["topic", "tokens"])

    return topic


# --- raking -----------------------------------------------------------------
@dataclass
class Raked:
    """``weights``: a DataFrame of the dimensions, ``mass`` and ``probability``, of ``CELLS`` rows at most; ``reached``: how far, from 0 to 1, the
    shares lie on the way from those that are there to the (feasible) targets; ``error``: their largest difference from that point."""

    weights: DataFrame
    reached: float
    error: float


def _filling(mass: np.ndarray, weight: np.ndarray, code: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each value the factor f with sum(mass * min(1, f * weight)) over its cells = ``want``, or the one that makes all of them 1."""
    out = np.ones(len(want))
    order = np.lexsort((-weight, code))
    ends = np.searchsorted(code[order], np.arange(len(want) + 1))
    for v, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        m, w = mass[order[a:b]], weight[order[a:b]]
        rest = np.cumsum((m * w)[::-1])[::-1]
        full = np.cumsum(m) - m
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.where(rest > 0, (want[v] - full) / rest, np.inf)  # if the cells before k have probability 1
        fits = np.flatnonzero(f * w <= 1)
        if want[v] <= 0:
            out[v] = 0.0
        elif len(fits):
            out[v] = max(f[fits[0]], 0.0)
        elif b > a and (w > 0).any():
            out[v] = 1 / w[w > 0].min()
    return out


def feasible(goal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``goal`` with no share above ``most``: what a value can't give is given by the others, in proportion to their goals."""
    out, full = goal.copy(), np.zeros(len(goal), bool)
    for _ in range(len(goal)):
        over = (out > most * (1 + 1e-12)) & ~full
        if not over.any():
            break
        full |= over
        rest = out[~full].sum()
        out = np.where(full, most, out * ((1 - most[full].sum()) / rest if rest > 0 else 0.0))
    return out


def _fitted(codes: Sequence[np.ndarray], mass: np.ndarray, goals: Sequence[np.ndarray], share: float, rounds: int) -> tuple[np.ndarray, float]:
    """(probabilities, error): iterative proportional fitting under the bound, each step of which solves for one dimension's factors exactly."""
    total, w, error, last = mass.sum(), np.ones(len(mass)), np.inf, np.inf
    for k in range(rounds):
        for code, goal in zip(codes, goals, strict=True):
            w = np.minimum(w * _filling(mass, w, code, goal * share * total)[code], 1e12)
        if k % 10 == 9:
            p = np.minimum(w, 1.0)
            kept = max((p * mass).sum(), 1e-300)
            error = max(float(np.abs(np.bincount(code, mass * p, len(goal)) / kept - goal).max()) for code, goal in zip(codes, goals, strict=True))
            if error < TOLERANCE / 10 or error > 0.9 * last:  # met, or it doesn't come nearer
                break
            last = error
    return np.minimum(w, 1.0), error


def rake_cells(codes: Sequence[np.ndarray], mass: np.ndarray, shares: Sequence[np.ndarray], share: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """(probabilities, reached, error): probabilities in [0, 1] of cells, products of a factor for each value cut at 1, so that ``share`` of all
    mass is kept and each dimension's shares of it are those given.

    A value whose target is more than all its mass gives all (``feasible``).  Targets of several dimensions may still contradict each other under the
    bound (a topic of one language only, say).  The shares that are there always can be kept, and what can be kept is convex, so the
    targets are then approached from there as far as possible: ``reached`` is found by halving.
    """
    seen = [np.bincount(code, mass, len(goal)) / mass.sum() for code, goal in zip(codes, shares, strict=True)]
    wanted = [feasible(goal, s / share) for goal, s in zip(shares, seen, strict=True)]
    at = lambda reached: [s + reached * (goal - s) for goal, s in zip(wanted, seen, strict=True)]
    p, error = _fitted(codes, mass, at(1.0), share, rounds)
    if error <= TOLERANCE:
        return p, 1.0, error
    low, high, best = 0.0, 1.0, (np.full(len(mass), share), 0.0)
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        p, error = _fitted(codes, mass, at(middle), share, rounds)
        if error <= TOLERANCE:
            low, best = middle, (p, error)
        else:
            high = middle
    return best[0], low, best[1]


def _complete(share: Mapping[str, float], present: Sequence[str]) -> dict[str, float]:
    """Shares of the values that are present; one without a target gets none, unless no value has one."""
    got = {v: max(0.0, float(share.get(v, 0.0))) for v in present}
    total = sum(got.values())
    return {v: (s / total if total else 1 / len(got)) for v, s in got.items()}


Target = Callable[[Mapping[str, float]], Mapping[str, float]]


def tempered(power: float) -> Target:
    """Targets from the observed shares, each raised to ``power``: 1 keeps them, 0 makes them equal."""
    return lambda seen: {v: s**power if s > 0 else 0.0 for v, s in seen.items()}


def rake(cells: DataFrame, targets: Mapping[str, Target], share: float = SHARE, rounds: int = ROUNDS) -> Raked:
    """``cells``: the dimensions, strings without null, and ``mass``, one row per cell; ``CELLS`` at most, else ValueError."""
    dims = list(targets)
    got = cells.orderBy(*dims).limit(CELLS + 1).toArrow()
    if got.num_rows > CELLS:
        raise ValueError(f"more than {CELLS} cells; map {', '.join(dims)} to coarser values")
    mass = np.array(got["mass"].to_numpy(), float)
    codes, shares = [], []
    for d in dims:
        values, code = np.unique(np.array(got[d].to_pylist(), str), return_inverse=True)
        seen = np.bincount(code, mass, len(values)) / max(mass.sum(), 1e-300)
        goal = _complete(targets[d](dict(zip(values, seen, strict=True))), list(values))
        codes.append(code)
        shares.append(np.array([goal[v] for v in values]))
    p, reached, error = rake_cells(codes, mass, shares, share, rounds) if got.num_rows else (np.zeros(0), 1.0, 0.0)
    rows = list(zip(*(got[c].to_pylist() for c in (*dims, "mass")), p.tolist(), strict=True))
    return Raked(cells.sparkSession.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", mass double, probability double"), reached, error)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


DEFAULT_TARGETS: dict[str, Target] = {"source": tempered(0.8), "lang": tempered(0.8), "topic": tempered(0.9)}


def sampled(docs: DataFrame, targets: Mapping[str, Target] = DEFAULT_TARGETS, share: float = SHARE, seed: int = 0, topics: int = TOPICS, mix: str = "_mix") -> DataFrame:
    """``docs`` with a struct column ``mix``, new to ``docs``: tokens, topic, probability, kept, and for all rows alike reached and error (see ``Raked``).

    Probabilities are raked under the bound 1, so that the tokens expected to be kept have the target shares by source, language and topic,
    but for ``error``; targets that can't be met under the bound are approached as far as they can be (``rake_cells``).  The tokens are ``share`` of all.  Null source or language is a value of its
    own.  The decision depends on the id and the seed, so repeated rows share it; a null id takes the hash of the text.  An empty table stays empty.
    """
    if mix in docs.columns:
        raise ValueError(f"{mix} is a column already")
    names = docs.columns
    (own,) = free_names(docs, "_d")
    described = docs.withColumn(own, topic_column(fit_topics(docs, topics))("text"))
    values = {d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) if d != "topic" else F.col(f"{own}.topic") for d in targets}
    cells = save(described.groupBy(*(c.alias(d) for d, c in values.items())).agg(F.sum(f"{own}.tokens").cast("double").alias("mass")), "cells")
    raked = rake(cells, targets, share)
    keys = dict(zip(values, free_names(docs, *(f"_w_{d}" for d in values)), strict=True))
    (p,) = free_names(docs, "_p")
    weights = F.broadcast(raked.weights.select(*(F.col(d).alias(n) for d, n in keys.items()), F.col("probability").alias(p)))  # CELLS rows at most
    joined = described.join(weights, [values[d] == F.col(n) for d, n in keys.items()], "left")
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    decided = F.struct(F.col(f"{own}.tokens").alias("tokens"), F.col(f"{own}.topic").alias("topic"), F.col(p).alias("probability"), (uniform(key, seed=seed) < F.col(p)).alias("kept"), F.lit(raked.reached).alias("reached"), F.lit(raked.error).alias("error"))
    return joined.select(*names, decided.alias(mix))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang and the columns of ``sampled`` for every row, kept or not."""
    slim = docs.select("doc_id", "text", "source", "lang")
    return sampled(slim, **options).select("doc_id", "source", "lang", "_mix.*")


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    (mix,) = free_names(docs, "_mix")
    return sampled(docs, mix=mix, **options).where(F.col(f"{mix}.kept")).select(*docs.columns)
