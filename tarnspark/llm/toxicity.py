"""Toxicity by a classifier chain.

The categories are predicted one after another.  Each link is a linear (logistic) model over
hashed words and word prefixes and the probabilities of the links before it.  A link is trained
with the out-of-fold probabilities of the earlier ones, so that it meets in training what it
will meet in use.  The last link is the label itself.

The tables label ``toxic`` only, so the categories come from the data: the labelled toxic documents are
clustered by the features that tell them from the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm import _text
from tarnspark.llm.quality import labelled_sample, one_row_an_id

#: Labelled documents that the fit reads at most, those of least hash of their id.
SAMPLE = 6_000
#: Hash space of words and prefixes, and the features that are kept: those with the strongest evidence.
SPACE, KEPT = 1 << 22, 1024
#: Bytes of the word prefixes that are features besides whole words.
PREFIXES = (4, 5, 6, 8)
FOLDS = 5
THRESHOLD = 0.5

#: Categories that the toxic labelled documents are clustered into, and the links of the chain.
KINDS = 3
LINKS = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
#: A fit ends when the gradient's norm has fallen to this part of its first value; it raises after so many steps.
SETTLED, STEPS = 1e-3, 2_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits and bytes over 127, A-Z in lower case), starts and rows' first word."""
    clean = np.where(_WORD[data], _text._LOWER[data], 32).astype(np.uint8)
    starts, ends, first = _text.words(clean, at)
    hashed = _text.RangeHash(clean)
    kinds = [hashed(starts, ends)]
    for n in PREFIXES:
        kinds.append(np.where(ends - starts > n, hashed(starts, np.minimum(starts + n, ends)) ^ _text.U(n), 0))
    return np.stack(kinds), starts, first


def hashed_features(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct feature numbers and how often each occurs; null counts as empty."""
    data, at = _text.buffers(column)
    for i, j in _text.slices(at):
        kinds, _, first = _tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
        bins = (kinds % _text.U(SPACE)).astype(np.int32)
        used = kinds != 0
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(bins[:, a:b][used[:, a:b]], return_counts=True)


def term_bins(words: Sequence[str]) -> np.ndarray:
    """The feature numbers of whole words."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    kinds, _, _ = _tokens(data, np.array([0, len(data)]))
    return (kinds[0] % _text.U(SPACE)).astype(np.int32)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Linear:
        """Logistic regression by a quasi-Newton method with limited memory, until the gradient vanishes."""
        n, d = x.shape
        if not n or y.min() == y.max():
            p = (y.sum() + 1) / (n + 2)
            return cls(np.zeros(d), float(np.log(p / (1 - p))))

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = (x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            value = (np.logaddexp(0, z) - y * z).sum() + 0.5 * penalty * (w[:-1] ** 2).sum()
            return float(value), np.append((x.T @ off.astype(x.dtype)).astype(float) + penalty * w[:-1], off.sum())

        w = np.append(np.zeros(d), np.log((y.sum() + 1) / (n - y.sum() + 1)))
        value, g = loss(w)
        first, past = np.linalg.norm(g), []
        for _ in range(STEPS):
            if np.linalg.norm(g) <= SETTLED * max(first, 1e-9):
                return cls(w[:-1], float(w[-1]))
            step, used = g.copy(), []
            for s, t, r in reversed(past):  # the two loops over remembered steps
                a = r * (s @ step)
                used.append(a)
                step -= a * t
            if past:
                step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
            for (s, t, r), a in zip(past, reversed(used), strict=True):
                step += s * (a - r * (t @ step))
            size, slope = 1.0 if past else 1 / max(1.0, np.linalg.norm(g)), g @ step
            while True:
                new = w - size * step
                less, h = loss(new)
                if less <= value - 1e-4 * size * slope:
                    break
                size /= 2
                if size < 1e-10:  # single precision doesn't tell the two apart any more
                    return cls(w[:-1], float(w[-1]))
            s, t = new - w, h - g
            if s @ t > 1e-10:
                past = [*past[-9:], (s, t, 1 / (s @ t))]
            w, value, g = new, less, h
        raise RuntimeError("the fit didn't settle")

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _presence(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.log(np.maximum(counts, 1)), 3.0)


def _matrix(rows: Sequence[tuple[np.ndarray, np.ndarray]], kept: np.ndarray, kind: type, more: np.ndarray | None = None) -> np.ndarray:
    """A row for each text and a column for each of the sorted feature numbers ``kept``, and then the columns ``more``."""
    x = np.zeros((len(rows), len(kept) + (0 if more is None else more.shape[1])), kind)
    if more is not None:
        x[:, len(kept) :] = more
    if len(kept):
        for r, (bins, counts) in enumerate(rows):
            at = np.minimum(np.searchsorted(kept, bins), len(kept) - 1)
            hit = kept[at] == bins
            x[r, at[hit]] = _presence(counts[hit])
    return x


@dataclass
class Chain:
    """``kept``: sorted feature numbers; ``links``: one model for each category, in order."""

    kept: np.ndarray
    names: tuple[str, ...]
    links: list[Linear]

    def matrix(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _matrix(rows, self.kept, np.float32)

    @classmethod
    def fit(cls, rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, names: Sequence[str], seed: int = 7) -> Chain:
        """``y``: a column of 0 and 1 for each name.  A fold's probabilities come from models whose features were chosen without it."""
        last = y[:, -1] if len(y) else np.zeros(0)
        chain = cls(_strongest(rows, last), tuple(names), [])
        part = np.random.default_rng(seed).permutation(len(rows)) % FOLDS
        folds = []
        for f in range(FOLDS if len(names) > 1 else 0):
            inside, others = np.flatnonzero(part == f), np.flatnonzero(part != f)
            folds.append((inside, others, _strongest([rows[i] for i in others], last[others])))
        out_of_fold = np.zeros((len(rows), 0), np.float32)
        for k in range(len(chain.names)):  # one matrix at a time, made anew for each link, so that the driver holds no more
            target, p = y[:, k].astype(float), np.zeros(len(rows))
            for inside, others, kept in folds if k + 1 < len(chain.names) else []:
                link = Linear.fit(_matrix([rows[i] for i in others], kept, np.float32, out_of_fold[others]), target[others])
                p[inside] = link.predict(_matrix([rows[i] for i in inside], kept, np.float32, out_of_fold[inside]))
            chain.links.append(Linear.fit(_matrix(rows, chain.kept, np.float32, out_of_fold), target))
            out_of_fold = np.hstack([out_of_fold, p[:, None].astype(np.float32)])
        return chain

    def predict(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = self.matrix(rows)
        out = np.zeros((len(rows), 0))
        for link in self.links:
            out = np.hstack([out, link.predict(np.hstack([x, out]))[:, None]])
        return out


def _strongest(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, signed: bool = False) -> np.ndarray:
    """Features in at least 3 rows whose presence tells most about ``y`` (smoothed log odds over its standard error); ``signed``: for 1 only."""
    if not len(rows):
        return np.zeros(0, np.int32)
    seen = [np.concatenate([b for (b, _), v in zip(rows, y, strict=True) if v == k] or [np.zeros(0, np.int32)]) for k in (0, 1)]
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    bins = np.unique(np.concatenate(seen))
    c0, c1 = (np.bincount(np.searchsorted(bins, s), minlength=len(bins)).astype(float) for s in seen)
    odds = np.log((c1 + 0.5) / (n[1] - c1 + 0.5)) - np.log((c0 + 0.5) / (n[0] - c0 + 0.5))
    error = np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    z = np.where(c0 + c1 >= 3, (odds if signed else np.abs(odds)) / error, 0)
    best = np.lexsort((bins, -z))[:KEPT]
    return np.sort(bins[best][z[best] > 1.5])


def category_labels(rows: Sequence[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """A column of 0 and 1 for each kind, and ``toxic`` last: the cluster of each toxic row, by spherical k-means over the features that
    toxic rows have more often.  The first centre is the mean, the others the rows least like those so far."""
    y = np.zeros((len(rows), kinds + 1), np.int8)
    y[:, -1] = toxic
    at = np.flatnonzero(toxic)
    kept = _strongest(rows, toxic, signed=True)
    if not len(at) or not len(kept):
        return y
    x = _matrix([rows[i] for i in at], kept, np.float32).astype(float)
    x *= np.log(len(x) / np.maximum((x > 0).sum(0), 1)) + 1  # a word that most have tells kinds apart less
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centers = x.mean(0, keepdims=True)
    for _ in range(kinds):
        centers = np.vstack([centers, x[(x @ centers.T).max(1).argmin()]])
    centers = centers[1:]
    for _ in range(50):
        own = (x @ centers.T).argmax(1)
        last, centers = centers, np.stack([x[own == k].sum(0) if (own == k).any() else c for k, c in enumerate(centers)])
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        if np.allclose(centers, last):
            break
    y[at, (x @ centers.T).argmax(1)] = 1
    return y


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Chain:
    """Fitted on a bounded sample of labelled documents; only their feature numbers reach the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(b.tobytes(), c.astype(np.int32).tobytes()) for b, c in hashed_features(batch["text"])]
            columns = [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], batch["y"], *columns], ["doc_id", "h", "y", "bins", "counts"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    made = labelled_sample(docs, labels, label, bound).mapInArrow(extract, f"doc_id {kind}, h long, y int, bins binary, counts binary")
    found = one_row_an_id(made).orderBy("doc_id").toArrow()
    rows = [(np.frombuffer(b.as_py(), np.int32), np.frombuffer(c.as_py(), np.int32)) for b, c in zip(found["bins"], found["counts"], strict=True)]
    toxic = np.array(found["y"].to_numpy(), np.int8)
    del found
    chain = Chain.fit(rows, category_labels(rows, toxic), LINKS)
    del rows
    _text.trim()
    return chain


def chain_column(chain: Chain):
    """A column function from text to a struct of the categories' probabilities."""

    @F.arrow_udf(", ".join(f"{name} double" for name in chain.names))
    def probabilities(text: pa.Array) -> pa.Array:
        out, rows = [], []
        for row in hashed_features(text):
            rows.append(row)
            if len(rows) == 256:
                out.append(chain.predict(rows))
                rows = []
        p = np.concatenate([*out, chain.predict(rows)])
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])], names=list(chain.names))

    return probabilities


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category, and ``is_toxic``, for every row.

    Whole texts are read.  Null and empty texts have the probabilities of a text without words; without
    labels every probability is the prior, 0.5.  Null ids and repeated rows are kept; other columns are ignored.
    """
    p = chain_column(fit(docs, labels))
    scored = docs.select("doc_id", p("text").alias("p"))
    return scored.select("doc_id", *(F.col(f"p.{c}").alias(f"p_{c}") for c in LINKS), (F.col("p.toxic") > threshold).alias("is_toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose last link exceeds ``threshold``; all columns and all other rows stay."""
    p = chain_column(fit(docs, labels))
    return docs.where(~(p("text")["toxic"] > threshold))
