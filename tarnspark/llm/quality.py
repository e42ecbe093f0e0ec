"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of the text alone are transformed (log, square root, logit) and standardised.
Each class has a Gaussian whose covariance is shrunk towards the pooled one and its diagonal;
a document's score is the logistic function of the difference of the two log densities,
computed from Mahalanobis distances with cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm import _text
from tarnspark.llm._scratch import bounded_sample

#: Labelled documents that the fit reads at most, those of least hash of their id.
SAMPLE = 20_000
#: Shrinkage towards the pooled covariance, and then towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
CLIP = 6.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digit", "symbol", "rare_symbol", "pipe", "newline", "high_byte",
    "short_words", "symbol_end", "capital_words", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "line_length", "byte_entropy", "repeat_next",
)
_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_DIGIT = (_B >= 48) & (_B <= 57)
_SYMBOL = (_B > 32) & (_B < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_RARE = np.isin(_B, list(b"#$%&*+<=>@[]^_{|}~\\!"))
_HIGH = _B >= 128


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _slice_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = len(at) - 1
    out = np.zeros((rows, len(FEATURES)))
    starts, ends, first = _text.words(data, at)
    hashes = _text.RangeHash(data)(starts, ends)
    lengths = (ends - starts).astype(float)
    last, initial = data[ends - 1] if len(ends) else data[:0], data[starts] if len(starts) else data[:0]
    for r in range(rows):
        text = data[at[r] : at[r + 1]]
        n, a, b = len(text), first[r], first[r + 1]
        w = b - a
        if not n or not w:
            out[r, :2] = np.log1p([n, w])
            continue
        seen = np.bincount(text, minlength=256)
        share = lambda mask: seen[mask].sum() / n  # noqa: B023, E731
        p = seen[seen > 0] / n
        size, h = lengths[a:b], hashes[a:b]
        _, times = np.unique(h, return_counts=True)
        pairs = len(np.unique(h[1:] * _text.U(3) + h[:-1])) if w > 1 else 1
        breaks = np.flatnonzero(text == 10)
        edges = np.concatenate([[0], breaks + 1, [n]])
        lines = len(edges) - 1
        line_hash = np.unique(np.add.reduceat(h, np.minimum(np.searchsorted(starts[a:b] - at[r], edges[:-1]), w - 1))) if lines > 1 else h[:1]
        out[r] = (
            np.log1p(n), np.log1p(w), np.log(size.mean()), np.log1p(size.std()),
            np.sqrt(share(_UPPER)), np.sqrt(share(_DIGIT)), np.sqrt(share(_SYMBOL)), np.sqrt(share(_RARE)), np.sqrt(seen[124] / n), np.sqrt(seen[10] / n), np.sqrt(share(_HIGH)),
            _logit((size <= 3).mean()), np.sqrt(_RARE[last[a:b]].mean()), np.sqrt(_UPPER[initial[a:b]].mean()),
            _logit(len(times) / w) + 0.3 * np.log1p(w), np.sqrt(times.max() / w), _logit(pairs / max(1, w - 1)), _logit(len(line_hash) / lines), np.log1p(w / lines), -(p * np.log2(p)).sum(),
            np.sqrt((h[1:] == h[:-1]).mean()) if w > 1 else 0.0,
        )
    return out


def features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of transformed statistics for each text; null counts as empty."""
    data, at = _text.buffers(column)
    parts = [_slice_features(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in _text.slices(at)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Means and Cholesky factors of classes 0 and 1 over standardised features."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverse of the lower Cholesky factors
    offsets: np.ndarray  # log prior - log determinant / 2

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
        """A class without rows has the mean of all and the pooled covariance; its prior is one row's."""
        d = x.shape[1]
        center = x.mean(0) if len(x) else np.zeros(d)
        scale = x.std(0) if len(x) else np.ones(d)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.clip((x - center) / scale, -CLIP, CLIP)
        own = [z[y == k] for k in (0, 1)]
        means = np.stack([v.mean(0) if len(v) else np.zeros(d) for v in own])
        scatter = [(v - m).T @ (v - m) for v, m in zip(own, means, strict=True)]
        pooled = (scatter[0] + scatter[1] + np.eye(d)) / (len(z) + 1)
        factors, offsets = [], []
        for v, s in zip(own, scatter, strict=True):
            mixed = (1 - to_pooled) * (s + pooled * d) / (len(v) + d) + to_pooled * pooled
            mixed = (1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
            lower = np.linalg.cholesky(mixed)
            factors.append(np.linalg.inv(lower))
            offsets.append(np.log((len(v) + 1) / (len(z) + 2)) - np.log(np.diag(lower)).sum())
        return cls(center, scale, means, np.stack(factors), np.array(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The logistic function of the difference of the log densities over the square root of the number of features.

        The features depend on each other in ways that no Gaussian has, so the plain difference is far too sure of itself; the
        root keeps scores apart from 0 and 1 and leaves their order as it is.
        """
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        density = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / np.sqrt(x.shape[1]), -35, 35)))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, h, text, y) of at most ``bound`` labelled ids, those of least hash; the broadcast side has so many rows at most.

    Null ids or labels and labels other than 0 and 1 are left out; an id labelled more than once
    counts with its largest label.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = bounded_sample(marked, ["doc_id"], bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "text", "y")


def one_row_an_id(made: DataFrame) -> DataFrame:
    """Of rows with equal doc_id that of least ``h``, without it; repeated rows go where they lie."""
    values = [c for c in made.columns if c not in ("doc_id", "h")]
    return made.groupBy("doc_id").agg(F.min_by(F.struct(*values), "h").alias("r")).select("doc_id", "r.*")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Discriminant:
    """Fitted on labelled documents outside the held-out fold; only their features reach the driver."""
    train = labelled_sample(docs, labels.where(fold(F.col("doc_id")) != 0), label, bound)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], batch["y"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "h", "y", "x"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    rows = one_row_an_id(train.mapInArrow(extract, f"doc_id {kind}, h long, y int, x array<double>")).orderBy("doc_id").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return Discriminant.fit(x, rows["y"].to_numpy())


def score_column(model: Discriminant):
    """A column function from text to the probability that the quality label is 1."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    The score depends on the whole text only.  Null and empty texts have the score of an empty text.
    A null id is never in the training set and counts as held out.  Without labels every score is 0.5.
    """
    score = score_column(fit(docs, labels))
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
