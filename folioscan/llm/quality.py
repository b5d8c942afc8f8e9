"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and towards its own diagonal. The
score of a text is the logistic of the difference of the two Mahalanobis log-densities plus the log prior odds;
the inverse Cholesky factors are computed once per model and travel with it. The difference counts by a factor that grows
with the number of words, so that a few words can outweigh the prior only if they are far off.

Defined results: a null text counts as empty, and an empty text has the statistics of no words and gets a score
like any other; equal texts get equal scores, whatever else is in their batch; without two labelled rows of each class every score is the share of
label 1 (0.5 without labels). Null ids are never labelled; labels other than 0 and 1 are ignored; a repeated
label counts each time it stands there. Whole texts are read, of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import distinct_per_text, map_arrow, per_text, pieces_of, range_hashes, utf8, words

#: Share of the pooled covariance and of the diagonal in each class covariance, and the ridge on it.
POOLED, DIAGONAL, RIDGE = 0.2, 0.1, 1e-3
THRESHOLD = 0.3
#: Shares of a few words are noise: the log-density difference of a text of w words counts by the factor min(1, w / SHRINK).
SHRINK = 150.0
STATISTICS = ("bytes", "words", "word_length", "upper", "digits", "exclaims", "bars", "symbols", "stops", "commas", "wide", "distinct_words", "echoes", "words_a_stop", "distinct_lines", "capitals", "line_words")

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b"#$%&*@^~<>{}[]\\_=+", b".?", b",;:"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[0xC0:] = 9


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each of the concatenated UTF-8 texts."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    count = {k: per_text(kind == k, offsets).astype(float) for k in range(1, 10)}
    starts, ends, text = words(data, offsets)
    hashes = range_hashes(data, starts, ends)
    n_bytes, n_words = np.diff(offsets).astype(float), np.bincount(text, minlength=n).astype(float)
    echo = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n)
    cuts = np.flatnonzero(data == 10)
    lo, hi = np.concatenate((offsets[:-1], cuts + 1)), np.concatenate((offsets[1:], cuts))
    lo.sort()
    hi.sort()
    full = hi > lo
    lines = np.searchsorted(offsets, lo[full], side="right") - 1
    n_lines = np.bincount(lines, minlength=n).astype(float)
    letters = count[1] + count[2] + count[9]
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    first = _CLASS[data[starts]] == 1
    return np.column_stack([
        np.log1p(n_bytes), np.log1p(n_words), np.log1p(n_bytes / np.maximum(n_words, 1)), share(count[1], letters),
        *(share(count[k], n_words) for k in (3, 4, 5, 6, 7, 8)), share(count[9], letters),
        np.log((distinct_per_text(hashes, text, n) + 1) / (n_words + 1)), share(echo, n_words), np.log1p(n_words / (count[7] + 1)),
        (distinct_per_text(range_hashes(data, lo[full], hi[full]), lines, n) + 1) / (n_lines + 1),
        share(np.bincount(text[first], minlength=n), n_words), np.log1p(n_words / np.maximum(n_lines, 1)),
    ])


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``x``, the statistics of the whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(*utf8(batch.column(1)))
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), values], [key, "x"])

    return map_arrow(df.select(key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, x array<double>", text)


def _rowwise(z: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``z @ factor.T``, each row summed in the same order whatever the number of rows."""
    out = np.zeros((len(z), len(factor)))
    for k in range(z.shape[1]):
        out += z[:, k : k + 1] * factor[:, k]
    return out


@dataclass
class Model:
    """Two classes: centre, inverse Cholesky factor and log determinant of each, and log prior odds of label 1."""

    shift: np.ndarray
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = np.full(len(x), self.odds)
        if self.factors:
            z = (x - self.shift) / self.scale
            far = [np.square(_rowwise(z - c, f)).sum(axis=1) + ld for c, f, ld in zip(self.centres, self.factors, self.logdets, strict=True)]
            n = np.expm1(x[:, STATISTICS.index("words")])
            d += (far[0] - far[1]) / 2 * np.minimum(1, n / SHRINK)
        return np.round(1 / (1 + np.exp(-np.clip(d, -700, 700))), 9)


def _moments(labelled: DataFrame, label: str) -> dict[int, np.ndarray]:
    """For each class the sum of (1, x)(1, x)'; the result has a fixed size, whatever the input."""
    k = len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, k, k))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.ones(b.num_rows), b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k - 1)])
                y = b.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    sums[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], k * k), pa.int32()), pa.array(np.tile(np.arange(k * k), 2), pa.int32()), pa.array(sums.ravel())], ["c", "at", "v"])

    rows = labelled.select("x", F.col(label).cast("int").alias("y")).mapInArrow(run, "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect()
    out = {0: np.zeros((k, k)), 1: np.zeros((k, k))}
    for r in rows:
        out[r["c"]][divmod(r["at"], k)] = r["v"]
    return out


def fit(labelled: DataFrame, label: str = "quality", pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """Fit on all rows of ``labelled``: ``x`` from ``features`` and a label of 0 or 1."""
    m = _moments(labelled.where(F.col(label).isin(0, 1)), label)
    n = [m[c][0, 0] for c in (0, 1)]
    if min(n) < 2:
        share = n[1] / sum(n) if sum(n) else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1), np.ones(1), [], [], [], math.log(share / (1 - share)))
    both = m[0] + m[1]
    shift = both[0, 1:] / both[0, 0]
    scale = np.diag(both)[1:] / both[0, 0] - shift**2
    scale = np.sqrt(np.where(scale > 1e-9, scale, 1.0))  # a statistic that is the same for all texts says nothing
    centres = [(m[c][0, 1:] / n[c] - shift) / scale for c in (0, 1)]
    raw = [(m[c][1:, 1:] / n[c] - np.outer(m[c][0, 1:], m[c][0, 1:]) / n[c] ** 2) / np.outer(scale, scale) for c in (0, 1)]
    within = (n[0] * raw[0] + n[1] * raw[1]) / sum(n)
    factors, logdets = [], []
    for c in (0, 1):
        s = (1 - pooled) * raw[c] + pooled * within
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s))
        values, axes = np.linalg.eigh((s + s.T) / 2)
        chol = np.linalg.cholesky((axes * np.maximum(values, 0)) @ axes.T + RIDGE * np.eye(len(s)))
        factors.append(np.linalg.inv(chol))
        logdets.append(2 * float(np.log(np.diag(chol)).sum()))
    return Model(shift, scale, centres, factors, logdets, math.log(n[1] / n[0]))


def score(feats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """The key and ``score`` for rows of ``features``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], [key, "score"])

    return map_arrow(feats.select(key, "x"), run, f"{key} {feats.schema[key].dataType.simpleString()}, score double", None)


def keep(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores ``threshold`` or more, unchanged; no row is moved."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = np.concatenate([model.scores(statistics(*utf8(p.column(at)))) >= threshold for p in pieces_of(batch, text, 2 << 20)])
                if good.any():
                    yield batch.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def held_out(key: Column | str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % folds == fold


def fit_on(feats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """Fit on the labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(key, label)
    return fit(feats.select(key, "x").join(known, key), label)
