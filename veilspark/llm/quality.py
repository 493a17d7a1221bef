"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are single tokens, pairs of neighbouring tokens, and the patterns "x x" and "x y x" for any token x, hashed to
``2**BITS`` weights; tokens are runs of letters and digits, or runs of other visible characters, as written. A feature's value is its share of the text's tokens, scaled, so
a text's score is one sparse dot product whatever its length.

``fit_rows`` and ``fit_bytes`` bound the labelled documents used for training (those with the smallest hashes), which one task
reads in hash order; scoring covers whole texts of all rows.

Defined results: null text is empty; an empty text has the bias alone as its score; without training rows every score is
0.5; rows labelled null, or with conflicting labels, are left out of training; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, small_batches
from .textops import IS_SPACE, U, buffers, mix, prefix_hash, segments, span_hash

BITS = 18
FIT_ROWS, FIT_BYTES = 16000, 64 << 20
SCALE = 8.0
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.02, 0.2, 2

#: Hashes of the n-grams "x x" and "x y x" with whatever token x, which stand for immediate repetition.
REPEATS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature index of each occurrence, row offsets into them, and tokens of each row."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64), np.zeros(rows, np.int64)
    kind = np.where(IS_SPACE[data], 0, np.where(_WORD[data], 1, 2)).astype(np.int8)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    full = kind[start] > 0
    start, end = start[full], end[full]
    h = span_hash(prefix_hash(data), start, end)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    marks, values = [np.arange(len(h)) * 4], [h]
    for gap in (1, 2):
        left, right = h[:-gap], h[gap:]
        inside = row[:-gap] == row[gap:]
        if gap == 1:
            at = np.flatnonzero(inside)
            marks.append(at * 4 + 1)
            values.append(mix(left[at] * U(3) + right[at]))
        same = np.flatnonzero(inside & (left == right))
        marks.append(same * 4 + 1 + gap)
        values.append(np.full(len(same), REPEATS[gap - 1], dtype=U))
    marks, values = np.concatenate(marks), np.concatenate(values)
    order = np.argsort(marks, kind="stable")
    return (values[order] >> U(64 - BITS)).astype(np.int64), np.searchsorted(marks[order], first * 4), np.diff(first)


class Leader:
    """FTRL-proximal state."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias = np.zeros(2)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        b = -self.bias[0] / ((BETA + np.sqrt(self.bias[1])) / ALPHA)
        p = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30)))
        g = (p - label) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g
        g0 = p - label
        s0 = (np.sqrt(self.bias[1] + g0 * g0) - np.sqrt(self.bias[1])) / ALPHA
        self.bias += (g0 - s0 * b, g0 * g0)

    def bias_weight(self) -> float:
        return float(-self.bias[0] / ((BETA + np.sqrt(self.bias[1])) / ALPHA))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, text: str = "text", key: str = "doc_id", label: str = "quality") -> np.ndarray:
    """Weights, the bias last."""
    named = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("y is not null and k is not null")
    one = named.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y")
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = bounded_sample(own, fit_rows, fit_bytes, "t", one).select("_h", "y", "t")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            at, x = [], []
            for a, b in segments(offsets):
                index, where, tokens = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i in range(b - a):
                    u, n = np.unique(index[where[i] : where[i + 1]], return_counts=True)
                    at.append(u.astype(np.int32))
                    x.append((n * (SCALE / max(1, tokens[i]))).astype(np.float32))
            sizes = np.concatenate([[0], np.cumsum([len(v) for v in at])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(v) if v else np.zeros(0, t))) for v, t in ((at, np.int32), (x, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *lists], names=["h", "y", "at", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, seen = Leader(), []
        for batch in batches:
            y = batch.column(1).to_numpy()
            for k in range(batch.num_rows):
                at, x = batch.column(2)[k].values, batch.column(3)[k].values
                seen.append((at.to_numpy().astype(np.int32), x.to_numpy().astype(np.float32), int(y[k])))
        for _ in range(PASSES if seen else 0):
            for at, x, label_ in seen:
                leader.update(at, x.astype(np.float64), label_)
        w = leader.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS).astype(np.int64)), pa.array(np.append(w[at], leader.bias_weight()))], names=["at", "w"])

    one_task = rows.mapInArrow(sparse, "h long, y int, at array<int>, x array<float>").repartition(1).sortWithinPartitions("h", "y")
    found = one_task.mapInArrow(train, "at long, w double").toArrow()
    out = np.zeros((1 << BITS) + 1)
    np.add.at(out, found["at"].to_numpy(), found["w"].to_numpy())
    return out.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score) of each row, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            out = np.zeros(len(offsets) - 1)
            for a, b in segments(offsets):
                index, where, tokens = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sums = np.concatenate([[0.0], np.cumsum(w[index], dtype=np.float64)])
                out[a:b] = (sums[where[1:]] - sums[where[:-1]]) * SCALE / np.maximum(tokens, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(out + w[-1], -30, 30))))], names=[key, *keep, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(key, *keep, text).mapInArrow(dot, f"{fields}, score double")
