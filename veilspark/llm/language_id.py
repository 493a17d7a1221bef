"""Language identification by words first, with a back-off to shorter character n-grams for unseen words.

Fit: over labelled documents, frequencies of lower-cased letter runs (words) by language, and of character n-grams of
1 to 5 code points of the words with their edges marked. Predict: a known word adds its log frequency in each language;
an unseen word adds the mean log frequency of those of its n-grams that are known, at the greatest length at which any
is. The language with the greatest sum wins; its score is the posterior of the sums, tempered by the word count.

``fit_rows`` and ``fit_bytes`` bound the labelled documents that are used for fitting (those with the smallest hashes); prediction
covers whole texts of all rows. Word identity is a 62-bit hash over a prime field.

Defined results: null text and text without a letter give ``und`` with score 0, and so does any text when there is
nothing to learn from; ties go to the first language by code point; repeated rows get equal results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import bounded_sample, small_batches
from .textops import U, buffers, mix, prefix_hash, segments, span_hash

FIT_ROWS, FIT_BYTES = 6000, 64 << 20
LONGEST = 5
LEAST_COUNT = 2
UNDETERMINED = "und"
_TABLES: list[np.ndarray] = []


def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case) by code point."""
    if not _TABLES:
        letter, lower = np.zeros(sys.maxunicode + 1, dtype=bool), np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                if len(d := c.lower()) == 1:
                    lower[i] = ord(d)
        _TABLES.extend((letter, lower))
    return _TABLES[0], _TABLES[1]


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of the rows, and the starts, ends and row offsets of their letter runs."""
    letter, lower = _unicode()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = len(points)
    if n == 0:
        return points, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = letter[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    a, b = full.copy(), full.copy()
    a[1:] &= ~full[:-1] | edge[1:n]
    b[:-1] &= ~full[1:] | edge[1:n]
    start, end = np.flatnonzero(a), np.flatnonzero(b) + 1
    return lower[points], start, end, np.searchsorted(start, at)


def ngrams(points: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of words with one edge mark on each side, and the word offsets into them."""
    length = end - start + 2
    offsets = np.concatenate([[0], np.cumsum(length)])
    word = np.repeat(np.arange(len(start)), length)
    k = np.arange(offsets[-1]) - offsets[word]
    inner = (k > 0) & (k < length[word] - 1)
    padded = np.where(inner, points[np.minimum(start[word] + k - 1, len(points) - 1)], 0x110000) if len(points) else np.zeros(0, np.uint32)
    keep = k + size <= length[word]
    at = np.flatnonzero(keep)
    h = np.full(len(at), 0x51ED270B + size, dtype=U)
    for j in range(size):
        h = mix(h * U(0x9E3779B97F4A7C15) + padded[at + j].astype(U))
    return h, np.concatenate([[0], np.cumsum(np.maximum(length - size + 1, 0))])


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # sorted hashes of words and n-grams
    logs: np.ndarray  # float32, one column per language

    def __post_init__(self) -> None:
        """Lookup by the top bits of the hash: the first key of each bucket."""
        self.shift = U(64 - max(1, min(22, int(len(self.keys)).bit_length() + 1)))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << int(U(64) - self.shift)) + 1, dtype=U)) if len(self.keys) else np.zeros(1, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where unknown."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        left = np.arange(len(h))
        while len(left):
            open_ = at[left] < stop[left]
            left = left[open_]
            same = self.keys[at[left]] == h[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, score) of each row."""
        n = len(offsets) - 1
        best, score = np.full(n, -1, dtype=np.int64), np.zeros(n)
        for a, b in segments(offsets):
            part = offsets[a : b + 1] - offsets[a]
            points, start, end, rows = letter_runs(data[offsets[a] : offsets[b]], part)
            if not len(start) or not self.languages:
                continue
            h, back = np.unique(span_hash(prefix_hash(points), start, end), return_inverse=True)
            first = np.full(len(h), len(start), dtype=np.int64)
            np.minimum.at(first, back, np.arange(len(start)))
            found = self.find(h)
            value = np.zeros((len(h), len(self.languages)), dtype=np.float64)
            value[found >= 0] = self.logs[found[found >= 0]]
            unseen = np.flatnonzero(found < 0)
            for size in range(LONGEST, 0, -1):
                if not len(unseen):
                    break
                grams, at = ngrams(points, start[first[unseen]], end[first[unseen]], size)
                hit = self.find(grams)
                known = np.concatenate([[0], np.cumsum(hit >= 0)])
                count = known[at[1:]] - known[at[:-1]]
                sums = np.concatenate([np.zeros((1, value.shape[1])), np.cumsum(self.logs[hit[hit >= 0]], axis=0, dtype=np.float64)])
                got = count > 0
                value[unseen[got]] = (sums[known[at[1:]]] - sums[known[at[:-1]]])[got] / count[got, None]
                unseen = unseen[~got]
            total = np.concatenate([np.zeros((1, value.shape[1])), np.cumsum(value[back], axis=0)])
            words = np.diff(rows)
            total = total[rows[1:]] - total[rows[:-1]]
            total /= np.sqrt(np.maximum(words, 1))[:, None]
            total -= total.max(axis=1, keepdims=True)
            posterior = np.exp(total)
            posterior /= posterior.sum(axis=1, keepdims=True)
            top = posterior.argmax(axis=1)
            best[a:b] = np.where(words > 0, top, -1)
            score[a:b] = np.where(words > 0, posterior[np.arange(b - a), top], 0.0)
        return best, score


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, text: str = "text", key: str = "doc_id", lang: str = "lang") -> Model:
    """Learn from at most ``fit_rows`` rows with a non-null language, of at most ``fit_bytes`` bytes together. What reaches the
    driver is bounded by their texts."""
    own = labelled.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull())
    sample = bounded_sample(own, fit_rows, fit_bytes, "text").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in dict.fromkeys(labels):
                own = batch.column(1).filter(pa.array(labels == name))
                data, offsets = buffers(own)
                for a, b in segments(offsets):
                    points, start, end, _ = letter_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    parts = [(0, span_hash(prefix_hash(points), start, end)), *((k, ngrams(points, start, end, k)[0]) for k in range(1, LONGEST + 1))]
                    for size, h in parts:
                        u, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(np.full(len(u), size, np.int32)), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "size", "h", "n"])

    counts = sample.mapInArrow(count, "lang string, size int, h long, n long").groupBy("lang", "size", "h").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")
    table = counts.toArrow()
    if not table.num_rows:
        return Model([], np.zeros(0, U), np.zeros((0, 0), np.float32))
    names = np.array(table["lang"].to_pylist(), dtype=object)
    languages = sorted(set(names), key=lambda s: s.encode("utf-32-be"))
    column = np.searchsorted(np.array(languages, dtype=object), names)
    size, h, n = (table[c].to_numpy() for c in ("size", "h", "n"))
    keys, row = np.unique(h.view(U), return_inverse=True)
    counts_by = np.zeros((len(keys), len(languages)), dtype=np.float64)
    np.add.at(counts_by, (row, column), n)
    kind = np.zeros(len(keys), dtype=np.int64)
    kind[row] = size
    logs = np.zeros_like(counts_by)
    for k in range(LONGEST + 1):
        of = kind == k
        logs[of] = np.log((counts_by[of] + 0.5) / (counts_by[of].sum(axis=0) + 0.5 * max(1, int(of.sum()))))
    return Model(languages, keys, logs.astype(np.float32))


def detect(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score) of each row, in one pass without a shuffle. ``keep`` cannot have the names of results;
    ``with_language`` hands on all columns, whatever their names."""
    rows = docs.select(F.struct(*(F.col(c) for c in (key, *keep))).alias("row"), F.col(text).alias("text"))
    return _predicted(rows, model, None).select("row.*", "lang_pred", "score")


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): each row as a struct of all its columns, with the language of its text."""
    return _predicted(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")), model, docs.columns.index(text))


def _predicted(rows: DataFrame, model: Model, at: int | None) -> DataFrame:
    """Predictions for rows (row) whose text is the field ``at``, or (row, text). The model is sent once to each executor."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((model.languages, model.keys, model.logs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        names = pa.array([*own.languages, UNDETERMINED])
        for batch in batches:
            best, score = own.scores(*buffers(batch.column(1) if at is None else batch.column(0).field(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(np.where(best < 0, len(own.languages), best))), pa.array(score)], names=["row", "lang_pred", "score"])

    out = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(predict, out)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))
