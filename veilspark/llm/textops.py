"""Vectorised byte and word primitives over Arrow string batches.

All functions work on a whole batch at once: a flat ``uint8`` buffer and the row offsets of an Arrow
string column. Long batches are cut into segments of about ``SEGMENT`` bytes so that temporary arrays stay
small whatever the batch or the longest text is; a text longer than that makes a segment of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

#: Runs of values are hashed as polynomials over the prime field of PRIME, at two points each: two different runs of n
#: values agree at a point with a chance of n / PRIME at most, whatever the values are. (A polynomial modulo a power of two
#: has short strings that agree at every odd point.) A family is a pair of points, so two families give 124 bits.
PRIME = (1 << 31) - 1
_POINTS = ((0x2545F491, 0x4F6CDD1D), (0x5851F42D, 0x1B873593))

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a full-avalanche permutation), in a new array."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


class _Powers:
    """Powers of a point and of its inverse in the field, grown on demand."""

    def __init__(self, point: int) -> None:
        self.point, self.back = point % PRIME, pow(point, -1, PRIME)
        self.up = self.down = np.ones(1, dtype=np.uint32)

    def need(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, SEGMENT + 1)
        self.up, self.down = (self._grown(x, n) for x in (self.point, self.back))

    @staticmethod
    def _grown(x: int, n: int) -> np.ndarray:
        out = np.ones(1, dtype=U)
        while len(out) < n:
            out = np.concatenate([out, out * U(pow(x, len(out), PRIME)) % U(PRIME)])
        return out[:n].astype(np.uint32)


POWERS = [[_Powers(x) for x in family] for family in _POINTS]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty. No copy unless the array has nulls."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about ``limit`` bytes (one row at least)."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


@dataclass(frozen=True)
class Prefix:
    """Running polynomials of a run of values: entry i covers the first i values and is right modulo PRIME. One row for each
    point of the family."""

    family: int
    sums: tuple[np.ndarray, ...]


_PIECE = 1 << 22  # values of a piece of sums, which stay under 2**62
_LIFT = U(PRIME * ((1 << 62) // PRIME + 1))


def prefix_hash(values: np.ndarray, family: int = 0) -> Prefix:
    """Running hashes of values under 2**22."""
    sums = []
    for powers in POWERS[family]:
        powers.need(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U)
        done = U(0)
        for x in range(0, len(values), _PIECE):
            y = min(len(values), x + _PIECE)
            part = values[x:y].astype(U)
            part += U(1)
            part *= powers.up[x:y]
            if values.dtype.itemsize > 1:
                part %= U(PRIME)
            part[0] += done
            np.cumsum(part, out=out[x + 1 : y + 1])
            done = out[y] % U(PRIME)
        sums.append(out)
    return Prefix(family, tuple(sums))


def span_hash(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the value runs [start, end), independent of where they stand."""
    h = None
    for powers, sums in zip(POWERS[prefix.family], prefix.sums, strict=True):
        own = sums[end] + _LIFT - sums[start]
        own %= U(PRIME)
        own *= powers.down[start]
        own %= U(PRIME)
        h = own if h is None else h << U(31) | own
    return mix(h + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def sampling_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Cheap hashes of the runs of ``size`` values from every place, to choose places by content; no identity rests on them.
    They are polynomials modulo 2**64."""
    n = len(values) - size + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, _BASE, U)]))
        out, done = np.zeros(n, dtype=U), 1
        # runs of 2**k values are made of two of half the length; a run of ``size`` is made of those of its binary digits
        half, at = values.astype(U) + U(1), 0
        while True:
            if size & done:
                out *= up[done]
                out += half[at : at + n]
                at += done
            if done * 2 > size:
                return mix(out)
            half = half[:-done] * up[done] + half[done:]
            done *= 2


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows: byte starts, byte ends, and the row offsets into them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = full.copy()
    starts[1:] &= ~full[:-1] | edge[1:n]
    ends = full.copy()
    ends[:-1] &= ~full[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, in order, and the row offsets into them."""
    start, end, rows = word_bounds(data, offsets)
    prefix = prefix_hash(LOWER[data] if lower else data)
    return span_hash(prefix, start, end), rows


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each row."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in segments(offsets):
        part = offsets[a : b + 1]
        _, _, rows = word_bounds(data[part[0] : part[-1]], part - part[0])
        out[a:b] = np.diff(rows)
    return out


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, repeated ones included; a shorter row is one shingle."""
    count = np.diff(rows)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(count)), made)
    at = rows[row] + np.arange(offsets[-1]) - offsets[row]
    span = np.minimum(count[row], size)
    h = np.full(len(at), 0x27D4EB2F165667C5, dtype=U)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = k < span
            nxt = mix((h ^ words[np.minimum(at + k, len(words) - 1)]) * U(_BASE) + U(k + 1)) if len(words) else h
            h = np.where(inside, nxt, h)
    return h, offsets


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def list_column(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == U else values))
