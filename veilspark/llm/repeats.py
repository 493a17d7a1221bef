"""Removal of repeated byte strings: every byte covered by a LENGTH-byte string that starts anywhere else too.

Suffixes are sampled by content before they are sorted: of the GRAM-byte strings inside a window of LENGTH bytes, the one
with the least hash is the window's anchor, so equal windows have equal anchors at equal places, and one suffix in about
(LENGTH - GRAM) / 2 is kept. The windows of one anchor follow each other; together they are a stretch.

1. Anchors that occur once in the corpus end here: none of their windows occurs again.
2. Stretches that are equal as a whole cover each other.
3. Of the anchors whose stretches differ, one stretch of each content is compared with the others: first the cores that
   all windows of a part of the stretch have in common, then, where a core occurs twice, window by window.

A text moves twice (to cut stretches for step 3, and for the result); what else moves is a short row per anchor. Groups are counted with partial
sums and joined, never gathered, so a passage that all documents share is no hot task.

Defined results: null text is empty; a text under LENGTH bytes loses nothing; matches never cross rows; rows that repeat a
key are texts of their own, and equal ones cover each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, small_batches, staged
from .textops import U, buffers, mix, prefix_hash, sampling_hash, segments, span_hash

LENGTH = 200
GRAM = 100
PARTS = 10
_LOW = U(0xFFFFFFFF)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first window, last window, anchor) of all stretches of the rows, as byte places."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none.view(U), none.view(U), none, none, none
    at = np.arange(n - gram + 1)
    h = sampling_hash(data, gram)
    key = (h & ~_LOW) | at.astype(U)
    wide, size = length - gram + 1, 1
    least = key
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    ends = offsets[1:]
    fits = np.zeros(n + 1, dtype=np.int64)  # windows that start here end in the same row
    lens = np.diff(offsets)
    ok = lens >= length
    np.add.at(fits, offsets[:-1][ok], 1)
    np.add.at(fits, ends[ok] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(fits)[: len(least)] > 0)
    if not len(window):
        return none.view(U), none.view(U), none, none, none
    anchor = (least[window] & _LOW).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    p0, p1 = window[first], window[np.append(first[1:], len(window)) - 1]
    a = anchor[first]
    content = mix(span_hash(prefix_hash(data, 1), p0, p1 + length) ^ ((a - p0).astype(U) * U(0x9E3779B97F4A7C15)))
    return span_hash(prefix_hash(data), a, a + gram), content, p0, p1, a


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(fp, sh, k, th, p0, p1, c, a) for each stretch, a being its anchor from p0; with fp null, a range of bytes that is known to repeat. Stretches that
    repeat inside one segment are folded: their bytes are ranges, one of them stays, with its count."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for a, b in segments(offsets):
                part = offsets[a : b + 1] - offsets[a]
                fp, sh, p0, p1, anchor = stretches(data[offsets[a] : offsets[b]], part, length, gram)
                pair = np.stack([fp, sh], axis=1) if len(fp) else np.zeros((0, 2), U)
                _, first, back, count = np.unique(pair.view([("a", U), ("b", U)]).reshape(-1), return_index=True, return_inverse=True, return_counts=True)
                row = np.searchsorted(part, p0, side="right") - 1
                many = np.flatnonzero(count[back] > 1)
                # ranges of different rows stay apart when each row is moved by one
                s, e = merged(p0[many] + row[many], p1[many] + length + row[many])
                owner = np.searchsorted(part + np.arange(len(part)), s, side="right") - 1
                s, e = s - owner - part[owner], e - owner - part[owner]
                ids = a + np.concatenate([row[first], owner])
                where = pa.array(ids)
                nulls = np.concatenate([np.zeros(len(first), bool), np.ones(len(s), bool)])
                long = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int32))
                zeros = np.zeros(len(s), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([fp[first].view(np.int64), zeros]), mask=nulls),
                        pa.array(np.concatenate([sh[first].view(np.int64), zeros]), mask=nulls),
                        batch.column(0).take(where),
                        batch.column(1).take(where),
                        long(p0[first] - part[row[first]], s),
                        long(p1[first] - part[row[first]] + length, e),
                        long(count, zeros),
                        long((anchor - p0)[first], zeros),
                    ],
                    names=["fp", "sh", "k", "th", "p0", "p1", "c", "a"],
                )

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(cut, f"fp long, sh long, k {kind}, th long, p0 int, p1 int, c int, a int")


def stretch_rows(rows: DataFrame) -> DataFrame:
    """(fp, sh, k, th, p0, a, single, s): the bytes of the stretches listed with a row (``at``: fp, sh, p0, p1, c, a)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            lists = batch.column(3)
            at, inner = lists.offsets.to_numpy(), lists.values
            p0, p1 = inner.field(2).to_numpy(), inner.field(3).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            for x in range(at[0], at[-1], 1 << 14):
                own = np.arange(x, min(at[-1], x + (1 << 14)))
                base = offsets[row[own - at[0]]]
                size = (p1[own] - p0[own]).astype(np.int64)
                ends = np.cumsum(size)
                take = np.repeat(base + p0[own] - (ends - size), size) + np.arange(ends[-1])
                s = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
                f = lambda i: inner.field(i).take(pa.array(own))
                who = pa.array(row[own - at[0]])
                yield pa.RecordBatch.from_arrays([f(0), f(1), batch.column(0).take(who), batch.column(1).take(who), f(2), f(5), pa.array(inner.field(4).to_numpy()[own] == 1), s], names=["fp", "sh", "k", "th", "p0", "a", "single", "s"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(cut, f"fp long, sh long, k {kind}, th long, p0 int, a int, single boolean, s binary")


def _windows(size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, first byte) of every window of stretches of the given sizes."""
    n = size - length + 1
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def core_rows(stretched: DataFrame, length: int, step: int) -> DataFrame:
    """(fp, sh, part, core, single): windows whose anchor stands step * part to step * (part + 1) - 1 bytes inside share a
    core, of which this is the hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(4))
            anchor = batch.column(2).to_numpy()
            for x, y in segments(offsets):
                prefix = prefix_hash(data[offsets[x] : offsets[y]])
                base = offsets[x:y] - offsets[x]
                which, t = _windows(np.diff(offsets[x : y + 1]), length)
                part = (anchor[x:y][which] - t) // step
                first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (part[1:] != part[:-1])]))
                which, part = which[first], part[first]
                start = base[which] + np.maximum(0, anchor[x:y][which] - step * part)
                end = base[which] + anchor[x:y][which] + length - step * (part + 1)
                h = span_hash(prefix, start, end)
                own = pa.array(which + x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(part.astype(np.int32)), pa.array(h.view(np.int64)), batch.column(3).take(own)], names=["fp", "sh", "part", "core", "single"])

    return stretched.select("fp", "sh", "a", "single", "s").mapInArrow(cut, "fp long, sh long, part int, core long, single boolean")


def window_rows(stretched: DataFrame, length: int, step: int) -> DataFrame:
    """(fp, wh, k, th, p, single) for the windows of the listed ``parts`` of stretches."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(6))
            anchor, p0 = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            lists = batch.column(7)
            wide = 1 + (int(anchor.max(initial=0)) // step)
            wanted = np.zeros((batch.num_rows, wide + 1), dtype=bool)
            at = lists.offsets.to_numpy()
            wanted[np.repeat(np.arange(batch.num_rows), np.diff(at)), lists.values.to_numpy()[at[0] : at[-1]]] = True
            for x, y in segments(offsets, 1 << 18):
                prefix = prefix_hash(data[offsets[x] : offsets[y]], 1)
                which, t = _windows(np.diff(offsets[x : y + 1]), length)
                part = (anchor[x:y][which] - t) // step
                keep = wanted[which + x, part]
                which, t = which[keep], t[keep]
                start = offsets[x:y][which] - offsets[x] + t
                h = span_hash(prefix, start, start + length)
                own = pa.array(which + x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(h.view(np.int64)), batch.column(1).take(own), batch.column(2).take(own), pa.array((p0[x:y][which] + t).astype(np.int32)), batch.column(5).take(own)], names=["fp", "wh", "k", "th", "p", "single"])

    kind = stretched.schema["k"].dataType.simpleString()
    return stretched.select("fp", "k", "th", "p0", "a", "single", "s", "parts").mapInArrow(cut, f"fp long, wh long, k {kind}, th long, p int, single boolean")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, th, ranges) of the rows that hold repeated strings; th is the text's hash, ranges array<struct<p0, p1>> of bytes."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    step = max(1, (length - gram) // PARTS)
    found = staged(anchor_rows(rows, length, gram), "anchors")
    runs = found.where("fp is not null")
    often = staged(runs.groupBy("fp").agg(F.sum("c").alias("n")).where("n > 1").select("fp"), "often")
    runs = staged(runs.join(often, "fp"), "repeated")
    loc = F.min(F.struct("k", "th", "p0", "p1", "a")).alias("at")
    groups = staged(runs.groupBy("fp", "sh").agg(F.sum("c").cast("int").alias("c"), loc), "groups")
    whole = runs.join(groups.where("c > 1").select("fp", "sh"), ["fp", "sh"]).select("k", "th", "p0", "p1")
    known = found.where("fp is null").select("k", "th", "p0", "p1")
    known = staged(known.unionByName(whole), "known")
    drop_staged(found, often, runs)
    mixed = groups.groupBy("fp").agg(F.count("*").alias("d"), F.min("c").alias("least")).where("d > 1 and least = 1").select("fp")
    open_ = groups.join(mixed, "fp").groupBy("at.k", "at.th").agg(F.collect_list(F.struct("fp", "sh", "at.p0", "at.p1", "c", "at.a")).alias("at"))
    listed = staged(open_, "open")
    part = rows.join(listed, [rows["k"].eqNullSafe(listed["k"]), rows["th"] == listed["th"]]).select(rows["k"], rows["th"], "text", "at")
    stretched = staged(stretch_rows(part), "stretches")
    drop_staged(groups, listed)
    cores = staged(core_rows(stretched, length, step), "cores")
    alive = cores.groupBy("fp", "part", "core").agg(F.count("*").alias("n"), F.bool_or("single").alias("any")).where("n > 1 and any").select("fp", "part", "core")
    parts = cores.join(alive, ["fp", "part", "core"]).groupBy("fp", "sh").agg(F.collect_set("part").alias("parts"))
    windows = staged(window_rows(stretched.join(parts, ["fp", "sh"]), length, step), "windows")
    drop_staged(stretched, cores)
    twice = windows.groupBy("fp", "wh").agg(F.count("*").alias("n")).where("n > 1").select("fp", "wh")
    single = windows.where("single").join(twice, ["fp", "wh"]).select("k", "th", F.col("p").alias("p0"), (F.col("p") + length).cast("int").alias("p1"))
    found = staged(single, "found")
    drop_staged(windows)
    return staged(known.unionByName(found).groupBy("k", "th").agg(F.collect_set(F.struct("p0", "p1")).alias("ranges")), "ranges")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of each row: spans are the maximal removed byte runs, kept
    is what is left, as bytes."""
    ranges = repeated_ranges(docs, length, gram, text, key)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = rows.join(ranges, [rows["k"].eqNullSafe(ranges["k"]), rows["th"] == ranges["th"]], "left").select(rows["k"], "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            lists = batch.column(2)
            at, inner = lists.offsets.to_numpy(), lists.values
            p0, p1 = inner.field(0).to_numpy().astype(np.int64), inner.field(1).to_numpy().astype(np.int64)
            removed, sha, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                s, e = merged(p0[at[i] : at[i + 1]], p1[at[i] : at[i + 1]])
                if len(s):
                    gone = np.zeros(len(own) + 1, dtype=np.int8)
                    gone[s] += 1
                    gone[e] -= 1
                    own = own[np.cumsum(gone[:-1]) == 0]
                removed.append(int((e - s).sum()))
                raw = own.tobytes()
                kept.append(raw)
                sha.append(hashlib.sha256(raw).hexdigest())
                spans.append([{"p0": int(x), "p1": int(y)} for x, y in zip(s, e, strict=True)])
            size = np.diff(offsets)
            kind = pa.list_(pa.struct([("p0", pa.int64()), ("p1", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(sha), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return both.mapInArrow(cut, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<p0: bigint, p1: bigint>>, kept binary")
