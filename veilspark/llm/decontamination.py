"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark's words are the vocabulary; every text becomes the sequence of its word numbers, once, in a written table.
2. Document frequencies over all texts give the weights; words of more than MAX_DF of all texts weigh nothing.
3. A randomised SVD (range finder, then one power step) of the TF-IDF matrix of all passages, texts' and benchmark's with
   equal total weight, gives RANK latent directions. Each task adds up its part of A'(A X); the sums are small.
4. Windows of all texts are compared with all benchmark passages by cosine in the latent space. Runs of RUN words that stand
   in a passage bring their window to it whatever the cosine, so copies of items whose words many texts have are not lost.
5. Windows over COSINE, and those of equal runs, are judged by the longest common subsequence of words with the item, and by that with its answer
   (the last sentence, where the benchmark has no answer column). So reworded passages are found, and passages that only
   share topics are not. Items of which the windows hold too few words, in any order, for the least share are not compared;
   a subsequence is no longer than that count, so this drops nothing that could be found.

The benchmark is read in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES bytes (or one item), each with a vocabulary and
matrices of bounded size; the texts
are never gathered, and nothing is shuffled but the sums.

Defined results: null and empty texts match nothing; null or empty items are never found; an item found in several
places of a text gives one row; repeated rows each give rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, staged, staged_alone
from .textops import LOWER, U, buffers, prefix_hash, segments, span_hash

BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
MAX_DF = 0.05
LEAST_DF = 50
RANK, OVERSAMPLE = 64, 16
PASSAGE = 48
BLOCK, SPAN = 16, 4  # a window is SPAN blocks of BLOCK words
COSINE = 0.5
RUN = 8
SHARE, SHARE_WITH_ANSWER, ANSWER_SHARE, ANSWER_WORDS = 0.75, 0.6, 0.8, 5
ROWS_AT_ONCE = 1 << 19

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (ASCII and Latin-1) runs of letters and digits of the rows, and the row offsets into them."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    full = _WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    a, b = full.copy(), full.copy()
    a[1:] &= ~full[:-1] | edge[1:n]
    b[:-1] &= ~full[1:] | edge[1:n]
    start, end = np.flatnonzero(a), np.flatnonzero(b) + 1
    low = LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[capital] += 0x20  # the accented capitals of Latin-1 in UTF-8
    return span_hash(prefix_hash(low), start, end), np.searchsorted(start, offsets)


class Vocabulary:
    """Numbers of known words, looked up by the top bits of their hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.bits = max(8, int(len(self.hashes)).bit_length() + 4)
        self.shift = U(64 - self.bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << self.bits) + 1, dtype=U)).astype(np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            same = self.hashes[at] == h[left]
            out[left[same]] = at[same]
            more = ~same & (at + 1 < stop)
            left, at, stop = left[more], at[more] + 1, stop[more]
        return out


@dataclass
class Passage:
    item: int
    ids: np.ndarray
    words: int


def run_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of RUN known words."""
    n = len(ids) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    at = np.flatnonzero(unknown[RUN:] == unknown[:-RUN])
    h = np.zeros(len(at), U)
    for j in range(RUN):
        h = (h + (ids[at + j].astype(np.int64) + 1).astype(U)) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    return at, h * U(0xD6E8FEB86659FD93)


class Runs:
    """The passages that hold each run of RUN words."""

    def __init__(self, passages: list[Passage]) -> None:
        hashes = [np.unique(run_hashes(p.ids)[1]) for p in passages]
        every = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(passages)), [len(h) for h in hashes])
        order = np.argsort(every, kind="stable")
        self.known = Vocabulary(every)
        self.owner = owner[order]
        self.first = np.searchsorted(every[order], np.append(self.known.hashes, U(0)))
        self.first[-1] = len(every)

    def found(self, ids: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, block, passage) of the runs inside a row that stand in a passage, each once."""
        at, h = run_hashes(ids)
        if not len(at) or not len(self.owner):
            return []
        number = self.known.ids(h)
        at, number = at[number >= 0], number[number >= 0]
        row = np.searchsorted(rows, at, side="right") - 1
        inside = at + RUN <= rows[row + 1]
        at, number, row = at[inside], number[inside], row[inside]
        much = self.first[number + 1] - self.first[number]
        place = np.repeat(self.first[number] - np.cumsum(much) + much, much) + np.arange(much.sum())
        block = (at - rows[row]) // BLOCK
        return sorted(set(zip(np.repeat(row, much).tolist(), np.repeat(block, much).tolist(), self.owner[place].tolist(), strict=True)))


def lcs(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the longest common subsequence of word numbers (negative ones never match), by bit vectors."""
    where: dict[int, int] = {}
    for i, x in enumerate(left.tolist()):
        if x >= 0:
            where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(left)) - 1
    v = full
    for y in right.tolist():
        m = where.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(left) - v.bit_count()


def _sequences(docs: DataFrame, vocabulary: Vocabulary, text: str, key: str) -> DataFrame:
    """(k, ids): the word numbers of each text, as int32 or int16 bytes."""
    kind = np.int16 if len(vocabulary.hashes) < 1 << 15 else np.int32
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.hashes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(shared.value)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in segments(offsets):
                h, rows = token_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = own.ids(h).astype(kind)
                width = raw.itemsize
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((rows * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column], names=["k", "ids"])

    return docs.select(key, text).mapInArrow(number, f"k {docs.schema[key].dataType.simpleString()}, ids binary")


def _chunks(batch: pa.RecordBatch, column: int, kind: type) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, row offsets) of pieces of a batch."""
    data, offsets = buffers(batch.column(column))
    width = np.dtype(kind).itemsize
    for a, b in segments(offsets, ROWS_AT_ONCE * width):
        own = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), dtype=kind)
        yield a, b, own, (offsets[a : b + 1] - offsets[a]) // width


def _frequencies(sequences: DataFrame, size: int, kind: type) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size + 1, dtype=np.int64), 0
        for batch in batches:
            for a, b, ids, rows in _chunks(batch, 0, kind):
                n += b - a
                for i in range(0, b - a, 128):
                    j = min(b - a, i + 128)
                    seen = np.zeros((j - i, size + 1), dtype=bool)
                    seen[np.repeat(np.arange(j - i), np.diff(rows[i : j + 1])), ids[rows[i] : rows[j]]] = True
                    df += seen.sum(axis=0)
        df[size] = n  # the last place gathers unknown words (-1); it holds the number of texts instead
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["term", "df"])

    found = sequences.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size + 1, dtype=np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return int(out[size]), out[:size]


def _passage_rows(ids: np.ndarray, rows: np.ndarray, weight: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted words only: (block number, word), and (row, number of blocks before) for blocks of ``block`` words of the rows."""
    per_row = -(-np.diff(rows) // block)
    before = np.concatenate([[0], np.cumsum(per_row)])
    at = np.flatnonzero((ids >= 0) & (weight[ids] > 0))
    row = np.searchsorted(rows, at, side="right") - 1
    return before[row] + (at - rows[row]) // block, ids[at].astype(np.int64), per_row, before


def _summed(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of consecutive values by group number: (group, sum)."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return group[first], np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


def _gram(ids: np.ndarray, rows: np.ndarray, weight: np.ndarray, basis: np.ndarray, block: int) -> tuple[np.ndarray, int]:
    """A'(A X) for the passages of ``block`` words of the rows, each scaled to length 1, and their number."""
    passage, word, _, _ = _passage_rows(ids, rows, weight, block)
    out = np.zeros_like(basis)
    if not len(word):
        return out, 0
    own, energy = _summed(weight[word] ** 2, passage)
    _, y = _summed(weight[word, None] * basis[word], passage)
    y /= energy[:, None]
    back = np.searchsorted(own, passage)
    order = np.argsort(word, kind="stable")
    terms, sums = _summed(weight[word[order], None] * y[back[order]], word[order])
    out[terms] = sums
    return out, len(own)


def latent_basis(sequences: DataFrame, weight: np.ndarray, passages: list[Passage], kind: type, rank: int = RANK) -> np.ndarray:
    """Orthonormal right singular vectors (words by rank) of the stacked passage matrix, the strongest first."""
    size, wide = len(weight), min(rank + OVERSAMPLE, len(weight))
    context = sequences.sparkSession.sparkContext
    ids = np.concatenate([p.ids for p in passages])
    rows = np.concatenate([[0], np.cumsum([len(p.ids) for p in passages])])

    def product(x: np.ndarray) -> np.ndarray:
        shared = context.broadcast((weight.astype(np.float32), x.astype(np.float32)))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, basis = shared.value
            total, n = np.zeros(basis.shape), 0
            for batch in batches:
                for _, _, own, at in _chunks(batch, 0, kind):
                    add, m = _gram(own, at, w, basis, BLOCK * SPAN // 2)
                    total += add
                    n += m
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, size)), *(pa.array(np.append(total[at, j], n)) for j in range(wide))], names=["term", *(f"v{j}" for j in range(wide))])

        schema = "term long, " + ", ".join(f"v{j} double" for j in range(wide))
        found = sequences.select("ids").mapInArrow(part, schema).groupBy("term").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(wide))).toArrow()
        out, n = np.zeros((size, wide)), 1.0
        at = found["term"].to_numpy()
        for j in range(wide):
            v = found[f"v{j}"].to_numpy()
            n = max(n, float(v[at == size].sum()))
            out[at[at < size], j] = v[at < size]
        own, m = _gram(ids, rows, weight, x, 1 << 30)
        return out / n + own / max(1, m)

    start = np.random.default_rng(7).standard_normal((size, wide))
    q, _ = np.linalg.qr(product(start))
    again = product(q)
    small = q.T @ again
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return q @ turn[:, order]


def _passages(items: list[tuple], hashes: list[np.ndarray], vocabulary: Vocabulary) -> list[Passage]:
    out = []
    for i, (_, h) in enumerate(zip(items, hashes, strict=True)):
        ids = vocabulary.ids(h)
        out += [Passage(i, part, len(part)) for part in np.array_split(ids, max(1, -(-len(ids) // PASSAGE))) if len(part)]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", answer: str | None = None) -> DataFrame:
    """(key, item, cosine, share, answer_found) for each text and each benchmark item that it holds. share is the part of
    the item's words that the text has in the item's order, near together."""
    small_batches(docs.sparkSession)
    wanted = benchmark.select(F.col(item), F.col(text), F.col(answer) if answer else F.lit(None).cast("string")).where(F.col(text).isNotNull())
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, cosine double, share double, answer_found boolean"
    found, block, size = None, [], 0
    for row in wanted.orderBy(item).toLocalIterator():
        more = len(row[1].encode())
        if block and (len(block) == BLOCK_ITEMS or size + more > BLOCK_BYTES):
            part = _block(docs, block, text, key, schema)
            found = part if found is None else found.unionByName(part)
            block, size = [], 0
        block.append(tuple(row))
        size += more
    part = _block(docs, block, text, key, schema)
    return part if found is None else found.unionByName(part)


def _tokens(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    h, rows = token_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    return [h[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]


def _answer(text: str, answer: str | None) -> str:
    """The answer given, or the last sentence."""
    if answer is not None:
        return answer
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


def _block(docs: DataFrame, items: list[tuple], text: str, key: str, schema: str) -> DataFrame:
    spark = docs.sparkSession
    hashes = _tokens([t for _, t, _ in items]) if items else []
    vocabulary = Vocabulary(np.concatenate(hashes) if hashes else np.zeros(0, U))
    size = len(vocabulary.hashes)
    if not size:
        return spark.createDataFrame([], schema)
    kind = np.int16 if size < 1 << 15 else np.int32
    passages = _passages(items, hashes, vocabulary)
    answers = [vocabulary.ids(h) for h in _tokens([_answer(t, a) for _, t, a in items])]
    sequences = staged(_sequences(docs, vocabulary, text, key), "sequences")
    total, df = _frequencies(sequences, size, kind)
    idf = np.log((1 + total) / (1 + df)) + 1e-3
    weight = np.where(df <= max(LEAST_DF, MAX_DF * total), idf, 0.0)
    for p in passages:  # a passage of common words only keeps its five rarest
        if (weight[np.unique(p.ids)] > 0).sum() < 5:
            rare = np.unique(p.ids)[np.argsort(-idf[np.unique(p.ids)], kind="stable")[:5]]
            weight[rare] = idf[rare]
    basis = latent_basis(sequences, weight, passages, kind)
    latent = np.stack([(weight[p.ids, None] * basis[p.ids]).sum(axis=0) for p in passages])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast(((weight[:, None] * basis).astype(np.float32), weight > 0, latent.astype(np.float32).T.copy(), passages, [x[0] for x in items], [len(h) for h in hashes], answers, Runs(passages)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, used, queries, parts, names, words, replies, runs = shared.value
        present = np.zeros(len(used) + 1, dtype=bool)
        for batch in batches:
            out = []
            for a, _b, ids, rows in _chunks(batch, 1, kind):
                for doc, hits in _windows(ids, rows, rows_of, used, queries, runs):
                    out += [(a + doc, *x) for x in _judged(ids[rows[doc] : rows[doc + 1]], hits, parts, words, replies, present)]
            where = pa.array([x[0] for x in out], pa.int64())
            kind_of_item = pa.array(names).type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), pa.array([names[x[1]] for x in out], kind_of_item), *(pa.array([x[j] for x in out], t) for j, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.bool_())))], names=[f.split()[0].strip("`") for f in schema.split(", ")])

    return sequences.mapInArrow(search, schema)


def _windows(ids: np.ndarray, rows: np.ndarray, rows_of: np.ndarray, used: np.ndarray, queries: np.ndarray, runs: Runs) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each row with candidates: (row, [(passage, first word, cosine)])."""
    block, word, per_row, before = _passage_rows(ids, rows, used, BLOCK)
    equal = runs.found(ids, rows)
    if not len(word) and not equal:
        return
    own, sums = _summed(rows_of[word], block)
    z = np.zeros((before[-1] + SPAN, rows_of.shape[1]), dtype=np.float32)
    z[own] = sums
    row = np.repeat(np.arange(len(per_row)), per_row)
    k = np.arange(before[-1]) - before[row]
    window = z[: before[-1]].copy()
    for j in range(1, SPAN):
        inside = k + j < per_row[row]
        window[inside] += z[np.flatnonzero(inside) + j]
    window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
    found: dict[int, list[tuple[int, int, float]]] = {}
    step = max(1, (1 << 22) // queries.shape[1])
    for x in range(0, len(window), step):
        cos = window[x : x + step] @ queries
        at, query = np.nonzero(cos >= COSINE)
        for i, q in zip(at.tolist(), query.tolist(), strict=True):
            found.setdefault(int(row[x + i]), []).append((q, int(k[x + i]) * BLOCK, float(cos[i, q])))
    for i, b, q in equal:
        found.setdefault(i, []).append((q, b * BLOCK, float(window[before[i] + b] @ queries[:, q])))
    yield from sorted(found.items())


def _possible(ids: np.ndarray, hits: list[tuple[int, int, float]], parts: list[Passage], words: list[int], replies: list[np.ndarray], present: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(passage, first word, last word, cosine) of the regions of items that can reach the least share. The words of a passage
    that are in a region, in any order, bound its longest common subsequence with each part of the region."""
    regions, most = [], {}
    hits.sort()
    i = 0
    while i < len(hits):  # neighbouring windows are judged as one region
        q, start, cos = hits[i]
        stop = start
        while i < len(hits) and hits[i][0] == q and hits[i][1] <= stop + BLOCK * SPAN:
            stop, cos = hits[i][1], max(cos, hits[i][2])
            i += 1
        lo, hi = max(0, start - PASSAGE), stop + BLOCK * SPAN + PASSAGE
        regions.append((q, lo, hi, cos))
        near = ids[lo : hi + 2 * parts[q].words]
        present[near] = True
        most[q] = max(most.get(q, 0), np.count_nonzero(present[parts[q].ids]))
        present[near] = False
    bound: dict[int, int] = {}
    for q, n in most.items():
        bound[parts[q].item] = bound.get(parts[q].item, 0) + n
    least = {x: SHARE_WITH_ANSWER if len(replies[x]) >= ANSWER_WORDS else SHARE for x in bound}
    return [x for x in regions if bound[parts[x[0]].item] / words[parts[x[0]].item] >= least[parts[x[0]].item]]


def _judged(ids: np.ndarray, hits: list[tuple[int, int, float]], parts: list[Passage], words: list[int], replies: list[np.ndarray], present: np.ndarray) -> list[tuple[int, float, float, bool]]:
    """(item, cosine, share, answer_found) of the items that a text holds. ``present`` has a false place per word, and one for
    unknown words; it is left so."""
    best: dict[int, tuple[int, float]] = {}
    answered: dict[int, bool] = {}
    for q, lo, hi, cos in _possible(ids, hits, parts, words, replies, present):
        p = parts[q]
        near = 2 * p.words  # the words looked at together: twice the passage, moved by half of it
        n = max(lcs(p.ids, ids[x : x + near]) for x in range(lo, min(hi, len(ids)), max(1, p.words // 2)))
        if n > best.get(q, (0, 0.0))[0]:
            best[q] = (n, cos)
        a = replies[p.item]
        if len(a) >= ANSWER_WORDS and n * 2 >= p.words and not answered.get(p.item):
            answered[p.item] = lcs(a, ids[lo : hi + PASSAGE]) >= ANSWER_SHARE * len(a)
    items: dict[int, list[float]] = {}
    for q, (n, cos) in best.items():
        own = items.setdefault(parts[q].item, [0, 0.0])
        own[0] += n
        own[1] = max(own[1], cos)
    out = []
    for item, (n, cos) in items.items():
        share, answer = n / words[item], answered.get(item, False)
        if share >= SHARE or share >= SHARE_WITH_ANSWER and answer:
            out.append((item, cos, share, answer))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", answer: str | None = None) -> DataFrame:
    """The rows in which no benchmark item was found. Rows are named by key and two hashes of the text, so rows of one key
    with different texts are judged apart; equal rows share their fate."""
    own = lambda c: [F.xxhash64(c), F.xxhash64(c, F.lit(1))]
    name = lambda k, c: F.struct(k.alias("k"), *(h.alias(f"h{i}") for i, h in enumerate(own(c))))
    named = docs.select(name(F.col(key), F.col(text)).alias("name"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text"), *([F.col(answer).alias("answer")] if answer else []))
    found = staged_alone(lambda: contaminated(named, items, "text", "name", answer="answer" if answer else None), "contaminated").select("name").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return rows.join(found, name(F.col("row").getField(key), F.col("row").getField(text)).eqNullSafe(F.col("name")), "left_anti").select("row.*")
