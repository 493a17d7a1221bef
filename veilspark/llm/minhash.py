"""Near-duplicate groups by MinHash with tensored banding, every link verified on full shingle sets.

Tensored banding: two collections of SIDE small hashes, each a combination of WIDTH minhashes, give SIDE * SIDE table
keys, one for each pair (left i, right j). So 2 * SIDE * WIDTH minhashes stand for SIDE**2 tables of 2 * WIDTH rows. Two
sets share a key exactly if some left and some right hash agree, so a pair of similarity s is missed with probability at
most 1 - (1 - (1 - s**WIDTH)**SIDE)**2; SIDE is chosen so that this is under MISS at the threshold.

Copies are folded first: one representative per distinct shingle set. A bucket never emits all its pairs. In each round a
bucket has one centre, each other member is compared with the centre, and verified links are contracted. The first
centre is the member that meets most others over all its buckets, the next ones are any; members that share buckets
share centres, so a dense group falls into one component in the first rounds with few comparisons.

What is left are members of buckets with several components. Their links are found by their rarest shingles: two sets
that reach the threshold have one of their rarest shingles in common, the more similar they must be the fewer of these are
needed. A shingle that only one of them has brings it to none, so boilerplate with own fillings meets nothing; of a shingle's
members those of its largest component meet the others, but not each other. Only pairs become rows whose overlap can still
reach the threshold: it is at most the number of shingles that either shares with other members, and two sets differ at
least in as many elements as their parity bits differ. All these bounds are exact, so no candidate link is lost.

Words are named by 62-bit hashes over a prime field, shingles by 64-bit hashes of these, and shingle sets by their size and two
64-bit sums over their elements.

Defined results: text without words (or null) has no shingles and is linked with nothing; a text shorter than the shingle
is one shingle; a group is named by the smallest key of all rows reachable, null if all keys in it are null; each row gets a
row, also where keys repeat, with the same text or another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_staged, small_batches, staged
from .textops import U, buffers, distinct_sorted, list_column, mix, segments, shingles, word_hashes

WIDTH = 2
MISS = 1e-4
ROUNDS = 3
PARITY_BITS = 1024


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least num / den on shingles of ``words`` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def linked(self, inter: Column, left: Column, right: Column) -> Column:
        return (inter > 0) & (inter * self.den >= (left + right - inter) * self.num)

    def reachable(self, most: Column, left: Column, right: Column) -> Column:
        """Whether an overlap of at most ``most`` can be enough."""
        return most * (self.num + self.den) >= (left + right) * self.num

    def side(self) -> int:
        s = self.num / self.den
        return max(2, math.ceil(math.log(MISS / 2) / math.log(1 - s**WIDTH)))


def shingle_rows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the row offsets into them."""
    return distinct_sorted(*shingles(*word_hashes(data, offsets), size))


def seeds(count: int) -> np.ndarray:
    """Odd multipliers of the hash functions, fixed for all runs."""
    return mix(np.arange(1, count + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def sub_keys(values: np.ndarray, offsets: np.ndarray, side: int) -> np.ndarray:
    """2 * side small hashes of each row (0 for rows without shingles): WIDTH minhashes combined."""
    out = np.zeros((len(offsets) - 1, 2 * side), dtype=U)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    at = offsets[full]
    salt = seeds(2 * side * WIDTH)
    for k in range(2 * side):
        h = np.full(len(full), k + 1, dtype=U)
        for j in range(WIDTH):
            turned = values * salt[k * WIDTH + j]
            turned ^= turned >> U(29)
            h = mix(h * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(turned, at))
        out[full, k] = h
    return out


def parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of PARITY_BITS bits of each row: whether a cell has an odd number of the row's shingles. Where two rows'
    bits differ, their sets differ in an element at least."""
    out = np.zeros((len(offsets) - 1, PARITY_BITS // 64), dtype=U)
    for a in range(0, len(out), 1024):
        own = offsets[a : a + 1025]
        n = len(own) - 1
        cell = np.repeat(np.arange(n), np.diff(own)) * PARITY_BITS + (values[own[0] : own[-1]] & U(PARITY_BITS - 1)).astype(np.int64)
        odd = (np.bincount(cell, minlength=n * PARITY_BITS) & 1).astype(np.uint8)
        out[a : a + n] = np.packbits(odd, bitorder="little").view(U).reshape(n, -1)
    return out


def signatures(docs: DataFrame, like: Similarity, text: str, key: str) -> DataFrame:
    """(k, th, n, set_a, set_b, sub): the text's hash, the number of shingles, 128 bits that name the shingle set, and the small hashes."""
    side = like.side()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for a, b in segments(offsets):
                values, at = shingle_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], like.words)
                sub = sub_keys(values, at, side)
                names = []
                for salt in (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)):
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(values ^ salt), dtype=U)])
                    names.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)))
                lists = list_column(sub.reshape(-1), np.arange(b - a + 1) * 2 * side)
                own = [c.slice(a, b - a) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), *names, lists], names=["k", "th", "n", "set_a", "set_b", "sub"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.xxhash64(text), text).mapInArrow(sign, f"k {kind}, th long, n long, set_a long, set_b long, sub array<long>")


def shingle_sets(texts: DataFrame, like: Similarity) -> DataFrame:
    """(c, s, p) of the rows (c, text): sorted distinct shingles, and the parity of their number in each of PARITY_BITS cells."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in segments(offsets):
                values, at = shingle_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], like.words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_column(values, at), list_column(parities(values, at).reshape(-1), np.arange(b - a + 1) * (PARITY_BITS // 64))], names=["c", "s", "p"])

    return texts.mapInArrow(cut, "c long, s array<long>, p array<long>")


def near_groups(docs: DataFrame, like: Similarity = Similarity(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept, class_id) of each row. class_id is the smallest key with the same shingle set."""
    small_batches(docs.sparkSession)
    side = like.side()
    signed = staged(signatures(docs, like, text, key), "signatures")
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "th"))
    classes = signed.where("n > 0").groupBy("n", "set_a", "set_b").agg(first.alias("r"), F.first("sub").alias("sub"), F.count("*").alias("rows"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("c"), "n", "set_a", "set_b", "r.k", "r.th", "sub", "rows"), "classes")
    pairs = [F.xxhash64(F.lit(i * side + j), F.col("sub")[i], F.col("sub")[side + j]) for i in range(side) for j in range(side)]
    keys = classes.select("c", "n", F.explode(F.array(*pairs)).alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    placed = staged(keys.join(shared, "bucket"), "placed")
    degrees = staged(placed.groupBy("c").agg(F.sum("m").alias("degree")), "candidates")
    wanted = classes.join(degrees, "c", "left_semi").select("c", F.col("k").alias("_k"), F.col("th").alias("_th"))
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    texts = texts.join(wanted, F.col("k").eqNullSafe(F.col("_k")) & (F.col("th") == F.col("_th"))).groupBy("c").agg(F.first("t").alias("t"))
    sets = staged(shingle_sets(texts, like), "sets")
    comp, used = None, [degrees, placed, sets]
    for turn in range(ROUNDS):
        member = placed if turn else placed.join(degrees, "c")
        links = staged(_verified(_stars(member, comp, turn), sets, like), f"stars{turn}")
        used.append(links)
        if comp is not None:
            if links.isEmpty():
                break
            links = links.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))
        comp = staged(components(links, "a", "b"), f"components{turn}")
    crossing = staged(_split_buckets(placed, comp).select("c", "n", "component").distinct(), "crossing-members")
    used.append(crossing)
    if not crossing.isEmpty():
        rest = staged(_verified(_crossing_pairs(crossing, sets, like), sets, like), "crossing")
        used.append(rest)
        if not rest.isEmpty():
            comp = staged(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest), "a", "b"), "components")
    own = classes.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = own.groupBy("component").agg(F.min("k").alias("component_id"))
    named = own.join(least, "component").select("n", "set_a", "set_b", "rows", F.col("k").alias("class_id"), "component_id")
    named = staged(named, "named")
    drop_staged(*used)
    return _spread(signed, named, key)


def _spread(signed: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Each row's component: classes of a thousandth of all rows or more, so a thousand at most, by a broadcast, the others by a join."""
    least = max(1000, signed.count() // 1000)
    on = ["n", "set_a", "set_b"]
    narrow = signed.select("k", *on)
    tagged = narrow.join(F.broadcast(named.where(F.col("rows") >= least)), on, "left")
    done = tagged.where("rows is not null or n = 0")
    rest = tagged.where("rows is null and n > 0").select("k", *on).join(named.where(F.col("rows") < least), on)
    every = done.unionByName(rest)
    alone = F.col("n") == 0
    group = F.when(alone, F.col("k")).otherwise(F.col("component_id"))
    return every.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("k").eqNullSafe(group).alias("kept"), F.when(alone, F.col("k")).otherwise(F.col("class_id")).alias("class_id"))


def _stars(member: DataFrame, comp: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (member, centre of its bucket) in different components, each once."""
    own = member.withColumn("component", F.col("c")) if comp is None else _in_components(member, comp)
    order = -F.col("degree") if turn == 0 else F.xxhash64("c", F.lit(turn))
    rank = F.struct(order.alias("r"), F.col("c").alias("x"), F.col("component").alias("y"))
    centre = own.groupBy("bucket").agg(F.min(rank).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    pairs = own.join(centre.select("bucket", "m.x", "m.y"), "bucket").where("component <> y")
    return pairs.select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b")).distinct()


def _in_components(member: DataFrame, comp: DataFrame) -> DataFrame:
    named = member.join(comp.withColumnRenamed("node", "c"), "c", "left")
    return named.withColumn("component", F.coalesce("component", "c"))


def _split_buckets(member: DataFrame, comp: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold more than one component."""
    named = _in_components(member, comp)
    split = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return named.join(split, "bucket")


def _verified(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) that are linked, by the intersection of their full sets."""
    left, right = (sets.select(F.col("c").alias(c), F.col("s").alias(f"_s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(like.linked(inter, F.size("_sa"), F.size("_sb"))).select("a", "b")


def _crossing_pairs(crossing: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Pairs of the members (c, n, component) in different components that may reach the threshold: they share one of the rarest
    shingles of both, and neither their sizes nor their parity bits keep them apart.

    A set of n shingles shares num / den of them at least with any partner, so of its shingles in order of rarity one of the
    first n - least + 1 is shared. Those that no other member has come first, and bring it to none."""
    tokens = crossing.join(sets.select("c", "s"), "c").select("c", "n", "component", F.explode("s").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    known = tokens.join(often, "t").repartition("c")  # as many rows for a member as it has shingles
    need = F.col("n") - F.ceil(F.col("n") * like.num / like.den) + 1 - (F.col("n") - F.col("u"))
    lists = known.groupBy("c").agg(F.collect_list(F.struct("df", "t")).alias("s"), F.first("n").alias("n"), F.first("component").alias("component")).withColumn("u", F.size("s"))
    rare = lists.withColumn("need", need.cast("int")).where("need > 0").withColumn("s", F.array_sort("s"))
    heads = staged(rare.select("c", "n", "component", "u", F.explode(F.slice("s", F.lit(1), F.col("need"))["t"]).alias("t")), "rare-shingles")
    sizes = heads.groupBy("t", "component").agg(F.count("*").alias("m")).groupBy("t").agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.count("*").alias("d"))
    split = staged(heads.join(sizes.where("d > 1").select("t", "most"), "t").join(sets.select("c", "p"), "c"), "split-shingles")
    fields = ("c", "n", "u", "p", "component")
    left = split.where("component <> most").select("t", *(F.col(x).alias(f"{x}_a") for x in fields))
    right = split.select("t", (F.col("component") == F.col("most")).alias("in_most"), *(F.col(x).alias(f"{x}_b") for x in fields))
    once = F.col("in_most") | (F.col("c_a") < F.col("c_b"))
    fits = like.reachable(F.least("u_a", "u_b"), F.col("n_a"), F.col("n_b"))
    apart = sum((F.bit_count(F.col("p_a")[i].bitwiseXOR(F.col("p_b")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    fits &= like.reachable(F.floor((F.col("n_a") + F.col("n_b") - apart) / 2), F.col("n_a"), F.col("n_b"))
    pairs = left.join(right, "t").where((F.col("component_a") != F.col("component_b")) & once & fits)
    return pairs.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()
