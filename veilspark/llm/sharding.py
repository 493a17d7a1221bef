"""Byte-limited shards by extendible hashing, with DataFrame functions only.

A document belongs to the directory entry given by the first bits of its key's hash. Starting from one entry, only an
entry whose documents exceed the byte limit splits on another bit, until every shard fits. Sums are made once for
cells finer than any shard is expected to be; the directory is derived from the cells, and cells that are themselves too
large are summed again at more bits, alone.

Defined results: null text counts 0 bytes; rows with the same key share a shard, and a key whose rows exceed the limit
alone makes an ``oversized`` shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

STEP = 6
MOST_BITS = 63


def _bits(key: str) -> Column:
    """The key's hash as a string of 64 binary digits."""
    return F.lpad(F.bin(F.xxhash64(F.col(key))), 64, "0")


def directory(cells: DataFrame, limit: int, depth: int) -> DataFrame:
    """Leaves (prefix, bytes, docs) of the split tree over ``cells`` (cell, bytes, docs), cells having ``depth`` bits."""
    nodes = cells.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("cell")), lambda d: F.substring("cell", F.lit(1), d))).alias("prefix"), "bytes", "docs")
    nodes = nodes.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    # an entry exists if every shorter prefix is too large; sums only shrink on the way down, so the parent decides
    whole = nodes.where(F.col("bytes") <= limit)
    large = nodes.where(F.col("bytes") > limit).select(F.col("prefix").alias("_large"))
    kept = whole.where("prefix = ''").unionByName(whole.where("prefix <> ''").withColumn("_up", F.expr("left(prefix, length(prefix) - 1)")).join(large, F.col("_up") == F.col("_large")).select("prefix", "bytes", "docs"))
    stuck = nodes.where((F.col("bytes") > limit) & (F.length("prefix") == depth))
    return kept.select("*", F.lit(False).alias("stuck")).unionByName(stuck.select("prefix", "bytes", "docs", F.lit(True).alias("stuck")))


def shards(docs: DataFrame, limit_bytes: int = 8 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_docs, oversized): ``shard`` is the hash prefix, of ``depth`` bits, as
    a string of 0 and 1 (empty if all fits one shard)."""
    rows = staged(docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"), _bits(key).alias("_h")), "bytes")
    total = rows.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]
    depth = min(MOST_BITS, max(0, (max(1, total // max(1, limit_bytes))).bit_length()) + STEP)
    leaves, part = None, rows
    while True:
        cells = part.groupBy(F.expr(f"left(_h, {depth})").alias("cell")).agg(F.sum("b").alias("bytes"), F.count("*").alias("docs"))
        found = staged(directory(cells, limit_bytes, depth) if leaves is None else _below(cells, limit_bytes, depth, above), f"directory{depth}")
        leaves = found.where("not stuck") if leaves is None else leaves.unionByName(found.where("not stuck"))
        stuck = found.where("stuck")
        if stuck.isEmpty():
            break
        if depth >= MOST_BITS:
            leaves = leaves.unionByName(stuck)
            break
        above, old = depth, depth
        depth = min(MOST_BITS, depth + 3 * STEP)
        # keys alone in a cell cannot be split; they are leaves where they are
        split = stuck.select(F.col("prefix").alias("_cell"))
        part = staged(part.join(split, F.expr(f"left(_h, {old})") == F.col("_cell"), "left_semi"), f"stuck{old}")
        alone = part.groupBy(F.expr(f"left(_h, {old})").alias("prefix")).agg(F.min("_h").alias("_a"), F.max("_h").alias("_z"))
        alone = staged(stuck.join(alone.where("_a = _z").select("prefix"), "prefix"), f"alone{old}")
        leaves = leaves.unionByName(alone.select("prefix", "bytes", "docs", "stuck"))
        part = part.join(alone.select(F.col("prefix").alias("_alone")), F.expr(f"left(_h, {old})") == F.col("_alone"), "left_anti")
    leaves = staged(leaves.select("prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), F.col("stuck").alias("oversized")), "leaves")
    lengths = sorted(r.d for r in leaves.select(F.length("prefix").alias("d")).distinct().collect())  # 64 values at most
    tries = F.array(*(F.substring("_h", 1, d) for d in lengths)) if lengths else F.array(F.lit(""))
    # a key has one leaf among its prefixes: prefixes of each depth are matched to the leaves of that depth
    found = rows.withColumn("prefix", F.explode(tries)).join(leaves, "prefix")
    return found.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("prefix").alias("shard"), F.length("prefix").alias("depth"), "shard_bytes", "shard_docs", "oversized")


def _below(cells: DataFrame, limit: int, depth: int, above: int) -> DataFrame:
    """Leaves under the too large cells of ``above`` bits."""
    return directory(cells, limit, depth).where(F.length("prefix") > above)
