"""Tables written in the folder that all executors share, sorts over all tasks, and joins that stay even under hot keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import clear_shared, drop_staged, release, shared_dir, staged, staged_alone

__all__ = ["clear_shared", "drop_staged", "join_groups", "numbered", "range_sorted", "release", "running_total", "shared_dir", "small_batches", "staged", "staged_alone"]

ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold batches sent to Python workers under ARROW_BYTES for this session, so that an executor's memory beside its heap
    stays small; a smaller setting is kept. Spark reads the setting when a plan runs, which is after the operator returns,
    so it is not set back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", str(spark.conf.get(name, "64m")))
    if not now or not 0 < int(now[1]) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def range_sorted(df: DataFrame, order: list[Column], size: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_part``, parts): a global range sort by ``order``, which should tell all rows apart so that no part is
    large, as written ranges. parts has a row for each range, (_part, _before, _own): the sum of ``size`` before the range and in it."""
    rows = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    sums = rows.groupBy("_part").agg(F.sum(size).alias("_own"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    return rows, sums.select("_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"), "_own")


def running_total(df: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """``df`` with ``_end``, the sum of ``size`` up to each row in the global order."""
    rows, parts = range_sorted(df, order, size, name)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_in", F.sum(size).over(inside))
    return own.join(F.broadcast(parts), "_part").withColumn("_end", F.col("_before") + F.col("_in")).drop("_part", "_before", "_own", "_in")


def bounded_sample(df: DataFrame, rows: int, size: int, text: str, labels: DataFrame | None = None, key: str = "k") -> DataFrame:
    """At most ``rows`` distinct rows of ``df`` (of those that have a record in ``labels``, which has one for a key), whose texts
    have at most ``size`` bytes together, taken in the order of their hashes ``_h``; each comes once, however often it repeats."""
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    narrow = hashed.select(*([key] if labels is not None else []), "_h", F.coalesce(F.octet_length(text), F.lit(0)).alias("_b")).distinct()
    more = [] if labels is None else [c for c in labels.columns if c != key]
    narrow = narrow if labels is None else narrow.join(labels, key).drop(key)
    first = narrow.orderBy("_h", "_b").limit(rows)
    running = F.sum("_b").over(Window.orderBy("_h", "_b"))  # over ``rows`` rows at most
    chosen = first.withColumn("_all", running).where(F.col("_all") <= size).select("_h", *more)
    return hashed.join(F.broadcast(chosen), "_h").dropDuplicates(["_h"])


def numbered(docs: DataFrame) -> DataFrame:
    """(id, row): every row as a struct with a number of its own, written once, so that rows can be named whatever their keys
    and column names are."""
    return staged(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*(docs[c] for c in docs.columns)).alias("row")), "numbered")


def text_word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: A key is hot when it holds this share of all rows or more, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one group record per key. The at most 1 / HOT_SHARE groups that hold HOT_SHARE of
    ``total`` rows each are broadcast (their number is bounded whatever the input), the others are joined by a shuffle in
    which no key is large. ``groups`` should be a written table, since it is read twice."""
    least = max(1000, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= least)
    names = [c for c in groups.columns if c != key]
    tagged = rows.join(F.broadcast(hot), key, "left")
    done = tagged.where(F.col(size).isNotNull())
    rest = tagged.where(F.col(size).isNull()).drop(*names).join(groups.where(F.col(size) < least), key)
    return done.select(*rest.columns).unionByName(rest)
