"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash and repeat, whole pass after whole pass, as often as its target asks.
A copy's virtual finish time is the number of source words up to its end, divided by the source's target. The copies of all
sources are sorted globally by that time, in ranges, and cut where their words reach the budget: sums of ranges find the
range of the cut, and in it running sums find the last copy that is taken. Running sums inside sources, the sources' order
and their targets are made the same way, so neither a source, nor a time range, nor the list of sources has to fit a task.

Defined results: null text has size 0, and a document of size 0 takes nothing; a null source is a source of its own, last
in order; ties of time are ordered by source, pass, hash, key, size and text; rows that repeat a key, or are equal, each count;
null keys are keys; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_groups, numbered, range_sorted, running_total, staged, staged_alone, text_word_count

MAX_PASSES = 3
#: Order of the rows of a source, which tells all rows apart; ``id`` only tells rows apart that are equal otherwise.
_ORDER = ("h", "k", "size", "th", "id")


def _tag(source: str) -> Column:
    """The source as a key that is never null."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def source_targets(sources: DataFrame, budget: float, most: float = MAX_PASSES) -> DataFrame:
    """``sources`` (tag, s, size, weight, ..) with ``target``: the budget split by weight, a source getting ``most`` times its
    size at most, and the excess going to the others by weight.

    Sources are full in the order of most * size / weight. With the first i of that order full, the others share what is
    left; the first i at which the next source is not full is the answer."""
    own = sources.where("size > 0 and weight > 0").select("tag", "weight", (F.col("size") * most).alias("cap"), (F.col("size") * most / F.col("weight")).alias("r"))
    both = running_total(running_total(own, [F.col("r"), F.col("tag")], "cap", "caps").withColumnRenamed("_end", "cap_end"), [F.col("r"), F.col("tag")], "weight", "weights")
    total = own.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]
    share = (F.lit(float(budget)) - (F.col("cap_end") - F.col("cap"))) / (F.lit(total) - (F.col("_end") - F.col("weight")))
    found = both.withColumn("share", share).where(F.col("share") <= F.col("r")).agg(F.min_by("share", F.struct("r", "tag")).alias("share")).first()["share"]
    cap = F.col("size") * F.lit(float(most))
    due = cap if found is None else F.least(cap, F.lit(found) * F.col("weight"))
    return sources.withColumn("target", F.when((F.col("size") > 0) & (F.col("weight") > 0), due).otherwise(0.0))


def weighted_sources(rows: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """(tag, s, size, n, s_at, weight): the sources in order of code points, null last, with weights 1, 2, 3, repeating, or
    the given ones (a source without one weighs 0)."""
    sums = rows.groupBy("tag").agg(F.first("s").alias("s"), F.sum("size").alias("size"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    ranked = running_total(sums, [F.col("s").isNull(), F.col("tag")], "one", "sources").withColumnRenamed("_end", "s_at").drop("one")
    if weights is None:
        return ranked.withColumn("weight", (1 + (F.col("s_at") - 1) % 3).cast("double"))
    given = rows.sparkSession.createDataFrame([("" if s is None else f"s{s}", float(w)) for s, w in weights.items()], "tag string, weight double")
    return ranked.join(F.broadcast(given), "tag", "left").fillna(0.0, ["weight"])


def _queue(rows: DataFrame, weights: dict[str | None, float] | None, budget_share: float) -> DataFrame:
    """(id, k, s, size, source_size, target, copies, taken, finish) for written rows (id, k, s, size, th, h)."""
    rows = rows.withColumn("tag", _tag("s"))
    sources = staged(weighted_sources(rows, weights), "weighted-sources")
    facts = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    budget = budget_share * facts["size"]
    starts = running_total(source_targets(sources, budget), [F.col("s_at")], "size", "starts")
    starts = staged(starts.select("tag", "s_at", F.col("size").alias("source_size"), "n", "target", (F.col("_end") - F.col("size")).alias("_start")), "source-facts")
    placed = join_groups(rows, starts, "tag", "n", facts["n"]).drop("tag", "n")
    placed = running_total(placed, [F.col("s_at"), *map(F.col, _ORDER)], "size", "shuffled")
    placed = staged(placed.withColumn("end", F.col("_end") - F.col("_start")).drop("_end", "_start"), "queue")
    finish = lambda e: (e * F.col("source_size") + F.col("end")) / F.col("target")
    copies = placed.where("size > 0 and target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))))
    copies = copies.select(finish(F.col("pass")).alias("finish"), "s_at", "pass", *_ORDER)
    order = ("finish", "s_at", "pass", *_ORDER)
    last = _cut(copies, order, budget)
    if last is None:
        took = F.lit(0)
    else:
        edge = F.struct(*(F.lit(last[c]).cast(copies.schema[c].dataType).alias(c) for c in order))
        rank = lambda e: F.struct(finish(F.lit(e)).alias("finish"), "s_at", F.lit(e).alias("pass"), *_ORDER)
        took = sum((F.when(rank(e) <= edge, 1).otherwise(0) for e in range(MAX_PASSES)), F.lit(0))
    out = placed.withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), took).otherwise(0).cast("int"))
    first = F.when(F.col("target") > 0, finish(F.lit(0)))
    return out.select("id", "k", "s", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), first.alias("finish"))


def _cut(copies: DataFrame, order: tuple[str, ...], budget: float):
    """The last copy, in the global order, with which the words taken do not exceed the budget; None if no copy does."""
    columns = [F.col(c) for c in order]
    rows, parts = range_sorted(copies, columns, "size", "finish-times")
    parts = parts.withColumn("_over", F.col("_before") + F.col("_own") > budget)
    at = parts.where("_over").orderBy("_part").limit(1).collect()
    if not at:
        return rows.agg(F.max(F.struct(*columns)).alias("x")).first()["x"]
    part, before = at[0]["_part"], at[0]["_before"]
    running = F.sum("size").over(Window.partitionBy("_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0))
    own = rows.where(F.col("_part") == part).withColumn("_in", running).where(F.col("_in") + F.lit(before) <= budget)
    earlier = rows.where(F.col("_part") < part)
    return own.select(*order).unionByName(earlier.select(*order)).agg(F.max(F.struct(*columns)).alias("x")).first()["x"]


def _rows(key: Column, source: Column, text: Column, seed: int) -> list[Column]:
    th = F.xxhash64(text)
    return [key.alias("k"), source.alias("s"), text_word_count(text).alias("size"), th.alias("th"), F.xxhash64(key, th, F.lit(seed)).alias("h")]


def fair_queue(docs: DataFrame, weights: dict[str | None, float] | None = None, budget_share: float = 1.0, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 42) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, finish) of each row: ``copies`` of the document are in the mix
    and ``finish`` is the virtual finish time of the first."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), *_rows(F.col(key), F.col(source), F.col(text), seed))
    out = _queue(staged(rows, "sizes"), weights, budget_share).drop("id")
    return out.withColumnsRenamed({"k": key, "s": source})


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, budget_share: float = 1.0, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 42) -> DataFrame:
    """The rows that the mix takes, whole, each as often as it takes it. Rows are written once with a number of their own, so
    null and repeated keys, and equal rows, are each taken as their own row of the queue says."""
    rows = numbered(docs)
    field = lambda c: F.col("row").getField(c)

    def queue() -> DataFrame:
        narrow = staged(rows.select("id", *_rows(field(key), field(source), field(text), seed)), "sizes")
        return _queue(narrow, weights, budget_share).where("copies > 0").select("id", "copies")

    taken = staged_alone(queue, "taken").select("id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.join(taken, "id").select("row.*")
