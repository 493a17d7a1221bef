"""Detection of personal data in tables of texts: extraction, deduplication and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T


def pattern_spans(df: DataFrame, keys: list[str], text: str, pattern: str, kind: str | None = None, needs: str | None = None) -> DataFrame:
    """One row per match: keys, type, a, b, value. ``needs`` is a literal that every match holds, tested before the pattern."""
    rows = df.where(F.col(text).contains(needs)) if needs else df
    rows = rows.select(*keys, F.explode(S.find_spans(text, pattern)).alias("s"))
    cols = [F.lit(kind).alias("type")] if kind else []
    return rows.select(*keys, *cols, "s.a", "s.b", "s.value")


def detect(df: DataFrame, keys: list[str], text: str, options: S.Detect = S.Detect()) -> DataFrame:
    """One row per span of the pattern detectors: keys, type, a, b, detector, value."""
    own = df.select(*keys, F.col(text).alias("_t"), *([T.ocr_variant(text).alias("_v")] if options.ocr else []))
    rows = own.select(*keys, "_t", F.explode(S.detect_spans("_t", options, "_v" if options.ocr else None)).alias("s"))
    return rows.select(*keys, "s.type", "s.a", "s.b", "s.detector", F.substring("_t", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("value"))


def span_order() -> list[Column]:
    return [F.col("a").asc(), F.col("b").desc(), S.rank(F.col("detector"), S.DETECTOR_PRIORITY, 9).asc(), S.rank(F.col("type"), S.TYPE_PRIORITY, 99).asc(), F.col("type").asc(), F.col("detector").asc()]


def dedup_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct spans that are not empty and not inside an earlier one (earlier: by start, longer first, then by detector and
    type). An earlier span starts no later, so it holds this one exactly if it ends no earlier: a running maximum."""
    own = [*keys, "type", "a", "b", "detector"]
    distinct = df.where("b > a").dropDuplicates(own)
    before = Window.partitionBy(*keys).orderBy(*span_order()).rowsBetween(Window.unboundedPreceding, -1)
    return distinct.withColumn("_end", F.max("b").over(before)).where("_end is null or _end < b").drop("_end")


def flag_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds doubtful, optional and optional_reason to spans that still have their text."""
    value = F.col("value")
    suggested = F.when(F.col("type") == "rut", S.rut_suggested(text, F.col("a"), F.col("b"))).otherwise(False)
    other = F.when(F.col("type") == "url", ~S.is_personal_url(value)).otherwise(False)
    reason = F.when(suggested, "rut").when(other, "url")
    doubt = F.when(F.col("type") == "rut", F.coalesce(S.rut_doubt(value), F.lit(False))).otherwise(F.col("detector") == "context")
    return df.withColumns({"doubtful": doubt, "optional": suggested | other, "optional_reason": reason})


def findings(df: DataFrame, keys: list[str], as_of: str, urls_other: bool = False) -> DataFrame:
    """Flagged spans as findings: a content hash as id, a status, and a history of one entry."""
    keep_other = F.lit(not urls_other)
    status = F.when(F.col("optional") & ((F.col("optional_reason") != "url") | keep_other), "suggested").otherwise("proposed")
    ident = F.sha2(F.concat_ws("\u0001", *(F.col(k).cast("string") for k in keys), "type", F.col("a").cast("string"), F.col("b").cast("string")), 256)
    entry = F.struct(F.lit(as_of).alias("at"), status.alias("action"))
    return df.withColumns({"id": F.left(ident, F.lit(16)), "status": status, "history": F.array(entry)})


def gaps(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Spans in order with the text between the end of all earlier spans and their start."""
    before = Window.partitionBy(*keys).orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("gap_from", F.coalesce(F.max("b").over(before), F.lit(0)))
    size = F.greatest(F.col("a") - F.col("gap_from"), F.lit(0))
    return out.withColumn("gap", F.substring(F.col(text), F.col("gap_from") + 1, size))


def context_type(kind: Column, value: str, sub_types: Column) -> Column:
    """A context "rut" that holds no such number takes the first type of what it does hold, or none."""
    best = F.array_min(F.transform(sub_types, lambda t: F.struct(S.rank(t, S.TYPE_PRIORITY, 99).alias("r"), t.alias("t"))))
    return F.when((kind != "rut") | S.has_rut_number(value), kind).otherwise(best["t"])


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lines with their place: keys, line, a, b, line_text."""
    parts = F.split(F.col(text), "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,t:string>>").alias("out"))
    step = lambda acc, t: F.struct((acc["at"] + F.length(t) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + F.length(t)).alias("b"), t.alias("t")))).alias("out"))
    rows = df.select(*keys, F.posexplode(F.aggregate(parts, start, step, lambda acc: acc["out"])).alias("line", "l"))
    return rows.select(*keys, "line", "l.a", "l.b", F.col("l.t").alias("line_text"))


def naive_scan(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The naive baseline: four plain patterns, nothing else."""
    parts = [pattern_spans(df, keys, text, p, kind) for kind, p in S.NAIVE.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
