"""Masking of texts, the leak check on what was written, and the audit record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import spans as S
from ..functions import text as T
from . import detect as D

MASK = "█"


def mask(text: T.Str, spans: Column, char: str = MASK) -> Column:
    """Text with the characters of the spans (array<struct<a, b>>) masked, white space kept; the length stays."""
    t = T.col(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        a, b = F.greatest(s["a"], acc["at"]), F.greatest(s["b"], acc["at"])
        hidden = F.regexp_replace(F.substring(t, a + 1, b - a), r"(?U)\S", char)
        return F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, a - acc["at"]), hidden).alias("out"), b.alias("at"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))


def mask_pattern(text: T.Str, pattern: str, char: str = MASK) -> Column:
    return mask(text, F.transform(S.find_spans(text, pattern), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))), char)


def mask_detected(text: T.Str, options: S.Detect, char: str = MASK) -> Column:
    """Text with all that the pattern detectors find in it masked, where it stands: nothing is joined or shuffled."""
    return mask(text, F.transform(F.filter(S.detect_spans(text, options), lambda s: s["b"] > s["a"]), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))), char)


def blank(text: T.Str, a: Column, b: Column) -> Column:
    """The characters of a range that are no white space become spaces."""
    t = T.col(text)
    return F.concat(F.substring(t, F.lit(1), a), F.regexp_replace(F.substring(t, a + 1, b - a), r"(?U)\S", " "), F.substring(t, b + 1, F.length(t)))


def masked_pages(pages: DataFrame, spans: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Pages with ``masked``, the text without its active spans."""
    own = spans.groupBy(*keys).agg(F.collect_set(F.struct("a", "b")).alias("_s"))
    out = pages.join(own, keys, "left")
    return out.withColumn("masked", F.when(F.col("_s").isNull(), F.col(text)).otherwise(mask(text, F.col("_s")))).drop("_s")


def needles_in_output(output: DataFrame, findings: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """Active values that the output still shows on their page, after what was kept visible has been blanked."""
    own = findings.withColumn("_p", T.needle_pattern("value")).where("_p is not null")
    both = output.select(*page, T.fold(text).alias("_t")).join(own, page)
    return both.where(F.regexp_like("_t", F.col("_p"))).select(*page, "id", "type", "value")


def unmarked(output: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Identifiers, e-mail addresses and phones that the output still holds: one row per page, type and value, all places."""
    found = D.dedup_spans(D.detect(output, keys, text, S.Detect(urls_personal=False, urls_other=False)), keys)
    key = F.when(F.col("type") == "email", F.lower("value")).otherwise(T.digits_k("value"))
    return found.groupBy(*keys, "type", key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("places"), F.count("*").alias("n"))


def string_leaks(strings: DataFrame, findings: DataFrame) -> DataFrame:
    """Strong values found in any string of a file, each pattern once."""
    own = findings.where(T.strong_needle("value")).withColumn("_p", T.needle_pattern("value"))
    first = Window.partitionBy("file", "_p").orderBy("id")
    own = own.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    both = strings.select("file", T.fold("text").alias("_t")).join(own, "file")
    return both.where(F.regexp_like("_t", F.col("_p"))).groupBy("file", "id", "type").agg(F.count("*").alias("strings"))


def metadata_leaks(metadata: DataFrame) -> DataFrame:
    """Files with any metadata text left."""
    return metadata.where(F.col("text").rlike(r"(?U)\S")).groupBy("file").agg(F.count("*").alias("left"), F.array_sort(F.collect_set("location")).alias("locations"))


def within(chars: Column, zones: Column) -> Column:
    """Every visible character's box meets a zone."""
    one = lambda c: F.exists(zones, lambda z: (c["x0"] < z["x1"]) & (z["x0"] < c["x1"]) & (c["y0"] < z["y1"]) & (z["y0"] < c["y1"]))
    return F.forall(chars, one)


def place(chars: DataFrame, keys: list[str], pad: float = 1.0) -> DataFrame:
    """Padded union box of characters."""
    return chars.groupBy(*keys).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))


def squeezed_leaks(output: DataFrame, active: DataFrame, kept: DataFrame, page: list[str]) -> DataFrame:
    """The development engine's check: active values minus kept ones, without white space, in the output's text."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    values = active.select(*page, squeeze("value").alias("needle")).exceptAll(kept.select(*page, squeeze("value").alias("needle"))).distinct()
    both = output.select(*page, squeeze("text").alias("_t")).join(values, page)
    return both.where(F.col("_t").contains(F.col("needle")) & (F.col("needle") != "")).select(*page, "needle")


def export(pages: DataFrame, spans: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(masked pages, leaks): mask, search the output again, mask what was found once more, and check again. The second pass
    starts from a checkpoint, so that it does not repeat the first."""
    first = masked_pages(pages, spans, keys, text).withColumn(text, F.col("masked")).drop("masked").checkpoint()
    second = first.withColumn(text, mask_detected(text, S.Detect(urls_personal=False, urls_other=False))).checkpoint()
    return second, unmarked(second, keys, text)


def audit_records(files: DataFrame, findings: DataFrame, results: DataFrame) -> DataFrame:
    """One JSON record per file: counts by type, changes, optional findings. Text is given only for what stays visible."""
    active = ~F.col("status").isin("removed", "suggested")
    by_type = findings.where(active).groupBy("file", "type").agg(F.count("*").alias("n"))
    counts = by_type.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    visible = F.when(~active, F.col("value"))
    optional = findings.where("optional").groupBy("file").agg(F.count_if(active).alias("applied"), F.count_if(~active).alias("left_visible"), F.array_sort(F.collect_list(F.struct("id", "type", "optional_reason", visible.alias("text")))).alias("items"))
    changes = findings.groupBy("file").agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "removed").alias("removed"), F.count_if(F.col("doubtful") & active).alias("doubtful"))
    out = files.join(results, "file", "left").join(counts, "file", "left").join(optional, "file", "left").join(changes, "file", "left")
    record = F.struct("name", F.coalesce("exported", F.lit(False)).alias("exported"), "by_type", F.struct("added", "removed", "doubtful").alias("changes"), F.struct("applied", "left_visible", "items").alias("optional"))
    return out.select("file", F.to_json(record).alias("record"))


def last_action(history: Column, action: str) -> Column:
    return F.try_element_at(F.filter(history, lambda h: h["action"] == action), F.lit(-1))


def reasons_text(codes: Column, order: list[str]) -> Column:
    """Distinct codes in the given order."""
    return F.array_join(F.filter(F.array(*map(F.lit, order)), lambda c: F.array_contains(codes, c)), "; ")


def split_zones(findings: DataFrame) -> DataFrame:
    """Boxes by page: active, kept visible, and drawn by the reviewer."""
    active = ~F.col("status").isin("removed", "suggested")
    b = G.bbox("polygon")
    return findings.groupBy("file", "page").agg(F.collect_list(F.when(active, b)).alias("active"), F.collect_list(F.when(~active, b)).alias("kept"), F.collect_list(F.when(active & (F.col("status") == "added"), b)).alias("drawn"))
