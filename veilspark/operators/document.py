"""Joins over a whole file: propagation of found values, settlement of links, exceptions, matching of results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T

#: Phrases that may stand before a listed value.
LABEL_PHRASES = [p for line in """
rut|rut n|n rut|r u t|run|rut del servicio|rut de la institucion|rol unico tributario
fono|fonos|telefono|telefonos|tel|telf|cel|celular|movil|whatsapp|fax|contacto|fono contacto|telefono contacto
mesa central|fono mesa central|telefono mesa central|mesa de ayuda|linea gratuita|call center|central telefonica
atencion ciudadana|informaciones|oficina de partes|numero|nro|n|web|sitio web|pagina web
""".split("\n") for p in line.split("|") if p]
NAME_LIKE = ["rut", "mesa"]
WORD = r"[\p{L}\p{N}_]+"


def found_values(spans: DataFrame, file: str = "file") -> DataFrame:
    """(file, value, type, detector, whole, pages, pattern): one row per folded value of a file, by its best detector."""
    own = spans.withColumn("_key", T.norm_general("value")).where(F.col("_key") != "")
    whole = T.strong_needle("value") & (F.col("detector") != "context")
    best = F.min(F.struct(S.rank(F.col("detector"), S.DETECTOR_PRIORITY, 9).alias("r"), F.col("page"), F.col("a"), F.col("type"), F.col("detector"), F.col("value"), whole.alias("whole")))
    out = own.groupBy(file, "_key").agg(best.alias("m"), F.collect_set("page").alias("pages"))
    out = out.select(file, F.col("m.value").alias("value"), F.col("m.type").alias("type"), F.col("m.detector").alias("detector"), F.col("m.whole").alias("whole"), "pages", F.struct("m.page", "m.a").alias("first"))
    return out.withColumn("pattern", T.needle_pattern("value")).where("pattern is not null")


def words_of(c: T.Str) -> Column:
    return F.regexp_extract_all(T.fold(c), F.lit(WORD), F.lit(0))


def first_words(c: T.Str) -> Column:
    """The words with which a place of a value can begin: its first word, or its first words written together."""
    w = words_of(c)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda k: F.array_join(F.slice(w, F.lit(1), k), ""))


def candidate_hits(pages: DataFrame, values: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Places where a found value stands again: on its pages, or in the whole file if it is strong. The words of the pages
    are joined with the values that begin with them, so a page meets only such values of its file."""
    words = pages.select(file, "page", F.explode(F.array_distinct(words_of(text))).alias("_w"))
    keyed = values.withColumn("_w", F.explode(first_words("value")))
    near = words.join(keyed.select(file, "_w", "pattern", "whole", "pages"), [file, "_w"]).where(F.col("whole") | F.array_contains("pages", F.col("page")))
    near = near.select(file, "page", "pattern").distinct()
    both = near.join(pages.select(file, "page", F.col(text).alias("text"), T.fold(text).alias("_fold")), [file, "page"]).join(values.drop("whole", "pages"), [file, "pattern"])
    spans = both.select(F.col(file).alias("file"), "page", "text", "type", "detector", F.col("first.page").alias("fp"), F.col("first.a").alias("fa"), F.explode(S.find_spans("_fold", F.col("pattern"))).alias("s"))
    return spans.select("file", "page", "type", "s.a", "s.b", "detector", F.substring("text", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("value"), "fp", "fa")


def propagate(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Every found value is searched again on its page, or in the whole file if strong; hits that overlap an existing span are
    dropped, then hits that overlap an earlier hit. Earlier is by the first appearance of the value, then by place. The
    choice among overlapping hits depends on order, so the hits of one page are folded together."""
    values = found_values(spans)
    hits = candidate_hits(pages, values)
    old = spans.select("file", "page", F.col("a").alias("_a"), F.col("b").alias("_b"))
    cond = [hits["file"] == old["file"], hits["page"] == old["page"], hits["a"] < old["_b"], old["_a"] < hits["b"]]
    free = hits.join(old, cond, "left_anti")

    order = ["file", "page", "fp", "fa", "value", "a", "b"]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, kept = None, []
        for df in batches:  # pages follow each other, so one page's places are all that is remembered
            keep = []
            for i, row in enumerate(df.itertuples(index=False)):
                if (row.file, row.page) != page:
                    page, kept = (row.file, row.page), []
                if all(row.a >= y or row.b <= x for x, y in kept):
                    kept.append((row.a, row.b))
                    keep.append(i)
            yield df.iloc[keep]

    kept = free.repartition("file", "page").sortWithinPartitions(*order).mapInPandas(take, free.schema)
    return kept.select("file", "page", "type", "a", "b", "detector", "value")


def data_in_urls(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Ranges inside link spans where a found value that is no link stands."""
    values = found_values(spans.where("type <> 'url'"))
    urls = spans.where("type = 'url'").select(F.col("file").alias("_f"), F.col("page").alias("_p"), F.col("a").alias("ua"), F.col("b").alias("ub"))
    hits = candidate_hits(pages, values)
    return hits.join(urls, (hits["file"] == urls["_f"]) & (hits["page"] == urls["_p"]) & (hits["a"] >= urls["ua"]) & (hits["b"] <= urls["ub"])).select("file", "page", "a", "b", "type", "value")


def settle_optional(findings: DataFrame) -> DataFrame:
    """An optional link that holds the value of a name, address or signature of its file is no longer optional."""
    named = findings.where(F.col("type").isin("name", "address", "signature") & F.col("value").isNotNull())
    names = named.select(F.col("file").alias("_f"), F.explode(first_words("value")).alias("_w"), T.needle_pattern("value").alias("_p")).where("_p is not null").distinct()
    plain = F.translate(T.fold("value"), "-_", "  ")
    urls = findings.where("type = 'url' and optional").select("id", F.col("file").alias("_f"), plain.alias("_u"))
    urls = urls.select("*", F.explode(F.array_distinct(words_of("_u"))).alias("_w"))
    hit = urls.join(names, ["_f", "_w"]).where(F.regexp_like("_u", F.col("_p"))).select(F.col("id").alias("_id")).distinct()
    out = findings.join(hit, F.col("id") == F.col("_id"), "left")
    settled = F.col("_id").isNotNull()
    return out.withColumns({"optional": F.col("optional") & ~settled, "optional_reason": F.when(~settled, F.col("optional_reason")), "status": F.when(settled & (F.col("status") == "suggested"), "proposed").otherwise(F.col("status"))}).drop("_id")


def exception_keys(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """(type, key) of the entries of the exception list."""
    p = entries.select(T.parse_exception(entry).alias("p"))
    return p.select(F.explode(F.array(F.struct(F.lit("rut").alias("type"), F.col("p.rut").alias("key")), F.struct(F.lit("phone").alias("type"), F.col("p.phone").alias("key")))).alias("k")).select("k.*").where("key is not null").distinct()


def clean_exceptions(entries: DataFrame, entry: str = "entry", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(kept, invalid): the first entry of each key, and those that are neither kind."""
    own = entries.withColumn("value", F.substring(F.trim(F.regexp_replace(entry, r"\s+", " ")), 1, 60)).where("value <> ''").withColumn("k", T.parse_exception("value"))
    valid = F.col("k.rut").isNotNull() | F.col("k.phone").isNotNull()
    first = Window.partitionBy("k.rut", "k.phone").orderBy(order)
    kept = own.where(valid).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(order, "value", "k.rut", "k.phone")
    return kept, own.where(~valid).select(order, "value")


def clean_entries(entries: DataFrame, entry: str = "entry", order: str = "pos") -> DataFrame:
    """Entries with spaces collapsed, 200 characters at most, the first of each value whatever its case."""
    own = entries.withColumn("value", F.substring(F.trim(F.regexp_replace(entry, r"\s+", " ")), 1, 200)).where("value <> ''")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("value")).orderBy(order))).where("_n = 1").select(order, "value")


def matches(values: DataFrame, keys: DataFrame, kind: str = "type", value: str = "value") -> DataFrame:
    """The values that are on the exception list as their type."""
    key = F.when(F.col(kind) == "rut", T.rut_key(value)).when(F.col(kind) == "phone", T.phone_key(value))
    own = values.withColumn("_key", key)
    return own.join(keys.select(F.col("type").alias("_t"), F.col("key").alias("_k")), (F.col(kind) == F.col("_t")) & (F.col("_key") == F.col("_k")), "left_semi").drop("_key")


def is_label_gap(gap: T.Str) -> Column:
    """Nothing, punctuation or one label phrase; phrases that could be names need a colon or capitals."""
    g = T.col(gap)
    sign = g.rlike(r"(?i)(?<![\p{L}\p{N}_])n\s*[°º]")
    words = F.array_join(F.regexp_extract_all(T.norm(F.regexp_replace(g, r"(?i)(?<![\p{L}\p{N}_])n\s*[°º]", " n ")), F.lit(r"\p{L}+"), F.lit(0)), " ")
    listed = words.isin(*LABEL_PHRASES)
    n_ok = ~F.array_contains(F.split(words, " "), "n") | sign
    like = F.arrays_overlap(F.split(words, " "), F.array(*map(F.lit, NAME_LIKE)))
    marked = g.rlike(r":\s*$") | g.rlike(r"(?<![\p{L}\p{N}_])RUT(?![\p{L}\p{N}_])")
    return ~g.rlike(r"[0-9]") & ((words == "") | (listed & n_ok & (~like | marked)))


def excepted(findings: DataFrame, spans: DataFrame, keys: DataFrame) -> DataFrame:
    """ids of findings of which all that would stay visible is listed, a link that is not personal, or a label.

    ``spans`` are the deduplicated spans of each finding's text (id, type, a, b, value, text)."""
    key = F.when(F.col("type") == "rut", T.rut_key("value")).when(F.col("type") == "phone", T.phone_key("value"))
    own = spans.withColumn("_key", key).join(keys.select(F.col("type").alias("_t"), F.col("key").alias("_k")), (F.col("type") == F.col("_t")) & (F.col("_key") == F.col("_k")), "left")
    before = Window.partitionBy("id").orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"_listed": F.col("_k").isNotNull(), "_end": F.coalesce(F.max("b").over(before), F.lit(0))})
    gap = F.substring("text", F.col("_end") + 1, F.greatest(F.col("a") - F.col("_end"), F.lit(0)))
    fine = (F.col("_listed") | ((F.col("type") == "url") & ~S.is_personal_url("value"))) & ((F.col("a") < F.col("_end")) | is_label_gap(gap))
    per = own.groupBy("id").agg(F.bool_and(fine).alias("fine"), F.bool_or("_listed").alias("listed"), F.max("b").alias("end"), F.first("text").alias("text"))
    tail = F.substring("text", F.col("end") + 1, F.length("text"))
    good = per.where(F.col("fine") & F.col("listed") & ~tail.rlike(r"[\p{L}\p{N}]")).select("id")
    return good.join(findings.where(~F.col("optional") & F.col("type").isin("rut", "phone")).select("id"), "id", "left_semi")


def apply_exceptions(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """The given findings become suggestions by reason of the exception list, with a history that begins anew."""
    out = findings.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    first = F.coalesce(F.try_element_at("history", F.lit(1))["at"], F.lit(None).cast("string"))
    fresh = F.array(F.struct(first.alias("at"), F.lit("suggested").alias("action")))
    proposed = hit & (F.col("status") == "proposed")
    return out.withColumns({"history": F.when(proposed, fresh).otherwise(F.col("history")), "status": F.when(proposed, "suggested").otherwise(F.col("status")), "optional": F.col("optional") | hit, "optional_reason": F.when(hit, "exception").otherwise(F.col("optional_reason"))}).drop("_id")


def adopt_unmarked(findings: DataFrame, leaks: DataFrame) -> DataFrame:
    """Where all leaks of a file are unmarked ones with boxes, they become findings of the detector ``verify``."""
    bad = leaks.where("finding_id is not null or size(polygons) = 0").select("file").distinct()
    good = leaks.join(bad, "file", "left_anti").select("file", "page", "type", F.col("message").alias("value"), F.explode("polygons").alias("polygon"))
    ident = F.left(F.sha2(F.concat_ws("\u0001", "file", F.col("page").cast("string"), "type", F.to_json("polygon")), 256), F.lit(16))
    return findings.unionByName(good.select(ident.alias("id"), "*", F.lit("verify").alias("detector"), F.lit("proposed").alias("status")), allowMissingColumns=True)


def path_key(path: T.Str) -> Column:
    return F.regexp_replace(F.replace(T.col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def match_results(files: DataFrame, results: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(files with their result, the last one of a path, or none; results without a file)."""
    own = results.withColumn("_k", path_key("input"))
    last = own.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    keyed = files.withColumn("_k", path_key("path"))
    return keyed.join(last, "_k", "left").drop("_k"), own.join(keyed.select("_k"), "_k", "left_anti").drop("_k")
