"""Evaluation against ground truth: needles and haystacks, checks, recall, over-redaction and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import merge as M

NEEDLE = "struct<form:string,kind:string,part:string,pattern:string,literal:string>"
#: Which checks apply to an element, by its layer.
CHECKS = {"text": ["coverage", "text", "bytes"], "raster": ["coverage", "pixels", "images"], "vector": ["coverage", "strokes", "pixels"], "hidden": ["text", "bytes"]}
DETECTED, DETECTED_FACE_CORE, DETECTED_FACE_BOX, DETECTED_FACE_ALONE = 0.95, 0.95, 0.80, 0.90


def _needle(form: Column, kind: str, part: str, pattern: Column | None = None, literal: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(form.alias("form"), F.lit(kind).alias("kind"), F.lit(part).alias("part"), (none if pattern is None else pattern).alias("pattern"), (none if literal is None else literal).alias("literal"))


def _general(value: Column, part: str) -> Column:
    """Folded text, and a pattern that leaves room for up to two characters where a letter is not ASCII."""
    clean = F.lower(F.regexp_replace(F.trim(value), r"(?U)\s+", " "))
    escaped = F.regexp_replace(clean, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    loose = F.when(~value.rlike(r"^[\x00-\x7f]*$"), F.regexp_replace(escaped, r"[^\x00-\x7f]", ".{0,2}"))
    return _needle(T.norm_general(value), "general", part, loose)


def needles(kind: T.Str, value: T.Str) -> Column:
    """array<needle>: the full value and its critical fragment, by type; [] for faces, signatures and empty values."""
    k, v = T.col(kind), T.col(value)
    written = F.upper(F.trim(v))
    d = T.digits_k(T.normalize_value(F.lit("rut"), v))
    phone = F.regexp_replace(v, "[^0-9]", "")
    compact = T.normalize_haystack(v, "compact")
    rut = F.array(_needle(d, "digits", "value", literal=written), F.when(F.length(d) >= 8, _needle(F.substring(d, F.lit(1), F.length(d) - 1), "digits", "rut_body", literal=F.regexp_replace(written, rf"[\s{T.DASHES}]*[0-9K]\s*$", ""))))
    tel = F.array(_needle(phone, "digits", "value", literal=written), F.when(F.length(phone) > 7, _needle(F.right(phone, F.lit(7)), "digits", "last7", literal=T.last_digits(written, 7))))
    local = F.when(compact.contains("@"), F.concat(F.substring_index(compact, "@", 1), F.lit("@"))).otherwise(F.regexp_extract(compact, r"^(.+?)[a-z0-9-]+(?:\.[a-z0-9-]+)+$", 1))
    mail = F.array(_needle(compact, "compact", "value"), F.when(k == "email", _needle(local, "compact", "local@")))
    fragment = F.when(k == "name", T.surnames(v)).when(k == "address", T.street_number(v))
    part = F.when(k == "name", _general(fragment, "surnames")).when(k == "address", _general(fragment, "street_number"))
    other = F.array(_general(v, "value"), F.when(fragment.isNotNull(), part))
    every = F.when(k == "rut", rut).when(k == "phone", tel).when(k.isin("email", "url", "qr"), mail).otherwise(other)
    kept = F.filter(every, lambda n: n.isNotNull() & (F.coalesce(n["form"], F.lit("")) != ""))
    return F.when(k.isin("face", "signature") | v.isNull() | (v == ""), F.array().cast(f"array<{NEEDLE}>")).otherwise(F.array_distinct(kept))


def metadata_needles(kind: T.Str, value: T.Str) -> Column:
    """Needles of a hidden value: as its type has them, else in all three normalisations."""
    v = T.col(value)
    d = T.digits_k(v)
    digits = F.when((F.length(d) >= 7) & (F.length(d) >= 0.6 * F.length(F.regexp_replace(v, " ", ""))), _needle(d, "digits", "value", literal=F.upper(F.trim(v))))
    own = F.filter(F.array(_general(v, "value"), _needle(T.normalize_haystack(v, "compact"), "compact", "value"), digits), lambda n: n.isNotNull())
    typed = needles(kind, value)
    return F.when((T.col(kind) != "text") & (F.size(typed) > 0), typed).otherwise(own)


def haystack(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, origin, binary, kind, form): texts normalised once per kind; digits of binary texts are left as written."""
    forms = [F.struct(F.lit(k).alias("kind"), (F.when(F.col("binary"), F.upper(text)).otherwise(T.normalize_haystack(text, k)) if k == "digits" else T.normalize_haystack(text, k)).alias("form")) for k in ("digits", "compact", "general")]
    return texts.select(*keys, "origin", "binary", F.explode(F.array(*forms)).alias("h")).select(*keys, "origin", "binary", "h.kind", "h.form")


def search(needle_rows: DataFrame, hay: DataFrame, keys: list[str]) -> DataFrame:
    """Needles found in the haystack of their file: (element, part, origin). An equi join on file and kind, then containment."""
    n = needle_rows.select(*keys, "element", "kind", F.col("form").alias("nf"), "part", "pattern", "literal")
    both = n.join(hay, [*keys, "kind"])
    plain = F.col("form").contains(F.col("nf")) | F.coalesce(F.when(F.col("pattern").isNotNull(), F.regexp_like("form", F.coalesce("pattern", F.lit("$^")))), F.lit(False))
    hit = F.when(F.col("binary") & (F.col("kind") == "digits"), F.col("form").contains(F.col("literal"))).otherwise(plain)
    return both.where(hit).select(*keys, "element", "part", "origin").distinct()


def found_list(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct "origin:part" of each element, sorted."""
    return hits.groupBy(*keys, "element").agg(F.array_sort(F.collect_set(F.concat_ws(":", "origin", "part"))).alias("found"))


#: Needles of at most this many bytes together are sent to all tasks; more are joined by a shuffle.
NEEDLE_BYTES = 8 << 20


def passages_in(texts: DataFrame, needles_: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", anchor_words: int = 4) -> DataFrame:
    """(key, item): folded needles contained in folded texts, whole words. A needle is keyed by the run of ``anchor_words`` of
    its words with the most letters (by all its words, if it has fewer); texts emit hashes of their runs of those lengths. These
    rows carry no text: it is looked up, and folded again, where a needle's run stands in it, so the containment test is made
    on few pairs. Needles that are small enough are sent to all tasks."""
    words = lambda c: F.filter(F.split(T.norm_general(c), " "), lambda w: w != "")
    bounded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    run = lambda k, h, i: F.xxhash64(F.lit(k), *(F.get(h, i + j) for j in range(k)))
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    n = needles_.select(item, words(text).alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(anchor_words)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("k"))
    best = F.array_max(F.transform(starts, lambda i: F.struct(F.length(F.array_join(F.slice("w", i + 1, F.col("k")), " ")).alias("n"), i.alias("i"))))
    n = n.select(item, "k", hashed("w").alias("hs"), best["i"].alias("i"), bounded("w").alias("n"))
    anchor = F.coalesce(*(F.when(F.col("k") == k, run(k, F.col("hs"), F.col("i"))) for k in range(1, anchor_words + 1)))
    n = n.select(item, "k", anchor.alias("h"), "n")
    facts = n.agg(F.collect_set("k").alias("ks"), F.coalesce(F.sum(F.octet_length("n")), F.lit(0)).alias("size")).first()  # anchor_words lengths at most
    t = texts.select(key, words(text).alias("w")).select(key, hashed("w").alias("hs"))
    # a run over the end of a text has fewer hashes than its length says, and equals that of no needle
    runs = lambda k: F.transform("hs", lambda _, i: run(k, F.col("hs"), i))
    grams = F.flatten(F.array(*map(runs, sorted(facts["ks"])))) if facts["ks"] else F.array().cast("array<bigint>")
    sent = F.broadcast if facts["size"] <= NEEDLE_BYTES else lambda df: df
    hits = t.select(key, F.explode(F.array_distinct(grams)).alias("h")).join(sent(n.select("h", item)), "h").select(key, item).distinct()
    both = hits.join(texts.select(key, text), key).join(sent(n.select(item, "n")), item)
    return both.where(bounded(words(text)).contains(F.col("n"))).select(key, item).distinct()


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 4)


def counts() -> list[Column]:
    """n, detected, recall, leaks, leak share of the evaluated, not processed."""
    evaluated = F.count("leak")
    return [
        F.count("*").alias("n"), F.count_if("detected").alias("detected"), ratio(F.count_if("detected"), F.count("*")).alias("recall"),
        F.count_if("leak").alias("leaks"), ratio(F.count_if("leak"), evaluated).alias("leak_share"), F.count_if(F.col("leak").isNull()).alias("not_processed"),
    ]


def recall_by(elements: DataFrame, *keys: str) -> DataFrame:
    return elements.groupBy(*keys).agg(*counts())


def recall_sets(elements: DataFrame, sets: list[list[str]]) -> DataFrame:
    """All breakdowns in one pass, by grouping sets; ``level_of`` tells them apart."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = elements.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    return grouped.agg(F.grouping_id().alias("level_of"), *counts())


def stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, p50, p95 (exact, linear between values) and max."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(p[0], 4).alias("p50"), F.round(p[1], 4).alias("p95"), F.round(F.max(value), 4).alias("max"))


def bins(value: Column, edges: list[float], unit: str = "") -> Column:
    """Half-open bins named by their edges; null is "?"."""
    out = F.when(value.isNull(), "?")
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        name = f"<{hi:g}{unit}" if lo is None else f">={lo:g}{unit}" if hi is None else f"{lo:g}-{hi:g}{unit}"
        out = out.when(F.lit(True) if hi is None else value < hi, name)
    return out


def angle(tags: T.Str) -> Column:
    t = T.col(tags)
    degrees = F.pmod(F.bround(F.try_element_at(t, F.lit("angle")).cast("double")).cast("int"), F.lit(360))
    return F.when(F.try_element_at(t, F.lit("mirrored")) == "true", "mirrored").otherwise(F.coalesce(degrees.cast("string"), F.lit("0")))


def degradation(tags: T.Str, known: list[str]) -> Column:
    own = F.filter(F.array(*map(F.lit, known)), lambda k: F.map_contains_key(T.col(tags), k))
    return F.when(F.size(own) == 0, "none").otherwise(F.array_join(own, "+"))


def detected(kind: Column, coverage: Column, core: Column) -> Column:
    face = F.when(core.isNull(), coverage >= DETECTED_FACE_ALONE).otherwise((core >= DETECTED_FACE_CORE) & (coverage >= DETECTED_FACE_BOX))
    return F.when(kind == "face", face).otherwise(coverage >= DETECTED)


def element_checks(layer: Column, results: dict[str, Column]) -> Column:
    """map(check, passed): the checks that apply to the layer; null where a check could not be made."""
    applies = F.lit(None).cast("array<string>")
    for name, wanted in CHECKS.items():
        applies = F.when(layer == name, F.array(*map(F.lit, wanted))).otherwise(applies)
    own = F.map_from_arrays(F.array(*map(F.lit, results)), F.array(*results.values()))
    return F.map_filter(own, lambda k, v: F.array_contains(applies, k))


def failures(checks: Column) -> Column:
    """Names of the checks that failed; a check that could not be made is no failure."""
    return F.array_sort(F.map_keys(F.map_filter(checks, lambda k, v: v == F.lit(False))))


def element_status(checks: Column) -> Column:
    values = F.map_values(checks)
    return F.when(F.size(checks) == 0, "not_evaluated").when(F.exists(values, lambda v: F.coalesce(~v, F.lit(False))), "leak").when(F.exists(values, lambda v: v.isNull()), "unknown").otherwise("ok")


def file_eval(expected: Column, error: Column, has_output: Column) -> Column:
    """Status of a file: a rejection must have the expected code."""
    want = F.when(expected.startswith("error:"), F.substring_index(expected, ":", -1))
    got = F.lower(F.trim(F.substring_index(error, ":", 1)))
    return F.when(want.isNotNull() & (want == got), "rejected_as_expected").when(want.isNotNull() & error.isNotNull(), "wrong_code").when(want.isNotNull(), "not_rejected").when(error.isNotNull(), "error").when(~has_output, "missing").otherwise("processed")


def geometry_kept(before: DataFrame, after: DataFrame, file: str = "file") -> DataFrame:
    """Pages whose size as seen (after rotation) is kept within 1 pt or 0.5 px; a page on one side only is a failure."""
    seen = lambda df, s: df.select(F.col(file), "page", F.when(F.col("rotation") % 180 == 0, F.col("width")).otherwise(F.col("height")).alias(f"w{s}"), F.when(F.col("rotation") % 180 == 0, F.col("height")).otherwise(F.col("width")).alias(f"h{s}"), F.col("unit").alias(f"u{s}"))
    both = seen(before, "0").join(seen(after, "1"), [file, "page"], "full")
    room = F.when(F.col("u0") == "pt", 1.0).otherwise(0.5)
    same = (F.abs(F.col("w0") - F.col("w1")) <= room) & (F.abs(F.col("h0") - F.col("h1")) <= room)
    return both.select(file, "page", F.coalesce(same, F.lit(False)).alias("kept"))


def over_redaction(zones: DataFrame, targets: DataFrame, page: list[str]) -> DataFrame:
    """Number of active zones of each page that touch no target."""
    return M.anti_boxes(zones, targets, page).groupBy(*page).agg(F.count("*").alias("zones"))


def uniform_share(pixels: DataFrame, keys: list[str], near: int = 8) -> DataFrame:
    """Share of pixels near the most frequent colour."""
    mode = pixels.groupBy(*keys).agg(F.mode("value", True).alias("m"))
    return pixels.join(mode, keys).groupBy(*keys).agg(ratio(F.count_if(F.abs(F.col("value") - F.col("m")) <= near), F.count("*")).alias("share"))


def correlation(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.round(F.corr("before", "after"), 4).alias("corr"))


def verdict(elements: DataFrame, files: DataFrame, metadata: DataFrame) -> DataFrame:
    """The five acceptance criteria, one row each: (criterion, failures, passed)."""
    crit = elements.agg(F.count_if((F.col("level") == "base") & F.col("type").isin("rut", "email", "phone") & F.col("leak")).alias("critical_leaks"), F.count_if((F.col("level") == "base") & F.col("leak").isNull()).alias("not_processed"))
    own = files.agg(F.count_if(F.col("status").isin("wrong_code", "not_rejected")).alias("rejections"), F.count_if((F.col("status") == "processed") & F.col("seconds").isNull()).alias("timings"))
    meta = metadata.agg(F.count_if("leak").alias("metadata_leaks"))
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), F.col(n).alias("failures")) for n in df.columns))).alias("c"))
    rows = long(crit).unionByName(long(own)).unionByName(long(meta))
    return rows.select("c.criterion", "c.failures", (F.col("c.failures") == 0).alias("passed"))


def duplicate_values(elements: DataFrame) -> DataFrame:
    """Identifiers, e-mail addresses and phones that a file shares with an earlier one."""
    own = elements.where(F.col("type").isin("rut", "email", "phone")).withColumn("norm", T.normalize_value("type", "value"))
    first = F.first("file").over(Window.partitionBy("type", "norm").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.withColumn("first_file", first).where("first_file <> file").select("type", "norm", "file", "first_file").distinct()


def markdown(table: DataFrame, title: str, most: int = 500) -> str:
    """A small table of metrics as Markdown, rendered on the driver; refuses tables that are not small."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: over {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([f"## {title}", "", *head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""])
