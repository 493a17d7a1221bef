"""The state of a session as tables: files that come and go, their queue, views, and what is reported about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .review import file_status, is_active

#: Stages in the order in which their times are told, and their Spanish names.
STAGE_LABELS = {"text": "texto", "render": "preparar imágenes", "ocr": "texto en imágenes", "faces": "rostros", "signatures": "firmas", "qr": "códigos QR"}
#: Detectors that read the text layer.
TEXT_DETECTORS = ["regex", "name_list", "context"]


def register(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files with the new ones, which are queued; a file that is known already stays as it is."""
    fresh = new.join(files, "file", "left_anti").withColumn("status", F.lit("queued"))
    return files.unionByName(fresh, allowMissingColumns=True)


def remove(files: DataFrame, gone: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Files, and other tables of them, without those that are gone."""
    return tuple(df.join(gone.select("file"), "file", "left_anti") for df in (files, *others))


def enqueue(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Files with those to be processed queued and cleared: the wanted ones that are not running, or all queued and cancelled."""
    if wanted is None:
        hit = F.col("status").isin("queued", "cancelled")
        own = files
    else:
        own = files.join(wanted.select("file", F.lit(True).alias("_w")), "file", "left")
        hit = F.coalesce("_w", F.lit(False)) & (F.col("status") != "processing")
    clear = {c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in ("error", "output") if c in files.columns}
    return own.withColumns({"queued": hit, "status": F.when(hit, "queued").otherwise(F.col("status")), **clear}).drop("_w")


def exported(files: DataFrame, results: DataFrame) -> DataFrame:
    """Confirmed files after an export (file, output, error): exported, or as they were with the error; others as they were."""
    own = files.drop("output", "error").join(results, "file", "left")
    done = F.col("output").isNotNull() & F.col("error").isNull()
    return own.withColumn("status", F.when(done, F.coalesce(file_status(F.col("status"), "export"), F.col("status"))).otherwise(F.col("status")))


def state(files: DataFrame) -> DataFrame:
    """(status, files) of the session."""
    return files.groupBy("status").agg(F.count("*").alias("files"))


def nested(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, record): each file with its findings in order, as JSON. A file has as many findings as a reader can look at."""
    own = findings.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "id", "type", "status"))).alias("findings"))
    whole = files.join(own, "file", "left")
    return whole.select("file", F.to_json(F.struct(*(F.col(c) for c in files.columns), F.coalesce("findings", F.array().cast(own.schema["findings"].dataType)).alias("findings"))).alias("record"))


def after_change(shown: Column, busy: Column, was: Column, now: Column) -> Column:
    """What the viewer does with a page's image: update, current, load, or null for nothing."""
    return F.when(shown.isNotNull(), F.when(shown == now, "current").otherwise("update")).when(busy & ~was.eqNullSafe(now), "load")


def resize_rect(r: Column, handle: Column, dx: Column, dy: Column, w: Column, h: Column, least: float = 1.0) -> Column:
    """struct(x, y, w, h) of a rectangle with the edges that ``handle`` names moved by the drag, inside the page, and never
    closer to the opposite edge than ``least``."""

    def axis(low: Column, high: Column, first: str, second: str, d: Column, end: Column) -> tuple[Column, Column]:
        a = F.when(handle.contains(first), F.greatest(F.lit(0.0), F.least(low + d, F.greatest(F.lit(0.0), high - least)))).otherwise(low)
        b = F.when(handle.contains(second), F.least(end, F.greatest(high + d, F.least(end, a + least)))).otherwise(high)
        return a, b

    x0, x1 = axis(r["x"], r["x"] + r["w"], "w", "e", dx, w)
    y0, y1 = axis(r["y"], r["y"] + r["h"], "n", "s", dy, h)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def unread_images(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(file, unread): OCR was off, and the file is an image or has a scanned page."""
    scanned = pages.groupBy("file").agg(F.bool_or("scanned").alias("_s"))
    return files.join(scanned, "file", "left").select("file", (~F.col("ocr") & ((F.col("kind") == "image") | F.coalesce("_s", F.lit(False)))).alias("unread"))


def timing_text(timings: T.Str) -> Column:
    """Spanish sentence on the time of an analysis, from a map of stage to seconds; null without a total."""
    t = T.col(timings)
    parts = F.array_compact(F.array(*(F.when(F.map_contains_key(t, F.lit(s)), F.concat(F.lit(f"{label} "), T.seconds_text(F.try_element_at(t, F.lit(s))))) for s, label in STAGE_LABELS.items())))
    detail = F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, " · "), F.lit(")"))).otherwise("")
    return F.when(F.map_contains_key(t, F.lit("analyze")), F.concat(F.lit("Tiempo de análisis: "), T.seconds_text(F.try_element_at(t, F.lit("analyze"))), detail, F.lit(".")))


def from_text_layer(source: Column, detector: Column) -> Column:
    """Whether a finding's text was read from a text layer: as its source says, else by its detector."""
    return F.coalesce(source == "text", detector.isin(*TEXT_DETECTORS))


def redactions(findings: DataFrame) -> DataFrame:
    """Findings as a report has them: active ones are redacted, the others dismissed."""
    return findings.select("file", "page", "polygon", "type", "detector", F.col("value").alias("text"), "score", F.when(is_active(F.col("status")), "redact").otherwise("dismissed").alias("status"))


def add_files(manifest: DataFrame, new: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(files to add with their digest and elements numbered, ids that are there already or come twice)."""
    twice = new.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id").unionByName(new.join(manifest, "id", "left_semi").select("id")).distinct()
    numbered = F.transform("elements", lambda e, i: F.struct(F.concat(F.col("id"), F.lit("-"), F.lpad((i + 1).cast("string"), 3, "0")).alias("id"), e.alias("element")))
    own = new.join(twice, "id", "left_anti").withColumns({"sha256": F.sha2(content, 256), "elements": numbered})
    return own.drop(content), twice


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def run_details(details: DataFrame) -> DataFrame:
    """(system, details): the details of a run's files as one map, the last of a name counting."""
    own = latest(details, ["system", "name"], "seq").groupBy("system").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("details"))
    return own
