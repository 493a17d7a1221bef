"""Queries on signature anchors, checks of outputs, the session's state, and metadata of image bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import checks as CH
from ..operators import session as SE
from ..operators import signatures as SIG
from ..sources import metadata as MD
from .catalog import Tables, query

PAGE = ["file", "page"]
_SAME = "a.file = b.file AND a.page = b.page"


# ---- lines and signatures -------------------------------------------------------------------------------------------


@query(r"""SELECT conv_id, turn, l AND s >= 90 AS legible, NOT (l AND s >= 90) AND l AS needs_mirror FROM (
SELECT conv_id, turn, length(regexp_replace(substr(text, 1, turn + 1), '[^\p{L}\p{N}]', '', 'g')) >= 4 AS l, (turn * 37 + conv_id) % 101 AS s FROM conversations)""")
def ocr_legible(t: Tables) -> DataFrame:
    own = t("conversations").select("conv_id", "turn", F.expr("substr(text, 1, cast(turn as int) + 1)").alias("text"), ((F.col("turn") * 37 + F.col("conv_id")) % 101 / 100).alias("score"))
    return SIG.legible(own, ["conv_id", "turn"])


@query("SELECT file, page, x0, y0, x1, h AS y1 FROM (SELECT *, CASE WHEN type = 'name' THEN y0 + id % 4 ELSE y1 END AS h FROM {syn_box}) a WHERE (type = 'name' AND id % 3 = 1 AND h - y0 <= 2 AND x1 - x0 BETWEEN 30 AND 40) OR (type = 'url' AND id % 2 = 0 AND x1 - x0 <= 40)")
def signature_rules(t: Tables) -> DataFrame:
    b = t("syn_box").withColumn("width", F.lit(66.67))
    paths = b.where("type = 'name'").withColumns({"y1": F.col("y0") + F.col("id") % 4, "segments": F.col("id") % 3, "curves": F.lit(0)})
    lines = b.where("type = 'url'").withColumn("text", F.when(F.col("id") % 2 == 0, " ___ . . . ___ ").otherwise("___ firma"))
    return SIG.signature_rules(paths, lines, PAGE)


_REACH = "greatest(15, 0.3 * (a.y1 - a.y0))"
_SHARED = "least(a.x1, b.x1) - greatest(a.x0, b.x0)"


@query(f"""SELECT id FROM {{syn_box}} a WHERE type = 'signature' AND (
EXISTS (SELECT 1 FROM {{syn_box}} b WHERE b.type = 'rut' AND {_SAME} AND {_SHARED} >= 0.5 * least(a.x1 - a.x0, b.x1 - b.x0) AND b.y1 >= a.y0 + 0.3 * (a.y1 - a.y0) AND b.y0 <= a.y1 + {_REACH})
OR EXISTS (SELECT 1 FROM {{syn_box}} b WHERE b.type = 'name' AND {_SAME} AND {_SHARED} > 0 AND b.y0 BETWEEN a.y1 - 0.2 * (a.y1 - a.y0) AND a.y1 + 2 * {_REACH}))""")
def signature_anchors(t: Tables) -> DataFrame:
    b = t("syn_box")
    return SIG.anchored(b.where("type = 'signature'"), b.where("type = 'rut'"), b.where("type = 'name'"), PAGE).select("id")


_ROLES = "(SELECT file, page, line, x0, y0, x1, y1, CASE line % 4 WHEN 0 THEN 'Directora General' WHEN 1 THEN 'Alcalde' WHEN 2 THEN 'valor' ELSE 'Firma y timbre' END AS text FROM {syn_line})"


def _role_lines(t: Tables) -> DataFrame:
    k = F.col("line") % 4
    return t("syn_line").withColumn("text", F.when(k == 0, "Directora General").when(k == 1, "Alcalde").when(k == 2, "valor").otherwise("Firma y timbre"))


@query(f"""SELECT file, page, line FROM {_ROLES} a WHERE (line % 4 < 2 OR line % 8 = 2) AND NOT EXISTS (SELECT 1 FROM {_ROLES} b WHERE {_SAME} AND a.line <> b.line
AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.4 * least(greatest(1, a.y1 - a.y0), b.y1 - b.y0) AND b.x1 >= a.x0 - 4 * greatest(1, a.y1 - a.y0) AND b.x0 <= a.x1 + 4 * greatest(1, a.y1 - a.y0))""")
def signer_lines(t: Tables) -> DataFrame:
    lines = _role_lines(t)
    return SIG.signer_lines(lines, PAGE, lines.where("line % 8 = 2 or line % 8 = 1")).select(*PAGE, "line")


@query(f"""SELECT DISTINCT a.id AS region, b.line FROM (SELECT * FROM {{syn_box}} WHERE type = 'signature') a JOIN (SELECT * FROM {_ROLES} WHERE line % 4 = 3) b ON {_SAME}
AND b.x0 <= a.x1 + 144 AND a.x0 - 144 <= b.x1 AND b.y0 <= a.y1 + 144 AND a.y0 - 144 <= b.y1""")
def signature_keyword_lines(t: Tables) -> DataFrame:
    regions = t("syn_box").where("type = 'signature'").withColumn("region", F.col("id"))
    return SIG.signature_lines(regions, _role_lines(t), PAGE).select("region", "line")  # a line's number says its page, on which a pair comes once


# ---- checks of outputs ----------------------------------------------------------------------------------------------

_OVER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


@query(f"SELECT DISTINCT a.file, a.id AS element, b.id % 50 AS digest FROM {{syn_box}} a JOIN {{syn_box}} b ON {_SAME} AND {_OVER} WHERE a.type = 'rut' AND b.type = 'url' AND (b.id % 50) IN (SELECT o.id % 50 FROM {{syn_box}} o WHERE o.type = 'phone' AND o.file = a.file)")
def originals_left(t: Tables) -> DataFrame:
    b = t("syn_box").withColumn("digest", F.col("id") % 50)
    elements = b.where("type = 'rut'").select(*PAGE, F.col("id").alias("element"), "x0", "y0", "x1", "y1")
    images = lambda kind: b.where(F.col("type") == kind).select(*PAGE, "digest", "x0", "y0", "x1", "y1")
    return CH.originals_left(elements, images("url"), images("phone"), PAGE)


@query(f"SELECT a.file, a.page, a.id AS element, count(*) AS points FROM {{syn_box}} a JOIN (SELECT file, page, x0 + 0.5 AS x, y0 + 0.25 AS y FROM {{syn_box}} WHERE type = 'url') b ON {_SAME} AND b.x > a.x0 AND b.x < a.x1 AND b.y > a.y0 AND b.y < a.y1 WHERE a.type = 'rut' GROUP BY ALL")
def strokes_left(t: Tables) -> DataFrame:
    b = t("syn_box")
    elements = b.where("type = 'rut'").select(*PAGE, F.col("id").alias("element"), G.rect_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("polygon"))
    return CH.strokes_left(elements, b.where("type = 'url'").select(*PAGE, (F.col("x0") + 0.5).alias("x"), (F.col("y0") + 0.25).alias("y")), PAGE)


@query("SELECT c_custkey AS file, c_custkey AS element, c_custkey % 3 <> 1 AS extractable FROM customer")
def neutral_text(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("file"), "c_name")
    elements = c.select("file", F.col("file").alias("element"), F.lit("text").alias("layer"), F.concat(F.lit("Acta de "), "c_name").alias("value"))
    text = F.when(F.col("file") % 3 == 0, F.concat(F.lit("ACTA  de\n"), "c_name", F.lit(" fin"))).when(F.col("file") % 3 == 1, F.concat(F.lit("acta del "), "c_name")).otherwise(F.concat(F.lit("El ácta de "), "c_name"))
    return CH.neutral_text(elements, c.select("file", text.alias("text")))


_PLACES = ["exif.gps.lat", "png.exif.gps", "webp.xmp", "IPTC", "png.text.Author", "png.text", "tiff.artist", "tiff.Host_Computer", "tiff.700", "tiff.none", "pdf.info.author", "pdf.info", "pdf.annotation.1", "other.place", "com", "exif"]
_LEFT = ["exif.gps", "png.text.author", "tiff.315", "pdf.info.title", "pdf.annotation"]
_EXPECT = ["true", "true", "false", "false", "true", "true", "true", "false", "false", "true", "false", "false", "true", "NULL", "false", "false"]


@query("SELECT p_partkey AS id, CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_EXPECT)) + " END AS present, CASE p_partkey % 16 WHEN 2 THEN 'tiff.700' WHEN 6 THEN 'tiff.315' WHEN 7 THEN 'tiff.316' WHEN 8 THEN 'tiff.700' END AS tag FROM part")
def structure_places(t: Tables) -> DataFrame:
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("p_partkey") % 16 + 1).cast("int"))
    own = t("part").select(F.col("p_partkey").alias("id"), place.alias("place"), F.array(*map(F.lit, _LEFT)).alias("left"))
    return own.select("id", CH.structure_present("place", "left").alias("present"), CH.tiff_structure("place").alias("tag"))


@query("SELECT id AS file, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN 1 ELSE 1 END ELSE (CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) END AS reasons, CASE WHEN id % 7 = 0 OR id % 2 = 0 OR id % 3 = 0 THEN 'leak' ELSE 'removed' END AS status FROM (SELECT c_custkey AS id FROM customer)")
def metadata_status(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("file"))
    entries = c.select("file", F.lit(1).alias("entry"), F.lit("exif.gps").alias("location"), F.lit("autor").alias("value"))
    found = c.where("file % 2 = 0").select("file", F.lit(1).alias("element"), F.array(F.lit("meta:value")).alias("found"))
    left = c.select("file", F.array(F.when(F.col("file") % 3 == 0, "exif.gps").otherwise("exif")).alias("structures"))
    return CH.metadata_status(entries, found, left, c.where("file % 7 = 0")).select("file", F.size("reasons").alias("reasons"), "status")


@query(f"""WITH l AS (SELECT id, file, page, x0, y0, x0 + 2 AS x1, y0 + 2 AS y1 FROM {{syn_box}} WHERE type = 'url'),
g AS (SELECT DISTINCT b.id, b.file, b.page, b.x0 - 1.1 AS x0, b.y0 - 1.1 AS y0, b.x1 + 1.1 AS x1, b.y1 + 1.1 AS y1 FROM {{syn_box}} a JOIN l b ON {_SAME} AND {_OVER} WHERE a.type = 'rut'
AND (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1 AND b.x0 - 1.1 >= a.x0 - 1.5 AND b.y0 - 1.1 >= a.y0 - 1.5 AND b.x1 + 1.1 <= a.x1 + 1.5 AND b.y1 + 1.1 <= a.y1 + 1.5)
SELECT id FROM g a WHERE NOT EXISTS (SELECT 1 FROM {{syn_box}} b WHERE b.type = 'phone' AND {_SAME} AND {_OVER})""")
def glyph_cover(t: Tables) -> DataFrame:
    b = t("syn_box")
    box = ["x0", "y0", "x1", "y1"]
    glyphs = b.where("type = 'url'").select(*PAGE, "id", F.lit(1.0).alias("reach"), "x0", "y0", (F.col("x0") + 2).alias("x1"), (F.col("y0") + 2).alias("y1"))
    return CH.cover(b.where("type = 'rut'").select(*PAGE, *box), glyphs, b.where("type = 'phone'").select(*PAGE, *box), PAGE).select("id")


@query("""WITH f AS (SELECT c_custkey AS file, CASE WHEN c_custkey % 6 = 0 THEN 'rejected_as_expected' WHEN c_custkey % 6 = 1 THEN 'wrong_code' WHEN c_custkey % 6 = 2 THEN 'not_rejected' WHEN c_custkey % 6 = 3 THEN 'error' WHEN c_custkey % 6 = 4 THEN 'missing' ELSE 'processed' END AS status FROM customer)
SELECT f.file, f.status, count(e.id) AS elements, count(e.id) FILTER (e.detected) AS detected, count(e.id) FILTER (e.id % 3 = 0) AS leaks, count(e.id) FILTER (e.id % 3 = 1) AS unknown FROM f LEFT JOIN {syn_eval} e ON f.file = e.file AND f.status = 'processed' GROUP BY ALL""")
def evaluate_files(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 6
    files = t("customer").select(F.col("c_custkey").alias("file"), F.when(k < 3, "error:password").otherwise("process").alias("expected"), F.when(k == 0, "Password : x").when(k == 1, "corrupt: x").when(k == 3, "corrupt").alias("error"), (k.isin(2, 5)).alias("has_output"))
    bad = F.when(F.col("id") % 3 == 0, False).when(F.col("id") % 3 == 2, True)
    elements = t("syn_eval").select("file", "detected", F.create_map(F.lit("coverage"), F.lit(True), F.lit("text"), bad).alias("checks"))
    return CH.evaluate_files(files, elements)


# ---- session --------------------------------------------------------------------------------------------------------

_STATES = ["queued", "processing", "ready", "confirmed", "exported", "cancelled"]
_STATE_SQL = "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"


def _files(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t("customer").select(F.col("c_custkey").alias("file"), status.alias("status"), F.lit("e").alias("error"), F.lit("o").alias("output"))


@query(f"SELECT status, count(*) AS files FROM (SELECT {_STATE_SQL} AS status FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'queued' FROM customer WHERE c_custkey % 2 = 0) GROUP BY status")
def session_register(t: Tables) -> DataFrame:
    files = _files(t)
    new = files.select((F.col("file") + F.when(F.col("file") % 2 == 0, 10**9).otherwise(0)).alias("file"))
    return SE.state(SE.remove(SE.register(files, new), files.where("file % 5 = 0").select("file"))[0])


@query(f"SELECT c_custkey AS file, s IN ('queued', 'cancelled') AS by_default, s <> 'processing' AND c_custkey % 4 = 0 AS wanted, CASE WHEN s IN ('queued', 'cancelled') THEN 'queued' ELSE s END AS status, s NOT IN ('queued', 'cancelled') AS keeps_output FROM (SELECT c_custkey, {_STATE_SQL} AS s FROM customer)")
def session_queue(t: Tables) -> DataFrame:
    files = _files(t)
    both = SE.enqueue(files).select("file", F.col("queued").alias("by_default"), "status", F.col("output").isNotNull().alias("keeps_output"))
    return both.join(SE.enqueue(files, files.where("file % 4 = 0")).select("file", F.col("queued").alias("wanted")), "file")


@query(f"SELECT c_custkey AS file, CASE WHEN s IN ('confirmed', 'exported') AND c_custkey % 5 < 2 THEN 'exported' ELSE s END AS status, CASE WHEN c_custkey % 5 = 2 THEN 'disk' END AS error FROM (SELECT c_custkey, {_STATE_SQL} AS s FROM customer)")
def session_export(t: Tables) -> DataFrame:
    results = t("customer").where("c_custkey % 5 < 3").select(F.col("c_custkey").alias("file"), F.when(F.col("c_custkey") % 5 < 2, "out").alias("output"), F.when(F.col("c_custkey") % 5 == 2, "disk").alias("error"))
    return SE.exported(_files(t), results).select("file", "status", "error")


@query("SELECT file, sum(n) AS findings, max(n) FILTER (k = 1) AS of_first_page FROM (SELECT file, page, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY page) AS k FROM {syn_finding} GROUP BY file, page) GROUP BY file")
def session_record(t: Tables) -> DataFrame:
    f = t("syn_finding")
    records = SE.nested(f.select("file").distinct(), f)
    own = records.select("file", F.from_json("record", "file bigint, findings array<struct<page: int>>").alias("r"))
    first = F.filter("r.findings", lambda x: x["page"] == F.col("r.findings")[0]["page"])
    return own.select("file", F.size("r.findings").cast("long").alias("findings"), F.size(first).cast("long").alias("of_first_page"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = c_custkey % 5 THEN 'current' ELSE 'update' END WHEN c_custkey % 7 < 3 AND c_custkey % 4 <> c_custkey % 5 THEN 'load' END AS action FROM customer")
def viewer_change(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select(k.alias("id"), SE.after_change(F.when(k % 2 == 0, k % 3), k % 7 < 3, k % 4, k % 5).alias("action"))


@query("""SELECT id, CASE WHEN h IN (0, 1) THEN least(greatest(x + dx, 0), greatest(0, x1 - 1)) ELSE x END AS x, CASE WHEN h IN (2, 3) THEN greatest(least(x1 + dx, 100), least(100, x + 1)) ELSE x1 END AS x1,
CASE WHEN h IN (1, 4) THEN least(greatest(y + dy, 0), greatest(0, y1 - 1)) ELSE y END AS y, CASE WHEN h IN (2, 5) THEN greatest(least(y1 + dy, 80), least(80, y + 1)) ELSE y1 END AS y1
FROM (SELECT l_orderkey AS id, l_orderkey % 6 AS h, CAST(l_partkey % 90 AS DOUBLE) AS x, CAST(l_suppkey % 70 AS DOUBLE) AS y, CAST(l_partkey % 90 + 10 AS DOUBLE) AS x1, CAST(l_suppkey % 70 + 8 AS DOUBLE) AS y1, CAST(l_partkey % 61 - 30 AS DOUBLE) AS dx, CAST(l_suppkey % 41 - 20 AS DOUBLE) AS dy FROM lineitem)""")
def resize_rectangle(t: Tables) -> DataFrame:
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    d = lambda c: c.cast("double")
    r = F.struct(d(p % 90).alias("x"), d(s % 70).alias("y"), F.lit(10.0).alias("w"), F.lit(8.0).alias("h"))
    handle = F.element_at(F.array(*map(F.lit, ["w", "nw", "se", "e", "n", "s"])), (k % 6 + 1).cast("int"))
    out = t("lineitem").select(k.alias("id"), SE.resize_rect(r, handle, d(p % 61 - 30), d(s % 41 - 20), F.lit(100.0), F.lit(80.0)).alias("r"))
    return out.select("id", "r.x", (F.col("r.x") + F.col("r.w")).alias("x1"), "r.y", (F.col("r.y") + F.col("r.h")).alias("y1"))


@query("SELECT c_custkey AS file, c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS unread FROM customer")
def unread_images(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    files = t("customer").select(k.alias("file"), (k % 2 == 1).alias("ocr"), F.when(k % 3 == 0, "image").otherwise("pdf").alias("kind"))
    pages = t("customer").select(k.alias("file"), F.explode(F.array(F.lit(False), k % 5 == 0)).alias("scanned"))
    return SE.unread_images(pages, files)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'Tiempo de análisis: ' || CAST(10 + c_custkey % 50 AS VARCHAR) || ' s' || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' (rostros 0,5 s)' ELSE ' (texto menos de 0,1 s · rostros 0,5 s)' END || '.' END AS text FROM customer")
def timing_texts(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    every = F.map_from_arrays(F.array(*map(F.lit, ["faces", "text", "analyze"])), F.array(F.lit(0.5), F.lit(0.01), (10 + k % 50).cast("double")))
    timings = F.map_filter(every, lambda s, _: F.when(s == "faces", (k % 4).isin(1, 2)).when(s == "text", k % 4 == 2).otherwise(k % 4 != 3))
    return t("customer").select(k.alias("id"), SE.timing_text(timings).alias("text"))


@query("SELECT id, status NOT IN ('removed', 'suggested') AS redacted, id % 2 = 0 AS text_layer FROM {syn_finding}")
def redaction_rows(t: Tables) -> DataFrame:
    f = t("syn_finding").withColumns({"polygon": G.rect_polygon(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1), "detector": F.when(F.col("id") % 4 == 2, "regex").otherwise("face"), "value": F.col("id").cast("string"), "score": F.lit(1.0)})
    own = SE.redactions(f).select(F.col("text").cast("bigint").alias("id"), (F.col("status") == "redact").alias("redacted"))
    layer = f.select("id", SE.from_text_layer(F.when(F.col("id") % 4 == 0, "text").when(F.col("id") % 2 == 1, "ocr"), F.col("detector")).alias("text_layer"))
    return own.join(layer, "id")


@query("SELECT p_partkey AS k, sha256(p_name) AS sha256, p_size AS elements FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0")
def manifest_add(t: Tables) -> DataFrame:
    p = t("part")
    known = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("id"))
    new = p.unionByName(p.where("p_partkey % 7 = 0")).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").cast("binary").alias("content"), F.sequence(F.lit(1), F.col("p_size").cast("int")).alias("elements"))
    added, _ = SE.add_files(known, new)
    return added.select(F.col("id").cast("bigint").alias("k"), "sha256", F.regexp_extract(F.element_at("elements", -1)["id"], "([1-9][0-9]*)$", 1).cast("bigint").alias("elements"))


@query("SELECT event_type AS system, count(DISTINCT user_id % 40) AS names, sum(v) AS total FROM (SELECT event_type, user_id % 40 AS user_id, arg_max(event_id, event_id) AS v FROM events GROUP BY event_type, user_id % 40) GROUP BY event_type")
def run_details(t: Tables) -> DataFrame:
    own = t("events").select(F.col("event_type").alias("system"), (F.col("user_id") % 40).cast("string").alias("name"), F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    d = SE.run_details(own)
    return d.select("system", F.size("details").cast("long").alias("names"), F.aggregate(F.map_values("details"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT c_custkey AS id, CAST(c_custkey % 28 + 1 AS VARCHAR) || ' de ' || (['" + "', '".join(T.MONTHS) + "'])[(c_custkey // 28) % 12 + 1] || ' de 2026' AS date, CAST(c_custkey % 9900 + 100 AS VARCHAR) || '/' || CASE WHEN c_custkey % 2 = 0 THEN '2026' ELSE '2025' END AS folio FROM customer")
def decoys(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), T.decoy_date("c_custkey").alias("date"), T.decoy_folio("c_custkey").alias("folio"))


# ---- bytes of images ------------------------------------------------------------------------------------------------


def _image_bytes(name: Column) -> Column:
    """A PNG with a text chunk, a JPEG with a comment, or a WebP with an XMP chunk, by the customer's number."""
    raw = F.encode(name, "UTF-8")
    hexed = F.hex(raw)
    size = F.length(raw)
    wide = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    png = F.concat(F.lit("89504E470D0A1A0A"), wide(size + 7, 8), F.lit("74455874" + b"Author\0".hex()), hexed, F.lit("00000000" + "00000000" + "49454E44" + "AE426082"))
    jpeg = F.concat(F.lit("FFD8FFFE"), wide(size + 2, 4), hexed, F.lit("FFD9"))
    webp = F.concat(F.lit("52494646"), wide(size + size % 2 + 12, 2), F.lit("000000" + "57454250" + "584D5020"), wide(size, 2), F.lit("000000"), hexed, F.when(size % 2 == 1, "00").otherwise(""))
    k = F.col("c_custkey") % 3
    return F.unhex(F.when(k == 0, png).when(k == 1, jpeg).otherwise(webp))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'png.text.Author' WHEN 1 THEN 'com' ELSE 'xmp' END AS location, c_name AS text, CASE c_custkey % 3 WHEN 0 THEN 'png.text.author' WHEN 1 THEN 'com' ELSE 'xmp' END AS structures FROM customer")
def image_metadata(t: Tables) -> DataFrame:
    own = t("customer").select(F.col("c_custkey").alias("id"), MD.image_metadata(_image_bytes(F.col("c_name"))).alias("m"))
    return own.select("id", F.explode("m.texts").alias("x"), F.array_join("m.structures", ",").alias("structures")).select("id", "x.location", "x.text", "structures")
