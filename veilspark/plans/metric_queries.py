"""Queries on evaluation metrics, summaries, order, review and the cost model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dimensions as DIM
from ..operators import estimate as EST
from ..operators import evaluate as E
from ..operators import redact as R
from ..operators import review as V
from .catalog import Tables, query

_COUNTS = "count(*) AS n, count(*) FILTER (detected) AS detected, round(count(*) FILTER (detected) / count(*), 4) AS recall, count(*) FILTER (leak) AS leaks, round(count(*) FILTER (leak) / nullif(count(leak), 0), 4) AS leak_share, count(*) FILTER (leak IS NULL) AS not_processed"


@query(f"SELECT type, level, {_COUNTS} FROM {{syn_eval}} GROUP BY type, level")
def recall_by_type_level(t: Tables) -> DataFrame:
    return E.recall_by(t("syn_eval"), "type", "level")


@query(f"SELECT type, level, layer, category, CAST(grouping(type, level, layer, category) AS BIGINT) AS level_of, {_COUNTS} FROM {{syn_eval}} GROUP BY GROUPING SETS ((type), (level), (layer), (category), (type, level), ())")
def recall_grouping_sets(t: Tables) -> DataFrame:
    return E.recall_sets(t("syn_eval"), [["type"], ["level"], ["layer"], ["category"], ["type", "level"], []])


@query(f"SELECT type, layer, {_COUNTS} FROM {{syn_eval}} GROUP BY CUBE (type, layer)")
def recall_cube(t: Tables) -> DataFrame:
    return t("syn_eval").cube("type", "layer").agg(*E.counts())


@query(f"SELECT CASE WHEN height < 8 THEN '<8px' WHEN height < 16 THEN '8-16px' WHEN height < 32 THEN '16-32px' ELSE '>=32px' END AS bin, {_COUNTS} FROM {{syn_eval}} GROUP BY 1")
def recall_bins(t: Tables) -> DataFrame:
    return t("syn_eval").groupBy(E.bins(F.col("height"), [8, 16, 32], "px").alias("bin")).agg(*E.counts())


@query("SELECT category, count(seconds) AS n, round(quantile_cont(seconds, 0.5), 4) AS p50, round(quantile_cont(seconds, 0.95), 4) AS p95, round(max(seconds), 4) AS max FROM {syn_eval} GROUP BY category")
def time_percentiles(t: Tables) -> DataFrame:
    return E.stats(t("syn_eval"), ["category"], "seconds")


@query("SELECT file, id, type, CASE WHEN type = 'face' THEN CASE WHEN core IS NULL THEN coverage >= 0.9 ELSE core >= 0.95 AND coverage >= 0.8 END ELSE coverage >= 0.95 END AS found FROM {syn_eval}")
def element_detected(t: Tables) -> DataFrame:
    return t("syn_eval").select("file", "id", "type", E.detected(F.col("type"), F.col("coverage"), F.col("core")).alias("found"))


@query("SELECT file, id, CASE WHEN layer = 'raster' OR NOT detected OR coalesce(leak, false) THEN 'leak' WHEN leak IS NULL THEN 'unknown' ELSE 'ok' END AS status, CASE WHEN layer = 'raster' THEN CASE WHEN detected THEN 'pixels' ELSE 'coverage;pixels' END WHEN NOT detected AND coalesce(leak, false) THEN 'coverage;text' WHEN NOT detected THEN 'coverage' WHEN coalesce(leak, false) THEN 'text' ELSE '' END AS failed FROM {syn_eval}")
def element_checks(t: Tables) -> DataFrame:
    checks = E.element_checks(F.col("layer"), {"coverage": F.col("detected"), "text": ~F.col("leak"), "pixels": F.lit(False)})
    own = t("syn_eval").withColumn("c", checks)
    return own.select("file", "id", E.element_status(F.col("c")).alias("status"), F.array_join(E.failures(F.col("c")), ";").alias("failed"))


@query("""SELECT 'critical_leaks' AS criterion, count(*) FILTER (level = 'base' AND type IN ('rut', 'email') AND leak) AS failures, count(*) FILTER (level = 'base' AND type IN ('rut', 'email') AND leak) = 0 AS passed FROM {syn_eval}
UNION ALL SELECT 'not_processed', count(*) FILTER (level = 'base' AND leak IS NULL), count(*) FILTER (level = 'base' AND leak IS NULL) = 0 FROM {syn_eval}
UNION ALL SELECT 'metadata_leaks', count(*), count(*) = 0 FROM labels WHERE toxic = 1 UNION ALL SELECT 'rejections', count(*), count(*) = 0 FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'timings', 0, true""")
def verdict(t: Tables) -> DataFrame:
    files = t("customer").select(F.when(F.col("c_custkey") % 9 == 0, "wrong_code").otherwise("processed").alias("status"), F.lit(1.0).alias("seconds"))
    return E.verdict(t("syn_eval"), files, t("labels").select((F.col("toxic") == 1).alias("leak")))


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'rejected_as_expected' WHEN 1 THEN 'wrong_code' WHEN 2 THEN 'not_rejected' WHEN 3 THEN 'error' WHEN 4 THEN 'missing' ELSE 'processed' END AS status FROM customer")
def file_status(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 6
    expected = F.when(k < 3, "error:password").otherwise("process")
    error = F.when(k == 0, "Password: x").when(k.isin(1, 3), "corrupt: y")
    return t("customer").select(F.col("c_custkey").alias("id"), E.file_eval(expected, error, k != 4).alias("status"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'mirrored' WHEN 1 THEN CAST(c_custkey % 360 AS VARCHAR) ELSE '0' END AS angle, CASE c_custkey % 4 WHEN 2 THEN 'blur+noise' WHEN 3 THEN 'blur' ELSE 'none' END AS degradation FROM customer")
def tag_classes(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    tags = F.when(k % 4 == 0, F.create_map(F.lit("mirrored"), F.lit("true"))).when(k % 4 == 1, F.create_map(F.lit("angle"), (k - 720 * 3).cast("string"))).when(k % 4 == 2, F.create_map(F.lit("noise"), F.lit("1"), F.lit("blur"), F.lit("2"))).otherwise(F.create_map(F.lit("blur"), F.lit("2")))
    return t("customer").withColumn("tags", tags).select(k.alias("id"), E.angle("tags").alias("angle"), E.degradation("tags", ["blur", "noise"]).alias("degradation"))


@query("WITH n AS (SELECT id AS seq, id % 400 AS file, CAST((id * 7) % 900 AS VARCHAR) AS norm FROM {syn_rut}), f AS (SELECT *, first_value(file) OVER (PARTITION BY norm ORDER BY seq) AS first_file FROM n) SELECT DISTINCT norm, file, first_file FROM f WHERE file <> first_file")
def manifest_validate_duplicates(t: Tables) -> DataFrame:
    own = t("syn_rut").select(F.col("id").alias("seq"), (F.col("id") % 400).alias("file"), F.lit("rut").alias("type"), ((F.col("id") * 7) % 900).cast("string").alias("value"))
    return E.duplicate_values(own).select("norm", "file", "first_file")


@query("SELECT l_returnflag AS mode, round(count(*) FILTER (abs(v - m) <= 8) / count(*), 4) AS share FROM (SELECT l_returnflag, l_suppkey % 50 AS v, m FROM lineitem JOIN (SELECT mode_ AS l_returnflag, v AS m FROM (SELECT l_returnflag AS mode_, l_suppkey % 50 AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey % 50) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1) USING (l_returnflag)) GROUP BY 1")
def pixel_uniformity(t: Tables) -> DataFrame:
    return E.uniform_share(t("lineitem").select(F.col("l_returnflag").alias("mode"), (F.col("l_suppkey") % 50).alias("value")), ["mode"])


@query("SELECT l_returnflag AS mode, round(corr(l_quantity, l_extendedprice), 4) AS corr FROM lineitem GROUP BY 1")
def pixel_correlation(t: Tables) -> DataFrame:
    return E.correlation(t("lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("before"), F.col("l_extendedprice").alias("after")), ["mode"])


@query("SELECT quality, toxic, count(*) AS docs, round(avg(n_chars), 4) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def label_flags(t: Tables) -> DataFrame:
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 4).alias("chars"))


# ---- summaries and audit --------------------------------------------------------------------------------------------

_ACT = "status NOT IN ('removed', 'suggested')"


@query(f"SELECT file, count(*) FILTER ({_ACT}) AS total, count(*) FILTER (doubtful AND {_ACT}) AS doubtful, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'suggested') AS suggested, count(*) FILTER (status = 'suggested' AND optional_reason = 'url') AS suggested_url, count(*) FILTER (status = 'suggested' AND optional_reason = 'rut') AS suggested_rut FROM {{syn_finding}} GROUP BY file")
def file_summary(t: Tables) -> DataFrame:
    return V.summary(t("syn_finding"))


@query(f"SELECT file, 'f' || CAST(file AS VARCHAR) AS name, sum(n) AS active, count(*) AS types FROM (SELECT file, type, count(*) AS n FROM {{syn_finding}} WHERE {_ACT} GROUP BY file, type) GROUP BY file")
def audit_json_counts(t: Tables) -> DataFrame:
    own = t("syn_finding").withColumn("value", F.lit("secreto"))
    files = own.select("file").distinct().withColumn("name", F.concat(F.lit("f"), F.col("file").cast("string")))
    records = R.audit_records(files, own, files.select("file", F.lit(True).alias("exported")))
    parsed = F.from_json("record", "name string, by_type map<string,bigint>")
    out = records.select("file", parsed.alias("r")).where("r.by_type is not null")
    return out.select("file", "r.name", F.aggregate(F.map_values("r.by_type"), F.lit(0).cast("long"), lambda a, x: a + x).alias("active"), F.size("r.by_type").alias("types"))


@query(f"SELECT file, count(*) FILTER ({_ACT}) AS applied, count(*) FILTER (NOT ({_ACT})) AS left_visible FROM {{syn_finding}} WHERE optional GROUP BY file")
def optional_record(t: Tables) -> DataFrame:
    active = V.is_active(F.col("status"))
    return t("syn_finding").where("optional").groupBy("file").agg(F.count_if(active).alias("applied"), F.count_if(~active).alias("left_visible"))


@query(f"SELECT p.file, p.page, count(f.id) FILTER ({_ACT}) AS zones FROM (SELECT DISTINCT file, page FROM {{syn_finding}}) p LEFT JOIN {{syn_finding}} f ON p.file = f.file AND p.page = f.page GROUP BY p.file, p.page")
def zone_counts(t: Tables) -> DataFrame:
    return V.zone_counts(t("syn_finding"), t("syn_finding"))


@query(f"SELECT file, page, sha256(string_agg(s, ';' ORDER BY s)) AS version FROM (SELECT file, page, CAST(id AS VARCHAR) || '|' || type || '|' || CAST(x AS VARCHAR) || '|' || CAST(y AS VARCHAR) AS s FROM {{syn_finding}} WHERE {_ACT}) GROUP BY file, page")
def page_versions(t: Tables) -> DataFrame:
    return V.page_versions(t("syn_finding"))


# ---- order ----------------------------------------------------------------------------------------------------------


@query("SELECT id, row_number() OVER w AS place, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM {syn_finding} WHERE type <> 'url' WINDOW w AS (PARTITION BY file ORDER BY CASE WHEN optional THEN 2 WHEN doubtful THEN 0 ELSE 1 END, page, floor(y + 0.5), floor(x + 0.5), id)")
def review_order(t: Tables) -> DataFrame:
    return V.ordered(t("syn_finding"), ["url"]).select("id", "place", "previous_id", "next_id")


@query("SELECT file, row FROM (SELECT file, id AS row, row_number() OVER (PARTITION BY file ORDER BY greatest(y - 60, 60 - (y + 4), 0), id) AS k FROM {syn_finding}) WHERE k = 1")
def nearest_row(t: Tables) -> DataFrame:
    rows = t("syn_finding").select("file", F.col("id").alias("row"), F.col("y").alias("y0"), (F.col("y") + 4).alias("y1"))
    return V.nearest_row(rows, ["file"], F.lit(60.0))


@query("SELECT id FROM (SELECT id, coalesce(sum(mp) OVER (PARTITION BY file ORDER BY y DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(mp) OVER (PARTITION BY file) AS total FROM (SELECT id, file, y, id % 7 + 1 AS mp FROM {syn_finding})) WHERE total - before > 150")
def release_budget(t: Tables) -> DataFrame:
    own = t("syn_finding").select("file", F.col("id").alias("row"), F.col("y").alias("dist"), (F.col("id") % 7 + 1).alias("mp"))
    return V.release_plan(own, ["file"], 150).select(F.col("row").alias("id"))


@query("SELECT id, row_number() OVER (PARTITION BY file ORDER BY CASE type WHEN 'name' THEN 0 WHEN 'rut' THEN 1 ELSE 2 END, doubtful DESC, abs(page - 2), page < 2, id) AS turn FROM {syn_finding}")
def plan_queue(t: Tables) -> DataFrame:
    own = t("syn_finding").select("file", F.col("id").alias("job"), F.when(F.col("type") == "name", "page").when(F.col("type") == "rut", "after").otherwise("thumb").alias("kind"), F.col("doubtful").alias("in_view"), F.col("page").alias("row"), F.lit(2).alias("centre"))
    return V.plan_queue(own, "centre", ["file"]).select(F.col("job").alias("id"), "turn")


@query()
def label_places(t: Tables) -> DataFrame:
    return V.place_labels(t("syn_finding").select("file", "page", "id", "x", "y"), ["file", "page"])


# ---- review ---------------------------------------------------------------------------------------------------------


def _reviewed(t: Tables) -> DataFrame:
    ids = t("events").select((F.col("user_id") % 500).alias("id")).distinct()
    return ids.select("id", F.when(F.col("id") % 3 == 0, "suggested").otherwise("proposed").alias("status"), (F.col("id") % 3 == 0).alias("optional"), F.when(F.col("id") % 7 == 0, "added").otherwise("proposed").alias("first_action"))


@query("""WITH RECURSIVE a AS (SELECT id, action, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS k FROM {syn_action}),
s AS (SELECT id, 0::BIGINT AS k, CASE WHEN id % 3 = 0 THEN 'suggested' ELSE 'proposed' END AS status, 0 AS applied, 0 AS refused FROM (SELECT DISTINCT id FROM a)
UNION ALL SELECT s.id, a.k, coalesce(n.new, s.status), s.applied + CASE WHEN n.new IS NULL THEN 0 ELSE 1 END, s.refused + CASE WHEN n.new IS NULL THEN 1 ELSE 0 END FROM s JOIN a ON a.id = s.id AND a.k = s.k + 1,
LATERAL (SELECT CASE WHEN a.action = 'remove' AND s.id % 3 <> 0 AND s.status NOT IN ('removed', 'suggested') THEN 'removed' WHEN a.action = 'restore' AND s.status = 'removed' THEN CASE WHEN s.id % 7 = 0 THEN 'added' ELSE 'proposed' END
WHEN a.action = 'apply' AND s.id % 3 = 0 AND s.status = 'suggested' THEN 'proposed' WHEN a.action = 'skip' AND s.id % 3 = 0 AND s.status = 'proposed' THEN 'suggested' WHEN a.action = 'resize' AND s.status NOT IN ('removed', 'suggested') THEN s.status END AS new) n)
SELECT id, last(status ORDER BY k) AS status, max(applied) AS applied, max(refused) AS refused FROM s GROUP BY id""")
def review_fold(t: Tables) -> DataFrame:
    return V.fold_actions(_reviewed(t), t("syn_action"))


@query("SELECT file, count(*) AS applied FROM {syn_finding} WHERE optional AND status = 'suggested' AND optional_reason = 'url' GROUP BY file")
def apply_optional(t: Tables) -> DataFrame:
    own = t("syn_finding").withColumn("history", F.array(F.struct(F.lit("t0").alias("at"), F.lit("suggested").alias("action"))))
    done = V.apply_optional(own, "t1", "url")
    return done.where(R.last_action(F.col("history"), "applied").isNotNull()).groupBy("file").agg(F.count("*").alias("applied"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (2, 3, 4) THEN 'ready' END AS edit, CASE WHEN c_custkey % 5 = 2 THEN 'confirmed' END AS confirm, CASE WHEN c_custkey % 5 IN (3, 4) THEN 'exported' END AS export FROM customer")
def file_transitions(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["queued", "processing", "ready", "confirmed", "exported"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t("customer").select(F.col("c_custkey").alias("id"), *(V.file_status(status, e).alias(e) for e in ("edit", "confirm", "export")))


# ---- options and cost -----------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, true AS patterns, c_custkey % 2 = 0 AS faces, true AS ocr, least(5, greatest(1, c_custkey % 9)) AS level, round(least(0.95, greatest(0.2, 0.6 + CASE least(5, greatest(1, c_custkey % 9)) WHEN 1 THEN 0.2 WHEN 2 THEN 0.1 WHEN 3 THEN 0 WHEN 4 THEN -0.1 ELSE -0.2 END)), 3) AS threshold FROM customer")
def detection_options(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    given = F.create_map(F.lit("patterns"), F.lit(False), F.lit("faces"), k % 2 == 0, F.lit("unknown"), F.lit(True))
    own = t("customer").select(k.alias("id"), DIM.options(given, (k % 9).cast("int")).alias("o"))
    return own.select("id", "o.patterns", "o.faces", "o.ocr", "o.level", DIM.face_threshold(F.lit(0.6), F.col("o.level")).alias("threshold"))


def _profiles(t: Tables) -> DataFrame:
    return t("syn_profile")


_UNITS = """SELECT file, stage, unit, CAST(count AS DOUBLE) AS count FROM {syn_profile} p, LATERAL (VALUES ('text', 'pdf_page', CASE WHEN kind = 'pdf' THEN pages ELSE 0 END), ('render', 'raster_page', raster_pages), ('render', 'image_mp', megapixels),
('ocr', 'scanned_page', scanned_pages), ('ocr', 'region', regions + drawn_regions), ('ocr', 'region_mp', regions_mp + drawn_regions_mp), ('ocr', 'image_frame', frames), ('faces', 'scanned_page', scanned_pages), ('faces', 'region', regions), ('faces', 'image_mp', megapixels),
('signatures', 'pdf_page', CASE WHEN kind = 'pdf' THEN pages - scanned_pages ELSE 0 END), ('signatures', 'scanned_page', scanned_pages), ('signatures', 'region', regions), ('signatures', 'image_mp', megapixels), ('qr', 'raster_page', raster_pages), ('qr', 'image_mp', megapixels)) u(stage, unit, count)"""
_RATES = "(VALUES " + ", ".join(f"('{s}', '{u}', {r})" for s, own in EST.DEFAULT_RATES.items() for u, r in own.items()) + ") r(stage, unit, rate)"
_STAGES = f"SELECT file, stage, sum(rate * count) AS seconds FROM ({_UNITS}) w JOIN {_RATES} USING (stage, unit) GROUP BY file, stage"


@query(_UNITS)
def cost_units(t: Tables) -> DataFrame:
    return EST.units(_profiles(t))


@query(f"SELECT file, stage, round(seconds, 6) AS seconds FROM ({_STAGES})")
def cost_stages(t: Tables) -> DataFrame:
    return EST.stages(EST.units(_profiles(t)), EST.rates(t.spark)).select("file", "stage", F.round("seconds", 6).alias("seconds"))


@query(f"SELECT file, grp, round(coalesce(seconds, 0), 6) AS seconds FROM (SELECT c_custkey AS file FROM customer) f CROSS JOIN (VALUES ('patterns', 'text'), ('urls_personal', NULL), ('ocr', 'ocr'), ('faces', 'faces'), ('signatures', 'signatures'), ('qr', 'qr')) g(grp, stage) LEFT JOIN ({_STAGES}) s USING (file, stage)")
def cost_by_group(t: Tables) -> DataFrame:
    s = EST.stages(EST.units(_profiles(t)), EST.rates(t.spark))
    return EST.by_group(s, ["patterns", "urls_personal", "ocr", "faces", "signatures", "qr"]).select("file", "grp", F.round("seconds", 6).alias("seconds"))


@query(f"SELECT file, round(sum(seconds), 4) AS total FROM ({_STAGES}) WHERE stage IN ('text', 'faces', 'render') GROUP BY ROLLUP (file)")
def cost_totals(t: Tables) -> DataFrame:
    s = EST.stages(EST.units(_profiles(t)), EST.rates(t.spark))
    return EST.totals(s, ["patterns", "faces"]).select("file", F.round("total", 4).alias("total"))


@query("SELECT stage, unit, CASE WHEN saved BETWEEN 1e-5 AND 1e4 THEN saved ELSE rate END AS rate FROM " + _RATES + " LEFT JOIN (VALUES ('ocr', 'region', 2.5::DOUBLE), ('ocr', 'region_mp', -1.0), ('qr', 'image_mp', 1e9)) s(stage, unit, saved) USING (stage, unit)")
def cost_rates_valid(t: Tables) -> DataFrame:
    saved = t.spark.createDataFrame([("ocr", "region", 2.5), ("ocr", "region_mp", -1.0), ("qr", "image_mp", 1e9), ("faces", "region", float("nan"))], "stage string, unit string, saved double")
    return EST.valid_rates(saved, EST.rates(t.spark))


@query("SELECT stage, round(list_reduce(list_concat([1.0::DOUBLE], list(seconds / count ORDER BY ts, seq)), lambda r, x: least(1e4, greatest(1e-5, r * (1 + 0.3 * (least(5.0, greatest(0.2, x / r)) - 1))))), 6) AS rate, CAST(count(*) AS INT) AS samples FROM {syn_timing} GROUP BY stage")
def cost_ema_fold(t: Tables) -> DataFrame:
    return EST.learn(t("syn_timing"), ["stage"]).withColumn("rate", F.round("rate", 6))


@query("SELECT c_custkey AS seq, c_nationkey AS folder, CASE k WHEN 1 THEN 'doc.pdf' WHEN 2 THEN 'doc (2).pdf' WHEN 3 THEN 'doc (2) (2).pdf' WHEN 4 THEN 'doc (3).pdf' WHEN 5 THEN 'sin' WHEN 6 THEN 'sin (2)' WHEN 7 THEN 'doc (3) (2).pdf' ELSE 'doc (' || CAST(k - 4 AS VARCHAR) || ').pdf' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)")
def unique_names(t: Tables) -> DataFrame:
    """Names that clash with each other and with what numbering makes of others."""
    from ..sources.files import unique_names as unique

    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    own = t("customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("folder"), k.alias("k"))
    own = own.withColumn("name", F.when(F.col("k") == 3, "doc (2).pdf").when(F.col("k") == 7, "doc (3).pdf").when(F.col("k").isin(5, 6), "sin").otherwise("doc.pdf"))
    return unique(own, ["folder"]).select("seq", "folder", "unique_name")


@query("SELECT category, file, n FROM (SELECT category, file, n, rank() OVER (PARTITION BY category ORDER BY n DESC, file) AS r FROM (SELECT category, file, count(*) AS n FROM {syn_eval} WHERE leak GROUP BY category, file)) WHERE r <= 5")
def worst_files(t: Tables) -> DataFrame:
    n = t("syn_eval").where("leak").groupBy("category", "file").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.rank().over(Window.partitionBy("category").orderBy(F.desc("n"), "file"))).where("r <= 5").drop("r")
