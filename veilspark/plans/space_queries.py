"""Queries on boxes, polygons, clusters and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import context as C
from ..operators import evaluate as E
from ..operators import merge as M
from ..operators import redact as R
from ..operators import review as V
from .catalog import Tables, query

_OVER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_INTER = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def _polygon(t: Tables) -> DataFrame:
    return t("syn_box").withColumn("polygon", G.rect_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


@query("SELECT id, x0, y0, x1 + 3 AS x1, y1 + 3 AS y1, x0 + 3 AS px, y0 + 3 AS py FROM {syn_box}")
def bbox_of(t: Tables) -> DataFrame:
    shifted = G.transform("polygon", [F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(3.0), F.lit(3.0)])
    own = _polygon(t).withColumn("q", shifted).withColumn("b", G.bbox(F.concat("polygon", "q")))
    return own.select("id", "b.x0", "b.y0", "b.x1", "b.y1", F.col("q")[0]["x"].alias("px"), F.col("q")[0]["y"].alias("py"))


@query("SELECT id, (x1 - x0) * (y1 - y0) AS area, 1.0 AS fill, x1 - x0 AS length, y1 - y0 AS height FROM {syn_box}")
def polygon_area(t: Tables) -> DataFrame:
    own = _polygon(t).withColumn("f", G.line_frame("polygon"))
    return own.select("id", G.area("polygon").alias("area"), F.round(G.fill_ratio("polygon"), 6).alias("fill"), "f.length", "f.height")


@query("SELECT id, (x0 + x1) / 2 BETWEEN x0 AND x1 AS centre, false AS outside, x0 AS bx, y0 AS by FROM {syn_box}")
def point_in_polygon(t: Tables) -> DataFrame:
    mid = ((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    back = G.turn(G.turn_back("polygon", F.lit(1), F.lit(900.0), F.lit(700.0)), F.lit(1), F.lit(900.0), F.lit(700.0))
    return _polygon(t).select("id", G.contains_point("polygon", *mid).alias("centre"), G.contains_point("polygon", F.col("x1") + 1, mid[1]).alias("outside"), back[0]["x"].alias("bx"), back[0]["y"].alias("by"))


@query("SELECT id, 100.0 AS x, least(y0, 50.0) AS y, x0 <= 100 AND x1 >= 100 AND y0 <= 40 AS crossed FROM {syn_box}")
def clip_and_cross(t: Tables) -> DataFrame:
    held = G.clipped(F.array(G.point(F.col("x0") + 200, F.col("y0"))), F.lit(100.0), F.lit(50.0))[0]
    hit = G.segment_crosses(F.lit(100.0), F.lit(-5.0), F.lit(100.0), F.lit(40.0), G.box())
    return _polygon(t).select("id", held["x"].alias("x"), held["y"].alias("y"), hit.alias("crossed"))


@query(f"SELECT a.file, a.page, count(*) AS pairs, round(sum({_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER})), 4) AS iou FROM {{syn_box}} a JOIN {{syn_box}} b ON a.file = b.file AND a.page = b.page AND a.id < b.id AND {_OVER} GROUP BY a.file, a.page")
def box_iou_pairs(t: Tables) -> DataFrame:
    b = t("syn_box").select("id", "file", "page", "x0", "y0", "x1", "y1")
    n, m = F.size("ids_a").cast("long"), F.size("ids_b").cast("long")
    pairs = M.box_pairs(b, ["file", "page"], "id").withColumn("n", F.when(F.col("alike"), F.expr("cast(size(ids_a) as long) * (size(ids_a) - 1) div 2")).otherwise(n * m))
    return pairs.groupBy("file", "page").agg(F.sum("n").alias("pairs"), F.round(F.sum(F.col("n") * G.iou(G.box("_a"), G.box("_b"))), 4).alias("iou"))


@query(f"SELECT a.id AS zone, b.id AS target FROM (SELECT * FROM {{syn_box}} WHERE type = 'rut') a JOIN (SELECT * FROM {{syn_box}} WHERE type = 'name') b ON a.file = b.file AND a.page = b.page AND {_OVER}")
def grid_box_join(t: Tables) -> DataFrame:
    b = t("syn_box").select("id", "file", "page", "x0", "y0", "x1", "y1", "type")
    return M.box_join(b.where("type = 'rut'"), b.where("type = 'name'"), ["file", "page"]).select(F.col("id_a").alias("zone"), F.col("id_b").alias("target"))


@query(f"SELECT a.file, a.page, count(*) AS zones FROM (SELECT * FROM {{syn_box}} WHERE type = 'rut') a WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM {{syn_box}} WHERE type <> 'rut') b WHERE a.file = b.file AND a.page = b.page AND {_OVER}) GROUP BY a.file, a.page")
def over_redaction_anti(t: Tables) -> DataFrame:
    b = t("syn_box").select("file", "page", "x0", "y0", "x1", "y1", "type")
    return E.over_redaction(b.where("type = 'rut'").drop("type"), b.where("type <> 'rut'").drop("type"), ["file", "page"])


@query(f"""WITH RECURSIVE g AS (SELECT id, file, page, x0 - (y1 - y0) / 2 AS x0, y0 - (y1 - y0) / 2 AS y0, x1 + (y1 - y0) / 2 AS x1, y1 + (y1 - y0) / 2 AS y1 FROM {{syn_box}}),
l AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.file = b.file AND a.page = b.page AND a.id <> b.id AND {_OVER}),
c AS (SELECT id AS node, id AS root FROM g UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node)
SELECT node AS id, min(root) AS component FROM c GROUP BY node""")
def box_components(t: Tables) -> DataFrame:
    from ..plans.session import checkpoints

    checkpoints(t.spark)
    return M.box_components(t("syn_box").select("id", "file", "page", "x0", "y0", "x1", "y1"), ["file", "page"]).select("id", "component")


@query("SELECT file, page, x0, y0, x1, y1, min(CASE type WHEN 'rut' THEN 1 WHEN 'phone' THEN 3 WHEN 'name' THEN 5 WHEN 'signature' THEN 6 ELSE 7 END) AS rank, max(score) AS score, bool_and(doubt) AS doubt, bool_and(optional) AS optional, count(*) AS merged FROM {syn_box} GROUP BY file, page, x0, y0, x1, y1")
def same_polygon_merge(t: Tables) -> DataFrame:
    from ..functions.spans import rank

    out = M.same_polygon(t("syn_box"), ["file", "page"])
    return out.withColumn("rank", (rank(F.col("type"), M.MERGE_ORDER, 98) + 1).cast("int")).drop("type")


@query()
def face_box_fixpoint(t: Tables) -> DataFrame:
    return M.fixpoint_boxes(t("syn_box"), ["file", "page"])


@query()
def zone_merge_greedy(t: Tables) -> DataFrame:
    return M.dedup_zones(t("syn_box"), ["file", "page"])


@query()
def image_regions(t: Tables) -> DataFrame:
    return M.join_regions(t("syn_box"), ["file", "page"], margin=3.0, least=24.0)


@query(f"SELECT a.id AS id_a, b.id AS id_b, round({_INTER} / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 4) AS overlap FROM {{syn_box}} a JOIN {{syn_box}} b ON a.file = b.file AND a.page = b.page AND a.id < b.id AND {_OVER}")
def hull_pairs(t: Tables) -> DataFrame:
    return M.overlap_pairs(_polygon(t), ["file", "page"]).withColumn("overlap", F.floor(F.col("overlap") * 10000 + 0.5) / 10000)  # ties as the SQL's engine rounds them


@query("""WITH z AS (SELECT c_custkey AS id, CAST(c_custkey % 7 AS DOUBLE) AS d FROM customer)
SELECT id, round((100 - 10 * d + CASE WHEN d > 2 THEN 10 * (d - 2) ELSE 0 END) / 100, 4) AS coverage FROM z""")
def zone_coverage(t: Tables) -> DataFrame:
    """A target of 10 by 10 under two zones: one leaves the last d columns, the other covers the columns from 12 - d... on."""
    c = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).cast("double").alias("d"))
    target = c.select("id", F.col("id").alias("file"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"))
    left = c.select(F.col("id").alias("file"), F.lit(-1.0).alias("x0"), F.lit(-1.0).alias("y0"), (10 - F.col("d")).alias("x1"), F.lit(11.0).alias("y1"))
    right = c.where("d > 2").select(F.col("id").alias("file"), (12 - F.col("d")).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"))
    return M.coverage(target, left.unionByName(right), ["file"]).select("id", F.round("coverage", 4).alias("coverage"))


@query("""SELECT file, page, line, island, min(x0) - 1 AS x0, max(x1) + 1 AS x1, count(*) AS chars FROM (SELECT *, sum(CASE WHEN x0 - px1 > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY file, page, line ORDER BY pos, x0) AS island FROM (
  SELECT *, lag(x1) OVER (PARTITION BY file, page, line ORDER BY pos, x0) AS px1 FROM (SELECT l_orderkey AS file, 0 AS page, l_linestatus AS line, l_linenumber AS pos, CAST(l_linenumber * 10 + CASE WHEN l_linenumber > 3 THEN l_suppkey % 40 ELSE 0 END AS DOUBLE) AS x0, CAST(l_linenumber * 10 + CASE WHEN l_linenumber > 3 THEN l_suppkey % 40 ELSE 0 END + 8 AS DOUBLE) AS x1 FROM lineitem))) GROUP BY ALL""")
def zone_islands(t: Tables) -> DataFrame:
    x = F.col("l_linenumber") * 10 + F.when(F.col("l_linenumber") > 3, F.col("l_suppkey") % 40).otherwise(0)
    chars = t("lineitem").select(F.col("l_orderkey").alias("file"), F.lit(0).alias("page"), F.col("l_linestatus").alias("line"), F.col("l_linenumber").alias("pos"), x.cast("double").alias("x0"), (x + 8).cast("double").alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"))
    return M.char_islands(chars, ["file", "page"]).select("file", "page", "line", "island", "x0", "x1", "chars")


@query("SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 14 ELSE 10 END AS DOUBLE) AS y0, CAST(CASE WHEN id % 2 = 0 THEN 27 ELSE 30 END AS DOUBLE) AS y1 FROM (SELECT c_custkey AS id FROM customer)")
def neighbour_clip(t: Tables) -> DataFrame:
    span = lambda a, b: F.struct(F.lit(float(a)).alias("y0"), F.lit(float(b)).alias("y1"))
    others = F.array_compact(F.array(F.when(F.col("c_custkey") % 3 == 0, span(0, 14)), F.when(F.col("c_custkey") % 2 == 0, span(27, 40))))
    own = t("customer").select(F.col("c_custkey").alias("id"), M.clip_to_neighbours(F.lit(10.0), F.lit(30.0), others).alias("z"))
    return own.select("id", "z.y0", "z.y1")


@query(f"SELECT a.id AS zone, count(*) AS glyphs FROM (SELECT * FROM {{syn_box}} WHERE optional) a JOIN (SELECT * FROM {{syn_box}} WHERE NOT optional) b ON a.file = b.file AND a.page = b.page AND {_OVER} AND ((b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1 OR {_INTER} >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY a.id")
def glyphs_under(t: Tables) -> DataFrame:
    b = t("syn_box").select("id", "file", "page", "x0", "y0", "x1", "y1", "optional")
    return M.glyphs_under(b.where("optional"), b.where("not optional"), ["file", "page"]).groupBy(F.col("id_a").alias("zone")).agg(F.count("*").alias("glyphs"))


@query("SELECT id, CASE WHEN optional THEN 'skip' ELSE 'remove' END AS action FROM {syn_finding} WHERE status NOT IN ('removed', 'suggested') AND x < 50 AND x + 10 > 20 AND y < 60 AND y + 10 > 20")
def erase_rectangle(t: Tables) -> DataFrame:
    own = t("syn_finding").withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + 10, "y1": F.col("y") + 10})
    return V.erase_actions(own, {"x0": F.lit(20.0), "y0": F.lit(20.0), "x1": F.lit(50.0), "y1": F.lit(60.0)}).select("id", "action")


@query("SELECT file, page, count(*) FILTER (status NOT IN ('removed', 'suggested')) AS active, count(*) FILTER (status IN ('removed', 'suggested')) AS kept, count(*) FILTER (status = 'added') AS drawn FROM {syn_finding} GROUP BY file, page")
def zones_by_page(t: Tables) -> DataFrame:
    own = t("syn_finding").withColumn("polygon", G.rect_polygon(F.col("x"), F.col("y"), F.col("x") + 5, F.col("y") + 5))
    return R.split_zones(own).select("file", "page", *(F.size(c).alias(c) for c in ("active", "kept", "drawn")))


@query("SELECT file, xref, x0, y0, x1, y1, count(DISTINCT page) AS pages FROM (SELECT file, page, id % 3 AS xref, CAST(round(x0) AS INT) AS x0, CAST(round(y0) AS INT) AS y0, CAST(round(x1) AS INT) AS x1, CAST(round(y1) AS INT) AS y1 FROM {syn_box}) GROUP BY file, xref, x0, y0, x1, y1 HAVING count(DISTINCT page) >= 2")
def repeated_images(t: Tables) -> DataFrame:
    return C.repeated_images(t("syn_box").withColumn("xref", F.col("id") % 3))


@query("SELECT id, id % 3 <> 0 AS kept FROM (SELECT c_custkey AS id FROM customer)")
def page_geometry(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("file"), F.lit(0).alias("page"), F.lit("pt").alias("unit"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit(0).alias("rotation"))
    after = c.withColumns({"width": F.when(F.col("file") % 3 == 0, 600.0).when(F.col("file") % 3 == 1, 842.5).otherwise(595.0), "height": F.when(F.col("file") % 3 == 1, 595.0).otherwise(842.0), "rotation": F.when(F.col("file") % 3 == 1, 90).otherwise(0)})
    return E.geometry_kept(c, after).select(F.col("file").alias("id"), "kept")


@query("SELECT id, id % 2 = 0 AS inside FROM (SELECT c_custkey AS id FROM customer)")
def chars_within(t: Tables) -> DataFrame:
    box = lambda a, b: F.struct(a.alias("x0"), F.lit(0.0).alias("y0"), b.alias("x1"), F.lit(9.0).alias("y1"))
    chars = F.array(box(F.lit(0.0), F.lit(5.0)), box(F.when(F.col("c_custkey") % 2 == 0, 6.0).otherwise(60.0), F.when(F.col("c_custkey") % 2 == 0, 9.0).otherwise(69.0)))
    return t("customer").select(F.col("c_custkey").alias("id"), R.within(chars, F.array(box(F.lit(0.0), F.lit(20.0)))).alias("inside"))


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead AS DOUBLE[])), 4) AS cosine FROM (SELECT vec_id, embedding, lead(embedding) OVER (ORDER BY vec_id) AS lead FROM embeddings) WHERE lead IS NOT NULL")
def vector_neighbours(t: Tables) -> DataFrame:
    e = t("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("lead"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(nxt, "vec_id").select("vec_id", F.round(dot("embedding", "lead") / F.sqrt(dot("embedding", "embedding") * dot("lead", "lead")), 4).alias("cosine"))
