"""Steps that grew with the square of a page or a group: right where rows repeat, and within seconds where they are many."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import geometry as G
from veilspark.functions import spans as S
from veilspark.operators import checks as CH
from veilspark.operators import detect as D
from veilspark.operators import estimate as EST
from veilspark.operators import merge as M
from veilspark.operators import names as N
from veilspark.operators import signatures as SIG
from veilspark.plans import catalog
from veilspark.plans.packaging import ship

BOX = "id int, page int, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def within(seconds, run):
    began = time.monotonic()
    out = run()
    assert time.monotonic() - began < seconds
    return out


def test_repeated_entries_match_once(spark):
    names = spark.range(40000).selectExpr("'Ana Soto' as entry")
    texts = spark.range(5000).selectExpr("id", "'ver Ana Soto, fin' as text")
    assert within(20, lambda: N.list_matches(texts, ["id"], "text", names).count()) == 5000


@pytest.mark.parametrize("most", [50_000, 5])
def test_boxes_that_all_meet_are_one_component(spark, most, monkeypatch):
    monkeypatch.setattr(M, "PAGE_BOXES", most)
    rows = spark.range(8000).selectExpr("cast(id as int) as id", "1 as page", "cast(id % 90 as double) as x0", "0D as y0", "cast(id % 90 + 30 as double) as x1", "20D as y1")
    assert {x.component for x in within(30, lambda: M.box_components(rows, ["page"]).collect())} == {0}


@pytest.mark.parametrize("most", [50_000, 3, 0])
def test_components_keep_every_row(spark, most, monkeypatch):
    """Boxes over many cells, repeated rows, and rows without a place or a page."""
    monkeypatch.setattr(M, "PAGE_BOXES", most)
    rows = [(5, 1, 0.0, 0.0, 900.0, 4.0), (3, 1, 890.0, 0.0, 990.0, 4.0), (3, 1, 890.0, 0.0, 990.0, 4.0), (9, 1, 0.0, 700.0, 5.0, 704.0), (1, 1, None, 0.0, 9.0, 4.0), (2, None, 0.0, 0.0, 9.0, 4.0), (4, 2, 0.0, 0.0, 9.0, 4.0)]
    found = sorted((x.id, x.component) for x in M.box_components(spark.createDataFrame(rows, BOX), ["page"]).collect())
    assert found == [(1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 3), (9, 9)]


@pytest.mark.parametrize("fold", [M.fixpoint_boxes, M.dedup_zones])
def test_many_zones_of_one_page(spark, fold):
    rows = spark.range(8000).selectExpr(
        "cast(id as int) as id", "1 as page", "id % 100 * 20D as x0", "id div 100 * 20D as y0", "id % 100 * 20D + 15 as x1", "id div 100 * 20D + 15 as y1",
        "'rut' as type", "1D as score", "true as doubt", "true as optional",
    )
    assert within(20, lambda: fold(rows, ["page"]).count()) == 8000


def test_zones_wide_or_without_place(spark):
    rows = [(0, 1, 0.0, 0.0, 1e7, 1e7), (1, 1, 5.0, 5.0, 9.0, 9.0), (2, 1, None, 0.0, 9.0, 9.0), (3, 1, 1e6, 1e6, 1e6 + 1, 1e6 + 1)]
    df = spark.createDataFrame([(*x, 0.5, True) for x in rows], BOX + ", score double, doubt boolean")
    assert sorted(str(x.x1) for x in M.fixpoint_boxes(df, ["page"]).collect()) == ["10000000.0", "9.0"]


def test_pairs_of_equal_turned_and_upright_zones(spark):
    r = random.Random(14)
    rows = []
    for i in range(120):
        x, y, w, h = r.randint(0, 150), r.randint(0, 150), r.choice([5, 30]), r.choice([5, 20])
        turned = [(x + w / 2, y), (x + w, y + h / 2), (x + w / 2, y + h), (x, y + h / 2)]
        rows.append((i, 1, turned if i % 5 == 0 else [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
    rows += [(1000 + i, p, q) for i, p, q in rows[:20]]
    df = spark.createDataFrame([(i, p, [{"x": float(a), "y": float(b)} for a, b in q]) for i, p, q in rows], "id int, page int, polygon array<struct<x: double, y: double>>")
    found = {(x.id_a, x.id_b): round(x.overlap, 9) for x in M.overlap_pairs(df, ["page"]).collect()}
    want = {}
    for a, _, p in rows:
        for b, _, q in rows:
            e, f = ((min(v[0] for v in z), min(v[1] for v in z), max(v[0] for v in z), max(v[1] for v in z)) for z in (p, q))
            if a < b and e[0] < f[2] and f[0] < e[2] and e[1] < f[3] and f[1] < e[3]:
                h, k = M._hull(p), M._hull(q)
                cut = M._poly_cut(h, k)
                want[a, b] = round(M._poly_area(cut) / min(M._poly_area(h), M._poly_area(k)) if len(cut) > 2 else 0.0, 9)
    assert found == want


@pytest.mark.parametrize("name", ["glyph_cover", "over_redaction_anti"])
def test_rows_are_not_told_apart_by_numbers(spark, name):
    """A number given in the order in which rows arrive is another one when rows are computed twice."""
    assert "monotonically" not in optimized(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_pairs_of_regions_and_lines_come_once(spark):
    regions = spark.createDataFrame([(7, 1, 0.0, 0.0, 9.0, 9.0), (7, 1, 2.0, 0.0, 9.0, 9.0), (8, 1, 0.0, 0.0, 9.0, 9.0), (6, 1, 900.0, 0.0, 909.0, 9.0)], BOX.replace("id", "region"))
    lines = spark.createDataFrame([(3, 1, 5.0, 0.0, 25.0, 9.0), (3, 1, 5.0, 0.0, 25.0, 9.0), (4, 1, 5.0, 0.0, 25.0, 9.0), (5, 2, 5.0, 0.0, 25.0, 9.0)], BOX.replace("id", "line"))
    assert sorted(tuple(x) for x in SIG.within_reach(regions, lines, ["page"]).collect()) == [(1, 7, 3), (1, 7, 4), (1, 8, 3), (1, 8, 4)]


def test_equal_strokes_and_elements(spark):
    polygon = G.rect_polygon(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    elements = spark.range(8000).select(F.lit(1).alias("page"), F.col("id").alias("element"), polygon.alias("polygon"))
    points = spark.range(8000).selectExpr("1 as page", "cast(id % 2 * 20 + 5 as double) as x", "5D as y")
    found = within(20, lambda: CH.strokes_left(elements, points, ["page"]).collect())
    assert len(found) == 8000 and {x.points for x in found} == {4000}


def test_stages_are_summed_where_the_profile_is(spark):
    profile = spark.createDataFrame([(1, "pdf", 3, 1, 2, 1, 0, 0.5, 0.0, 0, 0.0), (1, "pdf", 3, 1, 2, 1, 0, 0.5, 0.0, 0, 0.0)], "file int, kind string, pages int, scanned_pages int, raster_pages int, regions int, drawn_regions int, regions_mp double, drawn_regions_mp double, frames int, megapixels double")
    out = EST.stages(EST.units(profile), EST.rates(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file#\d+, stage", plan)
    assert {x.stage: round(x.seconds, 3) for x in out.collect()}["text"] == 0.45


def test_variant_is_made_once(spark):
    df = spark.createDataFrame([(1, "RUT 12.345.678-S y 1I.lll.lll-1")], "id int, text string")
    assert optimized(D.detect(df, ["id"], "text", S.Detect(ocr=True))).count("OoDQlI") == 1
