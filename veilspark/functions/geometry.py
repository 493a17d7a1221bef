"""Boxes and polygons as Column expressions. A polygon is array<struct<x: double, y: double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Str, col


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rect_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def bbox(polygon: Str) -> Column:
    p = col(polygon)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _edges(polygon: Column) -> Column:
    """(point, next point) all around."""
    return F.zip_with(polygon, F.concat(F.slice(polygon, F.lit(2), F.size(polygon) - 1), F.slice(polygon, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def area(polygon: Str) -> Column:
    cross = F.transform(_edges(col(polygon)), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def fill_ratio(polygon: Str) -> Column:
    b = bbox(polygon)
    return area(polygon) / F.greatest((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), F.lit(1e-9))


def contains_point(polygon: Str, x: Column, y: Column) -> Column:
    """Even-odd ray casting."""

    def crossed(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(_edges(col(polygon)), crossed)) % 2 == 1


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def box_area(a: dict[str, Column]) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    i = intersection(a, b)
    return i / F.greatest(box_area(a) + box_area(b) - i, F.lit(1e-9))


def inside_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller box."""
    return intersection(a, b) / F.greatest(F.least(box_area(a), box_area(b)), F.lit(1e-9))


def touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed boxes meet."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Open boxes meet."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def vertical_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), inter) / F.greatest(F.lit(1e-6), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))


def box(suffix: str = "", prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}{suffix}") for k in ("x0", "y0", "x1", "y1")}


def transform(polygon: Str, m: list[Column]) -> Column:
    """Affine map (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f."""
    return F.transform(col(polygon), lambda p: point(m[0] * p["x"] + m[2] * p["y"] + m[4], m[1] * p["x"] + m[3] * p["y"] + m[5]))


def scale(polygon: Str, k: Column) -> Column:
    return F.transform(col(polygon), lambda p: point(p["x"] * k, p["y"] * k))


def turn_back(polygon: Str, k: Column, w: Column, h: Column) -> Column:
    """Points of an image turned k quarter turns counter-clockwise, in the upright image of w by h."""
    return F.transform(
        col(polygon),
        lambda p: F.when(k % 4 == 0, point(p["x"], p["y"])).when(k % 4 == 1, point(w - p["y"], p["x"])).when(k % 4 == 2, point(w - p["x"], h - p["y"])).otherwise(point(p["y"], h - p["x"])),
    )


def turn(polygon: Str, k: Column, w: Column, h: Column) -> Column:
    """The inverse of ``turn_back``."""
    return F.transform(
        col(polygon),
        lambda p: F.when(k % 4 == 0, point(p["x"], p["y"])).when(k % 4 == 1, point(p["y"], w - p["x"])).when(k % 4 == 2, point(w - p["x"], h - p["y"])).otherwise(point(h - p["y"], p["x"])),
    )


def quad_height(polygon: Str) -> Column:
    """Height of a four-point zone whatever its rotation: the mean of its left and right sides."""
    p = col(polygon)
    side = lambda a, b: F.hypot(p[a]["x"] - p[b]["x"], p[a]["y"] - p[b]["y"])
    return (side(1, 2) + side(0, 3)) / 2


def line_frame(polygon: Str) -> Column:
    """struct(cx, cy, dx, dy, length, height) of a quad: centre, unit direction of its top side, sides."""
    p = col(polygon)
    cx = sum((p[i]["x"] for i in range(1, 4)), p[0]["x"]) / 4
    cy = sum((p[i]["y"] for i in range(1, 4)), p[0]["y"]) / 4
    length = (F.hypot(p[1]["x"] - p[0]["x"], p[1]["y"] - p[0]["y"]) + F.hypot(p[2]["x"] - p[3]["x"], p[2]["y"] - p[3]["y"])) / 2
    n = F.greatest(F.hypot(p[1]["x"] - p[0]["x"], p[1]["y"] - p[0]["y"]), F.lit(1e-9))
    return F.struct(cx.alias("cx"), cy.alias("cy"), ((p[1]["x"] - p[0]["x"]) / n).alias("dx"), ((p[1]["y"] - p[0]["y"]) / n).alias("dy"), length.alias("length"), quad_height(polygon).alias("height"))


def clipped(polygon: Str, w: Column, h: Column) -> Column:
    """Points held inside the page, two decimals; null if a coordinate is not a finite number."""
    p = col(polygon)
    bad = F.exists(p, lambda q: F.isnan(q["x"]) | F.isnan(q["y"]) | q["x"].isNull() | q["y"].isNull() | (F.abs(q["x"]) == float("inf")) | (F.abs(q["y"]) == float("inf")))
    held = F.transform(p, lambda q: point(F.bround(F.least(F.greatest(q["x"], F.lit(0.0)), w), 2), F.bround(F.least(F.greatest(q["y"], F.lit(0.0)), h), 2)))
    return F.when(~bad, held)


def segment_crosses(x0: Column, y0: Column, x1: Column, y1: Column, b: dict[str, Column]) -> Column:
    """Whether a segment meets a box, by clipping its parameter range."""
    dx, dy = x1 - x0, y1 - y0
    low, high = F.lit(0.0), F.lit(1.0)
    ok = F.lit(True)
    for d, start, lo, hi in ((dx, x0, b["x0"], b["x1"]), (dy, y0, b["y0"], b["y1"])):
        safe = F.when(d == 0, 1.0).otherwise(d)
        t0, t1 = (lo - start) / safe, (hi - start) / safe
        low = F.when(d == 0, low).otherwise(F.greatest(low, F.least(t0, t1)))
        high = F.when(d == 0, high).otherwise(F.least(high, F.greatest(t0, t1)))
        ok = ok & F.when(d == 0, (start >= lo) & (start <= hi)).otherwise(True)
    return ok & (low <= high)
