"""Signature anchors: rules and names near images, keyword and signer lines near regions, and what OCR lines show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .context import is_keyword_line, is_role_line

LEGIBLE_SCORE, LEGIBLE_LETTERS = 0.9, 4
RULE_HEIGHT, RULE_WIDTH, RULE_SHARE = 2.0, 30.0, 0.6
REACH_HEIGHTS = 12.0


def letters(text: T.Str) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(F.coalesce(T.col(text), F.lit("")), r"[^\p{L}\p{N}]", ""))


def legible(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, legible, needs_mirror): some line reads as text; none does, though some line has letters enough to be one."""
    many = letters("text") >= LEGIBLE_LETTERS
    own = lines.groupBy(*keys).agg(F.bool_or(many & (F.col("score") >= LEGIBLE_SCORE)).alias("legible"), F.bool_or(many).alias("_any"))
    return own.select(*keys, "legible", (~F.col("legible") & F.col("_any")).alias("needs_mirror"))


def signature_rules(paths: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, x0, y0, x1, y1): possible signature lines. Drawn ones are single strokes or filled boxes (``segments`` = 1, no
    curves) of at most RULE_HEIGHT, from RULE_WIDTH to RULE_SHARE of the page's width; typed ones are ten marks or more."""
    wide = F.col("x1") - F.col("x0") <= RULE_SHARE * F.col("width")
    drawn = paths.where((F.col("segments") == 1) & (F.col("curves") == 0) & (F.col("y1") - F.col("y0") <= RULE_HEIGHT) & (F.col("x1") - F.col("x0") >= RULE_WIDTH) & wide)
    typed = lines.where(F.trim("text").rlike(r"^[_.\-… ]{10,}$") & wide)
    box = [*page, "x0", "y0", "x1", "y1"]
    return drawn.select(*box).unionByName(typed.select(*box))


def _beside(images: DataFrame, others: DataFrame, page: list[str]) -> tuple[DataFrame, list[Column]]:
    right = others.select(*(F.col(k).alias(f"_{k}") for k in page), *(F.col(c).alias(f"{c}_r") for c in ("x0", "y0", "x1", "y1")))
    return right, [F.col(k) == F.col(f"_{k}") for k in page]


def anchored(images: DataFrame, rules: DataFrame, names: DataFrame, page: list[str]) -> DataFrame:
    """Images with a rule under or across them over half the narrower width, or with a name right under them."""
    height = F.col("y1") - F.col("y0")
    reach = F.greatest(F.lit(15.0), 0.3 * height)
    shared = F.least("x1", "x1_r") - F.greatest("x0", "x0_r")
    under = (shared >= 0.5 * F.least(F.col("x1") - F.col("x0"), F.col("x1_r") - F.col("x0_r"))) & (F.col("y1_r") >= F.col("y0") + 0.3 * height) & (F.col("y0_r") <= F.col("y1") + reach)
    right_under = (shared > 0) & F.col("y0_r").between(F.col("y1") - 0.2 * height, F.col("y1") + 2 * reach)
    tagged = images.withColumn("_id", F.monotonically_increasing_id())
    r, on_page = _beside(images, rules, page)
    by_rule = tagged.join(r, [*on_page, under], "left_semi")
    n, on_page = _beside(images, names, page)
    by_name = tagged.join(n, [*on_page, right_under], "left_semi").join(r, [*on_page, under], "left_anti")
    return by_rule.unionByName(by_name).drop("_id")


def within_reach(regions: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, region, line), each once, of lines whose box comes within REACH_HEIGHTS of its height of a region."""

    def touches(r: Column, b: Column) -> Column:
        reach = REACH_HEIGHTS * F.greatest(F.lit(1.0), F.least(b["x1"] - b["x0"], b["y1"] - b["y0"]))
        return (b["x0"] <= r["x1"] + reach) & (r["x0"] - reach <= b["x1"]) & (b["y0"] <= r["y1"] + reach) & (r["y0"] - reach <= b["y1"])

    def placed(df: DataFrame, ident: str, boxes: str) -> DataFrame:
        """Rows of one place, or several, with all that have it: what stands in equal places is compared once."""
        own = df.where(F.col(ident).isNotNull()).groupBy(*page, ident).agg(F.array_sort(F.collect_set(F.struct("x0", "y0", "x1", "y1"))).alias(boxes))
        return own.groupBy(*page, boxes).agg(F.collect_list(ident).alias(f"{ident}s"))

    both = placed(regions, "region", "_r").join(placed(lines, "line", "_b"), page)
    near = both.where(F.exists("_r", lambda r: F.exists("_b", lambda b: touches(r, b))))
    return near.select(*page, "lines", F.explode("regions").alias("region")).select(*page, "region", F.explode("lines").alias("line"))


def signature_lines(regions: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """Lines with a signature keyword near a region."""
    return within_reach(regions, lines.where(is_keyword_line("text")), page)


def alone_on_row(lines: DataFrame, wanted: DataFrame, page: list[str]) -> DataFrame:
    """The wanted lines that no other line of the page stands beside, within four of their heights."""
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    other = lines.select(*(F.col(k).alias(f"_{k}") for k in page), F.col("line").alias("_line"), *(F.col(c).alias(f"{c}_o") for c in ("x0", "y0", "x1", "y1")))
    same_row = F.least("y1", "y1_o") - F.greatest("y0", "y0_o") > 0.4 * F.least(height, F.col("y1_o") - F.col("y0_o"))
    beside = (F.col("x1_o") >= F.col("x0") - 4 * height) & (F.col("x0_o") <= F.col("x1") + 4 * height)
    return wanted.join(other, [*(F.col(k) == F.col(f"_{k}") for k in page), F.col("line") != F.col("_line"), same_row, beside], "left_anti")


def signer_lines(lines: DataFrame, page: list[str], names: DataFrame | None = None) -> DataFrame:
    """Short lines alone on their row that state a role, or hold a name (``names``: page, line)."""
    short = lines.where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).between(1, 8))
    role = short.where(is_role_line("text"))
    if names is not None:
        role = role.unionByName(short.where(~F.coalesce(is_role_line("text"), F.lit(False))).join(names.select(*page, "line").distinct(), [*page, "line"], "left_semi").select(*short.columns))
    return alone_on_row(lines, role, page)
