"""Layout rules: what stands beside or below a label. Lines have a file, a page, a number, a text and a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

#: Labels of fields, by the type of what they label.
LABELS = {
    "rut": ["rut", "r.u.t", "r.u.t.", "run", "ci", "c.i", "c.i.", "c i", "c. i.", "cedula", "cedula de identidad"],
    "email": ["correo", "correo electronico", "email", "e-mail", "e mail", "mail"],
    "phone": ["telefono", "fono", "celular", "movil"],
    "address": ["direccion", "domicilio"],
    "signature": ["firma", "firma del titular"],
    "name": ["nombre", "nombres", "nombre y apellido", "nombre y apellidos", "nombres y apellido", "nombres y apellidos", "nombre completo", "apellido", "apellidos"],
}
#: Words that are labels only with a colon.
COLON_LABELS = ["de", "para", "cc", "cco", "remitente", "destinatario", "asistente", "solicitante", "funcionaria", "funcionario", "prestador", "prestadora"]


def _any(words: list[str]) -> str:
    """Pattern of any of the words, the longest first, with any spaces between their parts."""
    return "|".join(r"\s+".join(p.replace(".", r"\.") for p in w.split()) for w in sorted(words, key=lambda w: (-len(w), w)))


_ALL = [w for own in LABELS.values() for w in own]
LABEL_ONLY = rf"^\s*(?:{_any(_ALL)})\s*:?\s*$"
LABEL_VALUE = rf"^(\s*(?:{_any(_ALL + COLON_LABELS)})\s*:\s*)(\S.*)$"
ROLE = r"^(?:alcalde(?:sa)?|director(?:a)?|jef[ea]|secretari[oa]|presidente|encargad[oa]|profesional|coordinador(?:a)?|ministr[oa])(?![a-z])"
SIGNATURE_WORD = r"firma|timbre|suscrib|rubrica"
ELECTRONIC = r"electronic|digital"


def is_label(text: T.Str) -> Column:
    return T.norm(text).rlike(LABEL_ONLY)


def type_by_label(label: T.Str) -> Column:
    """The type whose label the text begins with, the longest label first; a name if none."""
    by_label = {w: kind for kind, own in LABELS.items() for w in own}
    found = F.regexp_replace(F.regexp_extract(T.norm(label), rf"^\s*({_any(list(by_label))})", 1), r"\s+", " ")
    return F.coalesce(F.create_map(*(F.lit(x) for p in by_label.items() for x in p))[found], F.lit("name"))


def label_values(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, type, a, b, value) of lines "label: value"."""
    n = T.fold(text)
    head = F.regexp_extract(n, LABEL_VALUE, 1)
    value = F.regexp_extract(n, LABEL_VALUE, 2)
    out = lines.withColumns({"_h": head, "_v": value}).where((F.col("_h") != "") & ~is_label("_v"))
    return out.select(*keys, type_by_label("_h").alias("type"), F.length("_h").alias("a"), F.length(text).alias("b"), F.substring(F.col(text), F.length("_h") + 1, F.length(text)).alias("value"))


def is_role_line(text: T.Str) -> Column:
    return (F.size(F.split(F.trim(T.col(text)), r"\s+")) <= 8) & T.norm(text).rlike(ROLE)


def is_electronic(text: T.Str) -> Column:
    return T.norm(text).rlike(ELECTRONIC)


def is_keyword_line(text: T.Str) -> Column:
    return (F.size(F.split(F.trim(T.col(text)), r"\s+")) <= 8) & T.norm(text).rlike(SIGNATURE_WORD) & ~is_electronic(text)


BOX = ["x0", "y0", "x1", "y1"]


def same_row() -> Column:
    return G.vertical_overlap(G.box("_h"), G.box("_l")) > 0.4


def _places(lines: DataFrame, page: list[str]) -> DataFrame:
    """Lines of a page by their box: how many are short, the first two of them, the first that ends a column, and the last."""
    key = [*page, "width", "height", *BOX]
    short = (F.size(F.split(F.trim("text"), r"\s+")) <= 4) & (F.col("x1") - F.col("x0") < F.col("width") * 0.5)
    ends = (F.col("x1") - F.col("x0") > F.col("width") * 0.55) | is_label("text")
    own = lines.select(*key, "line", "text", short.alias("short"), ends.alias("ends"))
    first = Window.partitionBy(*page, *BOX).orderBy("line")
    firsts = own.select(*page, *BOX, "line", "text").withColumn("_n", F.row_number().over(first)).where("_n <= 2")
    firsts = firsts.groupBy(*page, *BOX).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("firsts"))
    return own.groupBy(*page, *BOX).agg(F.count_if("short").alias("short"), F.min(F.when(F.col("ends"), F.col("line"))).alias("end"), F.max("line").alias("last"), F.min("line").alias("least")).join(firsts, [*page, *BOX])


def _heads(lines: DataFrame, page: list[str]) -> DataFrame:
    """Labels alone on their line, with what their own line adds to the short lines of their row."""
    short = (F.size(F.split(F.trim("text"), r"\s+")) <= 4) & (F.col("x1") - F.col("x0") < F.col("width") * 0.5) & (F.col("y1") > F.col("y0"))
    own = lines.where(is_label("text")).select(*page, "width", "height", "line", "text", *BOX, short.cast("int").alias("self"))
    return own.select(*page, "width", "height", F.col("line").alias("line_h"), F.col("text").alias("text_h"), *(F.col(c).alias(f"{c}_h") for c in BOX), "self")


HEAD = ["width", "height", *(f"{c}_h" for c in BOX), "self"]


def with_headers(lines: DataFrame, page: list[str], places: DataFrame) -> DataFrame:
    """Boxes of lone labels with the boxes of the lines of their page (suffix _l), and for each label's box whether it heads a
    table column, and the column's range. Lines that share a box share what is said of it: pairs are made of boxes, not of
    lines, so a page with very many lines in few places has few pairs."""
    heads = _heads(lines, page).select(*page, *HEAD).distinct()
    others = places.select(*page, *(F.col(c).alias(f"{c}_l") for c in BOX), F.col("short").alias("_short"), "end", "last", "least", "firsts")
    own = Window.partitionBy(*page, *HEAD)
    beside = same_row() & (F.col("_short") > 0)
    left = F.max(F.when(beside & (F.col("x1_l") < F.col("x0_h")), F.col("x1_l"))).over(own)
    right = F.min(F.when(beside & (F.col("x0_l") > F.col("x1_h")), F.col("x0_l"))).over(own)
    count = F.sum(F.when(beside, F.col("_short")).otherwise(0)).over(own) - F.col("self")
    out = heads.join(others, page).withColumns({"same_row": count, "_left": left, "_right": right})
    start = F.coalesce((F.col("_left") + F.col("x0_h")) / 2, F.col("x0_h") - (F.col("y1_h") - F.col("y0_h")))
    end = F.coalesce((F.col("_right") + F.col("x1_h")) / 2, F.least(F.col("width"), F.col("x1_h") + 1.5 * (F.col("x1_h") - F.col("x0_h"))))
    return out.select("*", (F.col("same_row") >= 2).alias("table"), start.alias("x_start"), end.alias("x_end")).drop("_left", "_right")


def form_cells(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, line_h, type, line): the nearest line to the right of a lone label that heads no table."""
    near = same_row() & (F.col("x0_l") >= F.col("x1_h") - 2) & (F.col("x0_l") - F.col("x1_h") < F.col("width") * 0.45)
    boxes = with_headers(lines, page, _places(lines, page)).where(~F.col("table") & near)
    # of a box, the first line, or the second where the first is the label itself
    best = boxes.groupBy(*page, *HEAD).agg(F.array_sort(F.collect_list(F.struct("x0_l", "firsts"))).alias("near"))
    pairs = _heads(lines, page).join(best, [*page, *HEAD])
    line = F.transform("near", lambda b: F.struct(b["x0_l"].alias("x0_l"), F.get(F.filter(b["firsts"], lambda f: f["line"] != F.col("line_h")), F.lit(0)).alias("f")))
    m = F.array_min(F.transform(F.filter(line, lambda b: b["f"].isNotNull()), lambda b: F.struct(b["x0_l"].alias("x0_l"), b["f"]["line"].alias("line"), b["f"]["text"].alias("text"))))
    found = pairs.select(*page, "line_h", "text_h", m.alias("m")).where(F.col("m").isNotNull() & ~is_label("m.text"))
    return found.select(*page, "line_h", type_by_label("text_h").alias("type"), F.col("m.line").alias("line"))


def column_cells(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, line_h, type, line): lines below a table header inside its column, until one is too wide, too far, or a label.
    Where a column ends is found by boxes in order of their top: at the first line that ends it, or before the first line of a
    top that is too far below the last line of the top before. Only lines before the first that ends a column in their own
    box can stand in one."""
    places = _places(lines, page)
    centre = (F.col("x0_l") + F.col("x1_l")) / 2
    inside = F.col("table") & (F.col("y0_l") > F.col("y1_h") - 1) & (centre >= F.col("x_start") - 2) & (centre <= F.col("x_end") + 2)
    below = with_headers(lines, page, places).where(inside)
    head = [*page, *HEAD]
    # one row for each top below a head: the line that ends the column there, its first line, and the bottom of its last line
    tops = below.groupBy(*head, "y0_l").agg(F.min("end").alias("end"), F.min("least").alias("least"), F.max(F.struct("last", "y1_l"))["y1_l"].alias("bottom"))
    last = F.coalesce(F.lag("bottom").over(Window.partitionBy(*head).orderBy("y0_l")), F.col("y1_h"))
    gap = F.greatest(4 * (F.col("y1_h") - F.col("y0_h")), F.col("height") * 0.08)
    stop = F.when(F.col("y0_l") - last > gap, F.col("least")).otherwise(F.col("end"))
    ends = tops.withColumn("stop", stop).groupBy(*head).agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("y0_l", "stop"))).alias("s"))
    free = lines.join(places.where("end is not null").select(*page, *BOX, "end"), [*page, *BOX], "left").where("end is null or line < end")
    free = free.select(*page, F.col("line"), *(F.col(c).alias(f"{c}_l") for c in BOX))
    boxes = below.select(*head, *(f"{c}_l" for c in BOX)).join(ends, head)
    boxes = boxes.where(F.col("s").isNull() | (F.col("y0_l") <= F.col("s.y0_l")))
    cells = boxes.join(free, [*page, *(f"{c}_l" for c in BOX)]).where(F.col("s").isNull() | (F.col("y0_l") < F.col("s.y0_l")) | (F.col("line") < F.col("s.stop")))
    found = _heads(lines, page).join(cells.select(*head, "line"), head)
    return found.select(*page, "line_h", type_by_label("text_h").alias("type"), "line")


def repeated_images(images: DataFrame) -> DataFrame:
    """(file, xref, rounded box) that two pages or more have."""
    keys = ["file", "xref", *(F.round(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1"))]
    return images.groupBy(*keys).agg(F.countDistinct("page").alias("pages")).where("pages >= 2")
