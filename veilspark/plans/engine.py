"""The engine's verbs over tables: profile, analyse, export, evaluate; and SQL registration of the public functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import context as C
from ..operators import detect as D
from ..operators import document as DOC
from ..operators import estimate as EST
from ..operators import evaluate as E
from ..operators import names as N
from ..operators import redact as R
from .session import checkpoints


class Engine:
    """Detection, redaction and evaluation of files given as tables of pages (file, page, text)."""

    keys = ["file", "page"]

    def __init__(self, spark: SparkSession, as_of: str, detect: S.Detect = S.Detect(), urls_other_applied: bool = False) -> None:
        self.spark, self.as_of, self.options, self.urls_other_applied = spark, as_of, detect, urls_other_applied
        checkpoints(spark)

    def profile(self, pages: DataFrame) -> DataFrame:
        """Cheap facts of each file for the cost model; what only a decoder knows counts as none."""
        zero = {c: F.lit(0) for c in ("raster_pages", "regions", "drawn_regions", "frames")} | {c: F.lit(0.0) for c in ("regions_mp", "drawn_regions_mp", "megapixels")}
        own = pages.groupBy("file").agg(F.countDistinct("page").alias("pages"), F.count_if(F.length(F.trim("text")) < 50).alias("scanned_pages"))
        return own.withColumns({"kind": F.lit("pdf"), **zero})

    def estimate(self, pages: DataFrame, rates: DataFrame | None = None) -> DataFrame:
        return EST.stages(EST.units(self.profile(pages)), rates if rates is not None else EST.rates(self.spark))

    def context(self, pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """Spans that layout gives: values of "label: value" lines and, with boxed ``lines`` (file, page, line, text, a, x0, y0, x1,
        y1, width, height; a is the line's place in the page's text), form cells and table columns. A value
        under an identifier's label that holds none takes the type of what it does hold, or goes."""
        own = D.lines_of(pages, self.keys, "text")
        found = C.label_values(own.select(*self.keys, F.col("a").alias("at"), F.col("line_text").alias("text")), [*self.keys, "at"])
        found = found.select(*self.keys, "type", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"), "value")
        if lines is not None:
            cells = C.form_cells(lines, self.keys).unionByName(C.column_cells(lines, self.keys)).select(*self.keys, "type", "line").distinct()
            whole = lines.select(*self.keys, "line", "a", (F.col("a") + F.length("text")).alias("b"), F.col("text").alias("value"))
            found = found.unionByName(cells.join(whole, [*self.keys, "line"]).select(*self.keys, "type", "a", "b", "value"))
        kinds = F.transform(S.detect_spans("value"), lambda s: s["type"])
        typed = found.withColumn("type", D.context_type(F.col("type"), "value", kinds)).where("type is not null")
        return typed.withColumn("detector", F.lit("context")).select(*self.keys, "type", "a", "b", "detector", "value")

    def spans(self, pages: DataFrame, names: DataFrame | None = None, list_size: int | None = None, dictionary: bool = False, lines: DataFrame | None = None) -> DataFrame:
        """Deduplicated spans of patterns, layout, list and dictionary, with what propagation adds."""
        found = D.detect(pages, self.keys, "text", self.options).unionByName(self.context(pages, lines))
        if names is not None:
            hits = N.list_matches(pages, self.keys, "text", names, known_size=list_size)
            a, b = N.expand_name("text", F.col("a"), F.col("b"))
            wide = hits.withColumns({"_a": F.when(F.col("type") == "name", a).otherwise(F.col("a")), "_b": F.when(F.col("type") == "name", b).otherwise(F.col("b"))})
            found = found.unionByName(wide.select(*self.keys, "type", F.col("_a").alias("a"), F.col("_b").alias("b"), F.lit("name_list").alias("detector"), F.substring("text", F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("value")))
        if dictionary:
            own = pages.select(*self.keys, "text", F.explode(N.dictionary_names("text")).alias("s"))
            found = found.unionByName(own.select(*self.keys, F.lit("name").alias("type"), "s.a", "s.b", F.lit("context").alias("detector"), F.substring("text", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("value")))
        kept = D.dedup_spans(found, self.keys).checkpoint()
        return kept.unionByName(DOC.propagate(pages, kept))

    def data_in_links(self, pages: DataFrame, found: DataFrame) -> DataFrame:
        """Places inside links where a found value that is no link stands: (file, page, a, b, type, value)."""
        return DOC.data_in_urls(pages, found.select(*self.keys, "type", "a", "b", "detector", "value"))

    def analyze(self, pages: DataFrame, names: DataFrame | None = None, exceptions: DataFrame | None = None, list_size: int | None = None, dictionary: bool = False, lines: DataFrame | None = None) -> DataFrame:
        """Findings. Order matters: propagate, settle links, then exceptions."""
        found = self.spans(pages, names, list_size, dictionary, lines)
        flagged = D.flag_spans(found.join(pages.select(*self.keys, "text"), self.keys), "text").drop("text")
        out = DOC.settle_optional(D.findings(flagged, self.keys, self.as_of, self.urls_other_applied))
        if exceptions is None:
            return out
        inner = D.dedup_spans(D.detect(out.select("id", F.col("value").alias("text")), ["id", "text"], "text", S.Detect(ocr=True)), ["id", "text"])
        return DOC.apply_exceptions(out, DOC.excepted(out, inner, DOC.exception_keys(exceptions)))

    def export(self, pages: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(masked pages, leaks). A file may be published when it has no leaks."""
        active = findings.where("status not in ('removed', 'suggested')").select(*self.keys, "a", "b")
        return R.export(pages, active, self.keys)

    def evaluate(self, elements: DataFrame, output: DataFrame) -> DataFrame:
        """Elements (file, element, type, value, level) with ``leak``: whether the output's text still holds them."""
        n = elements.select("file", "element", F.explode(E.needles("type", "value")).alias("n")).select("file", "element", "n.*")
        hay = E.haystack(output.select("file", F.lit("text").alias("origin"), F.lit(False).alias("binary"), "text"), ["file"])
        hit = E.search(n, hay, ["file"]).select("file", "element").distinct().withColumn("leak", F.lit(True))
        out = elements.join(hit, ["file", "element"], "left").withColumn("leak", F.coalesce("leak", F.lit(False)))
        return out.withColumn("detected", ~F.col("leak"))


def register(spark: SparkSession) -> None:
    """SQL functions of this package: ``vs_matches(text, pattern)`` as a table function, ``vs_norm(text)`` as a scalar."""
    import unicodedata

    from pyspark.sql.functions import udtf

    @udtf(returnType="a int, b int, value string")
    class Matches:
        def eval(self, text: str, pattern: str):  # noqa: ANN201
            import re

            for m in re.finditer(pattern, text or ""):
                yield m.start(), m.end(), m.group()

    def norm(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).casefold().strip())

    spark.udtf.register("vs_matches", Matches)
    spark.udf.register("vs_norm", F.pandas_udf(norm, "string"))
