"""Queries on spans and findings: deduplication, propagation, settlement, exceptions, matching, leak search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..operators import context as C
from ..operators import detect as D
from ..operators import document as DOC
from ..operators import evaluate as E
from ..operators import redact as R
from .catalog import Tables, query

_PRIO = "CASE detector WHEN 'regex' THEN 0 WHEN 'name_list' THEN 1 ELSE 2 END"
_TYPE = "list_position(['email', 'address', 'name', 'rut', 'phone', 'url'], type)"


@query(f"""WITH d AS (SELECT DISTINCT file, page, type, a, b, detector FROM {{syn_span}} WHERE b > a),
o AS (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY a, b DESC, {_PRIO}, {_TYPE}, type, detector) AS k FROM d)
SELECT file, page, type, a, b, detector FROM o WHERE NOT EXISTS (SELECT 1 FROM o e WHERE e.file = o.file AND e.page = o.page AND e.k < o.k AND e.a <= o.a AND e.b >= o.b)""")
def span_dedup_window(t: Tables) -> DataFrame:
    return D.dedup_spans(t("syn_span"), ["file", "page"]).select("file", "page", "type", "a", "b", "detector")


@query("SELECT type, detector, count(*) AS spans, count(DISTINCT file) AS files, sum(b - a) AS chars FROM (SELECT * FROM {syn_span} WHERE type = 'rut' UNION ALL SELECT * FROM {syn_span} WHERE type = 'email') GROUP BY type, detector")
def span_union_types(t: Tables) -> DataFrame:
    s = t("syn_span")
    return s.where("type = 'rut'").unionByName(s.where("type = 'email'")).groupBy("type", "detector").agg(F.count("*").alias("spans"), F.countDistinct("file").alias("files"), F.sum(F.col("b") - F.col("a")).alias("chars"))


@query("""WITH d AS (SELECT DISTINCT file, page, a, b FROM {syn_span} WHERE b > a),
o AS (SELECT *, coalesce(max(b) OVER (PARTITION BY file, page ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_from FROM d)
SELECT file, page, count(*) AS spans, sum(greatest(a - gap_from, 0)) AS gap_chars, max(greatest(a - gap_from, 0)) AS longest FROM o GROUP BY file, page""")
def span_gap_text(t: Tables) -> DataFrame:
    own = t("syn_span").where("b > a").select("file", "page", "a", "b").distinct().withColumn("text", F.repeat(F.lit("x"), 400))
    g = D.gaps(own, ["file", "page"], "text")
    return g.groupBy("file", "page").agg(F.count("*").alias("spans"), F.sum(F.length("gap")).cast("decimal(38,0)").cast("long").alias("gap_chars"), F.max(F.length("gap")).alias("longest"))


@query("SELECT id, CASE WHEN t <> 'rut' OR valid THEN t WHEN id % 2 = 0 THEN 'email' END AS type FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'rut' WHEN 1 THEN 'name' ELSE 'address' END AS t, id % 5 <> 0 AS valid FROM {syn_rut})")
def context_value_type(t: Tables) -> DataFrame:
    own = t("syn_rut")
    kind = F.when(F.col("id") % 3 == 0, "rut").when(F.col("id") % 3 == 1, "name").otherwise("address")
    value = F.when(F.col("id") % 5 != 0, F.concat(F.col("body").cast("string"), F.lit("-"), "dv")).when(F.col("id") % 2 == 0, "ana@x.cl").otherwise("-")
    sub = F.when(F.col("id") % 2 == 0, F.array(F.lit("url"), F.lit("email"))).otherwise(F.array().cast("array<string>"))
    return own.withColumn("value", value).select("id", D.context_type(kind, "value", sub).alias("type"))


# ---- exceptions and lists -------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT id, value, CAST(body AS VARCHAR) || dv AS k FROM {syn_rut} UNION ALL SELECT id + 1000000, ' ' || value || ' ', CAST(body AS VARCHAR) || dv FROM {syn_rut}),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM e) SELECT id, trim(value) AS value, k AS rut FROM r WHERE n = 1""")
def exception_clean(t: Tables) -> DataFrame:
    own = t("syn_rut").select(F.col("id").alias("pos"), F.col("value").alias("entry"))
    again = t("syn_rut").select((F.col("id") + 1000000).alias("pos"), F.concat(F.lit(" "), "value", F.lit(" ")).alias("entry"))
    kept, _ = DOC.clean_exceptions(own.unionByName(again))
    return kept.select(F.col("pos").alias("id"), "value", "rut")


@query("SELECT id, value FROM {syn_rut} WHERE id % 10 = 3")
def exception_semi_join(t: Tables) -> DataFrame:
    entries = t("syn_rut").where("id % 10 = 3").select(F.concat(F.col("body").cast("string"), F.lit("-"), "dv").alias("entry"))
    keys = DOC.exception_keys(entries)
    return DOC.matches(t("syn_rut").withColumn("type", F.lit("rut")), keys).select("id", "value")


_GAPS = [*DOC.LABEL_PHRASES, "Juan", "Rut Mesa Soto", "oficina"]
_GAP_LIST = "[" + ", ".join(f"'{p}'" for p in _GAPS) + "]"


@query(f"""SELECT id, form, CASE WHEN p IN ('Juan', 'Rut Mesa Soto', 'oficina') OR (regexp_matches(p, '(^| )n( |$)') AND form <> 2) OR form = 3 THEN false ELSE form = 1 OR NOT regexp_matches(p, '(^| )(rut|mesa)( |$)') END AS label
FROM (SELECT c_custkey AS id, ({_GAP_LIST})[(c_custkey // 4) % {len(_GAPS)} + 1] AS p, CASE WHEN c_custkey % 4 = 2 AND NOT regexp_matches(({_GAP_LIST})[(c_custkey // 4) % {len(_GAPS)} + 1], '^n$') THEN 0 ELSE c_custkey % 4 END AS form FROM customer)""")
def exception_label_gap(t: Tables) -> DataFrame:
    """All label phrases and some that are none: bare, with a colon, as a number sign, and with a digit."""
    k = F.col("c_custkey")
    phrase = F.element_at(F.array(*map(F.lit, _GAPS)), (F.floor(k / 4) % len(_GAPS) + 1).cast("int"))
    own = t("customer").select(k.alias("id"), phrase.alias("p")).withColumn("form", F.when((F.col("id") % 4 == 2) & (F.col("p") != "n"), 0).otherwise(F.col("id") % 4))
    gap = F.when(F.col("form") == 1, F.concat(F.lit(", "), F.initcap("p"), F.lit(": "))).when(F.col("form") == 2, " N° ").when(F.col("form") == 3, F.concat("p", F.lit(" 2: "))).otherwise(F.concat("p", F.lit(" ")))
    return own.select("id", "form", DOC.is_label_gap(gap).alias("label"))


@query("SELECT id FROM {syn_rut} WHERE id % 10 IN (3, 4)")
def exception_covered(t: Tables) -> DataFrame:
    """Findings of which every datum is listed and the rest are labels; findings with another word are not."""
    own = t("syn_rut").withColumn("text", F.concat(F.lit("RUT: "), "value", F.lit(".")))
    keys = DOC.exception_keys(own.where("id % 10 in (3, 4)").select(F.col("value").alias("entry")))
    found = D.dedup_spans(D.detect(own.select("id", "text"), ["id", "text"], "text"), ["id", "text"])
    findings = own.select("id", F.lit(False).alias("optional"), F.lit("rut").alias("type"))
    return DOC.excepted(findings, found, keys)


@query("SELECT min(pos) AS pos, any_value(v) AS value FROM (SELECT pos, lower(regexp_replace(e, ' +', ' ', 'g')) AS v FROM (SELECT p_partkey AS pos, p_brand || '  ' || p_type AS e FROM part)) GROUP BY v")
def list_clean(t: Tables) -> DataFrame:
    own = t("part").select(F.col("p_partkey").alias("pos"), F.concat("p_brand", F.lit("  "), "p_type").alias("entry"))
    return DOC.clean_entries(own).select("pos", F.lower("value").alias("value"))


# ---- documents ------------------------------------------------------------------------------------------------------


def _mail_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages of customers' files, one of which gives a name by a pattern, the others repeat it in other writing."""
    c = t("customer").select(F.col("c_custkey").alias("id"))
    file = (F.floor(F.col("id") / 3)).alias("file")
    page = (F.col("id") % 3).alias("page")
    name = F.concat(F.lit("Nora Vera"), F.floor(F.col("id") / 3).cast("string"))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("firma: "), name, F.lit(" fin"))).otherwise(F.concat(F.lit("de NORA, "), F.regexp_replace(name, "Nora ", ""), F.lit(" y otros")))
    pages = c.select(file, page, text.alias("text"))
    spans = c.where("id % 3 = 0").select(file, page, F.lit("name").alias("type"), F.lit(7).alias("a"), (F.length(name) + 7).alias("b"), F.lit("name_list").alias("detector"), name.alias("value"))
    return pages, spans


@query("SELECT CAST(floor(c_custkey / 3) AS BIGINT) AS file, c_custkey % 3 AS page, 3 AS a, CAST(3 + 10 + length(CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR)) AS INT) AS b, 'name' AS type FROM customer WHERE c_custkey % 3 <> 0 AND CAST(floor(c_custkey / 3) AS BIGINT) IN (SELECT CAST(floor(c_custkey / 3) AS BIGINT) FROM customer WHERE c_custkey % 3 = 0)")
def propagate_values(t: Tables) -> DataFrame:
    return DOC.propagate(*_mail_pages(t)).select("file", "page", "a", "b", "type")


@query("SELECT id, id % 2 = 1 OR id % 10 >= 5 AS optional FROM (SELECT c_custkey AS id FROM customer)")
def settle_optional_urls(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("n"))
    url = c.select(F.col("n").alias("id"), F.col("n").alias("file"), F.lit("url").alias("type"), F.concat(F.lit("https://x.cl/"), F.when(F.col("n") % 2 == 0, "nora-vera").otherwise("nora")).alias("value"), F.lit(True).alias("optional"), F.lit("url").alias("optional_reason"), F.lit("suggested").alias("status"))
    name = c.where("n % 10 < 5").select((F.col("n") + 10**9).alias("id"), F.col("n").alias("file"), F.lit("name").alias("type"), F.lit("Nora Vera").alias("value"), F.lit(False).alias("optional"), F.lit(None).cast("string").alias("optional_reason"), F.lit("proposed").alias("status"))
    return DOC.settle_optional(url.unionByName(name)).where("type = 'url'").select("id", "optional")


@query("SELECT c_custkey AS file, 20 + c_custkey % 7 AS a FROM customer WHERE c_custkey % 3 <> 0")
def data_in_urls(t: Tables) -> DataFrame:
    """Links that hold the file's address, at varying places, or another one."""
    k = F.col("c_custkey")
    value = F.concat(F.lit("nora.vera"), k.cast("string"), F.lit("@y.cl"))
    link = F.concat(F.lit("https://x.cl/"), F.repeat(F.lit("a"), (k % 7).cast("int")), F.lit("id="), F.when(k % 3 == 0, "otra.persona@y.cl").otherwise(value))
    c = t("customer").select(k.alias("file"), F.lit(0).alias("page"), value.alias("v"), link.alias("u"))
    mail = c.select("file", "page", F.lit("email").alias("type"), F.lit(100).alias("a"), F.lit(114).alias("b"), F.lit("regex").alias("detector"), F.col("v").alias("value"))
    url = c.select("file", "page", F.lit("url").alias("type"), F.lit(4).alias("a"), (F.length("u") + 4).alias("b"), F.lit("regex").alias("detector"), F.col("u").alias("value"))
    return DOC.data_in_urls(c.select("file", "page", F.concat(F.lit("ver "), "u", F.lit(" ahora")).alias("text")), mail.unionByName(url)).select("file", F.col("a").cast("long").alias("a"))


@query("SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 END AS version, false AS orphan FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END, true FROM orders WHERE o_orderkey % 7 = 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)")
def match_results_orphans(t: Tables) -> DataFrame:
    o = t("orders").select(F.col("o_orderkey").alias("k"))
    path = F.concat(F.lit("a/"), F.col("k").cast("string"), F.lit(".pdf"))
    files = o.where("k % 7 <> 0").select(F.col("k").alias("file_id"), path.alias("path"))
    raw = F.concat(F.lit(".\\"), F.replace(path, F.lit("/"), F.lit("\\")))
    results = o.where("k % 2 = 0 or k % 3 = 0").select("k", F.lit(1).alias("seq"), raw.alias("input")).unionByName(o.where("k % 2 = 0").select("k", F.lit(2).alias("seq"), path.alias("input")))
    both, orphans = DOC.match_results(files, results)
    own = both.select("file_id", F.col("seq").alias("version"), F.lit(False).alias("orphan"))
    return own.unionByName(orphans.groupBy(F.col("k").alias("file_id")).agg(F.max("seq").alias("version")).withColumn("orphan", F.lit(True)))


@query("SELECT id AS file, 3 AS findings FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 1")
def adopt_unmarked(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("file"))
    findings = c.select(F.col("file").cast("string").alias("id"), F.col("file").cast("string").alias("file"), F.lit(0).alias("page"), F.lit("name").alias("type"), F.lit("x").alias("value"), F.lit("regex").alias("detector"), F.lit("proposed").alias("status"))
    poly = F.array(*(F.array(F.struct(F.lit(float(i)).alias("x"), F.lit(1.0).alias("y"))) for i in (1, 2)))
    leaks = c.select(F.col("file").cast("string").alias("file"), F.lit(0).alias("page"), F.lit("rut").alias("type"), F.lit("m").alias("message"), F.when(F.col("file") % 2 == 1, "f").alias("finding_id"), poly.alias("polygons"))
    return DOC.adopt_unmarked(findings, leaks).groupBy(F.col("file").cast("long").alias("file")).agg(F.count("*").cast("int").alias("findings"))


@query("SELECT id, 'rut' AS type, 5 AS a FROM {syn_field} WHERE id % 6 = 0 UNION ALL SELECT id, 'name', 9 FROM {syn_field} WHERE id % 6 = 1 UNION ALL SELECT id, 'email', 20 FROM {syn_field} WHERE id % 6 = 2 UNION ALL SELECT id, 'address', 10 FROM {syn_field} WHERE id % 6 = 3 UNION ALL SELECT id, 'name', 6 FROM {syn_field} WHERE id % 6 = 4")
def label_value(t: Tables) -> DataFrame:
    return C.label_values(t("syn_field"), ["id"]).select("id", "type", "a")


_PAIR = "least(h.y1, l.y1) - greatest(h.y0, l.y0) > 0.4 * least(h.y1 - h.y0, l.y1 - l.y0) AND h.line <> l.line"
_HEADS = f"""WITH n AS (SELECT * FROM {{syn_line}}), h AS (SELECT * FROM n WHERE text NOT LIKE 'valor%'),
s AS (SELECT h.file, h.page, h.line, count(l.line) FILTER ({_PAIR} AND l.x1 - l.x0 < 300) AS same_row,
      max(l.x1) FILTER ({_PAIR} AND l.x1 < h.x0) AS lft, min(l.x0) FILTER ({_PAIR} AND l.x0 > h.x1) AS rgt
      FROM h JOIN n l ON h.file = l.file AND h.page = l.page GROUP BY ALL)"""


@query(_HEADS + f""", p AS (SELECT h.file, h.page, h.line, l.line AS cell, l.text AS lt, row_number() OVER (PARTITION BY h.file, h.page, h.line ORDER BY l.x0, l.line) AS k FROM h JOIN s USING (file, page, line) JOIN n l ON h.file = l.file AND h.page = l.page
      WHERE same_row < 2 AND {_PAIR} AND l.x0 >= h.x1 - 2 AND l.x0 - h.x1 < 270)
SELECT file, page, line AS line_h, cell AS line FROM p WHERE k = 1 AND lt LIKE 'valor%'""")
def form_cell_nearest(t: Tables) -> DataFrame:
    return C.form_cells(t("syn_line"), ["file", "page"]).select("file", "page", "line_h", "line")


@query(_HEADS + """, c AS (SELECT h.file, h.page, h.line, h.y0 AS hy0, h.y1 AS hy1, l.line AS cell, l.text AS lt, l.y0, l.y1, l.x0, l.x1 FROM h JOIN s USING (file, page, line) JOIN n l ON h.file = l.file AND h.page = l.page
      WHERE same_row >= 2 AND l.y0 > h.y1 - 1 AND (l.x0 + l.x1) / 2 BETWEEN coalesce((lft + h.x0) / 2, h.x0 - (h.y1 - h.y0)) - 2 AND coalesce((rgt + h.x1) / 2, least(600, h.x1 + 1.5 * (h.x1 - h.x0))) + 2),
o AS (SELECT *, row_number() OVER (PARTITION BY file, page, line ORDER BY y0, cell) AS k, coalesce(lag(y1) OVER (PARTITION BY file, page, line ORDER BY y0, cell), hy1) AS last FROM c),
f AS (SELECT *, min(k) FILTER (x1 - x0 > 330 OR y0 - last > greatest(4 * (hy1 - hy0), 64) OR lt NOT LIKE 'valor%') OVER (PARTITION BY file, page, line) AS stop FROM o)
SELECT file, page, line AS line_h, cell AS line FROM f WHERE stop IS NULL OR k < stop""")
def table_column_prefix(t: Tables) -> DataFrame:
    return C.column_cells(t("syn_line"), ["file", "page"]).select("file", "page", "line_h", "line")


# ---- leak search ----------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower(strip_accents(replace({}, 'ß', 'ss'))), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


_HEAD = "regexp_extract({}, '^[^ ]+ [^ ]+ [^ ]+')"


@query(f"""SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || {_NORM.format('text')} || ' ' AS t FROM documents) d JOIN (
SELECT item_id, ' ' || {_NORM.format('text')} || ' ' AS n FROM benchmark UNION ALL SELECT item_id + 1000000, ' ' || {_HEAD.format(_NORM.format('text'))} || ' ' FROM benchmark) b ON contains(t, n)""")
def benchmark_leaks(t: Tables) -> DataFrame:
    """Whole items, and their first three words."""
    b = t("benchmark")
    short = b.select((F.col("item_id") + 1000000).alias("item_id"), F.regexp_extract(T.norm_general("text"), "^[^ ]+ [^ ]+ [^ ]+", 0).alias("text"))
    return E.passages_in(t("documents"), b.select("item_id", "text").unionByName(short))


@query("SELECT id, list_aggregate(['value:' || k] || CASE WHEN length(k) >= 8 THEN ['rut_body:' || substr(k, 1, length(k) - 1)] ELSE [] END, 'string_agg', ';') AS needles FROM (SELECT id, CAST(body AS VARCHAR) || dv AS k FROM {syn_rut})")
def needle_fragments(t: Tables) -> DataFrame:
    n = F.transform(E.needles(F.lit("rut"), "value"), lambda x: F.concat_ws(":", x["part"], x["form"]))
    return t("syn_rut").select("id", F.array_join(n, ";").alias("needles"))


@query("SELECT o_custkey AS id, count(*) AS kinds, sum(length(f)) AS chars FROM (SELECT o_custkey, unnest([regexp_replace(upper(o_clerk), '([0-9])[ .-]+([0-9])', '\\1\\2', 'g'), lower(replace(o_clerk, ' ', '')), lower(o_clerk)]) AS f FROM (SELECT o_custkey, o_orderpriority AS o_clerk FROM orders)) GROUP BY 1")
def haystack_kinds(t: Tables) -> DataFrame:
    own = t("orders").select(F.col("o_custkey").alias("id"), F.lit("text").alias("origin"), F.lit(False).alias("binary"), F.col("o_orderpriority").alias("text"))
    return E.haystack(own, ["id"]).groupBy("id").agg(F.count("*").alias("kinds"), F.sum(F.length("form")).alias("chars"))


@query("SELECT id AS file, 'value' AS part FROM {syn_rut} WHERE id % 2 = 0 UNION ALL SELECT id, 'rut_body' FROM {syn_rut} WHERE id % 2 = 0 AND length(CAST(body AS VARCHAR)) >= 7")
def haystack_search(t: Tables) -> DataFrame:
    own = t("syn_rut")
    hay = E.haystack(own.select(F.col("id").alias("file"), F.lit("t").alias("origin"), F.lit(False).alias("binary"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("consta "), "value", F.lit(" aqui"))).otherwise("nada").alias("text")), ["file"])
    n = own.select(F.col("id").alias("file"), F.col("id").alias("element"), F.explode(E.needles(F.lit("rut"), "value")).alias("n")).select("file", "element", "n.*")
    return E.search(n, hay, ["file"]).select("file", "part")


@query("SELECT id FROM {syn_rut} WHERE id % 2 = 0")
def pdf_leak_values(t: Tables) -> DataFrame:
    own = t("syn_rut")
    out = own.select(F.col("id").alias("file"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("queda "), F.replace("value", F.lit("-"), F.lit(" - ")))).otherwise("nada").alias("text"))
    found = own.select(F.col("id").alias("file"), "id", F.lit("rut").alias("type"), "value")
    return R.needles_in_output(out, found, ["file"]).select("id")


@query("SELECT id FROM {syn_rut} WHERE id % 3 = 1")
def squeezed_leaks(t: Tables) -> DataFrame:
    own = t("syn_rut")
    out = own.select(F.col("id").alias("file"), F.when(F.col("id") % 3 < 2, F.concat(F.lit("x "), "value")).otherwise("y").alias("text"))
    active = own.select(F.col("id").alias("file"), "value")
    return R.squeezed_leaks(out, active, active.where("file % 3 = 0"), ["file"]).select(F.col("file").alias("id"))


@query("SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,2}\\.[0-9]{3}\\.[0-9]{3}-[0-9kK]|[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{2,}|\\+?56 ?9 ?[0-9]{4} ?[0-9]{4}|https?://[^ \\t\\n\\r]+')) FROM documents) GROUP BY doc_id")
def naive_baseline(t: Tables) -> DataFrame:
    return D.naive_scan(t("documents"), ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("SELECT c_custkey AS file, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS left_texts, CASE c_custkey % 4 WHEN 0 THEN 'info.author,xmp' WHEN 1 THEN 'xmp' ELSE 'info.author' END AS places FROM customer WHERE c_custkey % 4 < 3")
def metadata_leaks(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("file"))
    k = F.col("file") % 4
    both = F.array(F.struct(F.lit("info.author").alias("location"), F.when(k.isin(0, 2), "autor").otherwise(" \t").alias("text")), F.struct(F.lit("xmp").alias("location"), F.when(k < 2, "otro").otherwise("").alias("text")))
    return R.metadata_leaks(c.select("file", F.explode(both).alias("m")).select("file", "m.*")).select("file", F.col("left").cast("int").alias("left_texts"), F.array_join("locations", ",").alias("places"))


_VALUES = [("Ana Luz Nora Vera", "nora vera"), ("Vera Soto, Ana", "vera soto"), ("Ana", None), ("A. Vera", None), ("Av Uno 12, depto 4", "av uno 12"), ("Calle 5 de Abril 100", "calle 5"), ("1234 Norte", None)]


@query("SELECT c_custkey AS id, CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN " + ("NULL" if f is None else f"'{f}'") for i, (_, f) in enumerate(_VALUES)) + " END AS fragment FROM customer")
def value_fragments(t: Tables) -> DataFrame:
    k = (F.col("c_custkey") % 7).cast("int")
    value = F.element_at(F.array(*(F.lit(v) for v, _ in _VALUES)), k + 1)
    frag = F.when(k < 4, T.surnames(value)).otherwise(T.street_number(value))
    return t("customer").select(F.col("c_custkey").alias("id"), T.norm_general(frag).alias("fragment"))


_RANKS = ", ".join(f"'{x}'" for x in S.TYPE_PRIORITY)


@query(f"SELECT id, type, list_position([{_RANKS}], type) - 1 AS place FROM {{syn_finding}}")
def priority_rank(t: Tables) -> DataFrame:
    return t("syn_finding").select("id", "type", S.rank(F.col("type"), S.TYPE_PRIORITY, 99).alias("place"))
