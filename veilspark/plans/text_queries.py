"""Queries on scalar functions and span extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..operators import detect as D
from ..operators import names as N
from ..operators import redact as R
from ..sources import files as FS
from .catalog import Tables, query
from .synth import digit

# ---- e-mail addresses and other patterns in texts -------------------------------------------------------------------

EMAIL_SIMPLE = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,4}"
DIGITS = r"[0-9][0-9 .-]{7,20}[0-9]"
URLS = r"https?://[^ \t\n\r]+"


def _spans_sql(table: str, key: str, text: str, pattern: str, extra: str = "") -> str:
    """Offsets by lists of pieces and matches, folded by running sums."""
    return f"""
WITH m AS (SELECT {key}{extra}, {text} AS t, regexp_extract_all({text}, '{pattern}') AS v, string_split_regex({text}, '{pattern}') AS g FROM {table}),
e AS (SELECT {key}{extra}, unnest(v) AS value, generate_subscripts(v, 1) AS i, v, g FROM m WHERE len(v) > 0)
SELECT {key}{extra}, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS INT) AS a,
       CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + list_sum(list_transform(v[1:i], lambda x: length(x))) AS INT) AS b, value FROM e"""


@query(_spans_sql("documents", "doc_id", "text", EMAIL_SIMPLE))
def email_spans(t: Tables) -> DataFrame:
    return D.pattern_spans(t("documents"), ["doc_id"], "text", EMAIL_SIMPLE, needs="@")


@query(_spans_sql("documents", "doc_id", "text", r"[A-Za-z0-9_.+-]+[ \t]?@[ \t]?[A-Za-z0-9_.,-]{2,}"))
def loose_email_spans(t: Tables) -> DataFrame:
    return D.pattern_spans(t("documents"), ["doc_id"], "text", r"[A-Za-z0-9_.+-]+[ \t]?@[ \t]?[A-Za-z0-9_.,-]{2,}", needs="@")


@query(_spans_sql("documents", "doc_id", "text", DIGITS))
def digit_run_spans(t: Tables) -> DataFrame:
    return D.pattern_spans(t("documents"), ["doc_id"], "text", DIGITS)


@query(_spans_sql("pages", "page_id", "url", URLS))
def url_spans(t: Tables) -> DataFrame:
    return D.pattern_spans(t("pages"), ["page_id"], "url", URLS)


@query("SELECT page_id, count(*) AS links, sum(length(u)) AS chars FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS u FROM pages) GROUP BY page_id")
def html_links(t: Tables) -> DataFrame:
    found = D.pattern_spans(t("pages"), ["page_id"], "html", r'href="[^"]*"')
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.sum(F.length("value")).alias("chars"))


@query(rf"""
WITH m AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{EMAIL_SIMPLE}')) AS value FROM documents)
SELECT lang, 'email' AS type, count(*) AS spans, count(DISTINCT doc_id) AS docs, count(DISTINCT lower(value)) AS addresses FROM m GROUP BY lang""")
def email_by_lang(t: Tables) -> DataFrame:
    """The flagship: extraction, deduplication by window, aggregation."""
    found = D.pattern_spans(t("documents"), ["doc_id", "lang"], "text", EMAIL_SIMPLE, "email", needs="@").withColumn("detector", F.lit("regex"))
    kept = D.dedup_spans(found, ["doc_id", "lang"])
    return kept.groupBy("lang", "type").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"), F.countDistinct(F.lower("value")).alias("addresses"))


@query()
def detect_documents(t: Tables) -> DataFrame:
    """All pattern detectors over whole texts, deduplicated: exact in look-around patterns that the oracle's engine lacks."""
    found = D.dedup_spans(D.detect(t("documents"), ["doc_id"], "text"), ["doc_id"])
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("spans"), F.min("a").alias("first"))


@query()
def detect_ocr_documents(t: Tables) -> DataFrame:
    return D.dedup_spans(D.detect(t("documents"), ["doc_id"], "text", S.Detect(ocr=True, urls_other=False)), ["doc_id"]).select("doc_id", "type", "a", "b")


@query(r"""SELECT conv_id, count(*) AS turns, count(*) FILTER (regexp_matches(text, '[0-9]{9}')) AS digit_turns, count(*) FILTER (contains(text, '@')) AS at_turns,
       sum(length(text)) AS chars FROM conversations GROUP BY conv_id""")
def conversation_scan(t: Tables) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("text").rlike("[0-9]{9}")).alias("digit_turns"), F.count_if(F.col("text").contains("@")).alias("at_turns"), F.sum(F.length("text")).alias("chars"))


@query(r"""SELECT doc_id, CAST(line AS INT) AS line, CAST(a AS INT) AS a, CAST(a + length(s) AS INT) AS b FROM (
    SELECT doc_id, i - 1 AS line, p[i] AS s, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x) + 1)), 0) AS a FROM (
      SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))""")
def text_lines(t: Tables) -> DataFrame:
    return D.lines_of(t("documents"), ["doc_id"], "text").select("doc_id", "line", "a", "b")


# ---- folding and counting -------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(lower(strip_accents(regexp_replace(replace(text, 'ß', 's'), '[ \\t\\n\\r\\f\\v]', ' ', 'g')))) AS folded FROM documents")
def fold_text(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2(T.fold("text"), 256).alias("folded"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS words, len(list_distinct(regexp_extract_all(lower(strip_accents(replace(text, 'ß', 'ss'))), '[a-z]+'))) AS distinct_words FROM documents")
def token_counts(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")).alias("words"), F.size(F.array_distinct(F.regexp_extract_all(T.norm("text"), F.lit("[a-z]+"), F.lit(0)))).alias("distinct_words"))


@query("""SELECT id, list_aggregate(list_transform(string_split(text, ' '), lambda w: CASE WHEN 2 * length(regexp_replace(w, '[^0-9]', '', 'g')) >= length(w) THEN translate(w, 'OoDQlI|SBZ', '0000111582') ELSE w END), 'string_agg', ' ') AS read FROM (
      SELECT id, 'cod ' || replace(replace(value, '0', 'O'), '1', 'l') || ' BOLD ' || CAST(body AS STRING) || 'SB' AS text FROM {syn_rut})""")
def ocr_confusion_fold(t: Tables) -> DataFrame:
    text = F.concat(F.lit("cod "), F.translate("value", "01", "Ol"), F.lit(" BOLD "), F.col("body").cast("string"), F.lit("SB"))
    return t("syn_rut").select("id", T.ocr_variant(text).alias("read"))


@query("SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9]{1,6})$', 1)) AS suffix, regexp_extract(url, '[^/]*$') AS base FROM pages")
def file_names(t: Tables) -> DataFrame:
    clean = F.regexp_replace("url", r"[?#].*$", "")
    return t("pages").select("page_id", T.safe_suffix(clean).alias("suffix"), F.regexp_extract("url", "[^/]*$", 0).alias("base"))


# ---- identifiers ----------------------------------------------------------------------------------------------------


@query("SELECT id, CASE n WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(n AS VARCHAR) END AS dv FROM (SELECT id, 11 - (" + " + ".join(f"{digit('body', k)} * {2 + k % 6}" for k in range(9)) + ") % 11 AS n FROM {syn_rut})")
def rut_check_digit(t: Tables) -> DataFrame:
    return t("syn_rut").select("id", T.check_digit(F.col("body").cast("string")).alias("dv"))


@query("SELECT id, value, valid FROM {syn_rut}")
def rut_validate(t: Tables) -> DataFrame:
    return t("syn_rut").select("id", "value", T.rut_is_valid("value").alias("valid"))


@query("SELECT id, value AS written, form <> 4 OR length(CAST(body AS VARCHAR)) BETWEEN 7 AND 9 AS shaped FROM {syn_rut}")
def rut_formats(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ["dots", "no_dots", "spaced_hyphen", "en_dash", "no_hyphen", "commas", "inner_spaces"]))
    own = t("syn_rut").withColumn("written", T.format_rut("body", "dv", F.element_at(names, (F.col("form") + 1).cast("int"))))
    return own.select("id", "written", T.rut_shape("written").alias("shaped"))


@query("SELECT id, CASE WHEN length(CAST(body AS VARCHAR)) BETWEEN 6 AND 9 THEN CAST(body AS VARCHAR) || dv END AS key FROM {syn_rut}")
def rut_key(t: Tables) -> DataFrame:
    return t("syn_rut").select("id", T.rut_key("value").alias("key"))


@query("SELECT id, NOT valid AS doubtful FROM {syn_rut}")
def rut_doubt_flags(t: Tables) -> DataFrame:
    return t("syn_rut").select("id", F.coalesce(S.rut_doubt("text"), F.lit(False)).alias("doubtful"))


@query("""SELECT id, form = 4 AND NOT valid AND NOT labelled AND regexp_matches(value, '^[0-9]{6,9}[0-9K]$') AND NOT regexp_matches(value, '^[2-9][0-9]{8}$') AND NOT regexp_matches(value, '^600[0-9]{7}$')
      AND NOT regexp_matches(value, '^56[2-9][0-9]{8}$') AND NOT regexp_matches(value, '^0[2-9][0-9]{8}$') AS suggested FROM {syn_rut}""")
def rut_suggested(t: Tables) -> DataFrame:
    a = F.instr("text", F.col("value")) - 1
    own = t("syn_rut").withColumn("a", a).withColumn("b", F.col("a") + F.length("value"))
    return own.select("id", S.rut_suggested("text", F.col("a"), F.col("b")).alias("suggested"))


@query("SELECT id, a, CAST(a + length(value) AS INT) AS b, value, valid FROM (SELECT *, CAST(CASE WHEN labelled THEN 8 ELSE 10 END AS INT) AS a FROM {syn_rut})")
def rut_spans(t: Tables) -> DataFrame:
    own = t("syn_rut").select("id", "text", F.explode(S.rut_spans("text")).alias("s"))
    return own.select("id", "s.a", "s.b", "s.value", T.rut_is_valid("s.value").alias("valid"))


# ---- phones ---------------------------------------------------------------------------------------------------------


@query("""SELECT id, CASE WHEN length(d) BETWEEN 8 AND 10 THEN d END AS key FROM (SELECT id, CASE WHEN length(e) = 10 AND e LIKE '0%' THEN substr(e, 2) ELSE e END AS d FROM (
      SELECT id, CASE WHEN r LIKE '0056%' THEN substr(r, 5) WHEN r LIKE '56%' AND length(r) >= 10 THEN substr(r, 3) ELSE r END AS e FROM (SELECT id, regexp_replace(value, '[^0-9]', '', 'g') AS r FROM {syn_phone})))""")
def phone_key(t: Tables) -> DataFrame:
    return t("syn_phone").select("id", T.phone_key("value").alias("key"))


@query("""SELECT id, CASE form WHEN 0 THEN '+56 9 ' || a || ' ' || b WHEN 1 THEN '+569' || a || b WHEN 2 THEN '9 ' || a || ' ' || b WHEN 3 THEN '9' || a || ' ' || b WHEN 4 THEN '(+56) 9 ' || a || ' ' || b
      WHEN 5 THEN '+56-9-' || a || '-' || b WHEN 6 THEN '09-' || a || ' ' || b ELSE a || ' ' || b END AS written FROM (SELECT id, form, substr(national, 2, 4) AS a, substr(national, 6, 4) AS b FROM {syn_phone})""")
def phone_formats(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, list(T.PHONE_FORMS)[:8]))
    return t("syn_phone").select("id", T.format_phone("national", F.element_at(names, (F.col("form") + 1).cast("int"))).alias("written"))


@query("SELECT id, CASE WHEN id % 11 = 0 THEN 1 WHEN form = 6 THEN 0 ELSE 1 END AS phones FROM {syn_phone}")
def phone_rule(t: Tables) -> DataFrame:
    return t("syn_phone").select("id", F.size(S.phone_spans(F.concat(F.lit("llamar al "), "value", F.lit(".")))).alias("phones"))


@query("SELECT id, id % 3 <> 2 OR regexp_matches(substr(text, a + 1, b - a), '^[0-9]{1,3}(\\.[0-9]{3}){2,}(,[0-9]+)?$') AS amount FROM {syn_amount}")
def amount_guard(t: Tables) -> DataFrame:
    return t("syn_amount").select("id", T.is_amount("text", F.col("a"), F.col("b")).alias("amount"))


@query("""SELECT id, CASE WHEN lower(value) LIKE '%k%' OR form <> 4 THEN CASE WHEN length(k) BETWEEN 7 AND 10 THEN k END WHEN length(k) BETWEEN 7 AND 10 THEN k END AS rut,
      CASE WHEN lower(value) LIKE '%k%' OR form NOT IN (4) THEN NULL WHEN length(p) BETWEEN 8 AND 10 THEN p END AS phone FROM (
      SELECT *, CASE WHEN length(e) = 10 AND e LIKE '0%' THEN substr(e, 2) ELSE e END AS p FROM (SELECT id, form, value, CAST(body AS VARCHAR) || dv AS k,
      CASE WHEN (CAST(body AS VARCHAR) || dv) LIKE '56%' AND length(CAST(body AS VARCHAR) || dv) >= 10 THEN substr(CAST(body AS VARCHAR) || dv, 3) ELSE CAST(body AS VARCHAR) || dv END AS e FROM {syn_rut}))""")
def exception_parse(t: Tables) -> DataFrame:
    own = t("syn_rut").select("id", T.parse_exception("value").alias("p"))
    return own.select("id", "p.rut", "p.phone")


# ---- links ----------------------------------------------------------------------------------------------------------


@query("SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (url LIKE 'https%') AS secure FROM pages GROUP BY 1")
def url_host_class(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return t("pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_if(F.col("url").startswith("https")).alias("secure"))


@query("SELECT key, count(*) AS pages FROM (SELECT unnest(regexp_extract_all(url, '[?&]([A-Za-z_]+)=', 1)) AS key FROM pages) GROUP BY key")
def url_query_keys(t: Tables) -> DataFrame:
    return t("pages").select(F.explode(F.regexp_extract_all("url", F.lit("[?&]([A-Za-z_]+)="), F.lit(1))).alias("key")).groupBy("key").agg(F.count("*").alias("pages"))


_OTHER_LINKS = ["https://www.linkedin.com/in/x", "https://host.example.org/a?b=1&user=ana", "https://host.example.org/a?b=1&size=2", "http://x.cl/?correo=z"]


@query("""SELECT page_id, kind, regexp_matches(u, '(?i)(""" + "|".join(h.replace(".", "\\.") for h in S.PERSONAL_HOSTS) + ")|[?&](" + "|".join(S.PERSONAL_KEYS) + """)=') AS personal FROM (
      SELECT page_id, 'page' AS kind, regexp_replace(url, '[0-9]', '', 'g') AS u FROM pages UNION ALL SELECT page_id, 'other', ([""" + ", ".join(f"'{x}'" for x in _OTHER_LINKS) + """])[page_id % 4 + 1] FROM pages)""")
def url_personal(t: Tables) -> DataFrame:
    """Every link of the table, and links of known kinds."""
    own = t("pages").select("page_id", F.lit("page").alias("kind"), F.regexp_replace("url", "[0-9]", "").alias("u"))
    other = F.element_at(F.array(*map(F.lit, _OTHER_LINKS)), (F.col("page_id") % 4 + 1).cast("int"))
    return own.unionByName(t("pages").select("page_id", F.lit("other").alias("kind"), other.alias("u"))).select("page_id", "kind", S.is_personal_url("u").alias("personal"))


@query("SELECT page_id, length(url) + 12 AS whole, length(url) AS alone FROM pages")
def url_continuation(t: Tables) -> DataFrame:
    more = F.concat("url", F.lit("\n/resto-largo\nfin"))
    return t("pages").select("page_id", F.length(S.url_spans(more)[0]["value"]).alias("whole_raw"), F.length(S.url_spans(F.concat("url", F.lit("\nfin de linea")))[0]["value"]).alias("alone")).select("page_id", (F.col("whole_raw") - 1).alias("whole"), "alone")


# ---- file types and bytes -------------------------------------------------------------------------------------------


@query("SELECT id, CASE id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN 'image' WHEN 5 THEN 'heic' WHEN 6 THEN 'empty' ELSE 'format' END AS kind, CASE id % 8 WHEN 0 THEN 'pdf' WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 'image' END AS short_kind, CASE id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'tiff' WHEN 4 THEN 'webp' WHEN 5 THEN 'heic' ELSE 'unknown' END AS signature FROM {syn_magic}")
def magic_sniff(t: Tables) -> DataFrame:
    content = F.unhex("h")
    return t("syn_magic").select("id", FS.sniff(content).alias("kind"), FS.sniff_kind(content).alias("short_kind"), FS.format_from_signature(content).alias("signature"))


@query("SELECT doc_id, sha256(text) AS sha, 1 + doc_id % 4 AS revisions, list_sum(list_transform(regexp_extract_all(text, '[ -~]{4,}'), lambda x: length(x))) AS printable FROM documents")
def byte_columns(t: Tables) -> DataFrame:
    content = F.col("text").cast("binary")
    marked = F.concat(content, F.encode(F.repeat(F.lit("\n%%EOF\n"), (F.col("doc_id") % 4 + 1).cast("int")), "UTF-8"))
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7e]{4,}"), F.lit(0))
    total = F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x))
    return t("documents").select("doc_id", F.sha2(content, 256).alias("sha"), FS.revisions(marked).alias("revisions"), F.when(F.size(runs) > 0, total).alias("printable"))


@query()
def byte_texts(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", F.size(FS.byte_texts(F.encode("text", "UTF-16LE"))).alias("texts"))


@query(r"SELECT item_id, 3 AS strings, regexp_replace(text, '[()\\\[\]<>]', ' ', 'g') || 'x' AS first, 'dos' AS last FROM benchmark")
def pdf_syntax_strings(t: Tables) -> DataFrame:
    raw = F.encode(F.concat(F.lit("[("), F.regexp_replace("text", r"[()\\\[\]<>]", " "), F.lit(")-20(x)] TJ (uno) Tj <646F73> Tj")), "ISO-8859-1")
    return t("benchmark").select("item_id", FS.pdf_strings(raw).alias("s")).select("item_id", F.size("s").alias("strings"), F.element_at("s", 1).alias("first"), F.element_at("s", -1).alias("last"))


# ---- masking --------------------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '[0-9]', 'X', 'g')) AS masked FROM documents")
def mask_text(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2(R.mask_pattern("text", "[0-9]", "X"), 256).alias("masked"))


@query("SELECT lang, count(*) AS docs, 0 AS left_after FROM documents GROUP BY lang")
def mask_then_rescan(t: Tables) -> DataFrame:
    """Masking the deduplicated spans leaves none of the patterns that must not leak."""
    masked = t("documents").select("doc_id", "lang", R.mask_detected("text", S.Detect()).alias("masked"))
    left = R.unmarked(masked.select("doc_id", F.col("masked").alias("text")), ["doc_id"]).groupBy("doc_id").agg(F.sum("n").alias("n"))
    return masked.join(left, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("left_after"))


@query("SELECT id, 'x' || repeat(' ', length(substr(text, 2, 6)) ) || substr(text, 8) AS blanked FROM (SELECT c_custkey AS id, 'xABCDEF' || c_name AS text FROM customer)")
def blank_range(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), R.blank(F.concat(F.lit("xABCDEF"), "c_name"), F.lit(1), F.lit(7)).alias("blanked"))


# ---- names ----------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT entry, list_filter(string_split(lower(entry), ' '), lambda x: x <> '') AS w FROM {syn_entry}),
v AS (SELECT entry, unnest(list_distinct(CASE WHEN regexp_matches(entry, '[0-9]') THEN [w] WHEN len(w) >= 3 THEN [w, list_concat(w[-2:], w[1:len(w)-2]), [w[1], w[len(w)-1]], w[-2:]] ELSE [w] END)) AS v FROM w)
SELECT entry, list_aggregate(v, 'string_agg', ' ') AS variant FROM v WHERE NOT regexp_matches(entry, '[0-9]')""")
def name_variants(t: Tables) -> DataFrame:
    own = N.list_variants(t("syn_entry")).where("type = 'name'")
    return own.select("entry", F.array_join("words", " ").alias("variant"))


@query("""WITH w AS (SELECT entry, list_filter(string_split(lower(entry), ' '), lambda x: x <> '') AS w FROM {syn_list} WHERE NOT regexp_matches(entry, '[0-9]')),
v AS (SELECT DISTINCT entry, unnest(CASE WHEN len(w) >= 3 THEN [w, list_concat(w[-2:], w[1:len(w)-2]), [w[1], w[len(w)-1]], w[-2:]] ELSE [w] END) AS v FROM w)
SELECT DISTINCT id, entry FROM {syn_name} n JOIN v ON contains(' ' || lower(n.text) || ' ', ' ' || list_aggregate(v.v, 'string_agg', ' ') || ' ')""")
def name_list_ngram_join(t: Tables) -> DataFrame:
    names = t("syn_list").where(~F.col("entry").rlike("[0-9]"))
    return N.list_matches(t("syn_name"), ["id"], "text", names, known_size=None).select("id", "entry").distinct()


@query("SELECT word, count(*) AS parts FROM (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS word FROM part) WHERE word IN (SELECT unnest(string_split(lower(entry), ' ')) FROM {syn_list} WHERE NOT regexp_matches(entry, '[0-9]')) AND length(word) >= 3 GROUP BY word")
def name_list_semi(t: Tables) -> DataFrame:
    words = t("part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    return words.join(N.list_words(t("syn_list")), "word", "left_semi").groupBy("word").agg(F.count("*").alias("parts"))


#: Lines, and the places of the names in them.
_NAME_LINES = [
    ("Sra. Rosa Parra", [(5, 15)]), ("firma: Camila Soto Vera", [(7, 23)]), ("Santiago Centro", []), ("Rosa Parra Contreras.", [(0, 20)]), ("Rosa Parra", []),
    ("Paz María Soto y Don Santiago", [(0, 14), (21, 29)]), ("Ana Director", []), ("el día en que Camila Soto Vera vino a la oficina fue", []), ("vino don Pedro Soto Vera Paz Luna Sol con ella ayer por la tarde", [(9, 33)]), ("Juan, Pedro Soto", [(6, 16)]),
]


@query("SELECT c_custkey, a, b FROM customer JOIN (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (_, own) in enumerate(_NAME_LINES) for a, b in own) + f") v(i, a, b) ON c_custkey % {len(_NAME_LINES)} = i")
def names_by_dictionary(t: Tables) -> DataFrame:
    line = F.element_at(F.array(*(F.lit(x) for x, _ in _NAME_LINES)), (F.col("c_custkey") % len(_NAME_LINES) + 1).cast("int"))
    return t("customer").select("c_custkey", F.explode(N.dictionary_names(line)).alias("s")).select("c_custkey", "s.a", "s.b")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Ana Soto' WHEN 1 THEN 'Ana Maria Soto' WHEN 2 THEN 'Ana Maria Luz Soto Vera' WHEN 3 THEN 'Soto' ELSE 'Soto Vera' END AS value FROM customer")
def name_expansion(t: Tables) -> DataFrame:
    """Words that are written with a capital and may be names are taken in, on both sides; others stop it."""
    k = F.col("c_custkey")
    around = F.when(k % 5 == 0, "Ana Soto, mayo ").when(k % 5 == 1, "Ana Maria Soto\nVera ").when(k % 5 == 2, "Ana Maria Luz Soto Vera de ").when(k % 5 == 3, "señor de Soto Mayo ").otherwise("Directora Soto Vera Jefe ")
    text = F.concat(F.lit("ante mi, "), around, k.cast("string"))
    at = F.instr(text, F.lit("Soto")) - 1
    a, b = N.expand_name(text, at, at + 4)
    return t("customer").select("c_custkey", F.substring(text, a + 1, b - a).alias("value"))


@query("SELECT name, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT name, sum(q) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS name, p_size AS q FROM part) WHERE regexp_matches(name, '^[a-z]{2,}$') GROUP BY name) QUALIFY n >= 20")
def given_name_counts(t: Tables) -> DataFrame:
    return N.count_names(t("part"), "p_name", "p_size", 20)


# ---- small texts ----------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN v < 0.1 THEN 'menos de 0,1 s' WHEN v < 10 THEN replace(printf('%.1f', v), '.', ',') || ' s' WHEN r < 60 THEN CAST(r AS VARCHAR) || ' s' ELSE CAST(r // 60 AS VARCHAR) || ' min' || CASE WHEN r % 60 > 0 THEN ' ' || CAST(r % 60 AS VARCHAR) || ' s' ELSE '' END END AS text,
      CAST(day(ts) AS VARCHAR) || ' de ' || (['""" + "', '".join(T.MONTHS) + """'])[month(ts)] || ' de ' || CAST(year(ts) AS VARCHAR) AS day FROM (SELECT *, CAST(round_even(v, 0) AS BIGINT) AS r FROM (SELECT event_id, ts, CAST(event_id % 4000 AS DOUBLE) / 2 AS v FROM events))""")
def spanish_texts(t: Tables) -> DataFrame:
    v = (F.col("event_id") % 4000).cast("double") / 2
    return t("events").select("event_id", T.seconds_text(v).alias("text"), T.spanish_date("ts").alias("day"))


@query("SELECT r_regionkey, CASE len(l) WHEN 1 THEN l[1] ELSE list_aggregate(l[1:len(l)-1], 'string_agg', ', ') || ' y ' || l[len(l)] END AS items FROM (SELECT n_regionkey AS r_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)")
def joined_items(t: Tables) -> DataFrame:
    return t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("l")).select("r_regionkey", T.join_items(F.col("l")).alias("items"))


@query("SELECT c_custkey, 'ana.soto@x' || CAST(c_custkey AS VARCHAR) || '.cl' AS dot, 'asoto@x' || CAST(c_custkey AS VARCHAR) || '.cl' AS initial, 'ana.soto [arroba] x' || CAST(c_custkey AS VARCHAR) || '.cl' AS spelled FROM customer")
def email_formats(t: Tables) -> DataFrame:
    domain = F.concat(F.lit("x"), F.col("c_custkey").cast("string"), F.lit(".cl"))
    form = lambda n: T.format_email(F.lit("Ana María"), F.lit("Soto"), domain, F.lit("1990"), F.lit(n))
    return t("customer").select("c_custkey", form("dot").alias("dot"), form("initial").alias("initial"), form("spelled_arroba").alias("spelled"))
