"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, language_id, license_texts, licenses, minhash, mixing, quality, repeats, sharding, token_counts

BYTE_LIMIT = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = minhash.Similarity(words=3, num=85, den=100)
    return minhash.near_groups(table(spark, sf_dir, "documents"), like)


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.fold(F.col("doc_id"), 3) == 1)
    model = language_id.fit(docs.where("not held_out"))
    return language_id.detect(docs, model, keep=("held_out",))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = mixing.fair_queue(table(spark, sf_dir, "documents"))
    return queue.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "finish")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has no paths: its sources are taken as top directories, languages and id ranges as lower ones."""
    place = F.when(F.col("doc_id") % 64 == 0, F.lit("")).when(F.col("doc_id") % 8 == 0, F.concat(F.lit("/"), "lang"))
    place = F.coalesce(place, F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.expr("doc_id div 64")))
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat("source", place, F.lit("/"), "doc_id"))
    return licenses.scan(docs, "path").withColumn("cosine", F.round("cosine", 6))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), BYTE_LIMIT)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.fold(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(language_id.fold(F.col("doc_id"), 4) != 2))
    return quality.score(docs, weights, keep=("held_out",)).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash_dedup, op2_repeated_strings, op3_decontamination, op4_language_id, op5_token_counts, op6_mix_sources, op7_license_scan, op8_shards, op9_quality, op10_exact_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scan": op7_sql(), "op10_exact_dedup": OP10_SQL}


def _values(templates: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', {}, '{}')".format(n, i, t.lower().replace("'", "''")) for i, (n, t) in enumerate(templates))


def op7_sql() -> str:
    """Every piece of every text is compared with every template, without the terms that let the operator skip pieces."""
    word = r"[a-z0-9]+(?:\.[0-9]+)*"
    blank = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
    spdx = r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]*[A-Za-z0-9+])"
    known = sorted({n for n, _ in (*licenses.TEMPLATES, *license_texts.BLOCKS)})
    return rf"""
WITH tpl(kind, license, i, s) AS (SELECT 'short', * FROM (VALUES {_values(licenses.TEMPLATES)}) UNION ALL SELECT 'whole', * FROM (VALUES {_values(license_texts.BLOCKS)})),
tt AS (SELECT kind, license, i, t, count(*) AS n FROM (SELECT kind, license, i, unnest(regexp_extract_all(s, '{word}')) AS t FROM tpl) GROUP BY ALL),
d AS (SELECT doc_id, text, regexp_replace(text, '^[^\p{{L}}\p{{N}}]+', '') AS body, CASE WHEN doc_id % 64 = 0 THEN source WHEN doc_id % 8 = 0 THEN source || '/' || lang
      ELSE source || '/' || lang || '/' || (doc_id // 64) END AS dir FROM documents),
total AS (SELECT count(*) AS n FROM d),
df AS (SELECT t, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{word}')) AS t FROM d) WHERE t IN (SELECT t FROM tt) GROUP BY t),
idf AS (SELECT kind, t, ln((1 + (SELECT n FROM total)) / (1 + coalesce(df.n, 0))) AS w FROM (SELECT DISTINCT kind, t FROM tt) LEFT JOIN df USING (t)),
tw AS (SELECT kind, license, i, t, n * w / sqrt(sum(n * w * n * w) OVER (PARTITION BY kind, license, i)) AS x FROM tt JOIN idf USING (kind, t)),
p AS (SELECT doc_id, string_split_regex(text, '[.!?]?[ \t\r]*\n\s*|[.!?][ \t\r]+') AS lines, string_split_regex(text, '[.!?]\s+|{blank}') AS sentences, body,
      string_split_regex(body, '{blank}') AS paragraphs, string_split_regex(body, '[ \t\r]*\n\s*') AS body_lines FROM d WHERE text IS NOT NULL),
piece AS (
  SELECT doc_id, 'short' AS kind, 'l' AS cut, generate_subscripts(lines, 1) - 1 AS u, u AS pos, unnest(lines) AS s FROM p
  UNION ALL SELECT * FROM (SELECT doc_id, 'short', 's', generate_subscripts(sentences, 1) - 1 AS u, u, unnest(sentences) AS s FROM p) WHERE contains(s, chr(10))
  UNION ALL SELECT doc_id, 'whole', 'b', generate_subscripts(body_lines, 1) - 1 AS u, u, unnest(body_lines) FROM p
  UNION ALL SELECT doc_id, 'whole', 'p', generate_subscripts(paragraphs, 1) - 1 AS u, u, unnest(paragraphs) FROM p
  UNION ALL SELECT doc_id, 'whole', 'f', k, 0, array_to_string(paragraphs[1:k], chr(10) || chr(10)) FROM p, range(1, {licenses.HEADER_PARAGRAPHS} + 1) r(k) WHERE k <= len(paragraphs)
  UNION ALL SELECT doc_id, 'whole', 'w', 0, 0, body FROM p),
st AS (SELECT doc_id, kind, cut, u, pos, t, count(*) AS n FROM (SELECT doc_id, kind, cut, u, pos, unnest(regexp_extract_all(lower(s), '{word}')) AS t FROM piece) GROUP BY ALL),
sv AS (SELECT doc_id, kind, cut, u, pos, t, n * coalesce(w, (SELECT ln(1 + n) FROM total)) AS v FROM st LEFT JOIN idf USING (kind, t)),
sn AS (SELECT doc_id, kind, cut, u, sqrt(sum(v * v)) AS len FROM sv GROUP BY ALL),
c AS (SELECT doc_id, pos, license, sum(v * x) / any_value(len) AS cosine FROM sv JOIN tw USING (kind, t) JOIN sn USING (doc_id, kind, cut, u) GROUP BY doc_id, kind, cut, u, pos, license, i HAVING sum(v * x) / any_value(len) >= {licenses.COSINE}
  UNION ALL SELECT doc_id, pos, coalesce(list_filter({known}, lambda k: lower(k) = lower(name))[1], name), 1.0 FROM (SELECT doc_id, pos, regexp_replace(regexp_extract(s, '(?i){spdx}', 1), '(?i)(?:-only|-or-later|\+)$', '') AS name
    FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS s FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM d)) WHERE regexp_matches(s, '(?i){spdx}'))),
own AS (SELECT doc_id, first(license ORDER BY round(cosine, 9) DESC, license) AS own, max(cosine) AS cosine, min(pos) AS f FROM c GROUP BY ALL),
r AS (SELECT d.doc_id, d.dir, own, cosine, f FROM d LEFT JOIN own USING (doc_id)),
votes AS (SELECT dir, own, count(*) AS n FROM r WHERE f = 0 GROUP BY ALL),
gov AS (SELECT dir AS up, first(own ORDER BY n DESC, own) AS license FROM votes GROUP BY ALL),
inh AS (SELECT doc_id, first(up ORDER BY length(up) DESC) AS license_dir, first(license ORDER BY length(up) DESC) AS license FROM r JOIN gov ON dir = up OR starts_with(dir, up || '/') WHERE own IS NULL GROUP BY ALL)
SELECT doc_id, dir || '/' || doc_id AS path, coalesce(own, inh.license) AS license, round(cosine, 6) AS cosine,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN inh.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis, license_dir
FROM r LEFT JOIN inh USING (doc_id)
"""


OP10_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n_cp DESC, doc_id) AS k, count(*) OVER (PARTITION BY t) AS group_size,
      first_value(doc_id) OVER (PARTITION BY t ORDER BY n_cp DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""
