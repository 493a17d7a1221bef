"""Corpus pipeline: five stages, each on all that the one before kept.

Stages hand on the columns of ``documents``; the last gives each document's shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontamination, language_id, minhash, mixing, sharding
from veilspark.llm.shared import numbered, staged, staged_alone
from veilspark.plans.packaging import ship

SHARD_BYTES = 4 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set the language that the text itself shows; texts in which none can be told go: null and empty texts, and those without
    a letter. The labels are learned from; where there are none, no language can be told, and all rows go. Repeated rows
    each stay or go alike. An empty table gives an empty result; further columns, whatever their names, are handed on."""
    ship(spark)
    found = language_id.with_language(docs, language_id.fit(docs)).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return found.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (five words, similarity 0.8 or more): the one with the smallest id, null last.
    Of equal rows, and of rows that repeat an id with texts that are alike, one stays. Null and empty texts, and those
    without a word, are in no group and all stay. Further columns are handed on."""
    ship(spark)
    rows = numbered(docs)
    named = rows.select("id", F.col("row").getField("doc_id").alias("k"), F.col("row").getField("text").alias("text"))
    groups = staged_alone(lambda: minhash.near_groups(named, key="id").select("id", "component_id"), "near-groups")
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(groups.join(several, "component_id").join(named.select("id", "k"), "id"), "near-members")
    rank = F.struct(F.col("k").isNull().alias("none"), "k", "id")
    first = members.groupBy("component_id").agg(F.min(rank).alias("r")).select(F.col("r.id").alias("id"))
    gone = staged(members.select("id").join(first, "id", "left_anti"), "near-duplicates")
    return rows.join(gone, "id", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a benchmark item. Null and empty texts hold none; rows with one id but different texts are judged
    each; repeated rows stay or go alike; without items all rows stay. Further columns are handed on."""
    ship(spark)
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to weights 1, 2, 3, repeating, at the size there is; a row stands as often as the mix takes it. Null, empty
    and wordless texts take nothing and go; a null source is a source; rows with null or repeated ids are each taken as
    rows of their own. Further columns are handed on."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign every row to a shard of at most SHARD_BYTES. Null texts count no bytes; rows of one id, null included, share a
    shard, which is oversized if they alone exceed the limit. An empty table gives an empty result."""
    return sharding.shards(docs, SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Language detection, latent retrieval and MinHash are not expressible in SQL; a brute-force version is in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
