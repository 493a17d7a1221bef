"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Each normalised text is cut where its own characters say so, each chunk is reduced to an identifier that is verified
against the chunk's SHA-256 and length over the whole corpus, and two texts are equal when their ordered identifier
lists are equal. A text is read once and never shuffled: what moves is its list, 8 bytes for about a thousand characters.

Defined results: null text counts as empty; empty texts (and texts of white space only) form one group; ties go to the
smallest doc_id; repeated rows count as group members; an empty table gives an empty result; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, join_groups, staged

WHITE_SPACE = r"[\x20\x09-\x0D]+"
LEAST, MOST = 256, 4096
#: A cut follows these four character classes in a row: about one place in a few hundred of Latin prose. Texts without
#: such places are cut every MOST characters.
ANCHOR = "[aeiouáéíóúàèäöü][nrstlNRST][aeiouAEIOU][bcdfghmpwBCDFGHM ]"
CHUNK = rf"(?s).{{{LEAST},{MOST - 4}}}?{ANCHOR}|.{{1,{MOST}}}"


def chunk_recipes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, text_sha256, chunks): chunks is the ordered array of (id, sha, size) of the normalised text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    normal = docs.select(F.col(key).alias(key), F.length(raw).alias("n_chars"), F.regexp_replace(raw, WHITE_SPACE, "").alias("_normal"))
    cut = F.regexp_extract_all("_normal", F.lit(CHUNK), F.lit(0))
    named = F.transform(cut, lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("sha"), F.length(c).alias("size")))
    return normal.select(key, "n_chars", F.sha2("_normal", 256).alias("text_sha256"), named.alias("chunks"))


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """One row per distinct chunk: (id, sha, size, ordinal, uses). ordinal is 0 unless several contents share an id."""
    one = recipes.select(F.explode("chunks").alias("c")).groupBy("c.id", "c.sha", "c.size").agg(F.count("*").alias("uses"))
    packed = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sha", "size", "uses"))).alias("all"))  # one entry, but for collisions
    return packed.select("id", F.posexplode("all").alias("ordinal", "c")).select("id", "c.sha", "c.size", "ordinal", "c.uses")


def verified_lists(recipes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Recipes with ``ids``, the ordered list of verified identifiers. Where contents share an id, the identifier is a
    hash of id and ordinal for all but the first content; such chunks are looked up by content digest, all others keep id."""
    ids: Column = F.transform("chunks", lambda c: c["id"])
    clash = staged(chunk_dictionary(recipes).where("ordinal > 0").select("id", "sha", "size", "ordinal"), "clash")
    if clash.isEmpty():
        return recipes.withColumn("ids", ids)
    placed = recipes.select(key, F.monotonically_increasing_id().alias("_row"), "n_chars", "text_sha256", F.posexplode_outer("chunks").alias("_at", "_c"))
    placed = placed.select("*", F.col("_c.id").alias("id"), F.col("_c.sha").alias("sha"), F.col("_c.size").alias("size"))
    named = placed.join(clash, ["id", "sha", "size"], "left").withColumn("_id", F.when(F.col("ordinal").isNull(), F.col("id")).otherwise(F.xxhash64("id", "ordinal")))
    lists = named.groupBy("_row").agg(*(F.first(c).alias(c) for c in (key, "n_chars", "text_sha256")), F.array_sort(F.collect_list(F.struct("_at", "_id"))).alias("_l"))
    return lists.select(key, "n_chars", "text_sha256", F.filter(F.transform("_l", lambda x: x["_id"]), lambda x: x.isNotNull()).alias("ids"))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: (key, keep_id, group_size, kept, text_sha256, n_chunks)."""
    recipes = staged(chunk_recipes(docs, text, key), "recipes")
    lists = staged(verified_lists(recipes, key), "lists")
    drop_staged(recipes)
    total = lists.count()
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col(key).alias("k")))
    groups = lists.groupBy("ids").agg(best.alias("_best"), F.count("*").alias("group_size"))
    groups = staged(groups.select("ids", F.col("_best.k").alias("keep_id"), "group_size"), "groups")
    found = join_groups(lists, groups, "ids", "group_size", total)
    return found.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("ids").alias("n_chunks"))
