"""License scan: TF-IDF cosine of text segments to license templates, then inheritance from the nearest directory, with
DataFrame functions only.

A segment is a line, or a sentence of a line, or a sentence over wrapped lines. Apart from these, blocks are compared with
whole headers, titles and short license texts: lines, paragraphs, the text's first 1, 2, .. HEADER_PARAGRAPHS paragraphs
together, and the whole text. Lines with an SPDX identifier state it as it stands. Weights are term counts times ln((1 + texts) / (1 + texts with the term)); a
term outside the templates' vocabulary weighs as one that no text has. For each template, the terms without which no
segment can reach the cosine are known from the weights, so only segments with one of them are compared; that drops
nothing that could match. A text's own license is that of its best segment.

A text whose first segment or block states a license, or that states one anywhere and has a license file's name, is a license
file: it governs its directory and those below. A text without a
license of its own takes that of the nearest directory upwards that has one.

Defined results: null and empty texts have no license of their own, but inherit; ties go to the license first by name,
in a directory to the license with the most license files, then by name; a null path has no directory; rows that repeat a
key share a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import BLOCKS
from .shared import drop_staged, join_groups, staged

COSINE = 0.75
MOST_TEMPLATE_TERMS = 20_000
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
HEADER_PARAGRAPHS = 12
PARAGRAPH_END = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
SENTENCE_END = r"[.!?]\s+|" + PARAGRAPH_END
SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]*[A-Za-z0-9+])"
#: Names of license files.
LICENSE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|copyright|notice)(?:[.\-_][^/]*)?$"
SEGMENT_END = r"[.!?]?[ \t\r]*\n\s*|[.!?][ \t\r]+"

#: Short statements of common licenses, in our own selection.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-clause license"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weights(docs: DataFrame, templates: list[tuple[str, str]]) -> tuple[float, dict[str, float], dict[str, dict[str, float]]]:
    """(weight of an unknown term, weight of each template term, unit vector of each template)."""
    import re

    counts = {name: {} for name, _ in templates}
    for name, statement in templates:
        for t in re.findall(TERM, statement.lower()):
            counts[name][t] = counts[name].get(t, 0) + 1
    vocabulary = sorted({t for own in counts.values() for t in own})
    if len(vocabulary) > MOST_TEMPLATE_TERMS:
        raise ValueError(f"the templates have {len(vocabulary)} terms; at most {MOST_TEMPLATE_TERMS} are broadcast")
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    each = docs.select(F.explode(F.concat(F.array_intersect(terms(F.coalesce(F.col("_text"), F.lit(""))), known), F.array(F.lit("")))).alias("t"))
    df = {r.t: r.n for r in each.groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row per template term at most
    total = df.get("", 0)
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) for t in vocabulary}
    vectors = {}
    for name, own in counts.items():
        w = {t: n * idf[t] for t, n in own.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        if length:
            vectors[name] = {t: x / length for t, x in w.items()}
    return math.log(1 + total), idf, vectors


def anchors(vectors: dict[str, dict[str, float]], cosine: float) -> set[str]:
    """Terms of which a segment must have one to reach ``cosine`` with any template."""
    out = set()
    for own in vectors.values():
        left = 1.0
        for t, x in sorted(own.items(), key=lambda p: (-p[1], p[0])):
            if math.sqrt(max(0.0, left)) < cosine:
                break
            out.add(t)
            left -= x * x
    return out


def _numbered(parts: Column) -> Column:
    return F.transform(parts, lambda s, i: F.struct(i.alias("at"), s.alias("segment")))


def segments(text: Column) -> Column:
    """(at, segment) of the lines and their sentences, then of the sentences that go over lines."""
    over = F.filter(_numbered(F.split(text, SENTENCE_END)), lambda s: F.contains(s["segment"], F.lit("\n")))
    return F.concat(_numbered(F.split(text, SEGMENT_END)), over)


def blocks(text: Column) -> Column:
    """(at, segment) of lines, paragraphs, beginnings and the whole text; ``at`` is 0 for what begins the text."""
    body = F.regexp_replace(text, r"^[^\p{L}\p{N}]+", "")
    parts = F.split(body, PARAGRAPH_END)
    first = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(HEADER_PARAGRAPHS))), lambda n: F.struct(F.lit(0).alias("at"), F.array_join(F.slice(parts, 1, n), "\n\n").alias("segment")))
    whole = F.array(F.struct(F.lit(0).alias("at"), body.alias("segment")))
    return F.array_distinct(F.concat(first, whole, _numbered(parts), _numbered(F.split(body, r"[ \t\r]*\n\s*"))))


def _gate(need: list[str]) -> str:
    """Pattern of any of the terms, which are grouped by their first letter."""
    letters = sorted({t[0] for t in need})
    return r"(?<![a-z0-9])(?:" + "|".join(c + "(?:" + "|".join(t[1:].replace(".", r"\.") for t in need if t[0] == c) + ")" for c in letters) + r")(?![a-z0-9])"


def statements(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, cosine: float = COSINE, text: str = "text", key: str = "doc_id", whole: list[tuple[str, str]] = BLOCKS) -> DataFrame:
    """(k, at, license, cosine): segments and blocks that state a license; ``at`` is 0 for what begins the text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("_text"))
    found = _stated(rows, templates, cosine, segments).unionByName(_stated(rows, [(f"{name}#{i}", x) for i, (name, x) in enumerate(whole)], cosine, blocks))
    lines = rows.where(F.col("_text").rlike(SPDX)).select("k", F.posexplode(F.split(F.regexp_replace("_text", r"^[^\p{L}\p{N}]+", ""), r"\n")).alias("at", "segment"))
    name = F.regexp_replace(F.regexp_extract("segment", SPDX, 1), r"(?i)(?:-only|-or-later|\+)$", "")
    known = {n.lower(): n for n, _ in (*templates, *whole)}
    name = F.coalesce(F.create_map(*(F.lit(x) for p in known.items() for x in p))[F.lower(name)], name) if known else name
    spdx = lines.where(F.col("segment").rlike(SPDX)).select("k", "at", name.alias("license"), F.lit(1.0).alias("cosine"))
    return found.unionByName(spdx).withColumn("license", F.substring_index("license", "#", 1))


def _stated(rows: DataFrame, templates: list[tuple[str, str]], cosine: float, cut: Callable[[Column], Column]) -> DataFrame:
    """(k, at, license, cosine) of the pieces that ``cut`` makes of the texts."""
    spark = rows.sparkSession
    unknown, idf, vectors = _weights(rows, templates)
    need = sorted(anchors(vectors, cosine))
    if not need:
        return spark.createDataFrame([], f"k {rows.schema['k'].dataType.simpleString()}, at int, license string, cosine double")
    gate = _gate(need)
    open_ = rows.where(F.lower("_text").rlike(gate))
    parts = open_.select("k", F.posexplode(cut(F.col("_text"))).alias("u", "p")).select("k", "u", "p.at", "p.segment").where(F.lower("segment").rlike(gate))
    counted = parts.select("k", "u", "at", F.explode(terms(F.col("segment"))).alias("t")).groupBy("k", "u", "at", "t").agg(F.count("*").alias("n"))
    weights = F.broadcast(spark.createDataFrame([(t, w, [(name, own[t]) for name, own in sorted(vectors.items()) if t in own]) for t, w in idf.items()], "t string, w double, own array<struct<license: string, x: double>>"))
    counted = counted.join(weights, "t", "left").withColumn("v", F.col("n") * F.coalesce("w", F.lit(unknown)))
    # one record per segment: its length, and its products with the templates
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(_segment())).alias("length")
    product = counted.select("k", "u", "at", "v", "own", length).select("k", "u", "at", "length", "v", F.explode("own").alias("o"))
    cosines = product.groupBy("k", "u", "at", "o.license", "length").agg((F.sum(F.col("v") * F.col("o.x")) / F.col("length")).alias("cosine"))
    return cosines.where(F.col("cosine") >= cosine).select("k", "at", "license", "cosine")


def _segment():
    from pyspark.sql import Window

    return Window.partitionBy("k", "u")


def parent(path: Column) -> Column:
    """Directory of a path: what stands before the last slash; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(docs: DataFrame, path: str, templates: list[tuple[str, str]] = TEMPLATES, cosine: float = COSINE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, path, license, cosine, basis, license_dir) of each row; basis is own, inherited or none."""
    found = staged(statements(docs, templates, cosine, text, key), "statements")
    best = found.groupBy("k").agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "license")).alias("b"), F.min("at").alias("first"))
    own = best.select("k", F.col("b.license").alias("own"), (-F.col("b.c")).alias("own_cosine"), "first")
    rows = docs.select(F.col(key).alias("k"), F.col(path).alias("p"), parent(F.col(path)).alias("dir"))
    rows = staged(rows.join(own, "k", "left"), "owned")
    drop_staged(found)
    total = rows.count()
    votes = rows.where((F.col("first") == 0) | F.col("p").rlike(LICENSE_FILE)).where("own is not null and dir is not null").groupBy("dir", "own").agg(F.count("*").alias("n"))
    governs = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("g")).select(F.col("dir").alias("up"), F.col("g.own").alias("license"))
    dirs = staged(rows.where("dir is not null").groupBy("dir").agg(F.count("*").alias("files")), "dirs")
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.array_join(F.slice(parts, 1, d), "/"))
    climb = staged(dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up")), "climb")
    below = climb.groupBy("up").agg(F.count("*").alias("below"))
    governs = staged(governs.join(below, "up"), "governs")
    near = join_groups(climb, governs, "up", "below", climb.count()).groupBy("dir").agg(F.max(F.struct(F.length("up").alias("d"), "up", "license")).alias("g"))
    near = staged(dirs.join(near, "dir").select("dir", "files", F.col("g.up").alias("license_dir"), F.col("g.license").alias("inherited")), "near")
    open_ = rows.where("own is null and dir is not null").select("k", "p", "dir")
    takes = join_groups(open_, near, "dir", "files", total)
    kind = "k, p, license, cosine, basis, license_dir".split(", ")
    none = F.lit(None).cast("string")
    left = open_.join(near.select("dir"), "dir", "left_anti").select("k", "p").unionByName(rows.where("own is null and dir is null").select("k", "p"))
    out = rows.where("own is not null").select("k", "p", F.col("own").alias("license"), F.col("own_cosine").alias("cosine"), F.lit("own").alias("basis"), none.alias("license_dir"))
    out = out.unionByName(takes.select("k", "p", F.col("inherited").alias("license"), F.lit(None).cast("double").alias("cosine"), F.lit("inherited").alias("basis"), "license_dir"))
    out = out.unionByName(left.select("k", "p", none.alias("license"), F.lit(None).cast("double").alias("cosine"), F.lit("none").alias("basis"), none.alias("license_dir")))
    return out.select(*kind).withColumnsRenamed({"k": key, "p": path})
