"""Sinks: audits, manifests, redaction reports, evaluations and rates, as files that must not exist yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import markdown


def _new_folder(df: DataFrame, folder: str, name: str) -> str:
    """folder/name, or folder/name (2) and so on: the first that does not exist. Spark refuses to write into one that appears
    in between."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 1
    while fs.exists(path(own := f"{folder}/{name}" if n == 1 else f"{folder}/{name} ({n})")):
        n += 1
    return own


def write_audit(records: DataFrame, folder: str, as_of: str) -> str:
    """One JSON line for each file's audit record (file, record), in a folder named by the time."""
    own = _new_folder(records, folder, "audit-" + "".join(c for c in as_of if c.isalnum()))
    records.select(F.col("record").alias("value")).write.text(own)
    return own


def save_manifest(tables: dict[str, DataFrame], path: str, root: str, seed: int) -> None:
    """Ground truth (files, pages, elements, metadata, name_list, as ``read_manifest`` gives them) as one JSON document. The
    ground truth of a test bench is made by hand or by a generator, so it is one row; corpora stay tables."""
    pairs = lambda c: F.transform(c, lambda p: F.array(p["x"], p["y"]))
    pages = tables["pages"].groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("index"), "width", "height", "unit", "rotation"))).alias("pages"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.struct("type", "page", pairs("polygon").alias("polygon"), "value", "level", "layer", pairs("core").alias("core"), "id").alias("e"))))
    elements = tables["elements"].groupBy("file_id").agg(F.transform(ordered, lambda x: x["e"]).alias("elements"))
    metadata = tables["metadata"].groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "location", "value"))).alias("sensitive_metadata"))
    files = tables["files"].join(pages, "file_id", "left").join(elements, "file_id", "left").join(metadata, "file_id", "left")
    record = F.struct(F.col("file_id").alias("id"), "path", "format", "category", "expected", "tags", "sha256", "pages", "elements", "sensitive_metadata")
    names = tables["name_list"].agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("name_list"))
    in_order = F.array_sort(F.collect_list(F.struct("seq", record.alias("f"))), lambda x, y: F.when(x["seq"] < y["seq"], -1).otherwise(1))
    listed = files.agg(F.transform(in_order, lambda x: x["f"]).alias("files"))
    both = listed.join(F.broadcast(names), F.lit(True))  # one row each
    both.select(F.lit(root).alias("root"), F.lit(seed).alias("seed"), "files", "name_list").coalesce(1).write.mode("errorifexists").json(path)


def save_report(results: DataFrame, redactions: DataFrame, path: str, system: str) -> None:
    """A redaction report as JSON lines, one for each file: (input, output, error, time_s, redactions)."""
    own = redactions.groupBy("input").agg(F.collect_list(F.struct("page", "polygon", "type", "detector", "text", "score", "status")).alias("redactions"))
    results.join(own, "input", "left").withColumn("system", F.lit(system)).write.mode("errorifexists").json(path)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """An evaluation: each table as JSON lines, and small ones together as a Markdown document."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    text = "\n".join(markdown(df, name) for name, df in tables.items())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/markdown")


def save_rates(rates: DataFrame, path: str) -> None:
    """The cost model's rates, a table of fixed size."""
    rates.select("stage", "unit", "rate").coalesce(1).write.mode("overwrite").json(path)
