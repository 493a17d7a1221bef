"""Event-time windows and stateful folds, as batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import estimate as EST
from ..operators import review as V


def tumbling(events: DataFrame, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums by window; on a stream, ``late`` is the watermark after which a window is final."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the last value of its key at or before its time: one union and a running last value, so the two
    sides are partitioned once and no pair is made."""
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)}).unionByName(right.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def review_stream(actions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(id, status, applied, refused) after each batch of actions: the state of a finding is its status and counts. Columns of
    ``actions``: id, ts, seq, action, status, optional, first_action (the last three as the finding began)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, ok, no = state.get if state.exists else (None, 0, 0)
        for df in batches:
            for a in df.sort_values(["ts", "seq"]).itertuples(index=False):
                status = status or a.status
                new = next_status(status, bool(a.optional), a.first_action, a.action)
                ok, no, status = (ok + 1, no, new) if new else (ok, no + 1, status)
        state.update((status, ok, no))
        yield pd.DataFrame([(key[0], status, ok, no)], columns=["id", "status", "applied", "refused"])

    return actions.withWatermark("ts", late).groupBy("id").applyInPandasWithState(fold, "id long, status string, applied int, refused int", "status string, applied int, refused int", "update", "NoTimeout")


def next_status(status: str, optional: bool, first: str, action: str) -> str | None:
    """The review's transitions for one row; the batch form is ``review.transition``."""
    active = status not in ("removed", "suggested")
    if action == "remove" and not optional and active:
        return "removed"
    if action == "restore" and status == "removed":
        return "added" if first == "added" else "proposed"
    if action == "apply" and optional and status == "suggested":
        return "proposed"
    if action == "skip" and optional and status == "proposed":
        return "suggested"
    return status if action == "resize" and active else None


def rate_stream(samples: DataFrame, start: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """(stage, rate, samples): the moving average of a stage's rate, kept between batches."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rate, n = state.get if state.exists else (start, 0)
        for df in batches:
            for s in df.sort_values(["ts", "seq"]).itertuples(index=False):
                if s.seconds is None or s.seconds < 0 or s.count <= 0:
                    continue
                ratio = min(EST.MOST_RATIO, max(1 / EST.MOST_RATIO, s.seconds / (rate * s.count)))
                rate, n = min(EST.MOST_RATE, max(EST.LEAST_RATE, rate * (1 + EST.SMOOTHING * (ratio - 1)))), n + 1
        state.update((rate, n))
        yield pd.DataFrame([(key[0], rate, n)], columns=["stage", "rate", "samples"])

    return samples.withWatermark("ts", late).groupBy("stage").applyInPandasWithState(fold, "stage string, rate double, samples int", "rate double, samples int", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str, path: str) -> DataFrame:
    """Run a stream until its input is read, and give its result as a table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
