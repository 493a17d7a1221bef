"""Sessions and shared folders."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .stage import shared_dir


def session(app: str = "veilspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; other settings come from the cluster or ``conf``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if "spark.master" not in conf:
        builder = builder.master(f"local[{cores}]")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable, in the folder that executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
