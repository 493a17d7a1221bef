"""Tables written in the folder that all executors share, so that long jobs restart from files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, as in tests, and the session is local, a local one
    is made and set; on a cluster that is an error, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_CLEARED: set[str] = set()
#: Paths staged in each open ``staged_alone``.
_OPEN: list[list[str]] = []


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veilspark/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: later stages restart from its files, whatever executor is lost.
    What an application has staged is deleted when its Python driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _CLEARED:
        _CLEARED.add(app)
        atexit.register(clear_shared, spark)
    path = f"{_place(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    df.write.mode("errorifexists").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``build`` gives, staged; all that was staged for it is deleted."""
    _OPEN.append([])
    try:
        out = staged(build(), name)
    finally:
        made = _OPEN.pop()
    for path in made[:-1]:
        _delete(out.sparkSession, path)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now; it acts when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application has staged."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        _delete(spark, _place(spark))
