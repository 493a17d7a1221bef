"""The query catalogue: each entry pairs a query on Spark with independent SQL for another engine, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .synth import SYN

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """Base and synthesised tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in SYN:
            used = {b: self(b) for b in BASE if f"{{{b}}}" in SYN[name]}
            return self.spark.sql(SYN[name], **used)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query. In its SQL, ``{syn_x}`` stands for a synthesised table."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        CATALOG[name or build.__name__] = Query(build, None if sql is None else _filled(sql))
        return build

    return add


def _filled(sql: str) -> str:
    for name, text in SYN.items():
        if f"{{{name}}}" in sql:
            for b in BASE:
                text = text.replace(f"{{{b}}}", b)
            sql = sql.replace(f"{{{name}}}", f"({text})")
    return sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import text_queries, join_queries, space_queries, metric_queries, stream_queries, check_queries  # noqa: F401, I001

    return {name: (lambda spark, d, q=q: q.build(Tables(spark, d))) for name, q in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: q.sql for name, q in CATALOG.items() if q.sql}
