"""Static dimensions: detection groups and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Group, default, locked, whether it decides what is searched.
GROUPS = [
    ("patterns", True, True, True), ("urls_personal", True, False, True), ("urls_other", False, False, False), ("names_list", True, False, True), ("names_context", True, False, True),
    ("addresses", True, False, True), ("ocr", True, False, True), ("faces", True, False, True), ("signatures", True, False, True), ("qr", True, False, True),
]
#: Level, shift of the face threshold, how curly a lone stroke must be.
LEVELS = [(1, 0.2, 2.0), (2, 0.1, 1.8), (3, 0.0, 1.6), (4, -0.1, 1.45), (5, -0.2, 1.3)]
DEFAULT_LEVEL = 3


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "grp string, is_default boolean, locked boolean, detection boolean")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, face_shift double, lone_curly double")


def options(given: Column, level: Column) -> Column:
    """struct of all groups and the level: missing keys take their default, unknown keys go, locked groups stay on."""
    flags = [F.lit(True).alias(g) if locked else F.coalesce(F.try_element_at(given, F.lit(g)), F.lit(default)).alias(g) for g, default, locked, _ in GROUPS]
    return F.struct(*flags, F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(level, F.lit(DEFAULT_LEVEL)))).alias("level"))


def unchecked() -> Column:
    """All groups off but the locked ones."""
    return options(F.create_map(*(x for g, _, _, _ in GROUPS for x in (F.lit(g), F.lit(False)))), F.lit(DEFAULT_LEVEL))


def everything() -> Column:
    return options(F.create_map(*(x for g, _, _, _ in GROUPS for x in (F.lit(g), F.lit(True)))), F.lit(DEFAULT_LEVEL))


def reads_pixels(o: str) -> Column:
    return F.col(f"{o}.ocr") | F.col(f"{o}.faces") | F.col(f"{o}.signatures") | F.col(f"{o}.qr")


def face_threshold(base: Column, level: Column) -> Column:
    shift = F.lit(0.0)
    for n, s, _ in LEVELS:
        shift = F.when(level == n, s).otherwise(shift)
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.2), base + shift)), 3)


def not_searched(o: str) -> Column:
    """Names of the groups that are off, in order."""
    return F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"{o}.{g}"), g) for g, _, _, detection in GROUPS if detection))), ", ")
