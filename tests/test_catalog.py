"""Every catalogue query on the smallest data, against its SQL where it has one."""

import datetime
import decimal
import os

import pytest

from veilspark.plans import catalog
from veilspark.plans.packaging import ship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in catalog.BASE:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


#: Queries that SQL cannot express, and the test that compares their operator with a plain definition.
BRUTE = {
    "detect_documents": "test_detect_documents", "detect_ocr_documents": "test_detect_documents", "byte_texts": "test_byte_texts", "face_box_fixpoint": "test_fixpoint_leaves_no_pair_to_merge",
    "image_regions": "test_fixpoint_leaves_no_pair_to_merge", "zone_merge_greedy": "test_zone_merge_in_order", "label_places": "test_labels_do_not_meet",
}


def test_every_query_is_checked():
    import test_brute

    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without == set(BRUTE) and all(callable(getattr(test_brute, t)) for t in BRUTE.values())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    ship(spark)
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows and name in BRUTE
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_native_queries_run_no_python(spark):
    for name in ("email_by_lang", "span_dedup_window", "rut_validate", "review_fold", "recall_grouping_sets", "benchmark_leaks", "grid_box_join"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_branches_of_groups_that_are_off_are_not_built(spark):
    from veilspark.functions.spans import Detect, detect_spans

    df = spark.createDataFrame([("x",)], "text string")
    plan = df.select(detect_spans("text", Detect(urls_personal=False, urls_other=False)))._jdf.queryExecution().optimizedPlan().toString()
    assert "https" not in plan
