from pyspark.sql import functions as F

from veilspark.plans.engine import Engine, register
from veilspark.plans.packaging import ship


def test_end_to_end(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, 0, "Contacto: Ana María Soto Vera, 12.345.678-5, ana@x.cl"), (1, 1, "Firma ANA MARIA SOTO VERA. Ver https://www.ministerio.cl/doc y fono 600 123 4567"), (2, 0, "sin datos")], "file long, page int, text string")
    names = spark.createDataFrame([("Ana María Soto Vera",)], "entry string")
    e = Engine(spark, "2026-01-01T00:00:00Z")
    found = e.analyze(pages, names, spark.createDataFrame([("600 123 4567",)], "entry string"), list_size=1)
    got = {(r.page, r.type, r.status) for r in found.where("file = 1").collect()}
    assert {(0, "name", "proposed"), (0, "rut", "proposed"), (0, "email", "proposed"), (1, "name", "proposed"), (1, "url", "suggested"), (1, "phone", "suggested")} <= got
    masked, leaks = e.export(pages, found)
    text = {(r.file, r.page): r.text for r in masked.collect()}
    assert "Ana" not in text[1, 0] and "12.345" not in text[1, 0] and "SOTO" not in text[1, 1] and "ministerio" in text[1, 1] and text[2, 0] == "sin datos"
    elements = spark.createDataFrame([(1, 1, "rut", "12.345.678-5"), (1, 2, "url", "https://www.ministerio.cl/doc")], "file long, element int, type string, value string")
    assert {r.element: r.leak for r in e.evaluate(elements, masked).collect()} == {1: False, 2: True}
    assert e.estimate(pages).agg(F.sum("seconds")).first()[0] > 0


def test_sql_functions(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM vs_matches('a1 b22', '[0-9]+')").collect()] == [(1, 2, "1"), (4, 6, "22")]
    assert spark.sql("SELECT vs_norm(' ÁÉ ')").first()[0] == "ae"


def test_layout_feeds_findings(spark):
    """Values beside labels, on their line or in a cell, are findings; an identifier's label without one gives none."""
    ship(spark)
    text = "Nombre: Pedro Pérez\nRUT: pendiente\nDomicilio\nCalle Uno 5\nnada"
    pages = spark.createDataFrame([(1, 0, text)], "file long, page int, text string")
    rows = [(1, 0, i, t, text.index(t), x0, y0, x0 + 60.0, y0 + 12.0, 600.0, 800.0) for i, (t, x0, y0) in enumerate([("Domicilio", 20.0, 100.0), ("Calle Uno 5", 100.0, 100.0), ("nada", 20.0, 300.0)])]
    lines = spark.createDataFrame(rows, "file long, page int, line int, text string, a int, x0 double, y0 double, x1 double, y1 double, width double, height double")
    e = Engine(spark, "2026-01-01T00:00:00Z")
    found = {(r.type, r.value, r.detector) for r in e.analyze(pages, lines=lines).collect()}
    assert found == {("name", "Pedro Pérez", "context"), ("address", "Calle Uno 5", "context")}
