"""Redaction, review, streams, sources."""

import json
import random

from pyspark.sql import functions as F

from veilspark.operators import estimate as EST
from veilspark.operators import evaluate as E
from veilspark.operators import redact as R
from veilspark.operators import review as V
from veilspark.plans.packaging import ship
from veilspark.plans.session import checkpoints
from veilspark.sources import adapters
from veilspark.sources import files as FS
from veilspark.streaming import events as EV


def test_masked_text_has_no_leaks(spark):
    checkpoints(spark)
    from veilspark.operators import detect as D

    pages = spark.createDataFrame([(1, 0, "Ana 12.345.678-5, a@b.cl\ny +56 9 8123 4567"), (2, 0, "nada")], "file int, page int, text string")
    spans = D.dedup_spans(D.detect(pages, ["file", "page"], "text"), ["file", "page"])
    out, leaks = R.export(pages, spans, ["file", "page"])
    assert leaks.isEmpty()
    text = {r.file: r.text for r in out.collect()}
    assert text[2] == "nada" and text[1].startswith("Ana ") and len(text[1]) == len("Ana 12.345.678-5, a@b.cl\ny +56 9 8123 4567") and "@" not in text[1]


def actions(n=200):
    r = random.Random(3)
    return [(r.randint(0, 9), i, r.choice(["remove", "restore", "apply", "skip", "resize"])) for i in range(n)]


def expected():
    out = {}
    for k in range(10):
        status, ok, no = ("suggested" if k % 3 == 0 else "proposed"), 0, 0
        for i, _, a in actions():
            if i == k:
                new = EV.next_status(status, k % 3 == 0, "added" if k % 4 == 0 else "proposed", a)
                ok, no, status = (ok + 1, no, new) if new else (ok, no + 1, status)
        out[k] = (status, ok, no)
    return out


def tables(spark):
    f = spark.range(10).select("id", F.when(F.col("id") % 3 == 0, "suggested").otherwise("proposed").alias("status"), (F.col("id") % 3 == 0).alias("optional"), F.when(F.col("id") % 4 == 0, "added").otherwise("proposed").alias("first_action"))
    a = spark.createDataFrame([(i, s, x) for i, s, x in actions()], "id long, seq long, action string").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_000_000))
    return f, a


def test_review_fold_equals_interpreter(spark):
    found = {r.id: (r.status, r.applied, r.refused) for r in V.fold_actions(*tables(spark)).collect()}
    assert found == expected()


def test_review_stream_equals_batch(spark, tmp_path):
    ship(spark)
    f, a = tables(spark)
    a.join(f, "id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = EV.read_stream(spark, str(tmp_path / "in"), "id long, seq long, action string, ts timestamp, status string, optional boolean, first_action string")
    out = EV.drain(EV.review_stream(stream), "reviewed", "update", str(tmp_path / "state"))
    last = {r.id: (r.status, r.applied, r.refused) for r in out.collect()}
    assert last == {k: v for k, v in expected().items() if k in last} and len(last) == 10


def test_rate_fold_equals_stream(spark, tmp_path):
    ship(spark)
    rows = [("ocr", i, float(i % 5), 1 + i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "stage string, seq long, seconds double, count int").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_000_000))
    batch = EST.learn(df, ["stage"]).first()
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = EV.read_stream(spark, str(tmp_path / "in"), "stage string, seq long, seconds double, count int, ts timestamp")
    out = EV.drain(EV.rate_stream(s), "rates", "update", str(tmp_path / "state")).first()
    assert abs(batch.rate - out.rate) < 1e-9 and batch.samples == out.samples == 50


def test_learning_moves_by_share(spark):
    work = spark.createDataFrame([("ocr", "scanned_page", 1.0), ("ocr", "region", 0.0), ("faces", "region", 4.0), ("faces", "image_mp", 2.0), ("qr", "image_mp", 1.0)], "stage string, unit string, count double")
    took = spark.createDataFrame([("ocr", 20.0), ("faces", 100.0), ("qr", float("nan")), ("text", 1.0)], "stage string, seconds double")
    new = {(r.stage, r.unit): r.rate for r in EST.learn_once(EST.rates(spark), work, took).collect()}
    old = {(s, u): v for s, own in EST.DEFAULT_RATES.items() for u, v in own.items()}
    estimate = 0.15 * 4 + 0.35 * 2
    moved = {("ocr", "scanned_page"): 10 * (1 + 0.3 * (2 - 1)), ("faces", "region"): 0.15 * (1 + 0.3 * (0.6 / estimate) * (5 - 1)), ("faces", "image_mp"): 0.35 * (1 + 0.3 * (0.7 / estimate) * (5 - 1))}
    assert all(abs(new[k] - moved.get(k, v)) < 1e-9 for k, v in old.items())


def test_windows_on_a_stream(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("x").alias("k"), F.lit(1.0).alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = EV.read_stream(spark, str(tmp_path / "in"), "ts timestamp, k string, value double")
    out = EV.drain(EV.tumbling(s, "10 minutes", ["k"], "1 minute"), "tumbled", "append", str(tmp_path / "state"))
    assert {r.n for r in out.collect()} == {10}


def test_identity_leaks_all_and_oracle_nothing(spark):
    e = spark.createDataFrame([(1, 1, "rut", "12.345.678-5"), (1, 2, "email", "a.b@c.cl")], "file int, element int, type string, value string")
    n = e.select("file", "element", F.explode(E.needles("type", "value")).alias("n")).select("file", "element", "n.*")
    for text, leaks in (("x 12.345.678-5 a.b@c.cl", 2), ("x nada", 0), ("x 12345678 5", 1)):
        hay = E.haystack(spark.createDataFrame([(1, "t", False, text)], "file int, origin string, binary boolean, text string"), ["file"])
        assert E.search(n, hay, ["file"]).select("element").distinct().count() == leaks


def test_manifest_and_report(spark, tmp_path):
    m = {"root": "r", "seed": 1, "name_list": ["A"], "files": [{"id": "f", "path": "a.pdf", "format": "pdf", "category": "c", "expected": "process", "tags": {"k": "v"}, "sha256": "0", "pages": [{"index": 0, "width": 1.0, "height": 2.0, "unit": "pt", "rotation": 0}], "elements": [{"type": "rut", "page": 0, "polygon": [[0, 0], [1, 0], [1, 1]], "value": "1", "level": "base", "layer": "text", "tags": {}, "core": None, "id": "e"}, {"type": "odd", "page": 0, "polygon": [[0, 0]], "value": "1", "level": "base", "layer": "text", "tags": {}, "core": None, "id": "e2"}], "sensitive_metadata": []}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    t = FS.read_manifest(spark, str(tmp_path / "m.json"))
    assert t["files"].count() == 1 and t["elements"].first().polygon[1].x == 1.0
    assert [r.bad for r in FS.unknown_values(t["elements"]).collect()] == [["type", "polygon"]]
    (tmp_path / "r.json").write_text(json.dumps({"system": "s", "results": [{"input": "a.pdf", "redactions": [{"page": 0, "polygon": [[0, 0]], "type": "rut", "score": 1.0, "status": "redact"}], "time_s": 1.0}]}))
    assert FS.read_report(spark, str(tmp_path / "r.json"))["redactions"].count() == 1


def test_folder_scan(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF"), (".b.pdf", b"%PDF"), ("c.txt", b"x"), ("d.png", b""), ("e.heic", b"x")):
        (tmp_path / name).write_bytes(data)
    taken, skipped = FS.scan_folder(spark, str(tmp_path))
    assert [r.name for r in taken.collect()] == ["a.pdf"]
    assert {r.reason for r in skipped.collect()} >= {"format", "heic"}


def test_adapter_contract(spark):
    ship(spark)
    assert "lines" in adapters.missing()
    import pandas as pd

    def decoder(batches):
        for df in batches:
            if df["content"].iloc[0] == b"bad":
                raise ValueError("x")
            yield pd.DataFrame({"file": df["file"], "location": "info", "text": "t"})

    adapters.register("metadata", decoder)
    files = spark.createDataFrame([("a", b"good"), ("b", b"good"), ("c", b"bad")], "file string, content binary")
    rows = {r.file: (r.text, r.error) for r in adapters.decode(files, "metadata").collect()}
    assert rows["a"] == rows["b"] == ("t", None) and rows["c"][1].startswith("corrupt")
