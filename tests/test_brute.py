"""Operators whose results SQL cannot express, against plain definitions; and cases of rules that must hold."""

import random
import re
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.functions import text as T
from veilspark.operators import detect as D
from veilspark.operators import document as DOC
from veilspark.operators import evaluate as E
from veilspark.operators import merge as M
from veilspark.operators import names as N
from veilspark.operators import review as V
from veilspark.plans.packaging import ship
from veilspark.sources import files as FS
from veilspark.sources import metadata as MD
from veilspark.sources import sinks

WORDS = "acta casa lugar tarde mesa obra plaza firma norte valle junto siempre".split()
#: What detectors must find whole, by type; ``ocr`` only as character recognition reads it.
ITEMS = {
    "rut": ["12.345.678-5", "7654321-6", "12.345.678 - 5", "11.111.111–1", "123456785", "12,345,678-5", "12 345 678-K"],
    "email": ["ana.soto@correo.cl", "a_b+c@x-y.gob.cl", "ANA.SOTO@X.CL", "ana.soto [arroba] x.cl", "ana(at)x.cl", "ana @ x.cl", "ana＠x.cl"],
    "phone": ["+56 9 8123 4567", "+56981234567", "600 123 4567", "0056981234567", "22-3456789"],
    "url": ["https://www.x.cl/a?b=1", "www.facebook.com/ana"],
}
OCR_ITEMS = ["12.345.678.5", "12.345.678 · 5", "12.345.678-X"]
DECOYS = ["12.345", "2024", "$ 12.345.678", "1.234.567 pesos", "12.345.678.901", "1234-5678-9012-3456-7890", "x12.345.678-5y", "600 millones"]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def planted(r, items):
    """A text and the places of the items in it."""
    text, spans = "", []
    for _ in range(8):
        text += " ".join(r.choice(WORDS) for _ in range(r.randint(2, 5))) + r.choice([": ", "\n", "; "])
        if r.random() < 0.4:
            text += r.choice(DECOYS) + " zz "
            continue
        kind = r.choice(list(items))
        item = r.choice(items[kind])
        spans.append((kind, len(text), len(text) + len(item)))
        text += item + r.choice(["\n", " zz "] if kind == "url" else [") ", "; ", "\n", " zz "])
    return text, spans


@pytest.mark.parametrize("ocr", [False, True])
def test_detect_documents(spark, ocr):
    r = random.Random(7 + ocr)
    items = ITEMS | ({"rut": ITEMS["rut"] + OCR_ITEMS} if ocr else {})
    rows = [(i, *planted(r, items)) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id int, text string")
    found = {}
    for x in D.dedup_spans(D.detect(docs, ["doc_id"], "text", S.Detect(ocr=ocr)), ["doc_id"]).collect():
        found.setdefault(x.doc_id, set()).add((x.type, x.a, x.b))
    for i, text, spans in rows:
        assert found.get(i, set()) == set(spans), text
    assert 900 not in found and 901 not in found


@pytest.mark.parametrize(("text", "labelled"), [("RUT 1", True), ("R.U.T. 1", True), ("r u n 1", True), ("Rol Único 1", True), ("fruta 1", False), ("rutina 1", False)])
def test_rut_labels(spark, text, labelled):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(S.RUT_LABEL)).first()[0] is labelled


def test_dictionary_names_equal_greedy_reading(spark):
    r = random.Random(3)
    vocabulary = ["Ana", "Pedro", "Camila", "Rosa", "Paz", "Luz", "Santiago", "Rut", "Soto", "Vera", "Parra", "Director", "Firma", "don", "Sra.", "el", "de", ",", ":", "señor", "Gloria", "María"]
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12))) for _ in range(600)]
    key = lambda w: w.translate(str.maketrans("áéíóúüñ", "aeiouun")).lower()
    given, weak, places, stop = ({key(w) for w in x} for x in ([*N.GIVEN, *N.AMBIGUOUS, *N.PLACES], N.AMBIGUOUS, N.PLACES, N.STOP))

    def names(line):
        ws = [m.span() for m in re.finditer("[A-ZÁÉÍÓÚÑÜ][\\w'’-]+", line)]
        word = lambda i: key(line[slice(*ws[i])])
        out, i = [], 0
        while i < len(ws):
            titled = re.search("(?i)\\b(don|doña|sra?|srta|señora?)\\b[.]?\\s+$", line[: ws[i][0]]) is not None
            if word(i) in given and (titled or len(line.split()) <= 7):
                j = i
                while j + 1 < len(ws) and j - i < 4 and not line[ws[j][1] : ws[j + 1][0]].strip() and word(j + 1) not in stop:
                    j += 1
                alone = j - i > 1 and not line[: ws[i][0]].strip() and not line[ws[j][1] :].strip(" \t,.;:")
                starts = j > i and word(i) not in stop | places and (word(i) not in weak or word(i + 1) in given - weak - places or alone)
                if titled or starts:
                    out.append((ws[i][0], ws[j][1]))
                    i = j
            i += 1
        return out

    rows = spark.createDataFrame([*enumerate(lines)], "id int, t string").select("id", "t", N.dictionary_names("t").alias("s")).collect()
    for x in rows:
        assert [(s.a, s.b) for s in x.s] == names(x.t), x.t


def test_long_list_entries(spark):
    entries = ["uno dos tres cuatro cinco seis siete ocho nueve 10", " ".join(f"n{chr(97 + i)}" for i in range(20)), "Ana Soto"]
    texts = [(i, f"ver {e.upper()}, fin") for i, e in enumerate(entries)]
    names = spark.createDataFrame([(e,) for e in entries], "entry string")
    found = {(x.id, x.value) for x in N.list_matches(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", names).collect()}
    assert {(i, e.upper()) for i, e in enumerate(entries)} <= found


@pytest.mark.parametrize("shuffled", [False, True])
def test_passages_of_any_length(spark, shuffled, monkeypatch):
    if shuffled:
        monkeypatch.setattr(E, "NEEDLE_BYTES", 0)
    r = random.Random(4)
    items = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (1, 2, 3, 4, 5, 9) for _ in range(6)] + ["", "ñandú", "mesa"]
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 60))).upper() for _ in range(80)] + ["Ñandú mesa", None]
    found = {(x.doc_id, x.item_id) for x in E.passages_in(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), spark.createDataFrame([*enumerate(items)], "item_id int, text string")).collect()}
    plain = lambda t: " " + (t or "").lower().replace("ñ", "n").replace("ú", "u") + " "
    assert found == {(i, j) for i, t in enumerate(texts) for j, n in enumerate(items) if n and plain(n) in plain(t)}


def test_label_phrases(spark):
    good = [f"{p.title()}: " for p in DOC.LABEL_PHRASES if "n" not in p.split()] + ["Oficina de partes: ", "Línea gratuita: ", "Teléfonos ", "RUT N° ", "N° ", " - "]
    bad = ["Juan ", "Rut Mesa ", "mesa central ", "n ", "fono 2 ", "Juan: "]
    rows = spark.createDataFrame([(g,) for g in good + bad], "g string").select("g", DOC.is_label_gap("g").alias("x")).collect()
    assert {x.g for x in rows if x.x} == set(good)


def test_unique_names_equal_one_by_one(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 2), i, r.choice(["a.pdf", "a (2).pdf", "a (3).pdf", "b", "b (2)", "a (2) (2).pdf"])) for i in range(90)]
    want, taken = {}, set()
    for folder, seq, name in sorted(rows, key=lambda x: x[1]):
        stem, dot, suffix = name.partition(".")
        n, new = 1, name
        while (folder, new) in taken:
            n += 1
            new = f"{stem} ({n}){dot}{suffix}"
        taken.add((folder, new))
        want[seq] = new
    found = FS.unique_names(spark.createDataFrame(rows, "folder int, seq int, name string"), ["folder"]).collect()
    assert {x.seq: x.unique_name for x in found} == want


def boxes(r, n, wide=60):
    return [(i, r.randint(0, 1), *(float(v) for v in (x, y, x + r.randint(4, 20), y + r.randint(4, 12)))) for i in range(n) for x, y in [(r.randint(0, wide), r.randint(0, wide))]]


def meets(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def test_box_components_of_long_chains(spark):
    r = random.Random(6)
    rows = boxes(r, 60, 200) + [(1000 + i, 0, i * 10.0, 500.0, i * 10.0 + 11, 504.0) for i in range(300)]
    grown = {i: (p, x0 - (y1 - y0) / 2, y0 - (y1 - y0) / 2, x1 + (y1 - y0) / 2, y1 + (y1 - y0) / 2) for i, p, x0, y0, x1, y1 in rows}
    group = {i: {i} for i in grown}
    for i in grown:
        for j in grown:
            if i < j and grown[i][0] == grown[j][0] and meets(grown[i][1:], grown[j][1:]) and group[i] is not group[j]:
                both = group[i] | group[j]
                group.update(dict.fromkeys(both, both))
    df = spark.createDataFrame(rows, "id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert {x.id: x.component for x in M.box_components(df, ["page"]).collect()} == {i: min(g) for i, g in group.items()}


def shared(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def size(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


@pytest.mark.parametrize(("iou", "inside"), [(0.4, 0.7), (1e-12, 1e-12)])
def test_fixpoint_leaves_no_pair_to_merge(spark, iou, inside):
    """Every box is in one result, no two results of a page would merge, and where results cannot depend on order they are
    what merging any pair again and again gives."""
    r = random.Random(8)
    rows = boxes(r, 50)
    df = spark.createDataFrame([(*x, r.random(), r.random() < 0.5) for x in rows], "id int, page int, x0 double, y0 double, x1 double, y1 double, score double, doubt boolean")
    out = [(x.page, (x.x0, x.y0, x.x1, x.y1)) for x in M.fixpoint_boxes(df, ["page"], iou, inside).collect()]
    close = lambda a, b: shared(a, b) > 0 and (shared(a, b) / (size(a) + size(b) - shared(a, b)) >= iou or shared(a, b) / min(size(a), size(b)) >= inside)
    for _, p, *b in rows:
        assert any(p == q and union(b, o) == o for q, o in out)
    assert not any(p == q and close(a, b) for i, (p, a) in enumerate(out) for q, b in out[:i])
    if iou < 1e-6:
        zones = [(p, tuple(b)) for _, p, *b in rows]
        while pair := next(((a, b) for a in zones for b in zones if a != b and a[0] == b[0] and meets(a[1], b[1])), None):
            zones = [z for z in zones if z not in pair] + [(pair[0][0], union(pair[0][1], pair[1][1]))]
        assert sorted(set(zones)) == sorted(out)


def test_zone_merge_in_order(spark):
    r = random.Random(9)
    rows = [(i, p, *b, r.choice(["url", "rut", "name"]), r.random(), r.random() < 0.5, r.random() < 0.5) for i, p, *b in boxes(r, 20) for _ in range(2)]
    rows = [(j, *x[1:2], *(v + r.choice([0, 0, 1]) for v in x[2:6]), *x[6:]) for j, x in enumerate(rows)]
    out = []
    for _, p, x0, y0, x1, y1, kind, score, doubt, optional in rows:
        b = (x0, y0, x1, y1)
        for o in out:
            if o["p"] == p and shared(b, o["b"]) / (size(b) + size(o["b"]) - shared(b, o["b"])) >= 0.7:
                o.update(b=union(b, o["b"]), t=min(kind, o["t"], key=M.MERGE_ORDER.index), s=max(score, o["s"]), d=doubt and o["d"], o=optional and o["o"], n=o["n"] + 1)
                break
        else:
            out.append({"p": p, "b": b, "t": kind, "s": score, "d": doubt, "o": optional, "n": 1})
    df = spark.createDataFrame(rows, "id int, page int, x0 double, y0 double, x1 double, y1 double, type string, score double, doubt boolean, optional boolean")
    found = sorted((x.page, (x.x0, x.y0, x.x1, x.y1), x.type, x.score, x.doubt, x.optional, x.merged) for x in M.dedup_zones(df, ["page"]).collect())
    assert found == sorted((o["p"], o["b"], o["t"], o["s"], o["d"], o["o"], o["n"]) for o in out)


def test_turned_zones_merge_as_polygons(spark):
    """Two turned lines side by side have boxes that nearly agree, but are no repeats; a line and its repeat are."""
    poly = lambda x, y: [{"x": x, "y": y}, {"x": x + 40.0, "y": y + 40.0}, {"x": x + 38.0, "y": y + 42.0}, {"x": x - 2.0, "y": y + 2.0}]
    rows = [(0, 1, poly(0.0, 0.0), "url", 0.5, True, True), (1, 1, poly(4.0, 0.0), "name", 0.6, True, True), (2, 1, poly(0.2, 0.1), "rut", 0.7, False, True)]
    df = spark.createDataFrame(rows, "id int, page int, polygon array<struct<x: double, y: double>>, type string, score double, doubt boolean, optional boolean")
    found = sorted((x.type, x.merged, x.doubt, x.score, round(x.x0, 1), round(x.x1, 1)) for x in M.dedup_zones(df, ["page"]).collect())
    assert found == [("name", 1, True, 0.6, 2.0, 44.0), ("rut", 2, False, 0.7, -2.0, 40.2)]


def test_labels_do_not_meet(spark):
    r = random.Random(10)
    rows = [(1, i, float(r.randint(0, 300)), float(r.randint(0, 200))) for i in range(80)]
    out = {x.id: x.label_y for x in V.place_labels(spark.createDataFrame(rows, "page int, id int, x double, y double"), ["page"]).collect()}
    at = {i: (x, y) for _, i, x, y in rows}
    for i in at:
        assert out[i] >= max(0, at[i][1] - 16)
        assert not any(abs(out[i] - out[j]) < 16 and abs(at[i][0] - at[j][0]) < 80 for j in at if j != i)
        step = out[i] - 16  # one step higher it would meet an earlier label, or stand over its zone
        assert step < max(0, at[i][1] - 16) or any(abs(step - out[j]) < 16 and abs(at[i][0] - at[j][0]) < 80 for j in at if (at[j][1], at[j][0], j) < (at[i][1], at[i][0], i))


def test_byte_texts(spark):
    r = random.Random(11)
    contents = [bytes(r.randint(0, 255) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["hola señor\tadiós".encode(c) for c in ("utf-8", "latin-1", "utf-16-le", "utf-16-be")] + [b"", None]

    def plain(b):
        out = []
        for code in ("utf-8", "latin-1", "utf-16-le", "utf-16-be"):
            run = ""
            for c in (b or b"").decode(code, "replace") + "\0":
                if c == "\ufffd" or ord(c) < 32 or 127 <= ord(c) < 160:
                    out += [run] if len(run) >= 4 and run not in out else []
                    run = ""
                else:
                    run += c
        return out

    rows = spark.createDataFrame([*enumerate(contents)], "id int, b binary").select("id", FS.byte_texts("b").alias("t")).collect()
    for x in rows:
        assert list(x.t) == plain(contents[x.id])


def test_propagated_values(spark):
    """Values stand again on their pages, or in the whole file if strong, whatever stands between their words."""
    pages = [(1, 0, "don Nora Vera y Luz"), (1, 1, "NORA,  vera; luz"), (1, 3, "y noravera; noraveral"), (1, 2, "nora-vera nora vera"), (2, 0, "Nora Vera")]
    spans = [(1, 0, "name", 4, 13, "name_list", "Nora Vera"), (1, 0, "name", 16, 19, "name_list", "Luz")]
    found = DOC.propagate(spark.createDataFrame(pages, "file int, page int, text string"), spark.createDataFrame(spans, "file int, page int, type string, a int, b int, detector string, value string"))
    assert sorted((x.file, x.page, x.value) for x in found.collect()) == [(1, 1, "NORA,  vera"), (1, 2, "nora vera"), (1, 2, "nora-vera"), (1, 3, "noravera")]


# ---- metadata of images and sinks -----------------------------------------------------------------------------------


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def tiff(order, tags, gps=False):
    """A TIFF directory with texts, and one for places below it."""
    mark, rows, rest = {"<": b"II*\0", ">": b"MM\0*"}[order], [], b""
    at = 8 + 2 + 12 * (len(tags) + gps) + 4
    for tag, text in tags:
        raw = text.encode() + b"\0"
        rows.append(struct.pack(order + "HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(rest))))
        rest += raw if len(raw) > 4 else b""
    if gps:
        rows.append(struct.pack(order + "HHII", 34853, 4, 1, at + len(rest)))
        rest += struct.pack(order + "H", 1) + struct.pack(order + "HHI", 1, 2, 2) + b"S\0\0\0" + struct.pack(order + "I", 0)
    return mark + struct.pack(order + "I", 8) + struct.pack(order + "H", len(rows)) + b"".join(rows) + struct.pack(order + "I", 0) + rest


@pytest.mark.parametrize("order", ["<", ">"])
def test_image_metadata(spark, order):
    exif = tiff(order, [(315, "Ana Soto"), (271, "Cam")], gps=True)
    iptc = b"8BIM" + b"\x1c\x02\x50" + struct.pack(">H", 8) + b"Ana Soto"
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    jpeg = b"\xff\xd8" + seg(0xE0, b"JFIF") + seg(0xE1, b"Exif\0\0" + exif) + seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x>Ana</x>") + seg(0xED, iptc) + seg(0xFE, "señal".encode()) + seg(0xE2, b"ICC_PROFILE") + seg(0xDA, b"..") + b"pixels Ana Rota\xff\xd9" + b"tras el fin"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x") + chunk(b"tEXt", b"Author\0Ana") + chunk(b"zTXt", b"Note\0\0" + zlib.compress(b"nota larga")) + chunk(b"iTXt", b"Title\0\0\0es\0Titulo\0" + "Señal".encode()) + chunk(b"eXIf", exif) + chunk(b"IDAT", b"pixels Ana Rota") + chunk(b"IEND", b"") + b"tras el fin"
    body = b"WEBP" + b"VP8 " + struct.pack("<I", 5) + b"pixel\0" + b"EXIF" + struct.pack("<I", len(exif)) + exif + b"\0" * (len(exif) % 2) + b"XMP " + struct.pack("<I", 3) + b"Ana\0"
    webp = b"RIFF" + struct.pack("<I", len(body)) + body + b"tras el fin"
    cases = {"jpeg": jpeg, "png": png, "webp": webp, "tiff": exif, "unknown": b"\0\0Ana Soto\0", "empty": b"", "broken": jpeg[:40]}
    rows = spark.createDataFrame(list(cases.items()), "name string, b binary").select("name", MD.image_metadata("b").alias("m")).collect()
    got = {x.name: (x.m.container, {(t.location, t.text) for t in x.m.texts}, set(x.m.structures)) for x in rows}
    for name in ("jpeg", "png", "webp"):
        kind, texts, left = got[name]
        assert kind == name and {("exif.artist", "Ana Soto"), ("exif.make", "Cam"), ("exif.gps.1", "S")} <= texts and {"exif", "exif.gps", f"{name}.data_after"} <= left
        assert any("tras el fin" in t for _, t in texts) and not any("Rota" in t for _, t in texts)
    assert {("xmp", "<x>Ana</x>"), ("iptc", "Ana Soto"), ("com", "señal")} <= got["jpeg"][1] and {"xmp", "iptc", "com", "icc"} <= got["jpeg"][2]
    assert {("png.text.Author", "Ana"), ("png.text.Note", "nota larga"), ("png.text.Title", "Señal"), ("png.text.Title", "Titulo")} <= got["png"][1] and {"png.text.author", "png.text.note"} <= got["png"][2]
    assert ("xmp", "Ana") in got["webp"][1]
    assert ("tiff.artist", "Ana Soto") in got["tiff"][1] and {"tiff.315", "exif.gps"} <= got["tiff"][2]
    assert ("bytes", "Ana Soto") in got["unknown"][1] and got["empty"][1] == set() and got["broken"][0] == "jpeg"


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("f", '{"a":1}')], "file string, record string")
    first, second = (sinks.write_audit(records, str(tmp_path), "2026-01-01T00:00:00Z") for _ in range(2))
    assert second == first + " (2)" and spark.read.text(second).first()[0] == '{"a":1}'
    poly = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
    point = "array<struct<x: double, y: double>>"
    tables = {
        "files": spark.createDataFrame([("f1", 0, "a.pdf", "pdf", "c", "process", {"k": "v"}, "0"), ("f2", 1, "b.pdf", "pdf", "c", "error:password", {}, "1")], "file_id string, seq int, path string, format string, category string, expected string, tags map<string,string>, sha256 string"),
        "pages": spark.createDataFrame([("f1", 0, 1.0, 2.0, "pt", 0)], "file_id string, page int, width double, height double, unit string, rotation int"),
        "elements": spark.createDataFrame([("f1", 0, 0, "rut", 0, poly, "1", "base", "text", None, "e1")], f"file_id string, seq int, at int, type string, page int, polygon {point}, value string, level string, layer string, core {point}, id string"),
        "metadata": spark.createDataFrame([("f1", "m1", "exif.gps", "x")], "file_id string, id string, location string, value string"),
        "name_list": spark.createDataFrame([(1, "B"), (0, "A")], "pos int, entry string"),
    }
    sinks.save_manifest(tables, str(tmp_path / "m"), "r", 7)
    back = FS.read_manifest(spark, str(tmp_path / "m"))
    assert [x.file_id for x in back["files"].orderBy("seq").collect()] == ["f1", "f2"] and back["elements"].first().polygon[2].x == 1.0
    assert [x.entry for x in back["name_list"].orderBy("pos").collect()] == ["A", "B"] and back["metadata"].first().location == "exif.gps"
    sinks.write_report({"totals": spark.createDataFrame([(1, "x")], "n int, name string")}, str(tmp_path / "r"))
    assert "| n | name |" in "\n".join(x.value for x in spark.read.text(str(tmp_path / "r" / "markdown")).collect())


def test_seconds_text(spark):
    cases = {0.0: "menos de 0,1 s", 0.4: "0,4 s", 9.96: "10,0 s", 12.0: "12 s", 59.6: "1 min", 80.0: "1 min 20 s"}
    rows = spark.createDataFrame([(k,) for k in cases], "v double").select("v", T.seconds_text("v").alias("t")).collect()
    assert {x.v: x.t for x in rows} == cases


def test_many_labels_of_one_page(spark):
    """Places of some hundred labels equal one-by-one search; thousands that all meet take seconds, not the cube of their number."""
    r = random.Random(13)
    rows = [(p, i, r.choice([-7.5, 0.5, 40.25, 80.0, 97.0, 161.0]), r.randint(-20, 400) / 4) for p in (1, 2) for i in range(150)]
    want = {}
    for p in (1, 2):
        taken = []
        for _, i, x, top in sorted((v for v in rows if v[0] == p), key=lambda v: (v[3], v[2], v[1])):
            y = max(0.0, top - 16)
            while any(abs(y - b) < 16 and abs(x - a) < 80 for a, b in taken):
                y += 16
            taken.append((x, y))
            want[p, i] = y
    df = spark.createDataFrame(rows, "page int, id int, x double, y double")
    assert {(v.page, v.id): v.label_y for v in V.place_labels(df, ["page"]).collect()} == want
    many = spark.range(4000).selectExpr("1 as page", "id", "cast(id % 97 as double) as x", "cast(id % 113 as double) as y")
    began = time.monotonic()
    assert V.place_labels(many, ["page"]).count() == 4000 and time.monotonic() - began < 30


def test_long_texts_are_searched_once(spark):
    """Hashes of runs move without the texts: some dozens of texts of 20,000 words take seconds, not copies of the text by word."""
    needles = spark.createDataFrame([(7, "w5 w6 w7 w8 w9"), (8, "w5 w6"), (9, "w9 w8")], "item_id int, text string")
    texts = spark.range(48).selectExpr("id as doc_id", "array_join(transform(sequence(1, 20000), x -> concat('w', x)), ' ') as text")
    began = time.monotonic()
    found = {tuple(x) for x in E.passages_in(texts, needles).collect()}
    assert found == {(i, j) for i in range(48) for j in (7, 8)} and time.monotonic() - began < 30
