"""Sources: file types by content, folder scans, JSON ground truth and reports, texts out of bytes."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Str, col

#: First bytes, as hexadecimal digits.
PDF, JPEG, PNG, TIFF_LE, TIFF_BE, RIFF, WEBP, FTYP = "25504446", "FFD8FF", "89504E47", "49492A00", "4D4D002A", "52494646", "57454250", "66747970"
HEIC_BRANDS = [b.encode().hex().upper() for b in ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs")]
HEIF_BRANDS = [b.encode().hex().upper() for b in ("mif1", "msf1")]
SUFFIXES = ["pdf", "jpg", "jpeg", "png", "webp", "tif", "tiff"]
MOST_FILES, MOST_BYTES = 1000, 1 << 30


def head(content: Str, n: int = 32) -> Column:
    return F.hex(F.substring(col(content), 1, n))


def is_image_head(h: Column) -> Column:
    return h.startswith(JPEG) | h.startswith(PNG) | h.startswith(TIFF_LE) | h.startswith(TIFF_BE) | (h.startswith(RIFF) & (F.substring(h, 17, 8) == WEBP))


def is_heic(h: Column) -> Column:
    """An ``ftyp`` box with a HEIC brand first, or a generic brand first and a HEIC brand among the compatible ones."""
    major = F.substring(h, 17, 8)
    size = F.least(F.conv(F.substring(h, 1, 8), 16, 10).cast("int"), F.lit(32))
    places = F.filter(F.sequence(F.lit(16), F.lit(28), F.lit(4)), lambda i: i + 4 <= F.least(size, F.length(h) / 2))
    compatible = F.exists(places, lambda i: F.substring(h, i * 2 + 1, F.lit(8)).isin(*HEIC_BRANDS))
    return (F.substring(h, 9, 8) == FTYP) & (major.isin(*HEIC_BRANDS) | (major.isin(*HEIF_BRANDS) & compatible))


def sniff(content: Str) -> Column:
    """pdf, image, empty, heic or format, by the first 32 bytes."""
    h = head(content)
    return F.when(h == "", "empty").when(h.startswith(PDF), "pdf").when(is_image_head(h), "image").when(is_heic(h), "heic").otherwise("format")


def sniff_kind(content: Str) -> Column:
    """pdf, image or null, by the first 12 bytes."""
    h = head(content, 12)
    return F.when(h.startswith(PDF), "pdf").when(is_image_head(h), "image")


def is_heic_file(path: Str, content: Str) -> Column:
    return F.lower(col(path)).rlike(r"\.(heic|heif|hif)$") | is_heic(head(content))


def format_from_signature(content: Str) -> Column:
    """The evaluator's own sniffing; it takes the PDF mark anywhere in the first kilobyte."""
    h = head(content)
    return F.when(h.startswith(JPEG), "jpg").when(h.startswith(PNG), "png").when(h.startswith(RIFF) & (F.substring(h, 17, 8) == WEBP), "webp").when(h.startswith(TIFF_LE) | h.startswith(TIFF_BE), "tiff").when(F.hex(F.substring(col(content), 1, 1024)).rlike(rf"^(..)*?{PDF}"), "pdf").when(is_heic(h), "heic").otherwise("unknown")


def output_format(kind: Column) -> Column:
    return F.when(kind.isin("jpg", "mpo"), "jpg").when(kind.isin("png", "webp", "tiff"), kind).otherwise("png")


def scan_folder(spark: SparkSession, path: str, most: int = MOST_FILES) -> tuple[DataFrame, DataFrame]:
    """(files to take, skipped ones with a reason) of a folder and those below; contents are not read. Spark
    itself does not list hidden and empty files."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,6})$", 1))
    reason = F.when(name.startswith(".") | name.startswith("~$"), "hidden").when(suffix.isin("heic", "heif", "hif"), "heic").when(~suffix.isin(*SUFFIXES), "format").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "size")
    rows = meta.withColumns({"name": name, "suffix": suffix, "reason": reason})
    taken = rows.where("reason is null").orderBy("path").limit(most)
    return taken.drop("reason"), rows.where("reason is not null").select("path", "reason")


MANIFEST = (
    "root string, seed int, files array<struct<id: string, path: string, format: string, category: string, description: string, pages: array<struct<index: int, width: double, height: double, unit: string, rotation: int>>,"
    " elements: array<struct<type: string, page: int, polygon: array<array<double>>, value: string, level: string, layer: string, tags: map<string, string>, core: array<array<double>>, id: string>>,"
    " sensitive_metadata: array<struct<location: string, value: string, tags: map<string, string>, id: string>>, expected: string, tags: map<string, string>, sha256: string>>, name_list array<string>"
)
REPORT = (
    "system string, results array<struct<input: string, output: string, redactions: array<struct<page: int, polygon: array<array<double>>, type: string, detector: string, text: string, score: double, status: string>>,"
    " error: string, time_s: double, pages_processed: int, all_text_mode: boolean>>, details map<string, string>"
)


def points(pairs: Str) -> Column:
    return F.transform(col(pairs), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Ground truth as flat tables: files, pages, elements, metadata, name_list."""
    doc = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    files = doc.select(F.posexplode("files").alias("seq", "f")).select("seq", "f.*")
    key = [F.col("id").alias("file_id"), "seq"]
    element = files.select(*key, F.posexplode("elements").alias("at", "e")).select("file_id", "seq", "at", "e.*")
    return {
        "files": files.select(F.col("id").alias("file_id"), "seq", "path", "format", "category", "expected", "tags", "sha256"),
        "pages": files.select(*key, F.explode("pages").alias("p")).select("file_id", F.col("p.index").alias("page"), "p.width", "p.height", "p.unit", "p.rotation"),
        "elements": element.withColumns({"polygon": points("polygon"), "core": points("core")}),
        "metadata": files.select(*key, F.explode("sensitive_metadata").alias("m")).select("file_id", "m.*"),
        "name_list": doc.select(F.posexplode("name_list").alias("pos", "entry")),
    }


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A redaction report as flat tables: results and redactions."""
    doc = spark.read.schema(REPORT).option("multiLine", "true").json(path)
    results = doc.select("system", F.posexplode("results").alias("seq", "r")).select("system", "seq", "r.*")
    return {"results": results.drop("redactions"), "redactions": results.select("input", F.explode("redactions").alias("d")).select("input", "d.*").withColumn("polygon", points("polygon"))}


def unknown_values(elements: DataFrame) -> DataFrame:
    """Elements that a constructor would refuse: unknown type, level or layer, or a polygon of under three points."""
    bad = F.array_compact(F.array(
        F.when(~F.col("type").isin("rut", "email", "phone", "name", "address", "url", "qr", "face", "signature", "text"), "type"),
        F.when(~F.col("level").isin("base", "stress", "out_of_scope"), "level"), F.when(~F.col("layer").isin("text", "raster", "vector", "hidden"), "layer"),
        F.when(F.size("polygon") < 3, "polygon"),
    ))
    return elements.withColumn("bad", bad).where(F.size("bad") > 0)


def latin_runs(content: Str) -> Column:
    """Printable Latin-1 runs of four characters or more in bytes, natively."""
    return F.regexp_extract_all(F.decode(col(content), "ISO-8859-1"), F.lit(r"[\x20-\x7e\xa0-\xff]{4,}"), F.lit(0))


def decode_field(content: Str) -> Column:
    """A text field by its byte order mark, else UTF-8 if valid, else Latin-1."""
    h = head(content, 3)
    c = col(content)
    return F.when(h.startswith("FEFF"), F.decode(F.substring(c, F.lit(3), F.length(c)), "UTF-16BE")).when(h.startswith("FFFE"), F.decode(F.substring(c, F.lit(3), F.length(c)), "UTF-16LE")).when(h.startswith("EFBBBF"), F.try_validate_utf8(F.substring(c, F.lit(4), F.length(c)).cast("string"))).otherwise(F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1")))


def revisions(content: Str) -> Column:
    """Incremental saves of a PDF: its end marks."""
    return F.regexp_count(F.decode(col(content), "ISO-8859-1"), F.lit("%%EOF"))


def byte_texts(content: Str) -> Column:
    """array<string>: printable runs of four or more in UTF-8, Latin-1 and both UTF-16 orders."""
    run = re.compile(r"[^\x00-\x1f\x7f-\x9f]{4,}")

    def one(b: bytes | None) -> list[str]:
        if not b:
            return []
        out = []
        for code in ("utf-8", "latin-1", "utf-16-le", "utf-16-be"):
            out += run.findall(bytes(b).decode(code, "replace").replace("\ufffd", "\x00"))
        return list(dict.fromkeys(out))

    def batch(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(batch, "array<string>")(col(content))


def pdf_streams(content: Str, most: int = 1 << 26) -> Column:
    """array<binary>: the streams of raw PDF bytes, inflated where they are compressed, each up to ``most`` bytes."""
    stream = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)

    def one(b: bytes | None) -> list[bytes]:
        out = []
        for m in stream.finditer(bytes(b or b"")):
            try:
                out.append(zlib.decompressobj().decompress(m[1], most))
            except zlib.error:
                out.append(m[1])
        return out

    return F.pandas_udf(lambda s: s.map(one), "array<binary>")(col(content))


def pdf_strings(content: Str) -> Column:
    """array<string>: literal and hexadecimal strings of PDF syntax; the pieces of an array are joined."""
    piece = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>", re.S)
    array = re.compile(rb"\[((?:\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>|[^\]()<>])*)\]", re.S)
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def text(p: bytes) -> str:
        if p[:1] == b"<":
            digits = re.sub(rb"\s", b"", p[1:-1])
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else escapes.get(m[1], m[1]), p[1:-1], flags=re.S)
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")

    def one(b: bytes | None) -> list[str]:
        data = bytes(b or b"")
        joined = ["".join(text(p) for p in piece.findall(m[1])) for m in array.finditer(data)]
        return joined + [text(p) for p in piece.findall(array.sub(b"", data))]

    return F.pandas_udf(lambda s: s.map(one), "array<string>")(col(content))


def write_new(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a table that must not exist yet; Spark's commit makes it appear whole."""
    df.write.mode("errorifexists").format(form).save(path)


def unique_names(names: DataFrame, folder: list[str], name: str = "name", order: str = "seq") -> DataFrame:
    """Names made unique in their folder, in order: each takes the first free of "name.ext", "name (2).ext", "name (3).ext" ..
    Each begins with the number of its like up to it, since those before it take the earlier ones; where two want the
    same, the later one goes on, until none does."""
    from pyspark.sql import Window

    from ..plans.stage import drop_staged, staged

    parts = [F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", i) for i in (1, 2)]
    wanted = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(parts[0], F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), parts[1]))
    rows = names.withColumn("_n", F.row_number().over(Window.partitionBy(*folder, name).orderBy(order)))
    last = None
    while True:
        now = rows.withColumn("unique_name", wanted)
        late = F.row_number().over(Window.partitionBy(*folder, "unique_name").orderBy(order)) > 1
        now = staged(now.withColumn("_late", late), "names")
        if last is not None:
            drop_staged(last)
        if now.where("_late").isEmpty():
            return now.drop("_n", "_late")
        rows, last = now.withColumn("_n", F.col("_n") + F.col("_late").cast("int")).drop("_late", "unique_name"), now
