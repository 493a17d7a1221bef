"""Metadata of image files: the parts of JPEG, PNG, WebP and TIFF files that hold no pixels, and the texts in them.

A walker for each container gives its parts as (name, body); a reader for each kind of part gives texts with their place, and
names of structures that are there. Parts that cannot be read give whatever printable runs they have. Python reads the
bytes, a file at a time, in Arrow batches.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import Str, col
from ..operators.checks import TIFF_TAGS

SCHEMA = "struct<container: string, texts: array<struct<location: string, text: string>>, structures: array<string>>"
#: Sizes of the value types of TIFF, and names of EXIF tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
EXIF_TAGS = {270: "imagedescription", 271: "make", 272: "model", 305: "software", 306: "datetime", 315: "artist", 316: "hostcomputer", 33432: "copyright", 36867: "datetimeoriginal", 36868: "datetimedigitized", 37500: "makernote", 37510: "usercomment", 42032: "cameraownername", 42033: "bodyserialnumber"}
EXIF_IFD, GPS_IFD, INTEROP_IFD = 34665, 34853, 40965
#: PNG chunks, lower case first, that hold no text.
PLAIN_CHUNKS = {"pHYs", "gAMA", "cHRM", "sRGB", "bKGD", "tRNS", "sBIT"}
_RUN = re.compile(r"[^\x00-\x1f\x7f-\x9f]{4,}")


def printable(data: bytes) -> list[str]:
    return list(dict.fromkeys(x for code in ("utf-8", "latin-1", "utf-16-le", "utf-16-be") for x in _RUN.findall(data.decode(code, "replace").replace("\ufffd", "\x00"))))


def decoded(data: bytes) -> list[str]:
    """A text by its mark or by what it can be."""
    for mark, codes in ((b"UNICODE\0", ("utf-16-be", "utf-16-le")), (b"ASCII\0\0\0", ("latin-1",)), (b"\xfe\xff", ("utf-16-be",)), (b"\xff\xfe", ("utf-16-le",)), (b"\xef\xbb\xbf", ("utf-8",))):
        if data.startswith(mark):
            return [data[len(mark) :].decode(c, "ignore").rstrip("\0") for c in codes]
    try:
        return [data.decode("utf-8").rstrip("\0")]
    except UnicodeDecodeError:
        return [data.decode("latin-1").rstrip("\0")]


def entries(data: bytes, at: int, order: str) -> tuple[list[tuple[int, bytes | list]], int]:
    """(tag, value) of a directory at a place, and the place of the next one. Values past the end are left out."""
    n = struct.unpack_from(order + "H", data, at)[0]
    out = []
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = SIZES.get(kind, 0) * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        raw = data[where : where + size]
        if not size or len(raw) < size:
            continue
        if kind in (1, 2, 6, 7):
            out.append((tag, raw))
        else:
            code = {3: "H", 4: "I", 5: "II", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}[kind]
            flat = struct.unpack(order + code * count, raw)
            out.append((tag, list(zip(flat[::2], flat[1::2], strict=True)) if len(code) > 1 else list(flat)))
    at += 2 + 12 * n
    return out, struct.unpack_from(order + "I", data, at)[0] if at + 4 <= len(data) else 0


def _texts(value: bytes | list) -> list[str]:
    return decoded(value) if isinstance(value, bytes) else [str(x[0] / x[1] if isinstance(x, tuple) and x[1] else x) for x in value]


class Found:
    """Texts and structures of one file."""

    def __init__(self) -> None:
        self.texts: list[tuple[str, str]] = []
        self.structures: set[str] = set()

    def add(self, place: str, texts: list[str]) -> None:
        self.texts += [(place, t) for t in texts if t]

    def directories(self, data: bytes, place: str, tags: dict[int, str], tiff: bool) -> None:
        """All directories of TIFF bytes, and those they point to."""
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        open_, seen = [(struct.unpack_from(order + "I", data, 4)[0], place, 0)], set()
        while open_:
            at, where, page = open_.pop(0)
            if not at or at in seen or at + 2 > len(data):
                continue
            seen.add(at)
            own, following = entries(data, at, order)
            if where == place:
                open_.append((following, place, page + 1))
                if page and not tiff:
                    self.structures.add("exif.thumbnail")
            for tag, value in own:
                if tag in (EXIF_IFD, GPS_IFD, INTEROP_IFD):
                    open_.append((value[0] if isinstance(value, list) else 0, f"{place}.gps" if tag == GPS_IFD else f"{place}.exif" if tiff else place + ".", 0))
                    self.structures |= {"exif.gps"} if tag == GPS_IFD else set()
                if tiff and tag in tags:
                    self.structures |= {f"tiff.{tag}"} | {700: {"xmp"}, 33723: {"iptc"}}.get(tag, set())
                if tag == 33723 and isinstance(value, bytes):
                    self.iptc(value)
                elif (not tiff or where != place or tag in tags) and tag not in (EXIF_IFD, GPS_IFD, INTEROP_IFD):
                    self.add(f"{where.rstrip('.')}.{tags.get(tag, tag)}", _texts(value))

    def exif(self, data: bytes) -> None:
        self.structures.add("exif")
        data = data.removeprefix(b"Exif\0\0")
        try:
            self.directories(data, "exif", EXIF_TAGS, False)
        except (struct.error, KeyError, IndexError):
            self.add("exif", printable(data))

    def iptc(self, data: bytes) -> None:
        """Records of a mark, two numbers, a length and a text."""
        at = data.find(b"\x1c")
        while 0 <= at <= len(data) - 5:
            size = struct.unpack_from(">H", data, at + 3)[0]
            known = 1 <= data[at + 1] <= 9 and size < 0x8000
            if known:
                self.add("iptc", decoded(data[at + 5 : at + 5 + size]))
            at = data.find(b"\x1c", at + (5 + size if known else 1))

    def text_chunk(self, kind: str, body: bytes) -> None:
        key, _, rest = body.partition(b"\0")
        name = key.decode("latin-1")
        if kind == "tEXt":
            texts = [rest.decode("latin-1")]
        elif kind == "zTXt":
            texts = [zlib.decompress(rest[1:]).decode("latin-1")]
        else:
            packed, (_, translated, text) = rest[:1] == b"\1", rest[2:].split(b"\0", 2)
            texts = [(zlib.decompress(text) if packed else text).decode("utf-8", "ignore"), translated.decode("utf-8", "ignore")]
        self.structures |= {f"png.text.{name.lower()}"} | ({"xmp"} if name == "XML:com.adobe.xmp" else set())
        self.add(f"png.text.{name}", texts)

    def part(self, container: str, name: str, body: bytes) -> None:
        if name == "after":
            self.structures |= {f"{container}.data_after"} if body else set()
            self.add(f"{container}.after", printable(body))
        elif (name == "app1" and body.startswith(b"Exif\0\0")) or name in ("eXIf", "EXIF"):
            self.exif(body)
        elif (name == "app1" and b"http://ns.adobe.com/" in body[:40]) or name == "XMP ":
            self.structures.add("xmp")
            self.add("xmp", [(body.split(b"\0", 1)[-1] if container == "jpeg" else body).decode("utf-8", "ignore")])
        elif name == "app13":
            self.structures.add("iptc")
            self.iptc(body)
            self.add("iptc", printable(body))
        elif name == "com":
            self.structures.add("com")
            self.add("com", decoded(body))
        elif name in ("iCCP", "ICCP") or (name == "app2" and body.startswith(b"ICC_PROFILE")):
            self.structures.add("icc")
        elif name in ("tEXt", "zTXt", "iTXt"):
            self.text_chunk(name, body)
        elif name == "tiff":
            self.directories(body, "tiff", {v: k for k, v in TIFF_TAGS.items()}, True)
        elif (container == "jpeg" and name != "app0") or (container == "png" and name[:1].islower() and name not in PLAIN_CHUNKS) or (container == "webp" and name not in ("VP8X", "ANIM")):
            self.structures.add(f"{container}.{name.strip()}")
            self.add(f"{container}.{name.strip()}", printable(body))


def _jpeg(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 2
    while (at := data.find(b"\xff", at)) >= 0 and at + 4 <= len(data):
        mark = data[at + 1]
        if mark == 0xFF or mark in (0, 1, 0xD8) or 0xD0 <= mark <= 0xD7:
            at += 1 if mark == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0] if mark != 0xD9 else 0
        if mark in (0xD9, 0xDA):  # pixels, or the end
            end = at if mark == 0xD9 else data.rfind(b"\xff\xd9")
            if end >= at:
                yield "after", data[end + 2 :]
            return
        if 0xE0 <= mark <= 0xEF or mark == 0xFE:
            yield "com" if mark == 0xFE else f"app{mark - 0xE0}", data[at + 4 : at + 2 + size]
        at += 2 + max(2, size)


def _png(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        name = kind.decode("latin-1")
        if name == "IEND":
            yield "after", data[at + 12 :]
            return
        if name != "IDAT":
            yield name, data[at + 8 : at + 8 + size]
        at += 12 + size


def _webp(data: bytes) -> Iterator[tuple[str, bytes]]:
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind not in (b"VP8 ", b"VP8L", b"ALPH", b"ANMF"):
            yield kind.decode("latin-1"), data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    yield "after", data[end:]


def read(data: bytes | None) -> dict:
    """Container, texts and structures of a file's bytes; other files have the container ``unknown`` and their printable runs."""
    data, found = bytes(data or b""), Found()
    kinds = (("jpeg", data[:3] == b"\xff\xd8\xff", _jpeg), ("png", data[:8] == b"\x89PNG\r\n\x1a\n", _png), ("webp", data[:4] == b"RIFF" and data[8:12] == b"WEBP", _webp), ("tiff", data[:4] in (b"II*\0", b"MM\0*"), lambda d: [("tiff", d)]))
    container, walk = next(((name, own) for name, hit, own in kinds if hit), ("unknown", None))
    parts = walk(data) if walk else iter(())
    try:
        for name, body in parts:
            try:
                found.part(container, name, body)
            except (struct.error, zlib.error, ValueError, KeyError, IndexError):
                found.add(container, printable(body))
    except struct.error:
        found.add(container, printable(data))
    if walk is None:
        found.add("bytes", printable(data))
    return {"container": container, "texts": [{"location": a, "text": b} for a, b in found.texts], "structures": sorted(found.structures)}


def image_metadata(content: Str) -> Column:
    """struct<container, texts: array<struct<location, text>>, structures: array<string>> of image bytes."""

    def batch(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x) for x in s], columns=["container", "texts", "structures"])

    return F.pandas_udf(batch, SCHEMA)(col(content))
