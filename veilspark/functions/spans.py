"""Matches with exact offsets, as native expressions, and the pattern catalogue.

Spark has no "find all with offsets". The matches and the pieces between them are taken by two passes of the same pattern
and zipped; a fold over their lengths gives every match its place in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import forms
from . import text as T

W = r"[\p{L}\p{N}_]"
SPAN = "array<struct<a:int,b:int,value:string>>"


def find_spans(text: T.Str, pattern: str | Column, needs: str | None = None) -> Column:
    """array<struct<a, b, value>> of the matches of a pattern that never matches nothing; [] for null text. ``needs`` is a
    cheap pattern that every text with a match has: where it fails, the costly one is not tried."""
    t = F.coalesce(T.col(text), F.lit(""))
    values = F.regexp_extract_all(t, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    gaps = F.split(t, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["g"])
        b = a + F.length(pair["v"])
        span = F.struct(a.alias("a"), b.alias("b"), pair["v"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(g.alias("g"), v.alias("v")))
    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return found if needs is None else F.when(t.rlike(needs), found).otherwise(F.array().cast(SPAN))


#: What texts with a match have in any case.
_DIGITS, _AT_SIGN, _LINK = r"[0-9].?[0-9]{2}|[0-9][0-9 .()+\-‐‑–—\t]{5}", r"(?i)[@＠©]|arroba|[\[(]at[\])]", r"(?i)https?://|www\."

_WORD = r"\p{L}\p{N}_"
#: Identifiers as people write them, and as character recognition gives them: the dash read as another mark, K as X.
RUT = forms.alone(forms.checked_number(["1.234.567-8", "12.345.678-5", "12345678-5", "12.345.678 - 5", "12,345,678–5", "12 345 678-K", "123.456.789-0", "123456785"], "0-9kK"), "0-9.,", f"{_WORD}@")
RUT_OCR = forms.alone(forms.checked_number(["1.234.567.8", "12.345.678-5", "12345678 · 5", "12 345 678 , K", "123.456.789-X"], "0-9kKxX"), "0-9", f"{_WORD}@")
EMAIL = "(?iu)" + forms.alone(forms.address(rf"{_WORD}.+'\-", "@＠©", ["at", "arroba"], rf"{_WORD}\-", ".,", (2, 4)), after=_WORD)
#: Whatever stands around an at sign, for addresses that have lost their dot.
LOOSE_EMAIL = rf"[{_WORD}.+'\-]+[ \t]?[@＠][ \t]?[{_WORD}.,\-]{{2,}}"
URL = rf"(?i)https?://\S+|(?<!{W})www\.\S+"
#: Seven digits or more of one line, with up to four marks between two of them; a dot only right between digits.
DIGIT_RUN = r"[+(]?[0-9](?:(?:[ \t()+‐‑–—\-]|\.(?=[0-9])){0,4}[0-9]){6,24}"
#: Words before a phone number, without accents.
PHONE_WORDS = ["fono", "telef", "tel", "cel", "movil", "whats", "wsp", "fax", "contacto"]
PHONE_LABEL = rf"(?:{'|'.join(PHONE_WORDS)})[^\n]{{0,20}}$"
RUT_LABEL = r"(?iu)(?<![a-zñ])(?:" + "|".join(forms.spelled(w) for w in ("rut", "run")) + r")(?![a-zñ])|(?iu)(?<![a-zñ])rol\s+[uú]nico"
#: Parts of addresses of personal pages, and query keys that identify a person.
PERSONAL_HOSTS = [
    "facebook", "instagram", "linkedin", "twitter.", "//x.com", "tiktok", "wa.me", "whatsapp", "teams.microsoft", "zoom.us", "meet.google",
    "drive.google", "docs.google", "dropbox", "onedrive", "1drv.ms", "sharepoint", "wetransfer", "forms.gle", "calendly",
]
PERSONAL_KEYS = ["rut", "run", "id", "token", "key", "pwd", "p", "user", "usuario", "email", "mail", "correo"]
PERSONAL_URL = "(?i)(?:" + "|".join(h.replace(".", r"\.") for h in PERSONAL_HOSTS) + r")|[?&](?:" + "|".join(PERSONAL_KEYS) + ")="
#: When several types or detectors claim the same place, the first wins.
TYPE_PRIORITY = ["email", "address", "name", "rut", "phone", "url"]
DETECTOR_PRIORITY = ["regex", "name_list", "context"]


def rank(c: Column, order: list[str], other: int) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at - 1).otherwise(other)


def _typed(spans: Column, kind: str, detector: str = "regex") -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("type"), s["a"].alias("a"), s["b"].alias("b"), F.lit(detector).alias("detector")))


def phone_spans(text: T.Str) -> Column:
    """Digit runs that are phone numbers, by length, first digit or the label before them."""
    t = T.col(text)

    def ok(s: Column) -> Column:
        before = F.substring(t, F.greatest(s["a"] - 24, F.lit(1)), F.least(s["a"], F.lit(25)))
        return T.phone_number_ok(T.national_digits(s["value"]), F.when(s["a"] > 0, F.lower(T.strip_accents(before)).rlike(PHONE_LABEL)).otherwise(False))

    return F.filter(find_spans(text, DIGIT_RUN, _DIGITS), ok)


def rut_spans(text: T.Str, ocr: bool = False) -> Column:
    own = F.filter(find_spans(text, RUT, _DIGITS), lambda s: T.rut_shape(s["value"]))
    return F.concat(own, find_spans(text, RUT_OCR, _DIGITS)) if ocr else own


def url_spans(text: T.Str) -> Column:
    """Links, each with the piece on the next line where that piece stands alone and has a slash or a dash."""
    t = T.col(text)

    def whole(s: Column) -> Column:
        rest = F.regexp_extract(F.substring(t, s["b"] + 1, F.lit(4000)), r"^\n([\p{L}\p{N}_\-./%?=&#~+:]+)(?=[ \t]*(?:\n|$))", 1)
        more = F.when(rest.contains("/") | rest.contains("-"), F.length(rest) + 1).otherwise(0)
        return F.struct(s["a"].alias("a"), (s["b"] + more).alias("b"), F.substring(t, s["a"] + 1, s["b"] + more - s["a"]).alias("value"))

    return F.transform(find_spans(text, URL, _LINK), whole)


def has_data(url: T.Str) -> Column:
    """The address holds an identifier, an e-mail address or a phone number."""
    return T.col(url).rlike(RUT) | T.col(url).rlike(LOOSE_EMAIL) | (F.size(phone_spans(url)) > 0)


def is_personal_url(url: T.Str) -> Column:
    return T.col(url).rlike(PERSONAL_URL) | has_data(url)


@dataclass(frozen=True)
class Detect:
    """What is searched. Identifiers, e-mail addresses and phones always are; the branches of what is off are not built."""

    ocr: bool = False
    urls_personal: bool = True
    urls_other: bool = True


def detect_spans(text: T.Str, options: Detect = Detect(), variant: T.Str | None = None) -> Column:
    """array<struct<type, a, b, detector>> of the pattern detectors (lists and dictionaries are joins, see operators).
    ``variant`` is the text's ``ocr_variant``, where it has been made already."""
    variants = [T.col(text), *([T.ocr_variant(text) if variant is None else T.col(variant)] if options.ocr else [])]
    numbers = F.concat(*(x for v in variants for x in (_typed(rut_spans(v, options.ocr), "rut"), _typed(phone_spans(v), "phone"))))
    numbers = F.filter(numbers, lambda s: ~T.is_amount(text, s["a"], s["b"]))
    found = [numbers, _typed(find_spans(text, EMAIL, _AT_SIGN), "email"), _typed(find_spans(text, LOOSE_EMAIL, "[@＠]"), "email")]
    if options.urls_personal or options.urls_other:
        urls = url_spans(text)
        if not options.urls_other:
            urls = F.filter(urls, lambda s: is_personal_url(s["value"]))
        elif not options.urls_personal:
            urls = F.filter(urls, lambda s: ~is_personal_url(s["value"]))
        found.append(_typed(urls, "url"))
    return F.concat(*found)


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def rut_suggested(text: T.Str, a: Column, b: Column, value: Column | None = None) -> Column:
    """A bare run of digits with a wrong check digit, no phone, and no label within 30 characters before it on its line."""
    t = T.col(text)
    v = F.trim(F.substring(t, a + 1, b - a) if value is None else value)
    line = F.regexp_extract(F.substring(t, F.greatest(a - 29, F.lit(1)), F.least(a, F.lit(30))), r"([^\n]*)$", 1)
    labelled = F.when(a > 0, line.rlike(RUT_LABEL)).otherwise(False)
    phone = F.exists(phone_spans(text), lambda s: overlaps(s["a"], s["b"], a, b))
    return v.rlike(r"^[0-9]{6,9}[0-9kKxX]$") & ~T.rut_is_valid(v) & ~phone & ~labelled


def has_rut_number(text: T.Str, ocr: bool = False) -> Column:
    own = F.size(rut_spans(text)) > 0
    return own | (F.size(rut_spans(T.ocr_variant(text), True)) > 0) | T.col(text).rlike(RUT_OCR) if ocr else own


def rut_doubt(text: T.Str) -> Column:
    """True when the text has candidates and none has a valid check digit; null otherwise."""
    every = F.concat(*(find_spans(v, p) for v in (T.col(text), T.ocr_variant(text)) for p in (RUT, RUT_OCR)))
    return F.when((F.size(every) > 0) & ~F.exists(every, lambda s: T.rut_is_valid(s["value"])), True)


def face_doubt(side: Column, score: Column) -> Column:
    return F.when((side < 40) | (score < 0.7), True)


def ocr_doubt(score: Column) -> Column:
    return F.when(score < 0.75, True)


#: The four patterns of the naive baseline: plain forms only.
NAIVE = {
    "rut": r"[0-9]{1,2}\.[0-9]{3}\.[0-9]{3}-[0-9kK]", "email": r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z]{2,}",
    "phone": r"\+?56 ?9 ?[0-9]{4} ?[0-9]{4}", "url": r"https?://\S+",
}
