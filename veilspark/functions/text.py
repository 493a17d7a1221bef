"""Text folding, identifier keys and written forms, as Column expressions without Python in the hot path.

Patterns are ported to Java's engine with explicit Unicode classes; lengths and offsets are in code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str

#: The letters that character recognition takes for digits, and those digits.
CONFUSED, MEANT = "OoDQlI|SBZ", "0000111582"
#: The dashes that may stand before a check digit, as part of a character class.
DASHES = r"\-‐‑‒–—−"


def _fold_tables() -> tuple[str, str]:
    """Latin, Greek and Cyrillic characters whose folded character is not the character itself; one to one."""
    source, target = [], []
    for point in [*range(0xA0, 0x0530), *range(0x1E00, 0x2000), *range(0xFF00, 0xFF60)]:
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        folded = ((plain[:1] or c).casefold()[:1]) or c
        if folded != c and not c.isspace() and folded != " ":
            source.append(c)
            target.append(folded)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_tables()


def col(c: Str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(c: Str, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(col(c), pattern, to)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fold(c: Str) -> Column:
    """Lower case without accents, character by character: the length stays, white space becomes spaces."""
    return F.lower(F.translate(rx(c, r"(?U)\s", " "), FOLD_FROM, FOLD_TO))


def norm(c: Str) -> Column:
    """Lower case without accents, trimmed; combining marks go and sharp s doubles, so lengths may change."""
    return rx(rx(fold(rx(rx(c, "ß", "ss"), r"\p{M}")), r"^\s+"), r"\s+$")


def norm_general(c: Str) -> Column:
    """``norm`` with white space collapsed."""
    return rx(norm(c), r"(?U)\s+", " ")


def norm_exact(c: Str) -> Column:
    """``norm`` by the full Unicode tables, for text beyond the folded scripts."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).casefold().strip()

    return F.pandas_udf(lambda s: s.map(one), "string")(col(c))


def strip_accents(c: Str) -> Column:
    """Accents go, case stays."""
    pairs = [(a, unicodedata.normalize("NFKD", a)[0]) for a in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFKD", a)) > 1]
    return F.translate(rx(c, r"\p{Mn}"), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def normalize_value(kind: Str, value: Str) -> Column:
    """Canonical form of a value by its type."""
    digits = F.upper(rx(value, rf"[\s.,·{DASHES}]"))
    phone = rx(rx(value, r"[^0-9]"), r"^(00)?56(?=\d{8,9}$)")
    squeezed = F.lower(rx(value, r"(?U)\s+"))
    kind = col(kind)
    return F.when(kind == "rut", digits).when(kind == "phone", phone).when(kind.isin("email", "url", "qr"), squeezed).otherwise(norm_general(value))


def normalize_haystack(c: Str, kind: str) -> Column:
    """Text to be searched: ``digits`` joins digits over separators, ``compact`` drops white space, else ``norm_general``."""
    if kind == "digits":
        return rx(F.upper(col(c)), rf"(?<=[0-9])[\s.,·()+{DASHES}]+(?=[0-9K])")
    if kind == "compact":
        return F.lower(rx(c, r"(?U)\s+"))
    return norm_general(c)


def ocr_variant(c: Str) -> Column:
    """In words of which half or more are digits, look-alike letters become digits; the length stays."""
    number = r"(?U)(?<!\S)[^\s\p{Nd}]*+\p{Nd}\S*"  # words with a digit; no other can be half digits
    words = F.regexp_extract_all(col(c), F.lit(number), F.lit(0))
    gaps = F.split(col(c), number, -1)

    def read(w: Column) -> Column:
        return F.when(F.length(rx(w, r"\P{Nd}")) * 2 >= F.length(w), F.translate(w, CONFUSED, MEANT)).otherwise(w)

    # gaps are one more than words: g0 w0 g1 w1 ... gn
    pairs = F.zip_with(gaps, F.transform(words, read), lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    return F.array_join(pairs, "")


def check_digit(body: Str) -> Column:
    """Modulo-11 check digit of a string of digits, weights 2 to 7 repeating from the right; 10 is K, 11 is 0."""
    digits = F.split(F.reverse(col(body)), "")
    weighted = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: d.cast("int") * (F.lit(2) + i % 6))
    rest = F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 11
    return F.substring(F.lit("0K987654321"), rest + 1, F.lit(1))


def rut_clean(c: Str) -> Column:
    """Digits and check digit only; X is read as K."""
    return F.translate(F.upper(rx(c, r"[^0-9kKxX]")), "X", "K")


def rut_is_valid(c: Str) -> Column:
    clean = rut_clean(c)
    body = F.regexp_extract(clean, r"^([0-9]+)[0-9K]$", 1)
    return (body != "") & (check_digit(body) == F.right(clean, F.lit(1)))


def rut_shape(c: Str) -> Column:
    """A number with a dash is a RUT; without one it must be 8 to 10 characters in a row and no 600 number."""
    squeezed = rx(c, r"(?U)\s")
    return F.when(col(c).rlike(f"[{DASHES}]"), True).when((F.length(squeezed) == 10) & squeezed.startswith("600"), False).otherwise(squeezed.rlike(r"^[0-9]{7,9}[0-9kK]$"))


def rut_key(c: Str) -> Column:
    return F.nullif(F.regexp_extract(rut_clean(c), r"^([0-9]{6,9}[0-9K])$", 1), F.lit(""))


def national_digits(c: Str) -> Column:
    """Digits without the country code and the old trunk prefix."""
    return rx(rx(rx(c, r"[^0-9]"), r"^(?:0056|56(?=[0-9]{8}))"), r"^0(?=[0-9]{9}$)")


def phone_key(c: Str) -> Column:
    return F.nullif(F.regexp_extract(national_digits(c), r"^([0-9]{8,10})$", 1), F.lit(""))


def phone_number_ok(digits: Column, labelled: Column) -> Column:
    """Nine digits from 2 to 9, a ten-digit 600 number, or eight digits after a phone label."""
    return digits.rlike(r"^[2-9][0-9]{8}$") | digits.rlike(r"^600[0-9]{7}$") | (labelled & digits.rlike(r"^[0-9]{8}$"))


def parse_exception(entry: Str) -> Column:
    """struct(rut, phone): the keys an entry of the exception list stands for; both null when it is neither."""
    return let(rx(rx(entry, r"(?U)^\s+"), r"(?U)\s+$"), _parsed)


def _parsed(text: Column) -> Column:
    as_rut = F.lower(text).contains("k") | text.rlike(rf"[0-9]\s?[{DASHES}]\s?[0-9]$") | text.rlike(r"[0-9]\.[0-9]{3}(\.|[^0-9]|$)")
    rut_chars = text.rlike(rf"^[0-9kK.,\s{DASHES}]+$")
    phone_chars = text.rlike(rf"^[0-9+()\s.{DASHES}]+$")
    bare = text.rlike(r"^[0-9]+$")
    any_digit = text.rlike(r"[0-9]")
    rut = F.when(any_digit & ((as_rut & rut_chars) | (~as_rut & bare)), rut_key(text))
    phone = F.when(any_digit & ~as_rut & phone_chars, phone_key(text))
    return F.struct(rut.alias("rut"), phone.alias("phone"))


def is_amount(text: Str, a: Column, b: Column) -> Column:
    """The span a..b of the text is money: a currency sign within 4 characters before, a unit within 12 after, or
    thousands groups."""
    t = col(text)
    before = F.lower(F.substring(t, F.greatest(a - 3, F.lit(1)), F.least(a, F.lit(4))))
    before = F.when(a == 0, "").otherwise(before)
    after = F.lower(F.substring(t, b + 1, F.lit(12)))
    value = rx(rx(F.substring(t, a + 1, b - a), r"^\s+"), r"\s+$")
    unit = after.rlike(r"^\s*(millones|mil(?![\p{L}\p{N}_])|pesos|uf(?![\p{L}\p{N}_])|%|usd)")
    return before.contains("$") | before.contains("clp") | unit | value.rlike(r"^[0-9]{1,3}(\.[0-9]{3}){2,}(,[0-9]+)?$")


def last_digits(c: Str, n: int) -> Column:
    """Suffix that holds the last n digits as written; the whole text if it has fewer."""
    found = F.regexp_extract(col(c), rf"((?:[0-9][^0-9]*){{{n}}})$", 1)
    return F.when(found == "", col(c)).otherwise(found)


def digits_k(c: Str) -> Column:
    return rx(F.upper(col(c)), "[^0-9K]")


def is_initial(word: Str) -> Column:
    return (F.length(rx(rx(word, r"^[.,;]+"), r"[.,;]+$")) <= 2) | col(word).endswith(".")


def surnames(value: Str) -> Column:
    """Surname part: before a comma, or the last two of three or more words; null with initials or one word."""
    words = F.filter(F.split(col(value), r"(?U)\s+"), lambda w: w != "")
    by_comma = F.filter(F.split(F.element_at(F.split(col(value), ","), 1), r"(?U)\s+"), lambda w: w != "")
    own = F.when(col(value).contains(","), by_comma).when(F.size(words) >= 3, F.slice(words, -2, 2))
    return F.when((F.size(own) >= 2) & ~F.exists(own, is_initial), F.array_join(own, " "))


def street_number(value: Str) -> Column:
    """Address up to its first number, which must not be all digits."""
    head = F.regexp_extract(col(value), r"^([^0-9]*?\S*?[0-9]+)", 1)
    return F.when(head.rlike(r"\p{L}"), head)


def needle_pattern(value: Str) -> Column:
    """Pattern that finds the value's words again in folded text, whole words, whatever stands between them."""
    words = F.regexp_extract_all(fold(value), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    body = F.array_join(words, r"[^\p{L}\p{N}_]*")
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), body, F.lit(r"(?![\p{L}\p{N}_])")))


def strong_needle(value: Str) -> Column:
    """Specific enough to be looked for in a whole file."""
    words = F.regexp_extract_all(fold(value), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return (F.length(F.array_join(words, "")) >= 6) & ((F.size(words) >= 2) | col(value).rlike(r"\p{Nd}") | col(value).contains("@"))


def group_thousands(number: Str, separator: str) -> Column:
    return F.translate(F.format_number(col(number), 0), ",", separator) if separator else F.format_number(col(number), 0)


def format_rut(body: Str, dv: Str, form: Str) -> Column:
    """Seven written forms of a number and its check digit."""
    b, v, form = col(body), col(dv), col(form)
    dots, plain = group_thousands(b, "."), b.cast("string")
    return (
        F.when(form == "dots", F.concat(dots, F.lit("-"), v)).when(form == "no_dots", F.concat(plain, F.lit("-"), v))
        .when(form == "spaced_hyphen", F.concat(dots, F.lit(" - "), v)).when(form == "en_dash", F.concat(dots, F.lit("–"), v))
        .when(form == "no_hyphen", F.concat(plain, v)).when(form == "commas", F.concat(F.format_number(b, 0), F.lit("-"), v))
        .when(form == "inner_spaces", F.concat(group_thousands(b, " "), F.lit("-"), v))
    )


#: Written forms of phones; n-m are places of the nine national digits.
PHONE_FORMS = {
    "mobile_international": "+56 9 {1-4} {5-8}", "mobile_compact": "+569{1-4}{5-8}", "mobile_national": "9 {1-4} {5-8}",
    "mobile_block": "9{1-4} {5-8}", "mobile_parentheses": "(+56) 9 {1-4} {5-8}", "mobile_hyphens": "+56-9-{1-4}-{5-8}",
    "old_mobile_09": "09-{1-4} {5-8}", "old_mobile_8": "{1-4} {5-8}",
    "santiago_international": "+56 2 {1-4} {5-8}", "santiago_national": "2{1-1} {2-4} {5-8}", "santiago_parentheses": "(2) {1-4} {5-8}",
    "regional_international": "+56 {0-1} {2-4} {5-8}", "regional_parentheses": "({0-1}) {2-4} {5-8}", "regional_compact": "({0-1}) {2-8}",
    "regional_hyphen": "{0-1}-{2-8}", "old_regional_0": "(0{0-1}) {2-8}",
}


def format_phone(national: Str, form: Str) -> Column:
    """Sixteen written forms of nine national digits."""
    import re

    out = F.lit(None).cast("string")
    for name, pattern in PHONE_FORMS.items():
        parts = []
        for piece in re.split(r"(\{\d-\d\})", pattern):
            if m := re.fullmatch(r"\{(\d)-(\d)\}", piece):
                parts.append(F.substring(col(national), int(m[1]) + 1, int(m[2]) - int(m[1]) + 1))
            elif piece:
                parts.append(F.lit(piece))
        out = F.when(col(form) == name, F.concat(*parts)).otherwise(out)
    return out


def format_email(given: Str, surname: Str, domain: Str, year: Str, form: Str) -> Column:
    """Ten written forms of a personal address."""
    n, s, d = (F.lower(strip_accents(F.element_at(F.split(col(given), " "), 1))), F.lower(strip_accents(col(surname))), col(domain))
    form = col(form)
    plain = F.concat(n, F.lit("."), s, F.lit("@"), d)
    return (
        F.when(form == "dot", plain).when(form == "initial", F.concat(F.left(n, F.lit(1)), s, F.lit("@"), d))
        .when(form == "with_year", F.concat(n, F.lit("."), s, F.right(col(year).cast("string"), F.lit(2)), F.lit("@"), d))
        .when(form == "underscore", F.concat(n, F.lit("_"), s, F.lit("@"), d)).when(form == "uppercase", F.upper(plain))
        .when(form == "plus", F.concat(n, F.lit("."), s, F.lit("+honorarios@"), d))
        .when(form == "subdomain", F.concat(n, F.lit("-"), s, F.lit("@"), F.when(d.startswith("correo."), d).otherwise(F.concat(F.lit("correo."), d))))
        .when(form == "spelled_arroba", F.concat(n, F.lit("."), s, F.lit(" [arroba] "), d))
        .when(form == "at", F.concat(n, F.lit("."), s, F.lit("(at)"), d)).when(form == "spaces", F.concat(n, F.lit("."), s, F.lit(" @ "), d))
    )


def display_name(path: Str) -> Column:
    """Safe base name of a path: control and reserved characters become underscores, 200 characters at most."""
    base = F.element_at(F.split(col(path), r"[\\/]"), -1)
    safe = rx(rx(rx(base, r"[\x00-\x1f<>:\"/\\|?*]", "_"), r"^[ .]+"), r"[ .]+$")
    return F.when(safe == "", "archivo").otherwise(F.substring(safe, 1, 200))


def safe_suffix(name: Str) -> Column:
    return F.regexp_extract(F.lower(col(name)), r"[^.](\.[a-z0-9]{1,6})$", 1)


def seconds_text(value: Str) -> Column:
    """Spanish duration: tenths under ten seconds, whole seconds under a minute, then minutes and seconds."""
    v = col(value).cast("double")
    whole = F.bround(v).cast("long")
    minutes, rest = F.floor(whole / 60).cast("string"), whole % 60
    long = F.concat(minutes, F.lit(" min"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" s"))).otherwise(""))
    tenths = F.concat(F.replace(F.format_string("%.1f", v), F.lit("."), F.lit(",")), F.lit(" s"))
    return F.when(v < 0.1, "menos de 0,1 s").when(v < 10, tenths).when(whole < 60, F.concat(whole.cast("string"), F.lit(" s"))).otherwise(long)


def decoy_date(n: Str) -> Column:
    """A Spanish date that is no personal datum, chosen by a number."""
    day, month = F.pmod(col(n), F.lit(28)) + 1, F.pmod(F.floor(col(n) / 28), F.lit(12)) + 1
    return F.concat(day.cast("string"), F.lit(" de "), F.element_at(F.array(*map(F.lit, MONTHS)), month.cast("int")), F.lit(" de 2026"))


def decoy_folio(n: Str) -> Column:
    """A document number with its year, chosen by a number."""
    return F.concat((F.pmod(col(n), F.lit(9900)) + 100).cast("string"), F.lit("/"), F.when(F.pmod(col(n), F.lit(2)) == 0, "2026").otherwise("2025"))


def join_items(items: Column) -> Column:
    """'a, b y c'."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, items[0]).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" y "), F.element_at(items, -1)))


#: Spanish month names.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def spanish_date(ts: Str) -> Column:
    t = col(ts)
    return F.concat(F.dayofmonth(t).cast("string"), F.lit(" de "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(t)), F.lit(" de "), F.year(t).cast("string"))


def name_words(path: Str) -> Column:
    """Capitalised words of a file name that may be surnames."""
    base = rx(F.element_at(F.split(col(path), r"[\\/]"), -1), r"\.[A-Za-z0-9]{1,6}$")
    return F.transform(F.filter(F.split(base, r"[^\p{L}]+"), lambda w: F.length(w) >= 4), lambda w: F.initcap(w))


def fnv1a(c: Str) -> Column:
    """FNV-1a of the text's UTF-16 units below 65536, 32 bits."""
    points = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, x: F.shiftleft(h.bitwiseXOR(x), 0).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(16777619) % F.lit(1 << 32))
