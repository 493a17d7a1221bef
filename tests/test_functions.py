"""Scalar functions and span extraction against direct definitions."""

import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.functions import text as T
from veilspark.operators import detect as D
from veilspark.operators import names as N

ALPHABET = "ab1234567890kK.,-–  \n@x:ñÉ +()$"


def texts(n=300):
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_spans_equal_finditer(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, t string")
    pattern = r"[0-9]{1,3}(?:[.,]?[0-9]{3})*-?[0-9kK]"
    found = {r.id: [(s.a, s.b, s.value) for s in r.s] for r in df.select("id", S.find_spans("t", pattern).alias("s")).collect()}
    for i, t in rows:
        assert found[i] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)]


def digit(body):
    total = sum(int(d) * (2 + i % 6) for i, d in enumerate(reversed(body)))
    return {11: "0", 10: "K"}.get(11 - total % 11, str(11 - total % 11))


def test_check_digit_and_validity(spark):
    bodies = [str(random.Random(i).randint(10**5, 10**9)) for i in range(200)]
    df = spark.createDataFrame([(b, f"{b}-{digit(b)}", f"{b}-{'0' if digit(b) != '0' else '1'}") for b in bodies], "b string, good string, bad string")
    for r in df.select("b", T.check_digit("b").alias("d"), T.rut_is_valid("good").alias("g"), T.rut_is_valid("bad").alias("x")).collect():
        assert (r.d, r.g, r.x) == (digit(r.b), True, False)


@pytest.mark.parametrize(
    ("value", "shaped"),
    [("12.345.678-5", True), ("12345678-5", True), ("123456785", True), ("600 123 4567", False), ("1234", False), ("12.345.6785", False)],
)
def test_shape(spark, value, shaped):
    assert spark.createDataFrame([(value,)], "v string").select(T.rut_shape("v")).first()[0] is shaped


@pytest.mark.parametrize(
    ("text", "phones"),
    [("llama al +56 9 8123 4567 hoy", 1), ("fono 2345 6789", 1), ("folio 2345 6789", 0), ("600 123 4567", 1), ("monto 12.345", 0), ("(2) 2345 6789", 1), ("0056 2 2345 6789", 1)],
)
def test_phones(spark, text, phones):
    assert spark.createDataFrame([(text,)], "t string").select(F.size(S.phone_spans("t"))).first()[0] == phones


@pytest.mark.parametrize(("text", "types"), [("a@b.cl y 12.345.678-5", ["email", "rut"]), ("$ 12.345.678", []), ("ver www.x.cl/a", ["url"]), ("", []), (None, [])])
def test_detect(spark, text, types):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert sorted(r.type for r in D.dedup_spans(D.detect(df, ["id"], "t"), ["id"]).collect()) == types


def test_fold_keeps_length_and_equals_the_definition(spark):
    t = "ÁÉÍ ñandú STRASSE Ünï\tÇa ƒ"

    def one(c):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        return ((plain[:1] or c).casefold()[:1] or c) if c.strip() else " "

    assert spark.createDataFrame([(t,)], "t string").select(T.fold("t")).first()[0] == "".join(map(one, t))


def test_ocr_variant(spark):
    df = spark.createDataFrame([("12O BOLD 1S8 x",)], "t string")
    assert df.select(T.ocr_variant("t")).first()[0] == "120 BOLD 158 x"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.sampled_from(S.TYPE_PRIORITY), st.sampled_from(S.DETECTOR_PRIORITY)), max_size=14))
def test_dedup_equals_greedy(spark, spans):
    rows = [(1, t, a, a + n, d) for a, n, t, d in spans]
    kept = []
    for s in sorted(set(rows), key=lambda s: (s[2], -s[3], S.DETECTOR_PRIORITY.index(s[4]), S.TYPE_PRIORITY.index(s[1]), s[1], s[4])):
        if s[3] > s[2] and not any(k[2] <= s[2] and s[3] <= k[3] for k in kept):
            kept.append(s)
    df = spark.createDataFrame(rows, "file int, type string, a int, b int, detector string")
    assert sorted(map(tuple, D.dedup_spans(df, ["file"]).collect())) == sorted(kept)


@pytest.mark.parametrize(
    ("text", "names"),
    [("Camila Soto Vera", ["Camila Soto Vera"]), ("Sra. Rosa Parra", ["Rosa Parra"]), ("Rosa Parra", []), ("Rosa Parra Contreras", ["Rosa Parra Contreras"]), ("Santiago Centro", []), ("camila soto", [])],
)
def test_dictionary_names(spark, text, names):
    from veilspark.plans.packaging import ship

    ship(spark)
    r = spark.createDataFrame([(text,)], "t string").select(N.dictionary_names("t").alias("s")).first()
    assert [text[s.a : s.b] for s in r.s] == names


def test_list_matches_variants(spark):
    names = spark.createDataFrame([("Ana María Soto Vera",), ("Calle Larga 123, Talca",)], "entry string")
    docs = spark.createDataFrame([(1, "por SOTO VERA, ANA MARIA y (Ana Soto)"), (2, "en calle larga 123."), (3, "Anastasia Soto")], "id int, text string")
    found = {(r.id, r.type, r.value) for r in N.list_matches(docs, ["id"], "text", names).collect()}
    assert (1, "name", "SOTO VERA, ANA MARIA") in found and (1, "name", "Ana Soto") in found
    assert (2, "address", "calle larga 123") in found
    assert not [f for f in found if f[0] == 3]
