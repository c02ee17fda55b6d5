"""Scalar rules F1-F18 against hand-written expectations (FIXTURES §3)."""

import pytest
from pyspark.sql import functions as F

from bibspark.functions import text as X
from bibspark.functions import urls as R


def one(spark, col, value, schema="v STRING"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


@pytest.mark.parametrize("raw,expected", [
    (None, "Unknown"), ("", "Unknown"), ("Proc. VLDB (12) 2019, 45", "Proc VLDB  2019"), ("(x)", ""),
    ("IEEE Trans. 123456 x", "IEEE Trans  x"),
])
def test_sanitize_text(spark, raw, expected):
    assert one(spark, X.sanitize_text("v"), raw) == expected


@pytest.mark.parametrize("raw,expected", [("ICSE 2020", "ICSE"), ("  ", "Unknown"), (None, "Unknown")])
def test_conference_acronym(spark, raw, expected):
    assert one(spark, X.conference_acronym("v"), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("Ada Love", True), ("Ada", False), ("A B C", False), ("José Diaz", False), (" ", True), ("Ada Love2", False),
])
def test_is_person_name(spark, raw, expected):
    assert one(spark, X.is_person_name("v"), raw) is expected


def test_seed_list(spark):
    assert one(spark, X.split_seed_list("v"), "a, b") == ["a", " b"]
    with pytest.raises(Exception):
        one(spark, X.split_seed_list("v"), "a;b")


def test_sanitize_string(spark):
    assert one(spark, X.sanitize_string("v"), " a/b:c? ") == "abc"


@pytest.mark.parametrize("raw,role,org", [
    ("Prof @ Pisa", "Prof", "Pisa"), ("Prof, Pisa", "Prof", "Pisa"), ("Prof Pisa", "?", "Prof Pisa"),
    ("a@b@c", "?", "a@b@c"), ("a, b, c", "?", "a, b, c"),
])
def test_affiliation(spark, raw, role, org):
    r = one(spark, X.affiliation_split("v"), raw)
    assert (r["role"], r["org"]) == (role, org)


@pytest.mark.parametrize("raw,expected", [("?cites=12,3", "12"), ("?x=1", None), ("No all versions link", None)])
def test_extract_id(spark, raw, expected):
    assert one(spark, X.extract_id_from("v", "cites"), raw) == expected


def test_url_params(spark):
    assert one(spark, X.user_id("v"), "/citations?user=AbC-1&hl=it") == "AbC-1"
    assert one(spark, X.org_id("v"), "/x?org=123&y") == "123"
    assert one(spark, X.citation_for_view("v"), "a?citation_for_view=U1:22&z") == "U1:22"
    assert one(spark, X.as_ylo("v"), "/s?as_ylo=2019&as_yhi=2019") == "2019"
    assert one(spark, X.after_last_eq("v"), "a=b=c") == "c"
    assert one(spark, X.after_last_eq("v"), "abc") is None


def test_years(spark):
    assert one(spark, X.first_year_word("v"), "Journals ranked 2021 x 2022") == 2021
    assert one(spark, X.first_year_word("v"), "12345 none") is None
    assert one(spark, X.publication_year("v", 2024), "2019/5/1") == 2019
    assert one(spark, X.publication_year("v", 2024), "1949/1/1") is None
    assert one(spark, X.publication_year("v", 2024), "2030") is None


def test_json_names(spark):
    txt = 'var x=[{"n":"Ada Love","k":3},{"n":"Bob Low"},{"o":{"n":"Cut Off"}},{\'q\':\'Single Quote\'}]'
    assert one(spark, X.root_names("v"), txt) == ["Bob Low", "Ada Love"]


def test_urls(spark):
    assert one(spark, R.scholar_search_url("v"), "Ada Love") == R.SCHOLAR_SEARCH + "Ada+Love"
    assert one(spark, R.dblp_search_url("v"), "Ada Love/~*#") == R.DBLP_SEARCH + "Ada%20Love/~%2A%23"
    assert one(spark, R.scimago_url(F.lit(2020), F.lit(3)), "x") == R.SCIMAGO_RANK + "?year=2020&page=3"
    assert one(spark, F.get(R.paged_urls("v", 2), 1), "u") == "u&cstart=100&pagesize=100"
    assert one(spark, F.get(R.paged_urls("v", 3, "citations"), 2), "u") == "u&start=20"


def test_page_ids(spark):
    assert one(spark, X.page_id(F.lit(2020), F.lit("4")), "x") == "2020_4"
    assert one(spark, X.next_page("v"), "4") == "5"
