import difflib

import pytest
from pyspark.sql import functions as F

from graphquarry.functions import norm as N
from graphquarry.functions.text_udf import porter


def value(spark, e, x="", **more):
    return spark.createDataFrame([(x,)], "x string").select(e.alias("v")).first()["v"]


@pytest.mark.parametrize("x,want", [("getUserName", ["get", "user", "name"]), ("HTTPServer", ["http", "server"]), ("a_b-c.d/e", ["a", "b", "c", "d", "e"]), ("__", []), ("two words", ["two", "words"]), ("utf8Decoder", ["utf8decoder"])])
def test_tokens(spark, x, want):
    assert value(spark, N.tokens("x"), x) == want


def test_strip_takes_all_white_space(spark):
    assert value(spark, N.strip("x"), "\t a b\n") == "a b"


def test_ascii_lower_leaves_other_letters(spark):
    assert value(spark, N.ascii_lower("x"), "AÉ") == "aÉ"


def test_wikilinks(spark):
    assert value(spark, N.wikilinks("x"), "[[ B ]] <!-- [[C]]\n[[D]] --> [[A]] [[B]]") == ["B", "A"]


@pytest.mark.parametrize("glob,path,hit", [("src/**/*.py", "src/a/b.py", True), ("src/**/*.py", "src/b.py", True), ("*.py", "a/b.py", False), ("a?.py", "ab.py", True), ("a.py", "abpy", False)])
def test_globs(spark, glob, path, hit):
    import re

    assert bool(re.search(value(spark, N.glob_regex("x"), glob), path)) == hit


def test_ancestors_and_slugs(spark):
    assert value(spark, N.ancestors("x"), "a/b/") == [".", "a", "a/b"]
    assert value(spark, N.slugify("x"), "Hello,  World!") == "hello-world"
    assert len(value(spark, N.slugify("x"), "word " * 30)) <= 60


def test_token_estimates_of_nothing(spark):
    assert value(spark, N.token_estimate("x")) == 0 and value(spark, N.token_estimate("x", 1)) == 1


def test_summary_rule_refs(spark):
    assert value(spark, N.summary("x"), "\n\nFirst\nline\n\nsecond\n## H") == "First\nline"
    assert value(spark, N.summary("x"), "## H\nx") == ""
    assert value(spark, N.rule("x"), "\nDo this.\n\nBecause") == "Do this."
    assert value(spark, N.file_refs("x"), "see `src/a.py` and `b.py`") == ["src/a.py"]


@pytest.mark.parametrize("w,s", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("generalization", "gener"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control")])
def test_porter(w, s):
    assert porter(w) == s


def test_suggestions_equal_difflib(spark):
    from graphquarry.operators.text import suggestions

    names = ["search_symbols", "search_symbol", "symbols", "trace", "serach", "research"]
    got = [r["name"] for r in suggestions(spark.createDataFrame([(n,) for n in names], "name string"), "search_symbls").collect()]
    assert got == difflib.get_close_matches("search_symbls", names, 3, 0.6)
