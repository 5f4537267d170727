import pytest

from graphquarry.operators import search as U
from graphquarry.sources import store


@pytest.fixture(scope="module")
def lib(spark):
    art = spark.createDataFrame(
        [("c/auth", "concept", "Authentication", "active", "CN-001"), ("c/old", "concept", "Old auth", "deprecated", "CN-002"), ("s/1", "stack", "Token trouble", None, "ST-001"), ("s/2", "stack", "Token gone", "stale", "ST-002"), ("d/x", "design", "Service", "active", "DS-001")],
        "path string, kind string, title string, status string, code string",
    )
    body = spark.createDataFrame([("c/auth", "who you are"), ("s/1", "the token of auth expires"), ("s/2", "token auth"), ("d/x", "uses auth token")], "path string, body string")
    tags = spark.createDataFrame([("c/auth", "security"), ("d/x", "security"), ("d/x", "Web_UI")], "path string, tag string")
    return art, body, tags


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_search_routes(lib):
    assert keys(U.unified(*lib, "CN-002")) == ["c/old"]
    assert keys(U.unified(*lib, "", ["security", "Web_UI"])) == ["d/x"]
    assert keys(U.unified(*lib, "", ["web-ui"])) == [] and keys(U.unified(*lib, "", ["web-ui"], indexed=False)) == ["d/x"]
    assert keys(U.unified(*lib, "auth")) == ["d/x", "s/1"]
    assert keys(U.unified(*lib, "auth", kind="stack")) == ["s/1"]
    assert keys(U.unified(*lib, "auth", scope="d/")) == ["d/x"]
    assert keys(U.unified(*lib, "uthent")) == ["c/auth"]
    assert keys(U.unified(*lib, "token auth", indexed=False)) == ["d/x", "s/1"]


def test_view(lib):
    assert U.view(lib[0], "CN-001")["path"] == "c/auth" and U.view(lib[0], "x")["error"] == "malformed" and U.view(lib[0], "CN-999")["error"] == "unknown"


def test_store(spark, tmp_path, lib):
    at = f"{tmp_path}/artifacts"
    assert store.open_table(spark, at, store.SCHEMAS["artifacts"]).count() == 0
    store.replace(lib[0], at)
    store.replace(lib[0].where("kind = 'concept'"), at)
    assert store.open_table(spark, at, store.SCHEMAS["artifacts"]).count() == 2
    assert store.open_table(spark, at, store.SCHEMAS["links"]).count() == 0


def test_crawl(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert sorted((r["path"], r["state"]) for r in store.crawl_changes(a, b).collect()) == [("a", "same"), ("b", "changed"), ("c", "gone"), ("d", "new")]


def test_file_lookup(spark):
    s = spark.createDataFrame([(1, "src/a.py", "f", "function", 1, "public"), (2, "src/a.py", "_g", "function", 5, "private"), (3, "src/b.py", "h", "method", 1, "public")], "id long, file string, name string, symbol_type string, line_start long, visibility string")
    c = spark.createDataFrame([(3, 1, 2)], "caller long, callee long, line long")
    links = spark.createDataFrame([("src/b.py", "src/a.py", "ast_import"), ("d", "src/a.py", "design_source")], "source string, target string, link_type string")
    art = spark.createDataFrame([("src/a.py", "source"), ("src/b.py", "source"), ("d", "design")], "path string, kind string")
    rules = spark.createDataFrame([("src", "in src", 0), ("project", "all", 0), ("other", "no", 0)], "directory string, title string, priority int")
    r = U.file_lookup("src/a.py", s, c, links, art, rules).first()
    assert (r["key_symbols"], r["importers"], r["references"], r["rules"], r["calls_in"]) == (["f"], ["src/b.py"], ["d"], ["all", "in src"], 1)
