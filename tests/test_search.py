import sqlite3

from graphquarry.functions.text_udf import stem
from graphquarry.operators import text as T

DOCS = [(1, "Auth service", "running tokens for the auth"), (2, "Cors", "the middleware runs and runs"), (3, "Util", "token of a café"), (4, "Auth auth", "auth tokens"), (5, "", "")]


def fts(match):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, title, body) VALUES (?, ?, ?)", DOCS)
    return db.execute("SELECT rowid, rank FROM f WHERE f MATCH ? ORDER BY rank, rowid", (match,)).fetchall()


def test_bm25_equals_sqlite(spark):
    d = spark.createDataFrame(DOCS, "id long, title string, body string")
    p = T.postings(d, "id", "title", "body", stem=stem)
    for word, term in (("running", "run"), ("cafe", "cafe"), ("tokens", "token")):
        got = [(r["id"], round(r["rank"], 5)) for r in T.bm25(p, d, "id", [[term]]).collect()]
        assert got == [(i, round(r, 5)) for i, r in fts(f'"{word}"')]


def test_compound_query_counts_all_phrases(spark):
    d = spark.createDataFrame(DOCS, "id long, title string, body string")
    got = [(r["id"], round(r["rank"], 5)) for r in T.search_texts(d, "id", "auth service", "title", "body").collect()]
    want = [(i, round(r, 5)) for i, r in fts('"auth service" OR ("auth" AND "service")')]
    assert [i for i, _ in got] == [i for i, _ in want]


def test_separators_alone_find_nothing(spark):
    d = spark.createDataFrame(DOCS, "id long, title string, body string")
    assert T.search_texts(d, "id", "--", "title", "body").count() == 0


def test_routes():
    assert T.route("CN-001", None, True) == "code" and T.route("x", ["t"], True) == "tags" and T.route("x", None, False) == "scan" and T.route("x", None, True) == "text"
