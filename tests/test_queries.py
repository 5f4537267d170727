import duckdb
import pandas as pd
import pytest

from graphquarry.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: "none" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) and x % 1 else str(int(x) if isinstance(x, float) else x)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


def test_stemmed_search_takes_all_languages(spark):
    """Ranks are those of BM25 over every text, whose number and lengths enter."""
    from graphquarry.functions.text_udf import stem
    from graphquarry.operators import text as T
    from graphquarry.sources.views import Views

    v = Views(spark, SF)
    assert v.texts.select("lang").distinct().count() > 1
    p = T.postings(v.texts, "doc_id", "title", "body", stem=stem)
    want = {r["doc_id"]: round(r["rank"], 6) for r in T.bm25(p, v.texts, "doc_id", [["disgust"]]).collect()}
    assert want and {r["doc_id"]: r["rank"] for r in QUERIES["fts_bm25_stemmed"](spark, SF).collect()} == want
