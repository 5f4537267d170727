import random

import pytest

from graphquarry.operators import text as T
from graphquarry.operators.text_index import TextIndex


def rows(df):
    """Ranks and ids; ranks that differ in their last digits alone are ties."""
    return sorted((round(r["rank"], 7) + 0.0, r["doc_id"]) for r in df.collect())


def ranks(df):
    return [r for r, _ in rows(df)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, rng.choice(["A title", "w1 w2"]), " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 80))), "x") for i in range(700)]
    docs += [(9001, None, None, "x"), (9002, "", "w1 " * 5000, "x"), (9003, "É w3", "e, W3!", "x")]
    d = spark.createDataFrame(docs, "doc_id long, title string, body string, term string").cache()
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), buckets=16)
    index.build(d, "title", "body")
    return d, index


@pytest.mark.parametrize("query", ["w1", "w59", "none", "w1 w2", "w2_w1", "w40.w7"])
def test_searches_equal_those_over_all_texts(made, query):
    d, index = made
    assert rows(index.search(query, 5000)) == rows(T.search_texts(d, "doc_id", query, "title", "body", limit=5000))
    for limit in (3, 20):
        assert ranks(index.search(query, limit)) == ranks(T.search_texts(d, "doc_id", query, "title", "body", limit=limit))


def test_phrases_and_any_words(made):
    d, index = made
    posts = T.postings(d, "doc_id", "title", "body")
    for phrases in ([["w1"], ["w30"]], [["w1", "w2", "w1"], ["w5"]], [["w1", "w1", "w1"]], [["w3", "e"]]):
        assert rows(index.bm25(phrases, limit=5000)) == rows(T.bm25(posts, d, "doc_id", phrases, limit=5000))
    assert sorted(map(tuple, index._phrase(["w1", "w1", "w1"]).where("doc = 9002").select("tf").collect())) == [(4998,)]


def test_a_search_reads_its_terms_and_skips_blocks(made):
    _, index = made
    read, plain = [], index.store.read
    index.store.read = lambda t, at, buckets=None: read.append((t, buckets)) or plain(t, at, buckets)
    plan = index.best("w1", 3)._jdf.queryExecution().executedPlan().toString()
    index.store.read = plain
    assert all(len(b) == 1 for t, b in read if t == "postings") and "PushedFilters: [IsNotNull(term)" in plan and "EqualTo(term,w1)" in plan.replace("In(term, [w1])", "EqualTo(term,w1)")
    heads = index._heads(["w1"])
    assert heads.count() > 6 and heads.select("level").distinct().count() > 1 and "level" in plan.split("PushedFilters")[-1] + plan


def test_an_empty_table(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.build(spark.createDataFrame([], "doc_id long, body string"), "body")
    assert index.search("a").count() == 0 and index.search("a b").count() == 0 and index.search("  ").count() == 0


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Of documents with keys of their own the words are grouped in their rows and go once to their bucket; a key of several rows is one document."""
    from graphquarry.sources.snapshot import Snapshot

    plans, commit = [], Snapshot.commit

    def seen(self, at, changes):
        plans.append(changes["postings"][0]._jdf.queryExecution().executedPlan().toString())
        assert "bucket" in changes["postings"][0].columns
        return commit(self, at, changes)

    monkeypatch.setattr(Snapshot, "commit", seen)
    d = spark.createDataFrame([(i, "b a a c" if i % 3 else "a b") for i in range(300)] + [(900, ""), (901, None)], "doc_id long, body string")
    for name, docs in (("once", d), ("pooled", d.union(d.where("doc_id = 7")))):
        index = TextIndex(spark, f"{tmp_path}/{name}", buckets=4)
        index.build(docs, "body")
        got = {r["doc"]: (r["tf"], r["len"], r["pos"]) for r in index._heads(["a"]).selectExpr("inline(docs)").collect()}
        want = {i: (2, 4, [1, 2]) if i % 3 else (1, 2, [0]) for i in range(300)}
        assert got == (want if name == "once" else want | {7: (4, 4, [1, 1, 2, 2])})
    assert plans[0].count("Exchange") == 1, plans[0]
