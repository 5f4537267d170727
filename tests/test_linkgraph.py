import pytest

from graphquarry.operators import linkgraph as L
from graphquarry.operators import traverse as V


@pytest.fixture(scope="module")
def links(spark):
    rows = [(2, 1, "design_source"), (4, 1, "ast_import"), (4, 5, "ast_import"), (2, 3, "wikilink"), (1, 5, "ast_import"), (3, 6, "wikilink"), (7, 3, "stack_concept_ref"), (8, 5, "ast_import")]
    return spark.createDataFrame(rows, "source long, target long, link_type string").cache()


def got(df):
    return sorted(map(tuple, df.collect()))


def start(spark, x):
    return spark.createDataFrame([(x,)], "start long")


def test_outbound_repeats_a_node_at_each_depth(spark, links):
    assert got(V.walk(links, start(spark, 4), 3, types=["ast_import"]).select("node", "depth")) == [(1, 1), (5, 1), (5, 2)]


def test_inbound(spark, links):
    assert got(V.walk(links, start(spark, 5), 3, inbound=True, types=["ast_import"]).select("node", "depth")) == [(1, 1), (4, 1), (4, 2), (8, 1)]


@pytest.mark.parametrize("edges,want", [([(1, 2), (2, 1)], [(2, 1)]), ([(1, 2), (2, 3), (3, 1)], [(2, 1), (3, 2)]), ([(1, 1)], [(1, 1)])])
def test_cycles(spark, edges, want):
    e = spark.createDataFrame([(a, b, "ast_import") for a, b in edges], "source long, target long, link_type string")
    assert got(V.walk(e, start(spark, 1), 9).select("node", "depth")) == want


def test_depth_below_one_and_above_the_cap(spark):
    e = spark.createDataFrame([(i, i + 1, "ast_import") for i in range(15)], "source long, target long, link_type string")
    assert got(V.walk(e, start(spark, 0), 0).select("node", "depth")) == [(1, 1)]
    assert len(got(V.walk(e, start(spark, 0), 50).select("node", "depth"))) == 10


def test_first_visits_and_closure(spark, links):
    e = links.select("source", "target")
    assert got(V.first_visits(e, start(spark, 4), 5)) == [(1, 1), (4, 0), (5, 1)]
    assert got(V.closure(e, start(spark, 7))) == [(3,), (6,), (7,)]


def test_aliases_fold_ascii_only_and_first_writer_wins(spark):
    art = spark.createDataFrame([("a", "concept"), ("b", "concept")], "path string, kind string")
    al = spark.createDataFrame([("a", "Auth", 1), ("b", "AUTH", 2), ("b", "É", 3)], "path string, alias string, pos long")
    names = spark.createDataFrame([("aUTh",), ("é",)], "name string")
    assert got(L.resolve_aliases(names, al, art)) == [("aUTh", "a", "concept")]


def test_rules_in_callers_order(spark):
    r = spark.createDataFrame([(".", 0, 0, "active"), (".", 1, -1, "draft"), (".", 2, 0, "deprecated"), (".", 3, 10, "active"), ("src", 0, 0, "active")], "directory string, ordinal int, priority int, status string")
    assert [x["ordinal"] for x in L.inherited_rules(r, ["."]).collect()] == [3, 0, 1]
    assert [x["ordinal"] for x in L.inherited_rules(r, ["."], deprecated=True).collect()] == [3, 0, 2, 1]
    assert [x["directory"] for x in L.inherited_rules(r, ["src", "."]).collect()][0] == "src"


def test_base_class_methods(spark):
    inh = spark.createDataFrame([(2, 1, 5), (3, 2, 9), (1, 3, 1)], "cls long, base long, line long")
    m = spark.createDataFrame([(1, "foo"), (2, "bar"), (3, "foo")], "owner long, name string")
    c = spark.createDataFrame([(1,), (2,), (3,)], "cls long")
    out = {(r["cls"], r["name"]): r["owner"] for r in V.resolve_in_bases(inh, m, c).collect()}
    assert out[(2, "foo")] == 1 and out[(3, "foo")] == 3 and out[(3, "bar")] == 2


def test_bases_are_walked_to_the_end(spark):
    inh = spark.createDataFrame([(i, i + 1, 1) for i in range(12)] + [(12, 3, 1), (0, 5, 2)], "cls long, base long, line long")
    m = spark.createDataFrame([(12, "far"), (5, "near"), (6, "near")], "owner long, name string")
    out = {(r["cls"], r["name"]): r["owner"] for r in V.resolve_in_bases(inh, m, spark.range(13).withColumnRenamed("id", "cls")).collect()}
    assert all(out[c, "far"] == 12 for c in range(13)) and out[0, "near"] == 5 and out[6, "near"] == 6


def test_a_popular_name_is_looked_up_once(spark):
    """Owners of a name share one look-up by its keys, and links are as by each key alone; what nothing answers falls back."""
    from graphquarry.operators import build as B

    rows = [(f"o{i}", f"o{i}", "n", ["a:n", "c:n"], "wikilink", "stub/n", "concept") for i in range(50)] + [("x", "x", "m", ["a:m"], "wikilink", None, "concept"), ("y", "y", "k", ["a:k", None], "wikilink", "stub/k", "concept"), ("z", "z", "s", [], "stack_file_ref", "src/s", "source")]
    sites = spark.createDataFrame(rows, "owner string, source string, name string, keys array<string>, link_type string, fallback string, kind string")
    names = spark.createDataFrame([("c:n", 1, "c/2", "concept"), ("a:n", 2, "c/1", "concept"), ("c:n", 3, "c/0", "concept")], B.NAMES)
    got = B.resolved(sites, names)
    assert {(r["owner"], r["target"]) for r in got.collect()} == {(f"o{i}", "c/2") for i in range(50)} | {("y", "stub/k"), ("z", "src/s")}
    assert "Aggregate [keys" in got._jdf.queryExecution().optimizedPlan().toString()


def test_impact_groups_the_posts_of_met_nodes_only(spark):
    links = spark.createDataFrame([("b", "a", "x"), ("b", "a", "x"), ("c", "b", "x"), ("c", "b", "y"), ("d", "z", "x")], "source string, target string, link_type string")
    artifacts = spark.createDataFrame([(x, "design", x.upper()) for x in "abcdz"], "path string, kind string, title string")
    posts = spark.createDataFrame([("p2", "two", "open", "b"), ("p1", "one", "open", "b"), ("p1", "one", "open", "b"), ("p3", "far", "open", "z"), ("p4", "shut", "done", "c")], "path string, title string, status string, about string")
    out = V.impact(links, artifacts, posts, "a", 2)
    assert got(out) == [("b", "design", "B", 1, "x", "p1 (one); p2 (two)"), ("c", "design", "C", 2, "x", ""), ("c", "design", "C", 2, "y", "")]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_link_rows_are_links_without_a_shuffle(spark):
    from graphquarry.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    assert got(v.link_rows.distinct()) == got(v.links)
    assert "Exchange" not in v.link_rows._jdf.queryExecution().executedPlan().toString()
