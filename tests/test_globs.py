import re

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import globs as G
from graphquarry.operators import indexes as X

CASES = [
    ("*.log", ["a.log", "x/a.log", "a.log/b"], ["a.logs", "log"]), ("build/", ["build/x", "a/build/x/y", "build/"], ["build", "builds/x"]), ("/top", ["top", "top/x"], ["a/top"]), ("src/*.py", ["src/a.py"], ["src/a/b.py", "x/src/a.py"]),
    ("src/**", ["src/a", "src/a/b"], ["src", "a/src/b"]), ("**/x", ["x", "a/x", "a/b/x/c"], ["ax"]), ("a/**/b", ["a/b", "a/x/b", "a/x/y/b/c"], ["a/xb", "c/a/b"]), ("**/a/b", ["a/b", "x/a/b"], ["a/x/b"]), ("te?t_*", ["test_a", "x/text_"], ["tet_a"]),
    ("[ab].c", ["a.c", "x/b.c"], ["c.c", "ab.c"]), ("[!a].c", ["b.c"], ["a.c"]), ("*", ["a", "a/b"], []), ("**", ["a", "a/b"], []), ("*.tar.gz", ["a.tar.gz"], ["a.gz"]), ("a b", ["a b", "x/a b/c"], ["ab"]), ("\\#x", ["#x"], ["x"]), ("x+(1).c", ["x+(1).c"], ["xx1.c"]),
    (".env", [".env", "a/.env"], ["env", ".env.local"]), (".env.*", [".env.local"], [".env"]), ("*.env", ["staging.env", ".env"], ["environment.py"]),
]


@pytest.fixture(scope="module")
def hits(spark):
    paths = sorted({p for _, yes, no in CASES for p in (*yes, *no)})
    rules = G.glob_rules(spark.createDataFrame([(p,) for p, _, _ in CASES] + [("# note",), ("",), (None,)], "pattern string"))
    found = G.glob_hits(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    return paths, {(r["path"], r["pattern"]) for r in found.collect()}


@pytest.mark.parametrize("pattern,yes,no", CASES)
def test_patterns(hits, pattern, yes, no):
    assert all((p, pattern) in hits[1] for p in yes) and not any((p, pattern) in hits[1] for p in no)


def test_the_join_leaves_no_match_out(hits):
    """Every pair that a pattern's expression takes is found by its literal part."""
    paths, found = hits
    assert found == {(p, pattern) for pattern, _, _ in CASES for p in paths if re.search(G.glob_rule(pattern)[3], p)}


def kept(spark, paths, lines):
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    x = spark.createDataFrame(lines, "layer string, directory string, pos int, pattern string")
    return {r["path"] for r in G.reachable(d, x).collect()}


def test_layers(spark):
    """Any layer ignores; within one the last match decides; a directory's layer holds below it; walks do not go down into what is ignored."""
    lines = [("config", ".", 0, "*.tmp"), (".gitignore", ".", 0, "*.log"), (".gitignore", ".", 1, "!keep.log"), ("logs/.gitignore", "logs", 0, "!important.log"), ("logs/.gitignore", "logs", 1, "*.bak"), ("own", ".", 0, "**/migrations/"), ("own", ".", 1, "!app/migrations/keep.py")]
    paths = ["debug.log", "keep.log", "logs/important.log", "logs/x.bak", "x.bak", "scratch.tmp", "app/migrations/0001.py", "app/migrations/keep.py", "src/main.py"]
    assert kept(spark, paths, lines) == {"keep.log", "x.bak", "src/main.py"}
    assert kept(spark, paths, []) == set(paths)


def test_ignore_files_are_found_in_the_scan(spark):
    files = spark.createDataFrame([(".gitignore", "*.a\n# c\n\n!b.a"), ("x/y/.gitignore", "/x/y/z"), ("x/.gitignored", "*"), ("x/c.py", None)], "path string, text string")
    got = sorted(map(tuple, G.glob_rules(G.ignore_lines(files)).select("layer", "directory", "pos", "pattern", "negated").collect()))
    assert got == [(".gitignore", ".", 0, "*.a", False), (".gitignore", ".", 3, "!b.a", True), ("x/y/.gitignore", "x/y", 0, "/x/y/z", False)]


def test_triggers(spark):
    plays = spark.createDataFrame([("cli", ["src/cli/**", "*.md"]), ("py", ["**/*.py"]), ("all", ["src/**/x.py", "!src/a.py"])], "title string, globs array<string>")
    files = spark.createDataFrame([("src/cli/a.py",), ("docs/r.md",), ("src/x.py",)], "file string")
    assert [tuple(r) for r in X.by_trigger(files, plays).collect()] == [("docs/r.md", "cli", 1), ("src/cli/a.py", "cli", 2), ("src/cli/a.py", "py", 1), ("src/x.py", "all", 2), ("src/x.py", "py", 1)]
    assert {tuple(r) for r in X.by_trigger_dir(spark.createDataFrame([("src/cli",), ("src",)], "directory string"), plays).collect()} == {("src/cli", "cli", 2)}


def test_scopes_of_several_roots(spark):
    paths = spark.createDataFrame([("a/b/c/x.py",), ("q/x.py",), ("z",)], "path string")
    rules = spark.createDataFrame([(1, ["a"]), (2, ["a/b/"]), (3, ["c"]), (4, ["."]), (5, ["/a/b/c"]), (6, ["project"]), (7, ["q", "nowhere"])], "rule long, scopes array<string>")
    got = {(r["path"], r["root"], r["rule"]) for r in X.by_any_scope(paths, rules, ["a/b", "q"]).collect()}
    assert got == {("a/b/c/x.py", "a/b", k) for k in (2, 4, 5, 6)} | {("q/x.py", "q", k) for k in (4, 6, 7)}
    assert {r["rule"] for r in X.by_any_scope(paths, rules, ["."]).where("path = 'a/b/c/x.py'").collect()} == {1, 2, 4, 5, 6}


def test_crowded_scopes_are_dealt_out_and_pairs_never_shuffled(spark, monkeypatch):
    """A directory's many paths meet its many rules in several tasks, and a pair is made once, however many scopes of a rule a path has."""
    monkeypatch.setattr(X, "BLOCK", 20, raising=False)
    paths = [f"{a}/{b}/f{i}" for a in ("a", "ab", "q") for b in ("b", "b/c", "c") for i in range(20)] + ["z", "a", "a/b", ".", "./x"]
    some = ["a", "/a/b/", "a/b/c", "b", "q", "q/c", "ab", ".", "project", "a/b/f3", "./x", None]
    rules = [(i % 290 if i else None, [some[(i * k + i // 7) % len(some)] for k in range(1, 1 + i % 4)]) for i in range(300)]
    rules += [(1000 + i, ["a/b", "a", "."]) for i in range(100)] + [(1100 + i, ["a/b/c", "a/b", "a"]) for i in range(100)]
    roots = ["a/b", "q/", "."]
    want = set()
    for p in paths:
        root = next(r for r in roots if (p + "/").startswith(r.strip("/") + "/") or r == ".")
        top, parts = root.strip("/"), p.split("/")
        above = {"/".join(parts[: i + 1]) for i in range(len(parts))}
        held = {d for d in above if top == "." or (d + "/").startswith(top + "/")} | {".", "project"}
        want |= {(p, root, rule) for rule, scopes in rules if any(x and (x.strip("/") or ".") in held for x in scopes)}
    got = X.by_any_scope(spark.createDataFrame([(p,) for p in paths * 2], "path string"), spark.createDataFrame(rules, "rule long, scopes array<string>"), roots)
    rows = [tuple(r) for r in got.select("path", "root", "rule").collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange")  # from the top: no shuffle comes after pairing
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < len(want) / 2


def test_tags_fold_case_only(spark):
    posts = spark.createDataFrame([(1, ["Web_UI"], 1), (2, ["web-ui"], 2)], "post long, tags array<string>, votes long")
    assert [r["post"] for r in X.posts_by(posts, tag=" web_ui ").collect()] == [1]


def test_paths_are_never_broadcast(spark):
    """Patterns go to the paths; what a walk leaves out is merged, as it may be as long as the paths."""
    paths = spark.createDataFrame([("a/b/x.log",), ("a/build/o.o",), ("a/y.py",)], "path string")
    lines = spark.createDataFrame([("l", ".", 0, "*.log"), ("l", ".", 1, "build/")], "layer string, directory string, pos int, pattern string")
    found = G.reachable(paths, lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len([x for x in joins if "SortMergeJoin" in x]) == 2
    assert all("BuildRight" in x for x in joins if "BroadcastHashJoin" in x)
    assert [r["path"] for r in found.collect()] == ["a/y.py"]
