"""Name resolution step by step, the languages of files, and what a search shows."""

from graphquarry.functions import norm as N
from graphquarry.operators import build as B
from graphquarry.operators import resolve as R
from graphquarry.operators import text as T

SYMBOLS = [
    (1, "a.py", "Base", "class", 1, 9), (2, "a.py", "run", "method", 2, 3), (3, "a.py", "helper", "function", 10, 11),
    (4, "b.py", "Child", "class", 1, 9), (5, "b.py", "go", "method", 2, 5), (6, "b.py", "own", "function", 20, 21), (7, "c.py", "lonely", "function", 1, 2), (8, "c.py", "x.deep", "function", 4, 5),
]
IMPORTS = [("b.py", "helper", "a.py", "helper"), ("b.py", "al", "a.py", "helper"), ("b.py", "mod", "c.py", None), ("b.py", "p.q", "c.py", None), ("b.py", "gone", "none.py", "gone")]


def test_python_calls(spark):
    """super and unknown names resolve to nothing, however few symbols have the name; a bare call never to a method."""
    s = spark.createDataFrame(SYMBOLS, "id long, file string, name string, symbol_type string, line_start long, line_end long")
    i = spark.createDataFrame(IMPORTS, "file string, local string, module_file string, original string")
    up = spark.createDataFrame([(4, 1, 1)], "cls long, base long, line long")
    calls = [
        ("super", "super", "super.run", None, None), ("self own", "self", "self.go", 5, 2), ("self base", "self", "self.run", 2, 2), ("self none", "self", "self.nope", None, None), ("same file", None, "own", 6, 3),
        ("method", None, "go", None, None), ("bare import", None, "helper", 3, 6), ("alias", None, "al", 3, 6), ("module", "mod", "mod.lonely", 7, 4), ("prefix", "p.q.x", "p.q.x.deep", 8, 5),
        ("prefix, bare", "p.q.z", "p.q.z.lonely", 7, 5), ("unique elsewhere", None, "lonely", None, None), ("dead import", None, "gone", None, None), ("other receiver", "obj", "obj.own", 6, 3),
    ]
    sites = spark.createDataFrame([(k, "b.py", 5, r, n) for k, r, n, _, _ in calls], "site string, file string, caller long, receiver string, name string")
    out = {r["site"]: (r["target"], r["step"]) for r in R.resolve_calls(sites, s, i, up).collect()}
    assert out == {k: (t, step) for k, _, _, t, step in calls}
    only = {r["site"]: r["target"] for r in R.same_file_only(sites.select("site", "file", "name"), s).collect()}
    assert only["same file"] == 6 and only["method"] == 5 and only["unique elsewhere"] is None


def test_class_names(spark):
    s = spark.createDataFrame(SYMBOLS, "id long, file string, name string, symbol_type string, line_start long, line_end long")
    i = spark.createDataFrame([("b.py", "Base", "a.py", "Base"), ("b.py", "pk.m", "a.py", None), ("b.py", "helper", "a.py", "helper")], "file string, local string, module_file string, original string")
    sites = spark.createDataFrame([("own", "b.py", "Child"), ("imported", "b.py", "Base"), ("dotted", "b.py", "pk.m.Base"), ("function", "b.py", "helper")], "site string, file string, name string")
    assert {r["site"]: (r["target"], r["step"]) for r in R.resolve_classes(sites, s, i).collect()} == {"own": (4, 3), "imported": (1, 4), "dotted": (1, 4)}
    j = i.where("local <> 'Base'")
    assert {r["site"]: r["target"] for r in R.resolve_classes(sites, s, j).collect()} == {"own": 4, "dotted": 1}


def test_languages_of_files(spark):
    want = {"a/b.pyi": "Python Stub", "x.tsx": "TypeScript JSX", "x.H": "C Header", "Makefile": "Makefile", "a/.gitignore": "Config", "x.unknown": "Text", "plain": "Text", "d/Taskfile.yml": "Task"}
    d = spark.createDataFrame([(p,) for p in want], "path string").select("path", N.language_of("path").alias("l"))
    assert {r["path"]: r["l"] for r in d.collect()} == want


def test_what_a_search_shows(spark):
    rows = [("a", "stack", "stale"), ("b", "stack", None), ("c", "concept", "deprecated"), ("d", "concept", None), ("e", "design", "deprecated")]
    d = spark.createDataFrame(rows, "id string, kind string, status string")
    shown = lambda **k: "".join(sorted(r["id"] for r in d.where(T.included(**k)).collect()))
    assert shown() == "bde" and shown(status="stale") == "a" and shown(deprecated=True) == "bcde" and shown(stale=True) == "abde"
    assert shown(status="open") == "b" and shown(kind="concept") == "d" and shown(status="deprecated") == "e"


def test_update_equals_rebuild(spark):
    def row(path, kind, **k):
        return tuple({"path": path, "kind": kind, "ok": True, "tags": [], "aliases": [], "files": [], "concepts": [], "stack": [], "imports": []}.get(c, None) if c not in k else k[c] for c in (x.split()[0] for x in B.PARSED.split(", ")))

    rows = [row("c/a.md", "concept", title="Auth", body="see [[Ghost]] [[Rule]]", aliases=["login"], files=["src/x.py", "src/no.py"], tags=["t"]), row("c/b.md", "concept", title="Other", aliases=["LOGIN"]),
            row("v/r.md", "convention", title="Rule", body="[[login]]", directory="src"), row("d/x.md", "design", title="X", source="src/x.py", imports=["src/y.py"], body="[[auth]]", stack=["s/1.md"]),
            row("s/1.md", "stack", title="Bug", concepts=["Auth", "Nowhere"], files=["src/z.py"]), row("bad.md", "concept", ok=False)]
    d = spark.createDataFrame(rows, B.PARSED)
    have = spark.createDataFrame([("src/x.py",)], "path string")
    out = B.full_build(d, have)
    links = {(r["source"], r["target"], r["link_type"]) for r in out["links"].collect()}
    assert links == {
        ("d/x.md", "src/x.py", "design_source"), ("src/x.py", "src/y.py", "ast_import"), ("d/x.md", "c/a.md", "wikilink"), ("d/x.md", "s/1.md", "design_stack_ref"), ("c/a.md", ".kb/concepts/Ghost.md", "wikilink"),
        ("c/a.md", "v/r.md", "wikilink"), ("c/a.md", "src/x.py", "concept_file_ref"), ("v/r.md", "c/a.md", "convention_concept_ref"), ("s/1.md", "c/a.md", "stack_concept_ref"), ("s/1.md", ".kb/concepts/Nowhere.md", "stack_concept_ref"), ("s/1.md", "src/z.py", "stack_file_ref"),
    }
    assert [tuple(r) for r in out["aliases"].collect()] == [("c/a.md", "login")]
    assert {(r["path"], r["action"]) for r in out["log"].where("action = 'failed'").collect()} == {("bad.md", "failed")}
    assert {r["path"] for r in out["artifacts"].where("is_stub").collect()} == {".kb/concepts/Ghost.md", ".kb/concepts/Nowhere.md", "src/y.py", "src/z.py"}
    changed = spark.createDataFrame([row("c/a.md", "concept", title="Auth", body="")], B.PARSED)
    after = B.full_build(B.updated(d, changed, spark.createDataFrame([("v/r.md",)], "path string")), have)
    fresh = B.full_build(spark.createDataFrame([r for r in rows if r[0] not in ("c/a.md", "v/r.md")], B.PARSED).union(changed), have)
    for name in after:
        assert sorted(map(str, after[name].collect())) == sorted(map(str, fresh[name].collect()))


def test_lookups_meet_one_symbol_a_name(spark):
    """A name that very many symbols of a file share is grouped before it is looked up: each site meets one row."""
    s = spark.createDataFrame([(i, "a.py", "same", "class", 100 - i, 200) for i in range(100)], "id long, file string, name string, symbol_type string, line_start long, line_end long")
    sites = spark.createDataFrame([(k, "a.py", "same", "same") for k in range(50)], "site long, file string, name string, bare string")
    hit = R._in_file(sites, s, ["class"])
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate"), plan
    assert {(r["site"], r["target"]) for r in hit.collect()} == {(k, 99) for k in range(50)}
    i = spark.createDataFrame([], "file string, local string, module_file string, original string")
    assert {tuple(r) for r in R.resolve_classes(sites.select("site", "file", "name"), s, i).select("site", "target", "step").collect()} == {(k, 99, 3) for k in range(50)}


def test_spans_of_lines_by_equality(spark):
    """Classes around a method and methods within a class, over short, long, empty and nested spans, without a comparison of each two in a file."""
    import random

    from graphquarry.operators import symbols as Y

    r = random.Random(5)
    rows = [(i, r.choice("ab"), f"n{i}", r.choice(["class", "method"]), a := r.choice([1, 2, 7, 8, 255, 256, 70000, r.randrange(1, 300)]), a + r.choice([-1, 0, 1, 2, 7, 8, 300, 1 << 20])) for i in range(240)]
    rows.append((999, "a", "none", "method", None, None))
    s = spark.createDataFrame(rows, "id long, file string, name string, symbol_type string, line_start long, line_end long")
    holds = lambda c, m: c[1] == m[1] and m[4] is not None and c[4] < m[4] <= c[5]
    classes, methods = ([x for x in rows if x[3] == k] for k in ("class", "method"))
    found = Y.enclosing_class(s)
    assert {(x["id"], x["cls"]) for x in found.collect()} == {(m[0], max((c[4], c[0]) for c in classes if holds(c, m))[1]) for m in methods if any(holds(c, m) for c in classes)}
    edges = spark.createDataFrame([], "source long, target long, edge_type string")
    counts = Y.class_hierarchy(s, edges)
    assert {x["id"]: x["methods"] for x in counts.collect()} == {c[0]: sum(holds(c, m) for m in methods) for c in classes}
    for d in (found, counts):
        joins = [x for x in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
        assert joins and not any("<" in x for x in joins), joins
