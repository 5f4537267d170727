import datetime as dt

from graphquarry.operators import checks as K
from graphquarry.operators import incremental as I
from graphquarry.operators import indexes as X
from graphquarry.operators import symbols as Y
from graphquarry.sources import files as S
from graphquarry.sources import store
from graphquarry.streaming import refresh as R


def test_merge_equals_rebuild(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (4, "d")], "k long, v string")
    out = I.merge(base, new, "k", spark.createDataFrame([(3,)], "k long"))
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "B"), (4, "d")]


def test_streamed_refresh(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(f"{tmp_path}/t/v0")
    rows = [(2, "x", False, 1), (2, "y", False, 2), (1, None, True, 1), (5, "n", False, 1)]
    spark.createDataFrame(rows, "k long, v string, deleted boolean, changed_at long").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("k long, v string, deleted boolean, changed_at long").parquet(f"{tmp_path}/in")
    R.refresh(s, f"{tmp_path}/t", "k", f"{tmp_path}/c").awaitTermination(60)
    assert sorted(map(tuple, R.current(spark, f"{tmp_path}/t").collect())) == [(2, "y"), (5, "n")]


def test_streamed_refresh_of_empty_batches_and_later_versions(spark, tmp_path):
    """Batches without rows leave a version too, and a stream that starts on an old table goes on from its newest version."""
    for k in (0, 4, 5):
        spark.createDataFrame([(1, f"v{k}")], "k long, v string").write.parquet(f"{tmp_path}/t/v{k}")
    schema = "k long, v string, deleted boolean, changed_at long"
    for rows in ([(2, "b", False, 1)], [], [(3, "c", False, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").where("v <> 'b' OR k = 2")
        R.refresh(s, f"{tmp_path}/t", "k", f"{tmp_path}/c").awaitTermination(60)
    assert sorted(map(tuple, R.current(spark, f"{tmp_path}/t").collect())) == [(1, "v5"), (2, "b"), (3, "c")]


def test_replaced_tables(spark, tmp_path):
    t = f"{tmp_path}/table"
    for k in range(3):
        old = store.open_table(spark, t, "k long")
        store.replace(old.union(spark.createDataFrame([(k,)], "k long")), t)
    assert sorted(r["k"] for r in store.open_table(spark, t, "k long").collect()) == [0, 1, 2] and store.versions(spark, t) == [1, 2]
    assert store.open_table(spark, f"{tmp_path}/none", "k long").count() == 0


def test_change_levels(spark):
    cases = [
        (("s", "d", "i", "s", None, "i", "agent"), "new_file"),
        ((None, None, None, "s", "d", "i", "agent"), "agent_updated"),
        (("s", "d", "i", "s", "edited", "i", "agent"), "unchanged"),
        (("s", "d", "i", "s", "d", "i", "skeleton-fallback"), "skeleton_only"),
        (("s", "d", "i", "t", "edited", "i", "agent"), "agent_updated"),
        (("s", None, None, "t", "d", None, "agent"), "content_changed"),
        (("s", "d", None, "t", "d", "i", "agent"), "interface_changed"),
        (("s", "d", "i", "t", "d", "i", "agent"), "content_only"),
        (("s", "d", "i", "t", "d", "j", "agent"), "interface_changed"),
    ]
    names = "stored_source string, stored_design string, stored_interface string, now_source string, now_design string, now_interface string, updated_by string, want string"
    out = I.change_level(spark.createDataFrame([(*a, b) for a, b in cases], names)).collect()
    assert [r["level"] for r in out] == [r["want"] for r in out]


def test_billboards(spark):
    """Up to three clauses are joined as they are; of more, those whose words recur most, without near repeats."""
    few = [("a", 1, "Provides the token cache; reads config files for"), ("a", 2, None)]
    many = [("b", i, d) for i, d in enumerate(["graph query engine", "graph query planner", "graph store tables", "unrelated words here", "query cache tables"])]
    out = {r["directory"]: r["billboard"] for r in I.billboards(spark.createDataFrame(few + many, "directory string, pos long, description string")).collect()}
    assert out["a"] == "token cache; config files"
    from collections import Counter

    words = [set(d.split()) for _, _, d in many]
    freq = Counter(w for ws in words for w in ws)
    kept = []
    for i in sorted(range(len(words)), key=lambda i: (-sum(freq[w] for w in words[i]), i)):
        if len(kept) < 3 and not any(len(words[i] & words[j]) * 2 > len(words[i]) for j in kept):
            kept.append(i)
    assert out["b"] == "; ".join(many[i][2] for i in kept) and len(kept) == 3


def test_signals(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [("a", now - dt.timedelta(hours=80), True), ("b", now - dt.timedelta(hours=1), True), ("c", None, True), ("d", now, False)]
    from pyspark.sql import functions as F

    out = I.expired_signals(spark.createDataFrame(rows, "id string, created timestamp, dir_exists boolean"), F.lit(now))
    assert sorted((r["id"], r["why"]) for r in out.collect()) == [("a", "expired"), ("c", "expired"), ("d", "orphan")]


def test_budget_cuts_one_tail(spark):
    s = spark.createDataFrame([(1, 0, 100), (1, 1, 150), (1, 2, 10), (2, 0, 180), (2, 1, 100)], "doc long, pos long, tokens long")
    assert sorted(map(tuple, Y.budgeted(s, 200).collect())) == [(1, 0, 100, False), (1, 1, 100, True), (2, 0, 180, False)]


def test_call_counts_keep_zeros(spark):
    s = spark.createDataFrame([(1, "foo"), (2, "bar"), (3, "baz"), (4, "meth")], "id long, name string")
    c = spark.createDataFrame([(1, 2, 2), (3, 2, 2), (4, 3, 7)], "caller long, callee long, line long")
    assert sorted(map(tuple, Y.call_counts(s, c).collect())) == [(1, "foo", 0, 1), (2, "bar", 2, 0), (3, "baz", 1, 1), (4, "meth", 0, 1)]


def test_concepts_fall_back_to_like_names(spark):
    rows = [("Authentication", ["auth"], ["sec"], "who"), ("Billing", [], [], "money")]
    c = spark.createDataFrame(rows, "title string, aliases array<string>, tags array<string>, summary string")
    assert [r["title"] for r in X.search_concepts(c, "Auth-").collect()] == ["Authentication"]
    assert [r["title"] for r in X.search_concepts(c, "authentcation").collect()] == ["Authentication"]
    assert X.find_concept(c, "AUTH").count() == 1


def test_exit_codes(spark):
    for rows, code in (([], 0), ([("warning",)], 2), ([("info",)], 0), ([("warning",), ("error",)], 1)):
        assert K.exit_code(spark.createDataFrame(rows, "severity string")).first()["exit_code"] == code


def test_ignore_rules():
    rules = ["*.log", "build/", "!keep.log", "/top.txt", "docs/**/x.md"]
    hit = lambda p: next((h for h, r in reversed([S.ignore_regex(x) for x in rules]) if r.match(p)), False)
    assert hit("a/b.log") and not hit("a/keep.log") and hit("build/x") and hit("top.txt") and not hit("a/top.txt") and hit("docs/a/b/x.md") and hit("docs/x.md")


def test_any_list_ignores(spark):
    """A line that lets a path in counts in its own list only; a folder's lines hold for what is below it."""
    from pyspark.sql import functions as F

    paths = ["a.log", "keep.log", "sub/x.tmp", "x.tmp", "own.bak", "b.py"]
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    rule = S.ignored(["*.log", "!keep.log"], {"sub": ["*.tmp"], "": ["!a.log"]}, ["*.bak"])
    assert sorted(r["path"] for r in d.where(rule(F.col("path"))).collect()) == ["a.log", "own.bak", "sub/x.tmp"]


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\nclass A(Base):\n    def f(self):\n        self.g()\ndef _h():\n    import json\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "x.bin").write_bytes(b"a\0b")
    f = S.discover(spark, str(tmp_path), ["*.md"])
    assert sorted(r["path"] for r in f.collect()) == ["bad.py", "src/a.py"]
    t = f.select("path", f["content"].cast("string").alias("text"))
    got = sorted((r["qualified_name"], r["symbol_type"], r["visibility"]) for r in S.python_symbols(t).collect())
    assert got == [("a.A", "class", "public"), ("a.A.f", "method", "public"), ("a._h", "function", "private")]
    assert sorted(r["module"] for r in S.python_imports(t).collect()) == ["json", "os"]


def test_front_matter(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("---\ntitle: Auth\ntags: [a, b]\naliases:\n  - x\n---\nBody",), ("none",)], "t string")
    a, b = t.select(S.front_matter(F.col("t")).alias("m")).select("m.*").collect()
    assert a["fields"]["title"] == "Auth" and a["lists"]["tags"] == ["a", "b"] and a["lists"]["aliases"] == ["x"] and a["body"] == "Body" and b["fields"] is None
