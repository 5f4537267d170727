from graphquarry.operators import lookup as K


def test_lookup_of_many_files(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = make([("src/a.py",), ("src/b.py",), ("top.py",)], "path string")
    links = [("src/b.py", "src/a.py", "ast_import"), (".kb/designs/src/a.py.md", "src/a.py", "design_source"), ("c/x", "src/a.py", "concept_file_ref"), ("src/z.py", "src/a.py", "ast_import"), ("other.md", "src/a.py", "design_source")]
    posts = [("src/a.py", "s/1", "Old", "resolved", 9), ("src/a.py", "s/2", "New", "open", 1), ("src/a.py", "s/3", "Gone", "stale", 99), ("src/a.py", "s/4", "More", "open", 5), ("src/a.py", "s/5", "Last", "duplicate", 5)]
    out = K.sections(
        files, 500, make([("src/a.py", "Design of a."), ("src/b.py", "")], "source string, content string"), make([("src", "In src", 0), ("project", "All", 0), ("lib", "No", 0)], "directory string, title string, priority int"),
        make(posts, "file string, post string, title string, status string, votes long"), make([("src", "left off here")], "directory string, body string"), make(links, "source string, target string, link_type string"), make([("Ship", ["src/**"]), ("Py", ["*.py"])], "title string, globs array<string>"),
    )
    got = {(r["path"], r["section"]): r["content"] for r in out.collect()}
    assert got == {
        ("src/a.py", K.DESIGN): "Design of a.", ("src/a.py", K.RULES): "- All\n- In src", ("src/a.py", K.ISSUES): "- [open] More\n- [open] New\n- [resolved] Old", ("src/a.py", K.SIGNALS): "left off here",
        ("src/a.py", K.LINKS): "- src/b.py\n- src/z.py\n- [[c/x]] (concept file ref)\n- [[other.md]] (design file)", ("src/a.py", K.PLAYBOOKS): "- Py\n- Ship", ("src/a.py", K.SIBLINGS): "- b.py",
        ("src/b.py", K.RULES): "- All\n- In src", ("src/b.py", K.SIGNALS): "left off here", ("src/b.py", K.PLAYBOOKS): "- Py\n- Ship", ("src/b.py", K.SIBLINGS): "- a.py", ("top.py", K.RULES): "- All", ("top.py", K.PLAYBOOKS): "- Py",
    }


def plain(sections, budget):
    out, used = [], 0
    for n, content in sorted(sections):
        size = len(content) // 4
        if used + size > budget:
            if budget - used > 50:
                out.append((n, content[: (budget - used) * 4] + "\n... truncated due to token budget\n"))
            break
        out.append((n, content))
        used += size
    return out


def test_budgets(spark):
    cases = {"a": [40, 200, 10], "b": [100, 4, 4], "c": [900], "d": [101], "e": [400, 0, 3], "f": [196, 300, 20], "g": [400, 8, 0]}
    rows = [(p, i, chr(97 + i) * n) for p, ns in cases.items() for i, n in enumerate(ns)]
    d = spark.createDataFrame(rows, "path string, section int, content string")
    for budget in (25, 60, 100, 1000):
        got = {}
        for r in sorted(K.within(d, budget).collect(), key=lambda r: (r["path"], r["section"])):
            got.setdefault(r["path"], []).append((r["section"], r["content"]))
        want = {p: plain([(i, chr(97 + i) * n) for i, n in enumerate(ns)], budget) for p, ns in cases.items()}
        assert got == {p: w for p, w in want.items() if w}


def test_staleness(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "path string, hash string")
    designs = spark.createDataFrame([("a", "A", "1"), ("b", "B", "1"), ("c", "C", "1")], "source string, title string, source_hash string")
    assert sorted(map(tuple, K.stale_designs(files, designs).collect())) == [("a", "A", False), ("b", "B", True), ("c", "C", True)]


def test_last_rules_of_a_crowded_directory_are_found_without_pairing_all(spark):
    """With a limit, a path meets the last rules of each directory only: as many rows as that, with ranks and totals over all."""
    from graphquarry.operators.indexes import rules_for

    rules = [(d, None if i % 9 == 0 else i % 7, f"{d}{i:04d}" if i % 5 else None) for d, n in ((".", 4), ("a", 300), ("a/b", 2)) for i in range(n)]
    rules = [(*x, i) for i, x in enumerate(rules) if x[2] is not None or x[1] == 3]
    r = spark.createDataFrame(rules, "directory string, priority int, title string, rule int")
    paths = ["a/b/c", "a/d", "e"]
    got = rules_for(spark.createDataFrame([(p,) for p in paths], "path string"), r, 3)
    order = lambda x: (len(x[0]) if x[0] != "." else 0, x[1] is None, -(x[1] or 0), x[2] is not None, x[2] or "")
    want = set()
    for p in paths:
        mine = sorted((x for x in rules if x[0] == "." or (p + "/").startswith(x[0] + "/")), key=order)
        want |= {(p, x[0], x[1], x[2], i + 1, len(mine)) for i, x in list(enumerate(mine))[-3:]}
    assert {tuple(x) for x in got.select("path", "directory", "priority", "title", "rank", "total").collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
