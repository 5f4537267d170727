import datetime as dt
import textwrap

import pytest

from graphquarry.operators import build as B
from graphquarry.sources import artifacts as A

DESIGN = textwrap.dedent("""\
    ---
    description: Parses tokens.
    id: DS-001
    updated_by: agent
    ---

    # src/pkg/tokens.py

    ## Interface Contract

    ```python
    ```python
    def parse(text): ...

    class Token: ...
    ```
    ```

    ## Dependencies

    - src/pkg/base.py
    - src/pkg/io.py

    ## Enums & constants

    - **Kind** — what a token is
      Values: WORD, SPACE.
    - **LIMIT** - the most
    Values: not indented

    ## Call paths

    - **parse()** — reads all
      Key hops: read, split

    ## Data flows

    - **text** in **parse** — decides the branch

    ## Wikilinks

    - [[Tokenizer]]
    - Cache

    ## Tags

    - parsing

    ## Guardrails

    - ST-001

    ## Notes

    Kept as it is.

    <!-- kb:meta {source: src/pkg/tokens.py, source_hash: abc, interface_hash: i1, design_hash: "d1", generated: 2024-05-01T10:00:00, generator: tool, dependents_complete: True} -->
    """)
POST = textwrap.dedent("""\
    ---
    id: ST-001
    title: "Token trouble"
    tags: [auth, cache]
    created: 2024-01-02
    author: me
    refs:
      concepts:
        - Tokenizer
      files: [src/pkg/tokens.py]
    ---
    ## Problem
    It fails.
    <!-- a note -->
    ### Context
    At night.
    ### Attempts
    - first try
    * second try
    ## Findings
    ### F1
    **Date:** 2024-02-03 | **Author:** you | **Votes:** -2 | **Accepted:** true

    Restart it.

    #### Comments
    works
    ### F2
    No line of votes.
    """)
CONCEPT = '---\ntitle: Tokenizer\nid: CN-001\naliases:\n  - Lexer\ntags: [nlp]\n---\nCuts text.\n\nSee `src/pkg/tokens.py` and [[Nowhere]].\n\n## Decision Log\n- one\n* two\n## Next\n- three\n'
FILES = [
    (".kb/designs/src/pkg/tokens.py.md", DESIGN), (".kb/stack/ST-001.md", POST), (".kb/concepts/CN-001.md", CONCEPT), (".kb/conventions/a.md", "---\ntitle: Rule\nid: CV-001\nscope: src\npriority: 3\n---\nAlways so.\n\nBecause [[lexer]].\n"),
    (".kb/playbooks/p.md", "---\ntitle: Ship\nid: PB-001\naliases: [deploy]\ntags: [ops]\n---\nHow to ship.\n\nSteps.\n"), (".kb/concepts/bad.md", "no front matter"), (".kb/concepts/state.md", "---\ntitle: x\nid: CN-009\nstatus: odd\n---\n"),
    (".kb/stack/none.md", "---\nid: ST-002\ntitle: t\ncreated: 2024-01-01\nauthor: a\n---\n"), (".kb/designs/x.md", "---\ndescription: d\nid: DS-2\n---\n# x\n"), (".kb/designs/null.md", None), ("src/pkg/tokens.py", "x = 1"), (".kb/concepts/readme.txt", "x"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return A.typed(spark.createDataFrame(FILES, "path string, text string")).cache()


def test_bad_files_are_rows_with_an_error(rows):
    got = {r["path"].split("/", 1)[1]: r["error"] for r in rows.collect()}
    assert got == {"designs/src/pkg/tokens.py.md": None, "stack/ST-001.md": None, "concepts/CN-001.md": None, "conventions/a.md": None, "playbooks/p.md": None, "concepts/bad.md": "no front matter", "concepts/state.md": "unknown status", "stack/none.md": "no tags", "designs/x.md": "no footer", "designs/null.md": "no front matter"}
    assert rows.where("error IS NOT NULL AND (design IS NOT NULL OR post IS NOT NULL)").count() == 0


def test_designs(rows):
    d = rows.where("design IS NOT NULL").first()["design"]
    assert (d["source"], d["contract"]) == ("src/pkg/tokens.py", "def parse(text): ...\nclass Token: ...")
    assert d["dependencies"] == ["src/pkg/base.py", "src/pkg/io.py"] and d["wikilinks"] == ["Tokenizer", "Cache"] and d["tags"] == ["parsing"] and d["stack"] == ["ST-001"]
    assert [tuple(e) for e in d["enums"]] == [("Kind", "what a token is", ["WORD", "SPACE"]), ("LIMIT", "the most", [])] and [tuple(e) for e in d["call_paths"]] == [("parse()", "reads all", ["read", "split"])]
    assert [tuple(e) for e in d["data_flows"]] == [("text", "parse", "decides the branch")] and d["other"] == {"Notes": "Kept as it is."}
    f = d["footer"]
    assert (f["source_hash"], f["interface_hash"], f["design_hash"], f["generated"], f["dependents_complete"]) == ("abc", "i1", "d1", dt.datetime(2024, 5, 1, 10), True)


def test_both_forms_of_footers(spark):
    lines = "<!-- kb:meta\nsource: a\nsource_hash: b\nsource_hash: c\ndesign_hash: d\ngenerated: 2024-01-01T00:00:00\ngenerator: g\n-->"
    texts = [lines, "<!-- kb:meta {source: a} -->\n" + lines, "<!-- kb:meta {source: a} -->", lines.replace("2024", "x"), "none", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["f"] and (r["f"]["source_hash"], r["f"]["interface_hash"], r["f"]["dependents_complete"]) for r in d.select("i", A.footer("text").alias("f")).collect()}
    assert got == {0: ("c", None, False), 1: ("c", None, False), 2: None, 3: None, 4: None, 5: None}


def test_posts(rows):
    p = rows.where("post IS NOT NULL").first()["post"]
    assert tuple(p["said"]) == ("It fails.", "At night.", [], ["first try", "second try"])
    assert [tuple(f) for f in p["findings"]] == [(1, dt.date(2024, 2, 3), "you", -2, True, "Restart it.", ["works"]), (2, None, "unknown", 0, False, "No line of votes.", [])]
    assert rows.where("kind = 'concept' AND error IS NULL").first()["log"] == ["one", "two"]


def test_reexports_stand_for_the_contract(spark):
    body = "# x\n## Re-exports\n- From `pkg.a`: A, B.\n- From `pkg.b`: C\n- other\n## Interface Contract\n```\nx\n```\n## Tags\n- first\n## Tags\n- second\n"
    d = spark.createDataFrame([(body,)], "t string")
    r = d.select(A.reexports(A.section("t", "Re-exports")).alias("r"), A.contract(A.section("t", "Interface Contract")).alias("c"), A.bullets(A.section("t", "Tags")).alias("b"), A.section("t", "None").alias("n")).first()
    assert [tuple(x) for x in r["r"]] == [("pkg.a", ["A", "B"]), ("pkg.b", ["C"])] and (r["c"], r["b"], r["n"]) == ("x", ["first"], "")


def test_directory_indexes(spark):
    good = "# src/pkg/\n\nToken tools.\nAnd more.\n\n## Child Map\n\n| Name | Type | Description |\n| --- | --- | --- |\n| `a.py` | file | reads |\n| sub/ | dir | more |\n\n<!-- kb:meta {source: s, source_hash: b, design_hash: d, generated: 2024-01-01T00:00:00, generator: g} -->\n"
    d = spark.createDataFrame([(0, good), (1, good.replace("Token tools.\nAnd more.", "")), (2, "# x\ntext\n"), (3, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in d.select("i", A.directory_index("t").alias("x")).collect()}
    assert (got[0]["directory"], got[0]["billboard"]) == ("src/pkg", "Token tools. And more.") and [tuple(c) for c in got[0]["children"]] == [("a.py", "file", "reads"), ("sub/", "dir", "more")]
    assert got[1] is got[2] is got[3] is None


def test_files_become_a_graph(spark, rows):
    out = B.full_build(A.parsed(rows), spark.createDataFrame([("src/pkg/tokens.py",)], "path string"))
    links = {(r["source"].split("/", 1)[1], r["target"], r["link_type"]) for r in out["links"].collect()}
    assert links == {
        ("designs/src/pkg/tokens.py.md", "src/pkg/tokens.py", "design_source"), ("designs/src/pkg/tokens.py.md", ".kb/concepts/CN-001.md", "wikilink"), ("designs/src/pkg/tokens.py.md", ".kb/concepts/Cache.md", "wikilink"),
        ("designs/src/pkg/tokens.py.md", "ST-001", "design_stack_ref"), ("concepts/CN-001.md", ".kb/concepts/Nowhere.md", "wikilink"), ("concepts/CN-001.md", "src/pkg/tokens.py", "concept_file_ref"),
        ("conventions/a.md", ".kb/concepts/CN-001.md", "convention_concept_ref"), ("stack/ST-001.md", "src/pkg/tokens.py", "stack_file_ref"), ("stack/ST-001.md", ".kb/concepts/CN-001.md", "stack_concept_ref"),
    }
    texts = {r["path"].rsplit("/", 1)[1]: r["body"] for r in out["texts"].collect()}
    assert texts["ST-001.md"] == "It fails.\nAt night.\nfirst try second try\nRestart it. No line of votes.\nauth cache" and texts["p.md"].startswith("How to ship.\nHow to ship.") and texts["tokens.py.md"] == "Parses tokens.\ndef parse(text): ...\nclass Token: ...\nparsing"
    assert {r["action"] for r in out["log"].where("path LIKE '%bad.md'").collect()} == {"failed"}


def test_each_part_of_a_text_is_evaluated_once(spark):
    """Expressions name a text's parts once, so that the work of a file does not multiply with what is read from it."""
    d = spark.range(1).selectExpr("'x' AS text")
    for made, most in ((A.footer("text"), 4), (A.sections("text"), 1), (A.contract("text"), 1)):
        plan = d.select(made.alias("made"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("text#") <= most + 1, plan  # once in the scan
    long = "<!-- kb:meta\n" + "\n".join(f"k{i}: {i}" for i in range(1500)) + "\nsource: a\nsource: b\nsource_hash: 'h'\ndesign_hash: d\ngenerated: 2024-05-01T00:00:00\ngenerator: g\n-->"
    r = spark.createDataFrame([(long,)], "text string").select(A.footer("text").alias("f")).first()["f"]
    assert (r["source"], r["source_hash"], r["generator"]) == ("b", "h", "g")
