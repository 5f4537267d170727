from graphquarry.operators import library as B


def test_every_check(spark):
    art = [
        ("c/a", "concept", "Auth", "active", "CN-001", "x", None, None, None, 0, 0),
        ("c/b", "concept", "au-th", "deprecated", "CN-001", "", None, None, None, 60, 0),
        ("d/x", "design", "X", "active", "DS-001", "y" * 2000, "agent", "src/x.py", "old", 0, 0),
        ("s/1", "stack", "S", "resolved", "ST-001", "none", None, None, None, 300, 0),
        ("p/1", "playbook", "P", "strange", "PB-001", "z", None, None, None, 0, None),
        ("src/gone.py", "source", None, None, None, None, None, None, None, 0, 0),
    ]
    tables = {
        "artifacts": spark.createDataFrame(art, B.TABLES["artifacts"]),
        "files": spark.createDataFrame([("src/x.py", "new", "src")] + [(f"lib/{i}.py", "h", "lib") for i in range(5)], B.TABLES["files"]),
        "aliases": spark.createDataFrame([("c/a", "au"), ("c/b", "AU")], B.TABLES["aliases"]),
        "links": spark.createDataFrame([("d/x", "c/b", "wikilink"), ("d/x", "nowhere", "wikilink")], B.TABLES["links"]),
        "wikilinks": spark.createDataFrame([("d/x", "design", "AUTH"), ("d/x", "design", "none")], B.TABLES["wikilinks"]),
        "names": spark.createDataFrame([("Auth",)], B.TABLES["names"]),
        "refs": spark.createDataFrame([("s/1", "file", "src/x.py"), ("s/1", "file", "no.py"), ("d/x", "stack", "ST-009")], B.TABLES["refs"]),
        "signals": spark.createDataFrame([("i", "gone", None, "warning", 80.0)], B.TABLES["signals"]),
        "comments": spark.createDataFrame([("c/a", 11, 3)], B.TABLES["comments"]),
    }
    out = B.validate(spark, tables)
    got = {}
    for r in out.collect():
        got.setdefault(r["check_name"], []).append(r["artifact"])
    want = {
        "wikilink_resolution": ["d/x"], "file_existence": ["s/1"], "playbook_frontmatter": ["p/1"], "iwh_frontmatter": ["i"], "artifact_id_uniqueness": ["c/a", "c/b"], "hash_freshness": ["d/x"], "stale_agent_design": ["d/x"], "token_budgets": ["d/x"],
        "orphan_concepts": ["c/a"], "deprecated_concept_usage": ["d/x"], "duplicate_aliases": ["c/a", "c/b"], "stack_refs_validity": ["d/x"], "design_structure": ["d/x"], "stack_body_sections": ["s/1"], "stack_staleness": ["s/1"],
        "resolved_post_staleness": ["s/1"], "dangling_links": ["d/x"], "orphan_artifacts": ["src/gone.py"], "orphaned_iwh": ["gone"], "comment_accumulation": ["c/a"], "deprecated_ttl": ["c/b"], "supersession_candidate": ["c/b"],
        "convention_gap": ["lib"], "convention_consistent_violation": ["c/a"], "orphaned_iwh_signals": ["i"], "concept_body": ["c/b"], "playbook_staleness": ["p/1"],
    }
    assert {k: sorted(set(v)) for k, v in got.items()} == want
    assert len(B.CHECKS) == 48
    assert {r["check_name"] for r in B.validate(spark, tables, least="error").collect()} == {k for k in want if B.CHECKS[k][0] == "error"}


def test_a_failing_check_reports_itself(spark):
    out = B.validate(spark, {"comments": spark.createDataFrame([(1,)], "x int")}, ["comment_accumulation"])
    assert [r["message"] for r in out.collect()] == ["check failed: AnalysisException"]
