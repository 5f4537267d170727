import difflib
import random

import pytest

from graphquarry.operators.close import close_matches, resolve_by_likeness


@pytest.mark.parametrize("cutoff,n", [(0.6, 3), (0.85, 2), (0.3, 4)])
def test_close_matches_equal_brute_force(spark, cutoff, n):
    rng = random.Random(4)
    words = ["auth", "authentication", "cache", "caching", "tokenizer", "token", "index", "é lan", "aaaa", "aaab", "a", "ab", "中文", "index builder"]
    make = lambda: (w := rng.choice(words))[: rng.randint(1, len(w))] + rng.choice(["", "s", "x", " y", rng.choice(words)])
    names, known = sorted({make() for _ in range(60)}), sorted({make() for _ in range(90)})
    d = close_matches(spark.createDataFrame([(x,) for x in [*names, None, ""]], "name string"), spark.createDataFrame([(x,) for x in [*known, known[0], None, ""]], "name string"), n, cutoff)
    got = {}
    for r in sorted(d.collect(), key=lambda r: (r["name"], r["rank"])):
        got.setdefault(r["name"], []).append(r["candidate"])
    want = {x: m for x in names if (m := difflib.get_close_matches(x, known, n, cutoff))}
    assert got == want


def test_likeness_resolves_concepts_and_playbooks_and_suggests_the_rest(spark):
    known = [("Authentication", "Authentication", "concept", "c/a"), ("auth flow", "Authentication", "concept", "c/a"), ("Deploying", "Deploying", "playbook", "p/d"), ("ship it", "Deploying", "playbook", "p/d"), ("Naming rules", "Naming rules", "convention", "v/n"), ("Naming rule", "Other", "convention", "v/o")]
    names = spark.createDataFrame([("Authentcation",), ("auth-flw",), ("deployin",), ("ship itt",), ("namin rules",), ("zzzzzz",)], "name string")
    out = {r["name"]: (r["kind"], r["target"], r["suggestions"]) for r in resolve_by_likeness(names, spark.createDataFrame(known, "name string, title string, kind string, path string")).collect()}
    assert out["Authentcation"] == ("concept", "c/a", None) and out["auth-flw"] == ("concept", "c/a", None) and out["deployin"] == ("playbook", "p/d", None)
    assert out["ship itt"] == (None, None, ["ship it"]) and out["namin rules"] == (None, None, ["Naming rules", "Naming rule"]) and out["zzzzzz"] == (None, None, [])
