import random

import pytest

from graphquarry.operators import build as B
from graphquarry.operators.delta import LinkStore
from graphquarry.sources.snapshot import Conflict, Snapshot

COLUMNS = [x.split()[0] for x in B.PARSED.split(", ")]


def row(path, kind, **k):
    base = {"path": path, "kind": kind, "ok": True, "tags": [], "aliases": [], "files": [], "concepts": [], "stack": [], "imports": [], "sections": []}
    return tuple((base | k).get(c) for c in COLUMNS)


def files(rng, paths):
    """Parsed files that name each other by titles and aliases which change hands."""
    name = lambda: rng.choice(["Auth", "auth ", "log-in", "Log In", "Rule", "Play", "Ghost", "CN-001", "CN-002"])
    out = {}
    for p in paths:
        kind = {"c": "concept", "v": "convention", "p": "playbook", "d": "design", "s": "stack"}[p[0]]
        out[p] = row(
            p, kind, title=name(), code=rng.choice([None, "CN-001", "CN-002"]) if kind == "concept" else None, body=" ".join(f"[[{name()}]]" for _ in range(rng.randint(0, 2))), aliases=[name() for _ in range(rng.randint(0, 2))], tags=["t"],
            files=[f"src/{rng.randint(0, 3)}"], concepts=[name()] if kind == "stack" else [], source=f"src/{rng.randint(0, 3)}" if kind == "design" else None, imports=[f"src/{rng.randint(0, 5)}"], stack=[f"s/{rng.randint(0, 2)}"],
            directory="src", priority=rng.randint(0, 2), ok=rng.random() < 0.9,
        )
    return out


def shown(tables):
    return {n: sorted(map(str, t.collect())) for n, t in tables.items()}


@pytest.mark.parametrize("seed", [1])
def test_updates_equal_rebuilds(spark, tmp_path, seed):
    rng = random.Random(seed)
    every = [f"{k}/{i}" for k in "cvpds" for i in range(4)]
    now, present = files(rng, rng.sample(every, 14)), {"src/0", "src/1"}
    frame = lambda rows: spark.createDataFrame(list(rows), B.PARSED)
    paths = lambda x: spark.createDataFrame([(p,) for p in sorted(x)], "path string")
    store = LinkStore(spark, str(tmp_path / "g"), buckets=8)
    store.build(frame(now.values()), paths(present))
    for _ in range(3):
        changed, gone = files(rng, rng.sample(every, 3)), set(rng.sample(sorted(now), 2))
        changed = {p: r for p, r in changed.items() if p not in gone}
        here = {f"src/{i}" for i in range(4) if rng.random() < 0.5}
        store.update(frame(changed.values()), paths(gone), paths(here - present), paths(present - here))
        now, present = {p: r for p, r in (now | changed).items() if p not in gone}, here
        assert shown(store.tables()) == shown(B.full_build(frame(now.values()), paths(present)))


def test_update_touches_the_buckets_of_the_change_only(spark, tmp_path):
    rows = [row(f"d/{i}", "design", title="x", source=f"src/{i}", body=f"[[Name {i}]]") for i in range(300)]
    empty = spark.createDataFrame([], "path string")
    store = LinkStore(spark, str(tmp_path / "g"), buckets=64)
    store.build(spark.createDataFrame(rows, B.PARSED), empty)
    read = []
    plain = store.store.read
    store.store.read = lambda t, at, buckets=None: read.append((t, buckets)) or plain(t, at, buckets)
    before = store.store._manifest(0)["tables"]
    store.update(spark.createDataFrame([row("c/new", "concept", title="name 7")], B.PARSED), empty)
    after = store.store._manifest(1)["tables"]
    assert read and all(b is not None and len(b) <= 4 for _, b in read)
    assert all(sum(before[t].get(b) != m for b, m in after[t].items()) <= 4 for t in after)
    links = {(r["source"], r["target"]) for r in store.tables()["links"].where("link_type = 'wikilink'").collect()}
    assert ("d/7", "c/new") in links and ("d/8", ".kb/concepts/Name 8.md") in links
    assert ("d/7", ".kb/concepts/Name 7.md") in {(r["source"], r["target"]) for r in store.tables(at=0)["links"].collect()}


def test_snapshot_of_several_tables(spark, tmp_path):
    """A reader between two writes sees both tables of one commit; a writer from an old version fails and changes nothing."""
    s = Snapshot(spark, str(tmp_path / "s"), {"a": ("k", "k long, v string"), "b": ("k", "k long, v string")}, buckets=4)
    frame = lambda v, n=9: spark.createDataFrame([(i, v) for i in range(n)], "k long, v string")
    assert s.newest() is None and s.read("a", None).count() == 0
    s.commit(None, {"a": (frame("0"), None), "b": (frame("0"), None)})
    pinned = s.newest()
    a = s.read("a", pinned)
    touched = s.buckets_of(frame("", 1), "k")
    kept = s.read("a", pinned, touched).where("k <> 0").union(frame("1", 1))
    s.commit(pinned, {"a": (kept, touched), "b": (frame("1"), None)})
    with pytest.raises(Conflict):
        s.commit(pinned, {"a": (frame("2"), None)})
    assert {r["v"] for r in a.collect()} == {r["v"] for r in s.read("b", pinned).collect()} == {"0"}
    assert {(r["k"], r["v"]) for r in s.read("a", s.newest()).collect()} == {(0, "1"), *((i, "0") for i in range(1, 9))}
    s.commit(s.newest(), {"a": (frame("3").where("k > 0"), None)})
    s.vacuum(keep=1)
    assert s.versions() == [2] and s.read("a", 2).count() == 8 and {r["v"] for r in s.read("b", 2).collect()} == {"1"}


def test_an_emptied_bucket_is_gone(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "s"), {"a": ("k", "k long")}, buckets=2)
    s.commit(None, {"a": (spark.range(10).selectExpr("id AS k"), None)})
    s.commit(0, {"a": (spark.range(0).selectExpr("id AS k"), [0])})
    assert 0 < s.read("a", 1).count() < 10 and s.read("a", 1, [0]).count() == 0
