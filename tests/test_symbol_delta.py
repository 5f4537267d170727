import random

from graphquarry.operators.resolve import promoted
from graphquarry.operators.symbol_build import symbol_graph
from graphquarry.operators.symbol_delta import SymbolStore
from graphquarry.sources.python_code import python_facts


def text(rng, n):
    a, b = rng.randrange(n), rng.randrange(n)
    lines = [rng.choice([f"from pkg.m{a} import C, f as g", f"import pkg.m{a} as g", "from vendor import C"]), rng.choice([f"from pkg.m{b} import f", f"from .m{b} import C as D", ""])]
    lines += [f"class {rng.choice('CE')}({rng.choice(['C', 'D', 'object'])}):", "    x: C", "    def run(self):", "        self.go()", "        self.stop()"]
    lines += ["    def go(self): pass"] * rng.randint(0, 1) + ["    def stop(self): pass"] * rng.randint(0, 1)
    lines += [rng.choice(["def f():", "def h():"]), "    g()", "    g.f()", "    f()", "    C()", "    D()"]
    return "\n".join(lines) + "\n"


def frames(spark, files):
    rows = spark.createDataFrame(sorted(files.items()), "path string, text string")
    return python_facts(rows), rows.selectExpr("path AS file")


def shown(tables):
    return {n: sorted(map(str, t.collect())) for n, t in tables.items() if n not in ("members", "parameters")}


def test_refreshes_equal_rebuilds(spark, tmp_path):
    rng, n = random.Random(3), 7
    now = {f"src/pkg/m{i}.py": text(rng, n) for i in range(n - 2)}
    store = SymbolStore(spark, str(tmp_path / "s"), buckets=8)
    store.build(*frames(spark, now))
    for _ in range(2):
        gone = set(rng.sample(sorted(now), 1))
        new = {p: text(rng, n) for p in rng.sample([f"src/pkg/m{i}.py" for i in range(n)], 2) if p not in gone}
        store.refresh(*frames(spark, new), spark.createDataFrame([(p,) for p in gone], "file string"))
        now = {p: t for p, t in (now | new).items() if p not in gone}
        assert shown(store.tables()) == shown(symbol_graph(*frames(spark, now)))


def test_a_new_symbol_answers_those_that_import_it_only(spark):
    """Calls of one name without an import stay unresolved, whatever file has a new symbol of that name."""
    files = {"src/pkg/a.py": "", "src/pkg/use.py": "from pkg.a import get\ndef u():\n    get()\n", "src/pkg/other.py": "def v():\n    get()\n    x.get()\n    d.get()\n"}
    before = symbol_graph(*frames(spark, files))
    after = files | {"src/pkg/a.py": "def get(): pass\nGET = 1\n"}
    facts, names = frames(spark, after)
    from graphquarry.operators import symbol_build as Z

    symbols = Z.symbols_of(facts).cache()
    none = spark.createDataFrame([], "cls long, base long, line long")
    new = symbols.where("file = 'src/pkg/a.py'")
    got = promoted(before["unresolved_calls"], new, symbols, Z.bindings(facts, names), none).collect()
    assert [(r["line"], r["callee_name"]) for r in got] == [(3, "get")] and got[0]["callee"] == new.where("name = 'get'").first()["id"]


def test_a_refresh_reads_the_files_it_needs(spark, tmp_path):
    files = {f"src/pkg/m{i}.py": f"from pkg.m{i // 2} import f{i // 2}\ndef f{i}():\n    f{i // 2}()\n" for i in range(200)}
    store = SymbolStore(spark, str(tmp_path / "s"), buckets=64)
    store.build(*frames(spark, files))
    read, plain = [], store.store.read
    store.store.read = lambda t, at, buckets=None: read.append(buckets) or plain(t, at, buckets)
    store.refresh(*frames(spark, {"src/pkg/m150.py": "def other(): pass\n"}), spark.createDataFrame([], "file string"))
    assert all(b is not None and len(b) < 12 for b in read)
    t = plain("sites", store.store.newest())
    assert t.where("target IS NULL").count() == 0 and t.count() == 199
    store.store.read = plain
    store.refresh(*frames(spark, {"src/pkg/m50.py": "def other(): pass\n"}), spark.createDataFrame([], "file string"))
    assert {r["callee_name"] for r in store.tables()["unresolved_calls"].collect()} == {"f50"} and store.tables()["unresolved_calls"].count() == 2
