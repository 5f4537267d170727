import textwrap

import pytest

from graphquarry.operators.symbol_build import symbol_graph
from graphquarry.sources.python_code import python_facts

HIERARCHY = {
    "src/pkg/upper.py": "class Upper:\n    def act(self) -> None:\n        pass\n",
    "src/pkg/lower.py": "from pkg.upper import Upper\n\n\nclass Lower(Upper):\n    def turn(self) -> None:\n        self.act()\n",
    "src/pkg/thing.py": "from vendor import Model\n\n\nclass Thing(Model):\n    pass\n",
    "src/pkg/forge.py": "def Forge() -> None:\n    pass\n\n\ndef main() -> None:\n    Forge()\n",
    "src/pkg/use.py": "from pkg.lower import Lower\n\n\ndef main() -> None:\n    d = Lower()\n    d.turn()\n",
}
PARTS = {
    "src/pkg/pool.py": "class Pool:\n    pass\n",
    "src/pkg/store.py": "class Store:\n    pass\n",
    "src/pkg/host.py": textwrap.dedent("""\
        from pkg.pool import Pool
        from .store import Store

        class Host:
            db: Store
            name: str
            rows: dict[str, list[Pool]]
            many: Pool | Store

            def __init__(self) -> None:
                self.pool: Pool | None = Pool()
                self.client: Foreign = None
        """),
}


def graph(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, text string")
    facts = python_facts(rows).cache()
    out = symbol_graph(facts, rows.selectExpr("path AS file"))
    names = {r["id"]: r["qualified_name"] for r in out["symbols"].collect()}
    return facts, out, names


def edges(out, names):
    found = {(names[r["source"]], names[r["target"]], r["edge_type"], r["line"]) for r in out["class_edges"].collect()}
    return found, {(names[r["source"]], r["target_name"], r["edge_type"]) for r in out["class_edges_unresolved"].collect()}


def test_class_hierarchy(spark):
    _, out, names = graph(spark, HIERARCHY)
    found, missed = edges(out, names)
    assert found == {("pkg.lower.Lower", "pkg.upper.Upper", "inherits", 4), ("pkg.use.main", "pkg.lower.Lower", "instantiates", 5)}
    assert missed == {("pkg.thing.Thing", "Model", "inherits"), ("pkg.forge.main", "Forge", "instantiates")}
    calls = {(names[r["caller"]], names[r["callee"]], r["line"], r["context"]) for r in out["calls"].collect()}
    assert calls == {("pkg.lower.Lower.turn", "pkg.upper.Upper.act", 6, "self"), ("pkg.forge.main", "pkg.forge.Forge", 6, None), ("pkg.use.main", "pkg.lower.Lower", 5, None)}
    assert {(names[r["caller"]], r["callee_name"], r["line"], r["context"]) for r in out["unresolved_calls"].collect()} == {("pkg.use.main", "d.turn", 6, "d")}


def test_compositions(spark):
    _, out, names = graph(spark, PARTS)
    found, missed = edges(out, names)
    assert {(t, line) for s, t, e, line in found if e == "composes"} == {("pkg.store.Store", 5), ("pkg.pool.Pool", 7), ("pkg.pool.Pool", 11)}
    assert {t for _, t, e in missed if e == "composes"} == {"Foreign"}


def test_golden_project(spark):
    files = {
        "src/pkg/__init__.py": "",
        "src/pkg/shapes.py": '"""Shapes."""\n\nfrom __future__ import annotations\n\n\nclass Shape:\n    def area(self) -> str:\n        return "..."\n\n\nclass Box(Shape):\n    def area(self) -> str:\n        return "four"\n\n    def twice(self) -> str:\n        return self.area()\n',
        "src/pkg/room.py": '"""Room."""\n\nfrom __future__ import annotations\n\nfrom pkg.shapes import Box\n\n\ndef measure() -> str:\n    box = Box()\n    return box.twice()\n\n\ndef report() -> str:\n    return measure()\n',
    }
    _, out, names = graph(spark, files)
    assert {(r["qualified_name"], r["symbol_type"], r["line_start"], r["line_end"], r["parent"]) for r in out["symbols"].collect()} == {
        ("pkg.shapes.Shape", "class", 6, 8, None), ("pkg.shapes.Shape.area", "method", 7, 8, "Shape"), ("pkg.shapes.Box", "class", 11, 16, None), ("pkg.shapes.Box.area", "method", 12, 13, "Box"),
        ("pkg.shapes.Box.twice", "method", 15, 16, "Box"), ("pkg.room.measure", "function", 8, 10, None), ("pkg.room.report", "function", 13, 14, None),
    }
    calls = {(names[r["caller"]], names[r["callee"]], r["line"], r["context"]) for r in out["calls"].collect()}
    assert calls == {("pkg.shapes.Box.twice", "pkg.shapes.Box.area", 16, "self"), ("pkg.room.report", "pkg.room.measure", 14, None), ("pkg.room.measure", "pkg.shapes.Box", 9, None)}


def test_facts(spark):
    text = textwrap.dedent('''\
        from enum import StrEnum
        MAX = 3
        _LOW: int = -1
        timeout: float = 2.5
        lower = 1
        CALLED = f()
        class Mode(StrEnum):
            A = "a"
            B = auto()
            def go(self): pass
        class Out:
            class In:
                def m(self): pass
        def outer(config, flag, seen, *rest, key=None):
            assert seen
            if config.verbose and not flag:
                def inner(x):
                    return super().go() or "".join(x) or x[0]()
            return 1 if key else a.b.c(1)
        ''')
    facts, out, names = graph(spark, {"lib/x.py": text, "lib/bad.py": "def (", "lib/none.py": None})
    kinds = {r["qualified_name"]: (r["symbol_type"], r["visibility"]) for r in out["symbols"].collect()}
    assert kinds == {
        "lib.x.MAX": ("constant", "public"), "lib.x._LOW": ("constant", "private"), "lib.x.timeout": ("constant", "public"), "lib.x.Mode": ("enum", "public"), "lib.x.Mode.go": ("method", "public"), "lib.x.Out": ("class", "public"),
        "lib.x.Out.In": ("class", "private"), "lib.x.Out.In.m": ("method", "public"), "lib.x.outer": ("function", "public"), "lib.x.outer.inner": ("function", "private"),
    }
    assert {(names[r["symbol"]], r["name"], r["value"], r["ordinal"]) for r in out["members"].collect()} == {("lib.x.MAX", "MAX", "3", 0), ("lib.x._LOW", "_LOW", "-1", 0), ("lib.x.timeout", "timeout", "2.5", 0), ("lib.x.Mode", "A", '"a"', 0), ("lib.x.Mode", "B", None, 1)}
    assert {(names[r["symbol"]], r["name"]) for r in out["parameters"].collect()} == {("lib.x.outer", "config"), ("lib.x.outer", "flag"), ("lib.x.outer", "key")}
    assert {(names[r["caller"]], r["callee_name"], r["context"]) for r in out["unresolved_calls"].collect()} == {("lib.x.outer.inner", "super.go", "super"), ("lib.x.outer", "a.b.c", "a.b"), ("lib.x.Mode", "auto", None)}
    assert [r["path"] for r in facts.where("fact = 'error'").collect()] == ["lib/bad.py"]


def test_classes_below_enums_are_enums(spark):
    """Over any chain and files, from an enum of the same file too, whose members are then read."""
    files = {
        "src/pkg/upper.py": "from enum import StrEnum\nclass Mine(StrEnum):\n    A = 'a'\nclass Near(Mine):\n    B = 'b'\n    def go(self): pass\n    C: int = f()\n",
        "src/pkg/far.py": "from pkg.upper import Near\nfrom pkg.upper import Mine\nclass Far(Near):\n    D = -1\nclass Other(Mine):\n    E = 1\nclass Plain:\n    F = 1\n",
    }
    _, out, names = graph(spark, files)
    kinds = {names[r["id"]].split(".")[-1]: r["symbol_type"] for r in out["symbols"].collect()}
    # a base that is an enum of another file stays open, as it does in resolution
    assert kinds == {"Mine": "enum", "Near": "enum", "go": "method", "Far": "enum", "Other": "class", "Plain": "class"}
    assert {(names[r["symbol"]].split(".")[-1], r["name"], r["value"], r["ordinal"]) for r in out["members"].collect()} == {("Mine", "A", "'a'", 0), ("Near", "B", "'b'", 0), ("Near", "C", None, 1), ("Far", "D", "-1", 0)}


@pytest.mark.parametrize("line,want", [("import pkg.a as m\nimport pkg.b as m", "pkg.b.f"), ("from pkg import a as m", None)])
def test_the_last_binding_of_a_name_holds(spark, line, want):
    files = {"src/pkg/a.py": "def f(): pass\n", "src/pkg/b.py": "def f(): pass\n", "src/pkg/use.py": f"{line}\ndef g():\n    m.f()\n"}
    _, out, names = graph(spark, files)
    assert [names[r["callee"]] for r in out["calls"].collect()] == ([want] if want else [])


def test_long_tables_are_not_broadcast(spark):
    """A table that grew behind a small one is joined by merging, although Spark guesses its size from the small one; a short one is left to Spark."""
    import os

    from graphquarry.operators.traverse import cut

    def grown(batches):
        for b in batches:
            b = b.loc[b.index.repeat(40)]
            yield b.assign(text=[os.urandom(100).hex() for _ in range(len(b))])

    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    few, many = (cut(spark.range(n).mapInPandas(grown, "id long, text string")) for n in (10, 1000))
    keys = cut(spark.range(1000))
    assert "BroadcastHashJoin" not in plan(many.join(cut(spark.range(20).mapInPandas(grown, "id long, text string")), "id", "left"))
    assert "BroadcastHashJoin" not in plan(keys.join(many, "id", "left"))
    assert "BroadcastHashJoin" in plan(keys.join(few, "id", "left"))
    assert keys.join(many, "id", "left").count() == 40000


def test_paths_of_one_small_file_are_parsed_in_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphquarry.sources.python_code import python_facts

    spark.range(400).select(F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("def f():\n    pass\n").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t")
    facts = python_facts(spark.read.parquet(f"{tmp_path}/t"))
    assert facts.select(F.spark_partition_id().alias("p")).distinct().count() > 4 and facts.where("fact = 'symbol'").count() == 400
