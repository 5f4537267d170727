from graphquarry.operators import js as J


def modules(spark, files, imports, config=None):
    f = spark.createDataFrame([(p,) for p in files], "path string")
    i = spark.createDataFrame(imports, "file string, specifier string")
    c = J.ts_paths(spark.createDataFrame([(config,)], "text string"))
    return {(r["file"], r["specifier"]): r["module_file"] for r in J.js_modules(i, f, c).collect()}


def test_relative_modules(spark):
    files = ["src/a/index.ts", "src/module.ts", "src/module.js", "src/x.jsx", "src/y/index.js", "src/foo.ts", "top.ts"]
    asked = [("src/b/user.ts", "../a"), ("src/main.ts", "./module"), ("src/main.ts", "./module.js"), ("src/main.ts", "./none.ts"), ("src/main.ts", "./x"), ("src/main.ts", "./y"), ("src/main.ts", "./foo.service"), ("src/main.ts", "../../out"), ("main.ts", "./top"), ("src/a/b.ts", "../../top"), ("src/main.ts", "lodash")]
    assert modules(spark, files, asked) == {
        ("src/b/user.ts", "../a"): "src/a/index.ts", ("src/main.ts", "./module"): "src/module.ts", ("src/main.ts", "./module.js"): "src/module.js", ("src/main.ts", "./x"): "src/x.jsx", ("src/main.ts", "./y"): "src/y/index.js",
        ("src/main.ts", "./foo.service"): "src/foo.ts", ("main.ts", "./top"): "top.ts", ("src/a/b.ts", "../../top"): "top.ts",
    }


def test_path_mappings(spark):
    config = """{
      // line "comment"
      "compilerOptions": { "baseUrl": "./src", /* block
        comment */ "url": "https://example.com", "paths": {"#/*": ["gone/*"], "@/*": ["lib/*", "*"], "exact": ["utils/parse"], "@/late/*": ["never/*"]} }
    }"""
    files = ["src/utils/parse.ts", "src/lib/both.ts", "src/both.ts", "src/late/x.tsx", "src/utils.ts"]
    asked = [("src/app/main.ts", s) for s in ("@/utils/parse", "@/both", "exact", "@/late/x", "#/x", "utils", "lodash")]
    got = {s: m for (_, s), m in modules(spark, files, asked, config).items()}
    assert got == {"@/utils/parse": "src/utils/parse.ts", "@/both": "src/lib/both.ts", "exact": "src/utils/parse.ts", "@/late/x": "src/late/x.tsx"}
    assert modules(spark, files, [("a.ts", "@/both")], "{ broken") == {} and modules(spark, files, [("a.ts", "@/both")], "{}") == {}
    assert modules(spark, ["x.ts"], [("a.ts", "~/x")], '{"compilerOptions": {"paths": {"~/*": ["*"]}}}') == {("a.ts", "~/x"): "x.ts"}


def test_import_lines(spark):
    text = "\n".join(["import { A, B as C } from './m'", "import D from \"./d\";", "import type E from './e'", "  import * as N from './n'", "import './side'", "export { F } from './f'", "const x = 'import'", "import {} from './none'", "importer"])
    d = J.js_imports(spark.createDataFrame([("a.ts", text), ("b.ts", None)], "path string, text string"))
    assert {r["specifier"]: r["names"] for r in d.collect()} == {"./m": ["A", "C"], "./d": ["D"], "./e": ["E"], "./n": ["N"], "./side": [], "./f": ["F"], "./none": []}


def test_calls_and_classes(spark):
    symbols = spark.createDataFrame([(1, "a.ts", "f", "function", 1), (2, "a.ts", "K", "class", 5), (3, "b.ts", "g", "function", 1), (4, "b.ts", "f", "function", 9), (5, "b.ts", "H", "function", 12), (6, "a.ts", "In", "class", 9)], "id long, file string, name string, symbol_type string, line_start long")
    files = spark.createDataFrame([("a.ts", ""), ("b.ts", "import { K, f as z } from './a'\nimport * as ns from './a'\nimport { g } from './none'")], "path string, text string")
    i = J.js_imports(files)
    b = J.js_bindings(i, J.js_modules(i, files, J.ts_paths(spark.createDataFrame([("{}",)], "text string"))))
    assert {tuple(r) for r in b.collect()} == {("b.ts", "K", "a.ts"), ("b.ts", "z", "a.ts"), ("b.ts", "ns", "a.ts")}
    sites = [(1, "b.ts", None, "g"), (2, "b.ts", "ns", "ns.f"), (3, "b.ts", None, "K"), (4, "b.ts", None, "z"), (5, "b.ts", "ns", "ns.K"), (6, "b.ts", "q", "q.none"), (7, "a.ts", None, "g"), (8, "b.ts", "this", "this.f")]
    got = dict(map(tuple, J.js_calls(spark.createDataFrame(sites, "site long, file string, receiver string, name string"), symbols, b).collect()))
    assert got == {1: 3, 2: 4, 3: 2, 4: None, 5: 2, 6: None, 7: None, 8: 4}
    names = [(1, "b.ts", "K"), (2, "b.ts", "ns.K"), (3, "b.ts", "H"), (4, "a.ts", "K"), (5, "b.ts", "ns.Out.In"), (6, "b.ts", "x.In")]
    got = dict(map(tuple, J.js_classes(spark.createDataFrame(names, "site long, file string, name string"), symbols, b).collect()))
    assert got == {1: 2, 2: 2, 3: None, 4: 2, 5: 6, 6: None}
