"""The symbol graph from facts of Python files: symbols, calls, class edges, members, branch parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import resolve_calls, resolve_classes
from .traverse import closure, cut

SYMBOLS = "id long, file string, name string, qualified_name string, symbol_type string, line_start long, line_end long, visibility string, parent string"
SITES = "site long, fact string, file string, caller long, name string, receiver string, kind string, line long, value string"


def symbols_of(facts: DataFrame) -> DataFrame:
    """SYMBOLS; an id is a hash of the file, name and line, so that it lasts as long as those."""
    s = facts.where("fact = 'symbol'")
    return s.select(
        F.xxhash64("path", "owner", "line").alias("id"), F.col("path").alias("file"), "name", F.col("owner").alias("qualified_name"), F.col("kind").alias("symbol_type"), F.col("line").alias("line_start"), "line_end", "visibility", "parent"
    )


def sites_of(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """SITES: calls and class edges of known definitions, each written once a line."""
    owner = symbols.groupBy(F.col("file").alias("path"), F.col("qualified_name").alias("owner")).agg(F.min_by("id", "line_start").alias("caller"))
    s = facts.where("fact IN ('call', 'edge')").join(owner, ["path", "owner"])
    key = F.xxhash64("fact", "path", "caller", "name", F.coalesce("receiver", F.lit("")), F.coalesce("kind", F.lit("")), "line")
    return s.select(key.alias("site"), "fact", F.col("path").alias("file"), "caller", "name", "receiver", "kind", "line", "value").dropDuplicates(["site"])


def bindings(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, local, module_file, original) of imports that name a file of the project (file): below src/ before the top, a module before a package; the last import that binds a name holds."""
    i = facts.where("fact = 'import'").select(F.col("path").alias("file"), F.col("name").alias("local"), F.col("value").alias("original"), F.col("owner").alias("at"), "kind", F.struct("ordinal", "line").alias("o"))
    tops = F.when(F.col("kind") == "absolute", F.array(F.lit("src/"), F.lit(""))).otherwise(F.array(F.lit("")))
    each = i.select("*", F.posexplode(F.flatten(F.transform(tops, lambda t: F.array(F.concat(t, "at", F.lit(".py")), F.concat(t, "at", F.lit("/__init__.py")))))).alias("rank", "module_file"))
    found = each.join(files.select(F.col("file").alias("module_file")).distinct(), "module_file")
    first = found.groupBy("file", "local", "original", "o").agg(F.min_by("module_file", "rank").alias("module_file"))
    return first.groupBy("file", "local").agg(F.max_by(F.struct("module_file", "original"), "o").alias("b")).select("file", "local", "b.module_file", "b.original")


def class_targets(sites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(site, target) of class edges."""
    edges = sites.where("fact = 'edge'")
    return resolve_classes(edges.select("site", "file", "name"), symbols, imports).select("site", "target")


def inherits_of(sites: DataFrame, targets: DataFrame) -> DataFrame:
    d = sites.where("fact = 'edge' AND kind = 'inherits'").join(targets.where("target IS NOT NULL"), "site")
    return d.select(F.col("caller").alias("cls"), F.col("target").alias("base"), "line")


def call_targets(sites: DataFrame, symbols: DataFrame, imports: DataFrame, inherits: DataFrame) -> DataFrame:
    calls = sites.where("fact = 'call'")
    return resolve_calls(calls.select("site", "file", "caller", "receiver", "name"), symbols, imports, inherits).select("site", "target")


def tables_of(sites: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """What split_by_target has, of sites and their targets."""
    return split_by_target(sites.join(targets.where("target IS NOT NULL"), "site", "left"))


def split_by_target(d: DataFrame) -> dict[str, DataFrame]:
    """calls, unresolved_calls, class_edges and class_edges_unresolved of sites with their target; an `instantiates` edge that leads to no class of the project is unresolved."""
    hit, miss = d.where("target IS NOT NULL"), d.where("target IS NULL")
    return {
        "calls": hit.where("fact = 'call'").select("caller", F.col("target").alias("callee"), "line", F.col("receiver").alias("context")).distinct(),
        "unresolved_calls": miss.where("fact = 'call'").select("caller", F.col("name").alias("callee_name"), "line", F.col("receiver").alias("context")).distinct(),
        "class_edges": hit.where("fact = 'edge'").select(F.col("caller").alias("source"), "target", F.col("kind").alias("edge_type"), "line", F.col("value").alias("context")).distinct(),
        "class_edges_unresolved": miss.where("fact = 'edge'").select(F.col("caller").alias("source"), F.col("name").alias("target_name"), F.col("kind").alias("edge_type"), "line").distinct(),
    }


def symbol_graph(facts: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """All tables from facts (FACTS) and the project's files (file).

    Calls by resolve_calls (over the resolved bases), class edges by resolve_classes. members: (symbol, name, value, ordinal);
    parameters: (symbol, name) that a condition looks at. Facts and what several joins read are cut by checkpoints: files are
    parsed once.
    """
    facts = cut(facts)
    symbols = cut(symbols_of(facts))
    sites, imports = cut(sites_of(facts, symbols)), cut(bindings(facts, files))
    edges = cut(class_targets(sites, symbols, imports))
    calls = call_targets(sites, symbols, imports, inherits_of(sites, edges))
    tables = tables_of(sites, edges.union(calls))
    enums = promoted_enums(symbols, tables["class_edges"], tables["class_edges_unresolved"])
    owner = symbols.groupBy(F.col("file").alias("path"), F.col("qualified_name").alias("owner")).agg(F.min_by("id", "line_start").alias("symbol"))
    of = lambda fact: facts.where(F.col("fact") == fact).join(owner, ["path", "owner"])
    members = of("member").union(of("slot").join(enums.select(F.col("id").alias("symbol")), "symbol", "left_semi").select(of("member").columns))
    return {"symbols": with_enums(symbols, enums), **tables, "members": members.select("symbol", "name", "value", "ordinal"), "parameters": of("branch").select("symbol", "name").distinct()}


def promoted_enums(symbols: DataFrame, class_edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(id): classes of Python files that inherit from an enum over any chain, and are none themselves.

    Edges are the resolved ones, and those left open whose name is an enum of the same file, as resolution looks for classes.
    """
    enums = symbols.where("symbol_type = 'enum'")
    up = class_edges.where("edge_type = 'inherits'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    own = enums.select(F.col("id").alias("enum"), F.col("file").alias("f"), F.col("name").alias("target_name"))
    open_ = unresolved.where("edge_type = 'inherits'").join(symbols.select(F.col("id").alias("source"), "file"), "source")
    open_ = open_.join(own, (open_["file"] == own["f"]) & (open_["target_name"] == own["target_name"])).select(F.col("enum").alias("source"), F.col("source").alias("target"))
    reached = closure(cut(up.union(open_)), enums.select(F.col("id").alias("start"))).select(F.col("node").alias("id"))
    return symbols.where(F.col("file").rlike(r"\.pyi?$") & (F.col("symbol_type") != "enum")).select("id").join(reached, "id", "left_semi")


def with_enums(symbols: DataFrame, enums: DataFrame) -> DataFrame:
    """symbols with the type `enum` for those of enums (id). The join takes the hint of symbols, so what comes out has one again."""
    d = symbols.join(enums.select("id", F.lit("enum").alias("_e")), "id", "left")
    return d.withColumn("symbol_type", F.coalesce("_e", "symbol_type")).select(symbols.columns).hint("merge")
