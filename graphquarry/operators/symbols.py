"""Symbol-graph queries and services over symbols, calls, class edges and members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.norm import like


def _side(symbols: DataFrame, p: str) -> DataFrame:
    return symbols.select(F.col("id").alias(f"{p}"), F.col("name").alias(f"{p}_name"), F.col("file").alias(f"{p}_file"))


def named(symbols: DataFrame, name: str, file: str | None = None, qualified: bool = False) -> DataFrame:
    hit = symbols.where(F.col("qualified_name" if qualified else "name") == name)
    return (hit if file is None else hit.where(F.col("file") == file)).orderBy("file", "line_start", "id")


def in_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file") == file).orderBy("line_start", "id")


def by_member_value(symbols: DataFrame, members: DataFrame, text: str) -> DataFrame:
    hit = members.where(like("value", F.lit(text))).select(F.col("symbol").alias("id"))
    return symbols.join(hit, "id", "left_semi")


def callers_of(symbols: DataFrame, calls: DataFrame, callee: int) -> DataFrame:
    return calls.where(F.col("callee") == callee).join(_side(symbols, "caller"), "caller").select("caller", "caller_name", "caller_file", "line").orderBy("caller_file", "line")


def callees_of(symbols: DataFrame, calls: DataFrame, caller: int) -> DataFrame:
    return calls.where(F.col("caller") == caller).join(_side(symbols, "callee"), "callee").select("callee", "callee_name", "callee_file", "line").orderBy("line", "callee_file")


def call_counts(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, callers, callees) of every symbol, zeros kept; both sides are summed before they are joined."""
    a = calls.groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    b = calls.groupBy(F.col("caller").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    out = symbols.select("id", "name").join(a, "id", "left").join(b, "id", "left")
    return out.select("id", "name", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def class_edges_from(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(_side(symbols, "target"), "target").select("source", "edge_type", "target", "target_file", "line").orderBy("edge_type", "target_file", "line")


def unresolved_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(symbols.select(F.col("id").alias("target")), "target", "left_anti").select("source", "edge_type", "target", "line")


def class_edges_to(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(_side(symbols, "source"), "source").select("target", "edge_type", "source", "source_file", "line").orderBy("edge_type", "source_file", "line")


def unresolved_callees(symbols: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(caller, caller_name, caller_file, callee_name, line) of unresolved calls (caller, callee_name, line), by line and name."""
    return unresolved.join(_side(symbols, "caller"), "caller").select("caller", "caller_name", "caller_file", "callee_name", "line").orderBy("line", "callee_name")


def branch_parameters(parameters: DataFrame, symbol: int) -> DataFrame:
    return parameters.where(F.col("symbol") == symbol).select("name").orderBy("name")


def branching_files(symbols: DataFrame, parameters: DataFrame) -> DataFrame:
    """The files in which some symbol branches on a parameter."""
    return symbols.join(parameters.select(F.col("symbol").alias("id")), "id", "left_semi").select("file").distinct()


def query_raw(spark, sql: str, args: list | dict | None = None, **tables: DataFrame) -> DataFrame:
    """Any SELECT over the given tables, its marks filled from args."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args)


def graph_health(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each given table, one pass a table; a table that is absent is not given."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = n if out is None else out.union(n)
    return out


def members_from(enums: DataFrame, constants: DataFrame) -> DataFrame:
    """(symbol, name, value, ordinal): variants of enums (symbol, variants: array of name and value) by their place, and constants
    (symbol, name, value) with place 0, those without a value left out. Of one name in a symbol the first counts."""
    e = enums.select("symbol", F.posexplode("variants").alias("ordinal", "v")).select("symbol", "v.name", "v.value", "ordinal")
    both = e.union(constants.where("value IS NOT NULL").select("symbol", "name", "value", F.lit(0)))
    return both.groupBy("symbol", "name").agg(F.min_by(F.struct("value", "ordinal"), "ordinal").alias("m")).select("symbol", "name", "m.value", "m.ordinal")


def members_of(members: DataFrame, symbols: list[int]) -> DataFrame:
    return members.where(F.col("symbol").isin(symbols)).orderBy("symbol", F.asc_nulls_last("ordinal"), "name")


def search(symbols: DataFrame, members: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Names like text first (score 0), then symbols with such a member value (0.5); each symbol once, limit rows in all."""
    a = symbols.where(like("name", F.lit(text)) | like("qualified_name", F.lit(text))).select("id", "name", F.lit(0.0).alias("score"))
    b = by_member_value(symbols, members, text).select("id", "name", F.lit(0.5).alias("score"))
    return a.union(b).groupBy("id", "name").agg(F.min("score").alias("score")).orderBy("score", "name", "id").limit(limit)


def distinct_names(symbols: DataFrame, limit: int = 200) -> DataFrame:
    return symbols.select("name").distinct().orderBy("name").limit(limit)


def trace(symbols: DataFrame, calls: DataFrame, edges: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """One row a hit, with callers, callees, bases, subclasses and members as sorted arrays; a name with a dot is a qualified one."""
    hit = symbols.where(F.col("qualified_name" if "." in name else "name") == name)
    ids = hit.select("id")

    def lists(df: DataFrame, key: str, value, out: str) -> DataFrame:
        d = df.select(F.col(key).alias("id"), value.alias("v")).join(ids, "id", "left_semi")
        return d.groupBy("id").agg(F.array_sort(F.collect_set("v")).alias(out))

    out = hit.select("id", "qualified_name", "file")
    for d, k, v, n in ((calls, "callee", F.col("caller"), "callers"), (calls, "caller", F.col("callee"), "callees"), (edges, "source", F.col("target"), "parents"), (edges, "target", F.col("source"), "children"), (members, "symbol", F.col("value"), "values")):
        out = out.join(lists(d, k, v, n), "id", "left")
    return out


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Files (file, hash) whose stored hash differs from the current one, or that are gone."""
    now = current.select("file", F.col("hash").alias("now"))
    return stored.join(now, "file", "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select("file", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))


def key_symbols(symbols: DataFrame, cap: int = 10) -> DataFrame:
    """Of each file the first `cap` public functions and classes and all methods, by line, and how many there are."""
    s = symbols.where("symbol_type = 'method' OR symbol_type IN ('function', 'class') AND visibility = 'public'")
    w = W.partitionBy("file")
    s = s.withColumn("rank", F.row_number().over(w.orderBy("line_start", "id"))).withColumn("total", F.count(F.lit(1)).over(w))
    return s.where(F.col("rank") <= cap).select("file", "id", "name", "symbol_type", "rank", "total")


#: A cell of a file's lines: those whose number is `cell` after `level` halvings.
_CELL = ["file", "level", "cell"]


def _span_cells(spans: DataFrame) -> DataFrame:
    """spans (file, lo, hi) with the cells that the lines after lo up to hi are made of, two a level at most; of cells of one line only one is among them."""
    d = spans.where("lo < hi").withColumn("level", F.explode(F.expr("sequence(0, 1 + CAST(floor(log2(hi - lo)) AS INT))")))
    d = d.withColumns({"_a": F.expr("shiftright(lo + shiftleft(1L, level), level)"), "_b": F.expr("shiftright(hi + 1, level)")}).where("_a < _b")
    ends = F.array(F.when(F.col("_a") % 2 != 0, F.col("_a")), F.when(F.col("_b") % 2 != 0, F.col("_b") - 1))
    return d.withColumn("cell", F.explode(F.array_compact(ends))).drop("_a", "_b")


def _point_cells(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file, at) with each cell that holds them, in as many levels as the longest of spans (line_start, line_end) has: an equality join with _span_cells pairs a point once with each span around it."""
    most = spans.where("line_start < line_end").agg(F.expr("1 + CAST(floor(log2(max(line_end - line_start))) AS INT)").alias("most"))
    d = points.where("at IS NOT NULL").crossJoin(F.broadcast(most))  # one row
    return d.withColumn("level", F.explode(F.expr("sequence(0, most)"))).withColumn("cell", F.expr("shiftright(at, level)")).drop("most")


def class_hierarchy(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Each class with its number of bases that are symbols, of those that are not, of subclasses, and of methods within its lines of the same file."""
    c = symbols.where("symbol_type = 'class'")
    up = edges.where("edge_type = 'inherits'")
    known = symbols.select(F.col("id").alias("target"), F.lit(1).alias("k"))
    bases = up.join(known, "target", "left").groupBy(F.col("source").alias("id")).agg(F.count("k").alias("bases"), F.count(F.when(F.col("k").isNull(), 1)).alias("unresolved"))
    subs = up.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("subclasses"))
    m = symbols.where("symbol_type = 'method'").select(F.col("file").alias("f"), F.col("line_start").alias("at"))
    cells = _span_cells(c.select("id", "file", F.col("line_start").alias("lo"), F.col("line_end").alias("hi")))
    held = _point_cells(m.select(F.col("f").alias("file"), "at"), c).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"))
    inside = cells.join(held, _CELL).groupBy("id").agg(F.sum("n").alias("methods"))
    out = c.select("id", "name").join(bases, "id", "left").join(subs, "id", "left").join(inside, "id", "left")
    return out.na.fill(0, ["bases", "unresolved", "subclasses", "methods"])


def enclosing_class(symbols: DataFrame) -> DataFrame:
    """(id, cls): the innermost class of the same file whose lines hold each method: the one that starts last, then the largest id."""
    m = symbols.where("symbol_type = 'method'").select("id", "file", F.col("line_start").alias("at"))
    c = symbols.where("symbol_type = 'class'")
    cells = _span_cells(c.select("file", F.col("id").alias("cls"), F.col("line_start").alias("lo"), F.col("line_end").alias("hi")))
    last = cells.groupBy(*_CELL).agg(F.max(F.struct("lo", "cls")).alias("c"))
    return _point_cells(m, c).join(last, _CELL).groupBy("id").agg(F.max("c").alias("c")).select("id", F.col("c.cls").alias("cls"))


def budgeted(sections: DataFrame, budget: int, least: int = 50) -> DataFrame:
    """Sections (doc, pos, tokens) of each doc in order until the budget: whole ones, then one cut to the rest if that is over `least`."""
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = sections.withColumn("before", before)
    # the first that does not fit ends the list
    late = F.max((F.col("before") + F.col("tokens") > budget).cast("int")).over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("late", F.coalesce(late, F.lit(0))).where("late = 0")
    whole = F.col("before") + F.col("tokens") <= budget
    given = F.when(whole, F.col("tokens")).when(F.lit(budget) - F.col("before") > least, F.lit(budget) - F.col("before"))
    return s.withColumn("given", given.cast("long")).where("given IS NOT NULL").select("doc", "pos", "given", (~whole).alias("truncated"))
