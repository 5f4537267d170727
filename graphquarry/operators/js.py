"""JavaScript and TypeScript: modules that imports name, and calls and class names through them, as ranked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import last_part

#: Extensions and index files in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
INDEX_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx")


def js_imports(files: DataFrame) -> DataFrame:
    """(file, pos, specifier, names) of the import and export lines of files (path, text) that name a module: what each binds there.

    `* as X` binds X; braces bind each name, or what follows `as`; otherwise the first word behind `import` counts. A line without
    names binds none. pos is the line's place.
    """
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.where(F.col("line").startswith("import") | F.col("line").startswith("export"))
    first = lambda pattern, of: F.regexp_extract(of, pattern, 1)
    double, single = first(r'"([^"]*)"', "line"), first(r"'([^']*)'", "line")
    specifier = F.when(F.col("line").rlike('"[^"]*"'), double).when(F.col("line").rlike("'[^']*'"), single)
    inner = F.transform(F.split(first(r"\{([^}]*)\}", "line"), ","), lambda x: F.trim(x))
    braces = F.transform(F.filter(inner, lambda x: x != ""), lambda x: F.when(x.rlike(r"^\S+\s+as\s+\S"), F.regexp_extract(x, r"^\S+\s+as\s+(\S+)", 1)).otherwise(F.regexp_extract(x, r"^(\S+)", 1)))
    space = F.filter(F.array(first(r"\* as\s+(\S+)", "line")), lambda x: (x != "") & (x != "from"))
    default = F.filter(F.array(first(r"^import\s+(?:type\s+)?(\S+)", "line")), lambda x: ~x.isin("", "from", "{", "*") & ~x.rlike("^['\"]"))
    names = F.when(F.col("line").contains("* as "), space).when(F.col("line").rlike(r"\{[^}]*\}"), braces).otherwise(default)
    return lines.select("file", "pos", specifier.alias("specifier"), names.alias("names")).where("specifier IS NOT NULL")


def ts_paths(config: DataFrame) -> DataFrame:
    """(base, rank, pattern, targets): the path mappings of a tsconfig.json (text), comments left out, in their order; none where it has none or is broken.

    base is the folder that targets start from, by default the top.
    """
    clean = F.regexp_replace("text", r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    d = config.select(F.from_json(clean, "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>").alias("c")).select("c.compilerOptions.*")
    base = F.coalesce(_normal(F.coalesce("baseUrl", F.lit("."))), F.lit(""))
    return d.select(base.alias("base"), F.posexplode(F.map_entries("paths")).alias("rank", "e")).select("base", "rank", F.col("e.key").alias("pattern"), F.col("e.value").alias("targets"))


def _normal(path: Column) -> Column:
    """A path without '.' and with '..' taken back; one that leaves the top starts with '..'."""
    back = lambda a, s: (s == "..") & (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("")) != "..")
    step = lambda a, s: F.when(s.isin("", "."), a).when(back(a, s), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, s))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _tried(base: Column) -> Column:
    """The files that a path without regard to its ending may mean, in order: itself where it has an extension, each extension in the place of any, index files below it."""
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]+$", "")
    own = F.when(base.rlike(r"[^/]\.(ts|tsx|js|jsx)$"), F.array(base)).otherwise(F.array().cast("array<string>"))
    return F.concat(own, *[F.array(F.concat(stem, F.lit(e))) for e in EXTENSIONS], *[F.array(F.concat(base, F.lit("/"), F.lit(i))) for i in INDEX_FILES])


def js_modules(imports: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, specifier, module_file) of imports (file, specifier) that lead to one of files (path); paths as of ts_paths.

    ./ and ../ start from the importing file's folder, and a known extension there is final. Others go through the path
    mappings: the first pattern in order with a target that exists counts; all else are packages. Imports
    meet the patterns by what is before the *, and each of their candidates the files.
    """
    i = imports.select("file", "specifier").distinct()
    near = F.col("specifier").startswith("./") | F.col("specifier").startswith("../")
    at = _normal(F.concat_ws("/", F.regexp_replace("file", r"(^|/)[^/]*$", ""), "specifier"))
    final = at.rlike(r"[^/]\.(ts|tsx|js|jsx)$")
    relative = i.where(near).withColumn("at", at).select("file", "specifier", F.when(final, F.array("at")).otherwise(_tried(F.col("at"))).alias("each"), F.lit(0).alias("rank"), F.lit(0).alias("k"))
    p = paths.withColumn("head", F.split("pattern", r"\*", 2)[0]).withColumn("wild", F.col("pattern").contains("*"))
    sizes = sorted(r["n"] for r in p.select(F.length("head").alias("n")).distinct().collect())  # lengths of what people write before a *
    heads = F.filter(F.array(*[F.left("specifier", F.lit(n)) for n in sizes]).cast("array<string>"), lambda x: x.isNotNull())
    met = i.where(~near).withColumn("head", F.explode(F.array_distinct(heads))).join(p, "head").where(F.col("wild") | (F.col("specifier") == F.col("pattern")))
    rest = F.when(F.col("wild"), F.substring("specifier", F.length("head") + 1, F.length("specifier"))).otherwise(F.lit("*"))
    met = met.withColumn("rest", rest).select("file", "specifier", "rank", "base", "rest", F.posexplode("targets").alias("k", "target"))
    mapped = met.select("file", "specifier", _tried(_normal(F.concat_ws("/", "base", F.replace("target", F.lit("*"), F.col("rest"))))).alias("each"), "rank", "k")
    tried = relative.unionByName(mapped).select("file", "specifier", "rank", "k", F.posexplode("each").alias("n", "module_file"))
    found = tried.join(files.select(F.col("path").alias("module_file")).distinct(), "module_file")
    return found.groupBy("file", "specifier").agg(F.min_by("module_file", F.struct("rank", "k", "n")).alias("module_file"))


def js_bindings(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, local, module_file): what each name that an import binds leads to; the last line that resolves holds."""
    d = imports.join(modules, ["file", "specifier"]).select("file", "pos", "module_file", F.explode("names").alias("local"))
    return d.groupBy("file", "local").agg(F.max_by("module_file", F.struct("pos", "module_file")).alias("module_file"))


def _symbols(symbols: DataFrame, kinds: list[str] | None) -> DataFrame:
    s = symbols if kinds is None else symbols.where(F.col("symbol_type").isin(kinds))
    return s.groupBy(F.col("file").alias("at"), F.col("name").alias("want")).agg(F.min_by("id", F.struct("line_start", "id")).alias("id"))


def js_calls(sites: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(site, target) of calls (site, file, receiver, name): of the same file; through the receiver, else the name itself, as an import binds it.

    An import that binds ends the search. The name is looked up as the call has it, not as the other file exports it.
    """
    s = sites.withColumn("bare", last_part("name"))
    local = _symbols(symbols, ["function", "method", "class"]).withColumnsRenamed({"at": "file", "want": "bare", "id": "local_id"})
    by = lambda c, n: bindings.select("file", F.col("local").alias(c), F.col("module_file").alias(n))
    d = s.join(local, ["file", "bare"], "left").join(by("receiver", "of_receiver"), ["file", "receiver"], "left").join(by("bare", "of_name"), ["file", "bare"], "left")
    there = _symbols(symbols, None)
    d = d.withColumn("module", F.coalesce("of_receiver", "of_name"))
    d = d.join(there, (d["module"] == there["at"]) & (d["bare"] == there["want"]), "left")
    return d.select("site", F.coalesce("local_id", "id").alias("target"))


def js_classes(sites: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(site, target) of class names (site, file, name): of the same file; as an import binds the last part, which ends the search; through the longest imported prefix, what follows it or the last part."""
    classes = _symbols(symbols, ["class"])
    s = sites.withColumn("bare", last_part("name")).withColumn("parts", F.split("name", r"\."))
    local = s.join(classes, (s["file"] == classes["at"]) & (s["bare"] == classes["want"])).select("site", F.lit(0).alias("rank"), F.col("id").alias("target"))
    b = bindings.select(F.col("file").alias("importer"), "local", "module_file")
    direct = s.join(b, (s["file"] == b["importer"]) & (s["bare"] == b["local"])).select("site", F.lit(1).alias("rank"), "module_file", F.array("bare").alias("names"))
    cut = s.withColumn("n", F.explode(F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1)))).withColumn("prefix", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "."))
    walked = cut.join(b, (cut["file"] == b["importer"]) & (cut["prefix"] == b["local"]))
    names = F.array(F.array_join(F.slice("parts", F.col("n") + 1, F.size("parts")), "."), F.col("bare"))
    longest = walked.groupBy("site").agg(F.max_by(F.struct("module_file", names.alias("names")), "n").alias("w")).select("site", F.lit(2).alias("rank"), "w.module_file", "w.names")
    claim = direct.unionByName(longest).groupBy("site").agg(F.min_by(F.struct("module_file", "names"), "rank").alias("c")).select("site", "c.module_file", F.posexplode("c.names").alias("k", "want"))
    found = claim.join(classes, (claim["module_file"] == classes["at"]) & (claim["want"] == classes["want"])).groupBy("site").agg(F.min_by("id", "k").alias("target")).select("site", F.lit(1).alias("rank"), "target")
    best = local.unionByName(found).groupBy("site").agg(F.min_by("target", "rank").alias("target"))
    return sites.select("site").join(best, "site", "left")
