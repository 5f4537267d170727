"""Queries over parsed concepts, conventions, playbooks and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.norm import ancestors, norm_concept, strip
from .globs import glob_hits, glob_rules

#: Fixed value: of a directory so many paths and rules meet in a task at once.
BLOCK = 2000


def find_concept(concepts: DataFrame, name: str) -> DataFrame:
    k = norm_concept(F.lit(name))
    return concepts.where((norm_concept("title") == k) | F.exists("aliases", lambda a: norm_concept(a) == k))


def search_concepts(concepts: DataFrame, text: str, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """Concepts that hold text in a title, alias, tag or summary; if there is none and text is long enough, those of like names."""
    k = norm_concept(F.lit(text))
    hit = norm_concept("title").contains(k) | F.exists("aliases", lambda a: norm_concept(a).contains(k)) | F.exists("tags", lambda a: norm_concept(a).contains(k)) | norm_concept("summary").contains(k)
    found = concepts.where(hit).orderBy("title")
    if len(text) < 5 or not found.isEmpty():
        return found
    from .text import suggestions

    names = concepts.select("title", F.explode(F.concat(F.array("title"), "aliases")).alias("a")).select("title", F.lower("a").alias("name"))
    near = suggestions(names, text, n, cutoff)
    return concepts.join(names.join(near, "name", "left_semi").select("title").distinct(), "title", "left_semi").orderBy("title")


def rules_for(paths: DataFrame, rules: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, directory, title, rank, total): the rules whose directory is the path's or above it, the broadest first.

    With a limit the most special ones stay, still the broadest first. '.' is the root, and 'project' holds everywhere.
    """
    dirs = paths.select("path", F.posexplode(ancestors("path")).alias("depth", "directory"))
    r = rules.withColumn("directory", F.when(F.col("directory") == "project", ".").otherwise(F.col("directory")))
    w = W.partitionBy("path")
    if limit is None:
        d = dirs.join(r, "directory").withColumn("total", F.count(F.lit(1)).over(w))
        return d.withColumn("rank", F.row_number().over(w.orderBy("depth", F.desc("priority"), "title")))
    # of a directory only its last rules can stay, so no path meets more of them than that; what it had in all is counted apart
    n = r.groupBy("directory").agg(F.count(F.lit(1)).alias("n"))
    totals = dirs.join(n, "directory").groupBy("path").agg(F.sum("n").alias("total"))
    from_end = [F.asc_nulls_first("priority"), F.desc_nulls_last("title")]
    last = r.withColumn("_r", F.row_number().over(W.partitionBy("directory").orderBy(*from_end))).where(F.col("_r") <= limit).drop("_r")
    d = dirs.join(last, "directory").withColumn("_r", F.row_number().over(w.orderBy(F.desc("depth"), *from_end))).where(F.col("_r") <= limit)
    return d.join(totals, "path").withColumn("rank", (F.col("total") - F.col("_r") + 1).cast("int")).drop("_r")


def by_title(rows: DataFrame) -> DataFrame:
    """Of rows with one title that of the last path."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("title").orderBy(F.desc("path")))).where("_r = 1").drop("_r")


def by_tag(rows: DataFrame, tag: str) -> DataFrame:
    return by_title(rows).where(F.exists("tags", lambda t: F.lower(strip(t)) == tag.strip().lower())).orderBy("title")


def by_trigger(files: DataFrame, playbooks: DataFrame) -> DataFrame:
    """(file, title, specificity): playbooks (title, globs) with a glob that a file matches, as an ignore file's pattern would; the most special glob counts."""
    rules = glob_rules(playbooks.select("title", F.explode("globs").alias("pattern"))).where("NOT negated")
    hit = glob_hits(files.select("file").distinct(), rules, "file")
    special = F.size(F.filter(F.split(F.regexp_replace("pattern", "^/+|/+$", ""), "/"), lambda s: s != "**"))
    return hit.groupBy("file", "title").agg(F.max(special).alias("specificity")).orderBy("file", F.desc("specificity"), "title")


def by_any_scope(paths: DataFrame, rules: DataFrame, roots: list[str]) -> DataFrame:
    """(path, root, rule): rules (rule, scopes: array) that hold for paths below several roots (an ordered list that a caller names).

    A path belongs to the first root that holds it. A scope "." or "project" always holds, others where they are the path or a
    directory above it that is not above the root; slashes at their ends do not count. A rule's status does not matter.
    """
    flat = lambda x: F.regexp_replace(x, "^/+|/+$", "")
    below = lambda p, d: (d == ".") | (p == d) | p.startswith(F.concat(d, F.lit("/")))
    tops = [r.strip("/") or "." for r in roots]
    owner = F.coalesce(*[F.when(below(flat("path"), F.lit(t)), F.lit(r)) for r, t in zip(roots, tops, strict=True)]) if roots else F.lit(None).cast("string")
    top = F.when(flat("root") == "", F.lit(".")).otherwise(flat("root"))
    edge = F.when(flat("root").isin("", "."), 1).otherwise(F.length(flat("root")))
    dirs = paths.select("path").distinct().select("path", owner.alias("root")).where("root IS NOT NULL").withColumns({"top": top, "edge": edge}).withColumn("dir", F.explode(F.array_distinct(ancestors(flat("path")))))
    dirs = dirs.where((F.col("dir") == ".") | below(F.col("dir"), F.col("top"))).drop("top")
    r = rules.select("rule", F.explode("scopes").alias("dir"))
    r = r.withColumn("dir", F.when(F.col("dir").isin("project", ".") | (flat("dir") == ""), ".").otherwise(flat("dir")))
    # a rule counts at the broadest of its scopes that a path has: at "." if that is one, else where none above is within the root
    r = r.groupBy("rule").agg(F.collect_set("dir").alias("all")).withColumn("all", F.when(F.array_contains("all", "."), F.array(F.lit("."))).otherwise(F.col("all")))
    over = F.array_max(F.transform(F.filter("all", lambda a: F.col("dir").startswith(F.concat(a, F.lit("/")))), F.length))
    r = r.withColumn("dir", F.explode("all")).select("rule", "dir", F.coalesce(over, F.lit(0)).alias("over"))
    return _paired(dirs, r, F.col("over") < F.col("edge")).select("path", "root", "rule")


def _paired(dirs: DataFrame, rules: DataFrame, where) -> DataFrame:
    """dirs (path, dir) joined with rules (rule, dir) where that holds; many pairs of one directory are dealt to many tasks.

    A directory of over BLOCK paths or rules is cut into cells of about BLOCK paths and BLOCK rules each, so a row is repeated once
    for BLOCK of those that it meets. Tasks are as many as shuffles have, and four a core: by their bytes, which say nothing of pairs,
    they would be few.
    """
    blocks = lambda d, name: d.groupBy("dir").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)
    crowded = blocks(dirs, "_np").join(blocks(rules, "_nr"), "dir", "full_outer")
    spark = dirs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def dealt(d: DataFrame, key: str, own: str, other: str) -> DataFrame:
        d = d.join(F.broadcast(crowded), "dir", "left")  # at most a row for BLOCK paths or rules
        d = d.withColumns({f"{own}b": F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))), f"{other}b": F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}).drop("_np", "_nr")
        return d.withColumns({c: F.col(c).cast("int") for c in ("_npb", "_nrb")}).repartition(n, "dir", "_npb", "_nrb")

    return dealt(dirs, "path", "_np", "_nr").hint("merge").join(dealt(rules, "rule", "_nr", "_np"), ["dir", "_npb", "_nrb"]).where(where)


def by_trigger_dir(dirs: DataFrame, playbooks: DataFrame) -> DataFrame:
    """(directory, title, specificity) as by_trigger, for directories: what would match a file right below one."""
    found = by_trigger(dirs.select(F.concat("directory", F.lit("/.d")).alias("file")), playbooks)
    return found.select(F.regexp_replace("file", r"/\.d$", "").alias("directory"), "title", "specificity")


def posts_by(posts: DataFrame, tag: str | None = None, status: str | None = None, concept: str | None = None, resolution: str | None = None, scope: str | None = None) -> DataFrame:
    """Posts (tags, concepts, files: arrays; status, resolution_type) that have all that is asked; scope: a file that starts with it."""
    hit = F.lit(True)
    if tag is not None:
        hit = hit & F.exists("tags", lambda t: F.lower(t) == tag.strip().lower())
    if status is not None:
        hit = hit & (F.col("status") == status)
    if concept is not None:
        hit = hit & F.exists("concepts", lambda c: F.lower(c) == concept.lower())
    if resolution is not None:
        hit = hit & (F.col("resolution_type") == resolution)
    if scope is not None:
        hit = hit & F.exists("files", lambda f: f.startswith(scope))
    return posts.where(hit).orderBy(F.desc("votes"), "post")


def in_scope(conventions: DataFrame, scope: str) -> DataFrame:
    """Conventions that a search below scope shows: those of the project, and those whose scope is a prefix of its text."""
    return conventions.where((F.col("scope") == "project") | F.lit(scope).startswith(F.col("scope")))


def details(conventions: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of conventions whose path is among ids (path), in one join."""
    return conventions.join(ids.select("path").distinct(), "path", "left_semi")


def search_posts(posts: DataFrame, text: str, *columns: str) -> DataFrame:
    """Posts that hold text, the most voted first, ties by id."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    return posts.where(hit).orderBy(F.desc("votes"), "post")


def known_issues(posts: DataFrame, limit: int = 3) -> DataFrame:
    """Posts but stale ones by status (open, resolved, outdated, duplicate) and falling votes; limit of them, and how many there are."""
    order = F.when(F.col("status") == "open", 0).when(F.col("status") == "resolved", 1).when(F.col("status") == "outdated", 2).when(F.col("status") == "duplicate", 3).otherwise(9)
    p = posts.where("status <> 'stale'").withColumn("o", order)
    total = p.agg(F.count(F.lit(1)).alias("total"))
    return p.orderBy("o", F.desc("votes"), "post").limit(limit).crossJoin(F.broadcast(total)).select("post", "status", "votes", "total")  # one row
