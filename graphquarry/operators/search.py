"""Unified search over artifacts, texts, tags and symbols, and the lookup of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import norm_tag
from . import linkgraph as L
from . import symbols as Y
from . import text as T

HITS = "bucket string, key string, title string, rank double"


def _hits(df: DataFrame, bucket, rank=None) -> DataFrame:
    b = F.lit(bucket) if isinstance(bucket, str) else bucket
    return df.select(b.alias("bucket"), F.col("path").cast("string").alias("key"), "title", (F.lit(0.0) if rank is None else rank).cast("double").alias("rank"))


def unified(artifacts: DataFrame, bodies: DataFrame, tags: DataFrame, query: str = "", wanted: list[str] | None = None, kind: str | None = None, status: str | None = None, scope: str | None = None, symbols: DataFrame | None = None, members: DataFrame | None = None, limit: int = 20, indexed: bool = True) -> DataFrame:
    """(bucket, key, title, rank) of a search; bucket is an artifact kind or `symbol`.

    artifacts (path, kind, title, status, code), bodies (path, body), tags (path, tag). A code is looked up and ends the search.
    Tags decide alone on the indexed route, on which their case and marks count; the scan folds them. Texts are limited before they are filtered
    by kind, status and scope; scope is a prefix of the path and drops concepts. Symbols join a search that filters nothing but
    the scope, which counts after their limit. A text search without a hit falls back to concepts by part of their title.
    """
    spark = artifacts.sparkSession
    way = T.route(query, wanted, indexed)
    if way == "code":
        return _hits(L.by_code(artifacts, query), F.col("kind"))
    if way == "tags":
        found = artifacts.join(L.with_all_tags(tags, "path", wanted), "path", "left_semi").withColumn("rank", F.lit(0.0))
    elif way == "text":
        d = artifacts.where("kind <> 'source'").join(bodies, "path", "left").select("path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
        found = artifacts.join(T.search_texts(d, "path", query, "title", "body", limit=limit), "path")
    else:
        d = artifacts.join(bodies, "path", "left").withColumn("body", F.coalesce("body", F.lit("")))
        found = T.scan(d, query, "title", "body") if query else d
        if wanted:
            folded = tags.select("path", norm_tag("tag").alias("tag"))
            found = found.join(L.with_all_tags(folded, "path", [t.strip().lower().replace("_", "-") for t in wanted]), "path", "left_semi")
        found = found.withColumn("rank", F.lit(0.0))
    found = found.where(T.included(status))
    if kind:
        found = found.where(F.col("kind") == kind)
    if scope:
        found = found.where((F.col("kind") != "concept") & F.col("path").startswith(scope))
    out = _hits(found, F.col("kind"), F.col("rank"))
    if way == "text" and out.isEmpty():
        c = artifacts.where("kind = 'concept'").where(T.included(status)).where(F.lower("title").contains(query.lower()))
        out = _hits(c, "concept")
    if symbols is not None and query and not (wanted or kind or status):
        s = Y.search(symbols, members, query, 10).join(symbols.select("id", "file", "qualified_name"), "id")
        s = s.where(F.col("file").startswith(scope)) if scope else s
        out = out.union(s.select(F.lit("symbol"), F.col("id").cast("string"), F.col("qualified_name"), F.col("score")))
    return out if out.columns else spark.createDataFrame([], HITS)


def view(artifacts: DataFrame, code: str) -> dict:
    """The artifact of a code, or an error (`malformed`, `unknown`) by name."""
    import re

    if not re.fullmatch(r"[A-Z]{2}-\d{3,}", code):
        return {"error": "malformed", "code": code}
    row = L.by_code(artifacts, code).first()
    return row.asDict() if row else {"error": "unknown", "code": code}


def file_lookup(path: str, symbols: DataFrame, calls: DataFrame, links: DataFrame, artifacts: DataFrame, rules: DataFrame, limit: int = 5) -> DataFrame:
    """One row for a file: its key symbols, importers and other references as sorted arrays, and its rules, the broadest first."""
    from .indexes import rules_for

    spark = symbols.sparkSession
    one = spark.createDataFrame([(path,)], "path string")
    lists = lambda df, value, name: df.agg(F.array_sort(F.collect_list(value)).alias(name))
    keys = lists(Y.key_symbols(symbols.where(F.col("file") == path)), F.col("name"), "key_symbols")
    refs = L.reverse_deps(links, artifacts, path)
    importers = lists(refs.where("link_type = 'ast_import'"), F.col("path"), "importers")
    others = lists(refs.where("link_type <> 'ast_import'"), F.col("path"), "references")
    held = rules_for(one, rules, limit).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("rules"))
    called = calls.join(symbols.where(F.col("file") == path).select(F.col("id").alias("callee")), "callee", "left_semi").agg(F.count(F.lit(1)).alias("calls_in"))
    return one.crossJoin(keys).crossJoin(importers).crossJoin(others).crossJoin(held).crossJoin(called)  # one row each


def directory_lookup(links: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, imports, importers): inbound imports of each directory's files (path, directory), and from how many different files."""
    hit = links.where("link_type = 'ast_import'").join(files.select(F.col("path").alias("target"), "directory"), "target")
    return hit.groupBy("directory").agg(F.count(F.lit(1)).alias("imports"), F.countDistinct("source").alias("importers"))
