"""Link-graph queries and sinks over (source, target, link_type) edges and an artifacts table keyed by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.norm import ascii_lower


def by_path(artifacts: DataFrame, path: str) -> DataFrame:
    return artifacts.where(F.col("path") == path)


def by_code(artifacts: DataFrame, code: str) -> DataFrame:
    return artifacts.where(F.col("code") == code)


def first_writer(rows: DataFrame, key: list, order: list) -> DataFrame:
    """Of rows with an equal key the first by order: what INSERT OR IGNORE keeps."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def resolve_aliases(names: DataFrame, aliases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(name, path, kind) for names that are an alias but for the case of A-Z; of equal aliases the first written counts."""
    one = first_writer(aliases.withColumn("key", ascii_lower("alias")), ["key"], ["pos", "path"]).select("key", "path")
    return names.join(one, ascii_lower("name") == F.col("key")).join(artifacts.select("path", "kind"), "path").select("name", "path", "kind")


def reverse_deps(links: DataFrame, artifacts: DataFrame, target: str, link_type: str | None = None) -> DataFrame:
    hit = links.where(F.col("target") == target)
    if link_type:
        hit = hit.where(F.col("link_type") == link_type)
    return hit.join(artifacts, hit["source"] == artifacts["path"]).select("path", "kind", "link_type")


def dependents(links: DataFrame, artifacts: DataFrame, target: str, link_type: str = "ast_import") -> DataFrame:
    return reverse_deps(links, artifacts, target, link_type).select("path").distinct().orderBy("path")


def with_all_tags(tags: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Keys that carry every wanted tag (exact, case-sensitive)."""
    w = list(dict.fromkeys(wanted))
    return tags.where(F.col("tag").isin(w)).groupBy(key).agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(w)).select(key)


def inherited_rules(rules: DataFrame, dirs: list[str], deprecated: bool = False) -> DataFrame:
    """Rules of the given directories: in the order of dirs, then falling priority, then ordinal."""
    d = rules.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dirs)], "directory string, pos int")
    r = rules.join(F.broadcast(d), "directory")  # as long as the caller's list
    r = r if deprecated else r.where(F.coalesce(F.col("status"), F.lit("")) != "deprecated")
    return r.orderBy("pos", F.desc("priority"), "ordinal")


def latest_build(log: DataFrame) -> DataFrame:
    """Actions of the latest build: count and total duration, by action."""
    last = log.agg(F.max("build_started").alias("build_started"))
    return log.join(F.broadcast(last), "build_started").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms")).orderBy("action")  # one row


def keep_recent(log: DataFrame, days: int = 30) -> DataFrame:
    last = log.agg(F.max("build_started").alias("_last"))
    return log.join(F.broadcast(last), F.col("build_started") >= F.date_sub("_last", days)).drop("_last")


def stubs(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """An artifact for each link target that there is none for."""
    missing = links.select(F.col("target").alias("path")).distinct().join(artifacts.select("path"), "path", "left_anti")
    return missing.select("path", F.lit("concept").alias("kind"), F.lit(True).alias("is_stub"))


def health(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    return artifacts.agg(F.count(F.lit(1)).alias("artifacts")).crossJoin(links.agg(F.count(F.lit(1)).alias("links")))  # one row each


def ordinals(rows: DataFrame, directory: str, order: str) -> DataFrame:
    return rows.withColumn("ordinal", (F.row_number().over(W.partitionBy(directory).orderBy(order)) - 1).cast("int"))
