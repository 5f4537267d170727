"""Library checks: each a DataFrame of issues (severity, check_name, artifact, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import token_estimate

SCHEMA = "severity string, check_name string, artifact string, message string"


def issue(df: DataFrame, severity: str, check: str, artifact, message) -> DataFrame:
    a = F.col(artifact) if isinstance(artifact, str) else artifact
    m = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check_name"), a.cast("string").alias("artifact"), m.alias("message"))


def dangling(refs: DataFrame, ref: str, existing: DataFrame, key: str, severity: str = "error", check: str = "file_existence") -> DataFrame:
    """Rows of refs (owner, ref) whose ref does not exist."""
    e = existing.select(F.col(key).alias(ref)).distinct()
    return issue(refs.join(e, ref, "left_anti"), severity, check, "owner", F.col(ref).cast("string"))


def required(df: DataFrame, artifact: str, fields: list[str], check: str) -> DataFrame:
    """An issue for each required field that is null or blank."""
    bad = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return issue(df.select(artifact, F.explode(bad).alias("f")), "error", check, artifact, F.concat(F.lit("missing "), "f"))


def allowed(df: DataFrame, artifact: str, field: str, values: list[str], check: str) -> DataFrame:
    return issue(df.where(~F.coalesce(F.col(field), F.lit("")).isin(values)), "error", check, artifact, F.concat(F.lit(f"bad {field} "), F.coalesce(field, F.lit("none"))))


def stale_hashes(stored: DataFrame, current: DataFrame) -> DataFrame:
    j = stored.join(current.select("path", F.col("hash").alias("now")), "path")
    return issue(j.where("hash <> now"), "warning", "hash_freshness", "path", "source changed")


def over_budget(df: DataFrame, artifact: str, text: str, limits: dict[str, int]) -> DataFrame:
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("kind")]
    t = token_estimate(text, 1)
    return issue(df.where(t > limit), "warning", "token_budgets", artifact, t.cast("string"))


def orphans(concepts: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Concepts (path, title) that no link names by path, title or alias."""
    used = links.select(F.lower("target").alias("k")).distinct()
    names = concepts.select("path", F.lower("path").alias("k")).union(concepts.select("path", F.lower("title"))).union(aliases.select("path", F.lower("alias")))
    named = names.join(used, "k", "left_semi").select("path").distinct()
    return issue(concepts.join(named, "path", "left_anti"), "warning", "orphan_concepts", "path", "no link names it")


def deprecated_use(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    d = artifacts.where("status = 'deprecated'").select(F.col("path").alias("target"))
    return issue(links.join(d, "target"), "warning", "deprecated_concept_usage", "source", F.col("target"))


def drift(declared: DataFrame, graph: DataFrame) -> DataFrame:
    """Declared and found dependencies (src, dep) that the other side has not."""
    a = issue(declared.join(graph, ["src", "dep"], "left_anti"), "warning", "bidirectional_deps", "src", F.concat(F.lit("not in graph: "), F.col("dep").cast("string")))
    return a.union(issue(graph.join(declared, ["src", "dep"], "left_anti"), "info", "bidirectional_deps", "src", F.concat(F.lit("not declared: "), F.col("dep").cast("string"))))


def duplicates(df: DataFrame, key, artifact: str, check: str, severity: str = "error") -> DataFrame:
    """Rows whose key others have too. Keys are counted before they are joined, so a hot key costs no window."""
    k = df.withColumn("_k", key)
    many = k.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return issue(k.join(many, "_k"), severity, check, artifact, F.concat_ws(" x", F.col("_k").cast("string"), F.col("n").cast("string")))


def supersession(names: DataFrame) -> DataFrame:
    """Artifacts (path, name) that share a normalised name: each but the first, with the first, so a group costs a row a member."""
    first = names.groupBy("name").agg(F.min("path").alias("first"))
    return issue(names.join(first, "name").where("path <> first"), "info", "supersession_candidate", "path", F.col("first"))


def expired(df: DataFrame, artifact: str, age, limit: int, check: str) -> DataFrame:
    return issue(df.where(age > limit), "info", check, artifact, age.cast("string"))


def uncovered(files: DataFrame, rules: DataFrame, least: int = 5) -> DataFrame:
    """Directories of at least `least` files without an active rule there or above."""
    from ..functions.norm import ancestors

    d = files.groupBy("directory").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    up = d.select("directory", "n", F.explode(ancestors("directory")).alias("a"))
    held = up.join(rules.where("status = 'active'").select(F.col("directory").alias("a")).distinct(), "a", "left_semi").select("directory").distinct()
    return issue(d.join(held, "directory", "left_anti"), "info", "convention_gap", "directory", F.col("n").cast("string"))


def summarize(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "check_name").agg(F.count(F.lit(1)).alias("n"))


def exit_code(issues: DataFrame) -> DataFrame:
    """1 with errors, 2 with warnings only, else 0."""
    c = issues.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    return c.select(F.when(F.col("e") > 0, 1).when(F.col("w") > 0, 2).otherwise(0).alias("exit_code"))
