"""The named health checks of a library, as a table of forms, and their run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.norm import norm_concept, slugify
from . import checks as K

#: Limits of the checks.
BUDGETS = {"design": 400, "concept": 400, "convention": 500, "playbook": 500, "aindex": 200}
COMMENTS, VIOLATIONS, GAP_FILES, TTL_COMMITS, PLAYBOOK_COMMITS, PLAYBOOK_DAYS, POST_COMMITS, SIGNAL_HOURS, LOOKUP_TOKENS, VERSION = 10, 3, 5, 50, 100, 180, 200, 72, 1200, "2"
STATUSES = {"concept": ["draft", "active", "deprecated"], "convention": ["draft", "active", "deprecated"], "playbook": ["draft", "active", "deprecated"], "design": ["active", "deprecated", "unlinked"], "stack": ["open", "resolved", "outdated", "duplicate", "stale"]}

#: Columns of the tables that the checks read; those that a caller has not are empty.
TABLES = {
    "artifacts": "path string, kind string, title string, status string, code string, body string, updated_by string, source string, source_hash string, commits long, days long",
    "files": "path string, hash string, directory string",
    "directories": "directory string",
    "covered": "directory string",  # directories with a directory file
    "aliases": "path string, alias string",
    "links": "source string, target string, link_type string",
    "wikilinks": "owner string, kind string, ref string",
    "names": "name string",  # what a wikilink can resolve to
    "refs": "owner string, kind string, ref string",  # kind: file, dependency, stack, scope, entry, linked
    "declared": "src string, dep string",
    "graph": "src string, dep string",
    "comments": "path string, n long, violations long",
    "signals": "path string, directory string, author string, scope string, hours double",
    "lookups": "path string, tokens long",
    "lines": "path string, n long, text string",  # of the configuration and ignore files
    "meta": "key string, value string",
}
Tables = dict[str, DataFrame]


def _kind(t: Tables, *kinds: str) -> DataFrame:
    return t["artifacts"].where(F.col("kind").isin(*kinds))


def _form(kind: str, *fields: str) -> Callable[[Tables, str, str], DataFrame]:
    def run(t: Tables, sev: str, name: str) -> DataFrame:
        a = _kind(t, kind)
        return K.required(a, "path", list(fields), name).union(K.allowed(a, "path", "status", STATUSES[kind], name))

    return run


def _unknown(*kinds: str):
    def run(t: Tables, sev: str, name: str) -> DataFrame:
        w = t["wikilinks"].where(F.col("kind").isin(*kinds)).select("owner", F.lower("ref").alias("ref"))
        return K.dangling(w, "ref", t["names"].select(F.lower("name").alias("n")), "n", sev, name)

    return run


def _missing(kind: str, table: str = "files", key: str = "path"):
    return lambda t, sev, name: K.dangling(t["refs"].where(F.col("kind") == kind), "ref", t[table], key, sev, name)


def _gone(table: str, key: str, other: str, okey: str, message: str):
    return lambda t, sev, name: K.issue(t[table].join(t[other].select(F.col(okey).alias(key)).distinct(), key, "left_anti"), sev, name, key, message)


def _where(table: str, condition: str, key: str, message: str, *kinds: str):
    def run(t: Tables, sev: str, name: str) -> DataFrame:
        d = _kind(t, *kinds) if kinds else t[table]
        return K.issue(d.where(condition), sev, name, key, message)

    return run


def _stale(condition: str = "true"):
    def run(t: Tables, sev: str, name: str) -> DataFrame:
        now = t["files"].select(F.col("path").alias("source"), "hash")
        return K.issue(_kind(t, "design").where(condition).join(now, "source").where("source_hash <> hash"), sev, name, "path", "source changed")

    return run


def _stale_posts(t: Tables, sev: str, name: str) -> DataFrame:
    d = _kind(t, "design").join(t["files"].select(F.col("path").alias("source"), "hash"), "source").where("source_hash <> hash").select(F.col("source").alias("ref"))
    hit = t["refs"].where("kind = 'file'").join(_kind(t, "stack").select(F.col("path").alias("owner")), "owner").join(d, "ref")
    return K.issue(hit.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set("ref")), ", ").alias("m")), sev, name, "owner", F.col("m"))


def _unused(t: Tables, sev: str, name: str) -> DataFrame:
    return K.orphans(_kind(t, "concept").select("path", "title"), t["links"], t["aliases"])


def _same(key, *kinds: str, table: str = "artifacts"):
    def run(t: Tables, sev: str, name: str) -> DataFrame:
        d = _kind(t, *kinds) if kinds else t[table]
        return K.duplicates(d.where(key().isNotNull()), key(), "path", name, sev)

    return run


def _lacks(kind: str, pattern: str, message: str):
    return lambda t, sev, name: K.issue(_kind(t, kind).where(~F.coalesce(F.col("body"), F.lit("")).rlike(pattern)), sev, name, "path", message)


def _successors(t: Tables, sev: str, name: str) -> DataFrame:
    c = _kind(t, "concept").select("path", "title")
    names = c.select("path", norm_concept("title").alias("name")).union(t["aliases"].join(c, "path").select("path", norm_concept("alias")))
    return K.supersession(names.distinct())


def _gap(t: Tables, sev: str, name: str) -> DataFrame:
    scopes = t["refs"].where("kind = 'scope'").select(F.col("owner").alias("path"), F.col("ref").alias("directory"))
    return K.uncovered(t["files"], scopes.join(_kind(t, "convention").select("path", "status"), "path"), GAP_FILES)


def _empty_scopes(t: Tables, sev: str, name: str) -> DataFrame:
    s = t["refs"].where("kind = 'scope'").join(t["files"].groupBy(F.col("directory").alias("ref")).agg(F.count(F.lit(1)).alias("n")), "ref", "left")
    return K.issue(s.groupBy("owner").agg(F.max(F.coalesce("n", F.lit(0))).alias("n")).where("n = 0"), sev, name, "owner", "no file in its scope")


#: Name, registered severity, form. Severity filters go by this one; a form may report another.
CHECKS: dict[str, tuple[str, Callable[[Tables, str, str], DataFrame]]] = {
    "wikilink_resolution": ("error", _unknown("concept", "convention", "design", "stack")),
    "file_existence": ("error", _missing("file")),
    "concept_frontmatter": ("error", _form("concept", "title", "code")),
    "convention_frontmatter": ("error", _form("convention", "title", "code")),
    "design_frontmatter": ("error", _form("design", "title", "code", "updated_by")),
    "stack_frontmatter": ("error", _form("stack", "title", "code")),
    "playbook_frontmatter": ("error", _form("playbook", "title", "code")),
    "iwh_frontmatter": ("error", _where("signals", "author IS NULL OR coalesce(scope, '') NOT IN ('warning', 'incomplete', 'blocked')", "path", "bad signal")),
    "playbook_wikilinks": ("error", _unknown("playbook")),
    "artifact_id_uniqueness": ("error", _same(lambda: F.col("code"))),
    "linkgraph_version": ("error", _where("meta", f"key = 'schema_version' AND value <> '{VERSION}'", "key", "another version")),
    "config_valid": ("error", _where("lines", "path LIKE '%.yaml' AND trim(text) <> '' AND NOT text RLIKE '^\\\\s*(#|-|[^:]+:)'", "path", "not a setting")),
    "hash_freshness": ("warning", _stale()),
    "stale_agent_design": ("warning", _stale("updated_by IN ('agent', 'maintainer')")),
    "token_budgets": ("warning", lambda t, sev, name: K.over_budget(t["artifacts"].where(F.col("kind").isin(*BUDGETS)), "path", "body", BUDGETS)),
    "orphan_concepts": ("warning", _unused),
    "deprecated_concept_usage": ("warning", lambda t, sev, name: K.deprecated_use(t["links"], _kind(t, "concept"))),
    "orphaned_designs": ("warning", lambda t, sev, name: K.dangling(_kind(t, "design").select(F.col("path").alias("owner"), F.col("source").alias("ref")), "ref", t["files"], "path", sev, name)),
    "orphaned_aindex": ("warning", _gone("covered", "directory", "directories", "directory", "directory is gone")),
    "convention_orphaned_scope": ("warning", _missing("scope", "directories", "directory")),
    "ignore_syntax": ("warning", _where("lines", "path LIKE '%ignore' AND text RLIKE '\\\\[[^\\\\]]*$'", "path", "open bracket")),
    "duplicate_aliases": ("warning", _same(lambda: F.lower("alias"), table="aliases")),
    "duplicate_slugs": ("warning", _same(lambda: F.concat_ws("/", "kind", slugify("title")))),
    "stack_refs_validity": ("warning", _missing("stack", "artifacts", "code")),
    "design_deps_existence": ("warning", _missing("dependency")),
    "aindex_entries": ("warning", _missing("entry")),
    "design_structure": ("warning", _lacks("design", r"(?m)^## Interface", "no interface section")),
    "stack_body_sections": ("warning", _lacks("stack", r"(?m)^## Problem\s+\S", "no problem section")),
    "forward_dependencies": ("info", _missing("dependency")),
    "stack_staleness": ("info", _stale_posts),
    "resolved_post_staleness": ("info", _where("artifacts", f"status = 'resolved' AND commits > {POST_COMMITS}", "path", "many commits since", "stack")),
    "aindex_coverage": ("info", _gone("directories", "directory", "covered", "directory", "no directory file")),
    "bidirectional_deps": ("info", lambda t, sev, name: K.drift(t["declared"], t["graph"])),
    "dangling_links": ("info", lambda t, sev, name: K.dangling(t["links"].select(F.col("source").alias("owner"), F.col("target").alias("ref")), "ref", t["artifacts"], "path", sev, name)),
    "orphan_artifacts": ("info", lambda t, sev, name: K.issue(t["artifacts"].where("kind = 'source'").join(t["files"].select("path"), "path", "left_anti"), sev, name, "path", "file is gone")),
    "orphaned_iwh": ("info", _gone("signals", "directory", "directories", "directory", "directory is gone")),
    "comment_accumulation": ("info", _where("comments", f"n > {COMMENTS}", "path", "many comments")),
    "deprecated_ttl": ("info", _where("artifacts", f"status = 'deprecated' AND commits > {TTL_COMMITS}", "path", "long deprecated", "concept", "convention", "design")),
    "stale_concept": ("info", _missing("linked")),
    "supersession_candidate": ("info", _successors),
    "convention_stale": ("info", _empty_scopes),
    "convention_gap": ("info", _gap),
    "convention_consistent_violation": ("info", _where("comments", f"violations >= {VIOLATIONS}", "path", "often violated")),
    "lookup_token_budget_exceeded": ("info", _where("lookups", f"tokens > {LOOKUP_TOKENS}", "path", "long lookup")),
    "orphaned_iwh_signals": ("info", _where("signals", f"hours IS NULL OR hours > {SIGNAL_HOURS}", "path", "expired")),
    "concept_body": ("info", _lacks("concept", r"\S", "empty body")),
    "playbook_staleness": ("info", _where("artifacts", f"days IS NULL OR days > {PLAYBOOK_DAYS} OR commits > {PLAYBOOK_COMMITS}", "path", "not verified lately", "playbook")),
    "playbook_deprecated_ttl": ("info", _where("artifacts", f"status = 'deprecated' AND commits > {TTL_COMMITS}", "path", "long deprecated", "playbook")),
}


def validate(spark: SparkSession, tables: Tables, names: list[str] | None = None, least: str = "info") -> DataFrame:
    """The union of the checks of at least a severity; one whose tables do not fit reports that instead of failing the run."""
    rank = {"error": 2, "warning": 1, "info": 0}
    t = {n: tables[n] if n in tables else spark.createDataFrame([], s) for n, s in TABLES.items()}
    out = spark.createDataFrame([], K.SCHEMA)
    for name, (severity, form) in CHECKS.items():
        if rank[severity] >= rank[least] and (names is None or name in names):
            try:
                part = form(t, severity, name)
            except AnalysisException as e:
                part = spark.createDataFrame([("error", name, None, f"check failed: {type(e).__name__}")], K.SCHEMA)
            out = out.unionByName(part)
    return out
