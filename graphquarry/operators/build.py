"""The link graph from parsed files, as pieces that a full build and an update of some files share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import norm_concept, rule, strip, summary, wikilinks
from .linkgraph import ordinals

#: One row a file: what its parser found; ok is false where it found nothing it could read. sections: what its kind has
#: besides the body: a playbook's overview; a design's summary and interface contract; a post's problem, context, attempts
#: and findings.
PARSED = (
    "path string, kind string, title string, status string, code string, body string, tags array<string>, aliases array<string>, source string, "
    "files array<string>, concepts array<string>, stack array<string>, imports array<string>, directory string, priority int, ok boolean, sections array<string>"
)
NAMES = "key string, rank int, path string, kind string"
LINKS = "owner string, source string, target string, link_type string, kind string"
CLAIMS = "path string, rank int, kind string, title string, status string, code string"
#: The order in which what names a file counts.
PRESENT, RULE_TITLE, RULE_ALIAS, CONCEPT, PLAYBOOK, CODE = range(6)
OWN, MADE, STUB = range(3)


def _folded(x) -> Column:
    return F.concat(F.lit("a:"), F.lower(strip(x)))


def _normal(x) -> Column:
    return F.concat(F.lit("c:"), norm_concept(x))


def _coded(x) -> Column:
    return F.concat(F.lit("i:"), F.upper(strip(x)))


def _present(x) -> Column:
    return F.concat(F.lit("f:"), x)


def names_of(parsed: DataFrame) -> DataFrame:
    """(key, rank, path, kind): what may be named, and how: the least rank, then the first path counts.

    Rules go by title, then alias; concepts by title or alias, with spaces, hyphens and underscores left out; playbooks by
    title or alias; codes of concepts count in references of posts alone.
    """
    good = parsed.where("ok")
    a = lambda kind, rank, key: good.where(F.col("kind") == kind).select(key.alias("key"), F.lit(rank).alias("rank"), "path", "kind")
    each = lambda key: F.explode(F.transform("aliases", key))
    rules = a("convention", RULE_TITLE, _folded("title")).union(a("convention", RULE_ALIAS, each(_folded)))
    concepts = a("concept", CONCEPT, _normal("title")).union(a("concept", CONCEPT, each(_normal))).union(a("concept", CODE, _coded("code")))
    playbooks = a("playbook", PLAYBOOK, _folded("title")).union(a("playbook", PLAYBOOK, each(_folded)))
    return rules.union(concepts).union(playbooks).where("key IS NOT NULL").distinct()


def present_names(present: DataFrame) -> DataFrame:
    return present.select(_present(F.col("path")).alias("key"), F.lit(PRESENT).alias("rank"), "path", F.lit("source").alias("kind")).distinct()


def sites_of(parsed: DataFrame) -> DataFrame:
    """(owner, source, name, keys, link_type, fallback, kind): what each file refers to.

    Names are looked up by their keys; where none is known the target is fallback, a stub of that kind, or no link without one.
    Fixed targets have no keys. A design's imports are its source's links.
    """
    good = parsed.where("ok")
    none, stub = F.lit(None).cast("string"), lambda x: F.concat(F.lit(".kb/concepts/"), x, F.lit(".md"))

    def each(kind: str, names, link: str, keys, fallback, target: str, source="path") -> DataFrame:
        d = good.where(F.col("kind") == kind).select("path", F.col(source).alias("source"), F.explode(F.array_distinct(names)).alias("name"))
        keys = F.array(*[k(F.col("name")) for k in keys]).cast("array<string>")
        return d.select(F.col("path").alias("owner"), "source", "name", keys.alias("keys"), F.lit(link).alias("link_type"), fallback(F.col("name")).alias("fallback"), F.lit(target).alias("kind"))

    same, no = (lambda x: x), (lambda x: none)
    named = [_folded, _normal]
    parts = [
        each("design", F.array("source"), "design_source", [], same, "source"), each("design", "imports", "ast_import", [], same, "source", "source"), each("design", wikilinks("body"), "wikilink", named, stub, "concept"),
        each("design", "stack", "design_stack_ref", [], same, "stack"), each("concept", wikilinks("body"), "wikilink", named, stub, "concept"), each("concept", "files", "concept_file_ref", [_present], no, "source"),
        each("convention", wikilinks("body"), "convention_concept_ref", named, stub, "concept"), each("stack", "files", "stack_file_ref", [], same, "source"), each("stack", "concepts", "stack_concept_ref", [_normal, _coded], stub, "concept"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def resolved(sites: DataFrame, names: DataFrame) -> DataFrame:
    """LINKS of the sites: a name's best target over its keys."""
    best = names.groupBy("key").agg(F.min(F.struct("rank", "path")).alias("best"))
    named = sites.where(F.size("keys") > 0)
    # a popular name is looked up once, however many files refer to it
    asked = named.select("keys").distinct().select("keys", F.explode("keys").alias("key"))
    hit = asked.join(best, "key").groupBy("keys").agg(F.min("best").alias("best"))
    hit = hit.select("keys", F.col("best.path").alias("path"))
    found = named.join(hit, "keys", "left").select("owner", "source", F.coalesce("path", "fallback").alias("target"), "link_type", "kind").where("target IS NOT NULL")
    fixed = sites.where(F.size("keys") == 0).select("owner", "source", F.col("fallback").alias("target"), "link_type", "kind").where("source IS NOT NULL AND target IS NOT NULL")
    return found.union(fixed).distinct()


def own_claims(parsed: DataFrame) -> DataFrame:
    """CLAIMS of the files themselves and of the sources that designs bring."""
    good, none = parsed.where("ok"), F.lit(None).cast("string")
    own = good.select("path", F.lit(OWN).alias("rank"), "kind", "title", "status", "code")
    return own.union(good.where("kind = 'design' AND source IS NOT NULL").select("source", F.lit(MADE), F.lit("source"), "title", none, none))


def link_claims(links: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return links.select(F.col("target").alias("path"), F.lit(STUB).alias("rank"), "kind", none.alias("title"), none.alias("status"), none.alias("code"))


def artifacts_of(claims: DataFrame) -> DataFrame:
    """Each claimed path once: as its file says, else as a design does, else as a stub."""
    best = claims.groupBy("path").agg(F.min(F.struct("rank", "kind", "title", "status", "code")).alias("c"))
    return best.select("path", "c.kind", "c.title", "c.status", "c.code", (F.col("c.rank") == STUB).alias("is_stub"))


def public_links(links: DataFrame) -> DataFrame:
    return links.select("source", "target", "link_type").distinct()


def texts_of(parsed: DataFrame) -> DataFrame:
    """(path, title, body) that searches read: a concept's summary, a rule's first paragraph or the sections, then the body but of
    designs and posts, aliases of what has them, and tags; parts that are empty are left out."""
    kind, line = F.col("kind"), lambda c: F.array_join(c, " ")
    head = F.when(kind == "concept", F.array(summary("body"))).when(kind == "convention", F.array(rule("body"))).otherwise(F.coalesce("sections", F.array().cast("array<string>")))
    whole = F.when(kind.isin("design", "stack"), F.array().cast("array<string>")).otherwise(F.array("body", line("aliases")))
    parts = F.filter(F.concat(head, whole, F.array(line("tags"))), lambda x: x != "")
    return parsed.where("ok").select("path", F.coalesce("title", F.lit("")).alias("title"), F.array_join(parts, "\n").alias("body"))


def own_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """tags, aliases, conventions, texts and log: what needs no other file, but that an alias belongs to the first file by path."""
    good = parsed.where("ok")
    said = good.where("kind IN ('concept', 'convention', 'playbook')").select(F.explode("aliases").alias("alias"), "path")
    aliases = said.groupBy(F.lower("alias").alias("key")).agg(F.min(F.struct("path", "alias")).alias("r")).select("r.path", "r.alias")
    tags = good.select("path", F.explode("tags").alias("tag")).distinct()
    rules = good.where("kind = 'convention'")
    conventions = rules.select("path", "directory", "body", "status", "priority").join(ordinals(rules.select("path", "directory"), "directory", "path"), ["path", "directory"])
    log = parsed.select("path", "kind", F.when(F.col("ok"), "created").otherwise("failed").alias("action"))
    return {"tags": tags, "aliases": aliases, "conventions": conventions, "texts": texts_of(parsed), "log": log}


def full_build(parsed: DataFrame, present: DataFrame) -> dict[str, DataFrame]:
    """artifacts, links, tags, aliases, conventions, texts and log of parsed files (PARSED); present: (path) of files that exist.

    A file that did not parse adds nothing but a row of the log. A design brings its source and what that imports. Names in
    bodies are resolved by title and alias, references of posts to concepts also by code; what nothing resolves becomes a
    stub. A concept's file references count only if the file exists. Links are unique by source, target and type.
    """
    links = resolved(sites_of(parsed), names_of(parsed).union(present_names(present)))
    claims = own_claims(parsed).union(link_claims(links))
    return {"artifacts": artifacts_of(claims), "links": public_links(links), **own_tables(parsed)}


def updated(parsed: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """parsed after a change: rows of changed files in the place of their old ones, those of deleted files gone."""
    gone = changed.select("path").union(deleted.select("path")).distinct()
    return parsed.join(gone, "path", "left_anti").unionByName(changed)
