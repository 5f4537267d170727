"""What to know about files, for many at once: tagged sections of lines, and a budget of tokens for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .indexes import by_trigger, rules_for

#: Sections by importance, names of link types, the rank of a post's state.
DESIGN, RULES, ISSUES, SIGNALS, LINKS, PLAYBOOKS, SIBLINGS = range(7)
LABELS = {
    "wikilink": "concept wikilink", "stack_file_ref": "stack post", "stack_concept_ref": "stack concept ref", "design_stack_ref": "design stack ref", "design_source": "design file", "concept_file_ref": "concept file ref",
    "convention_concept_ref": "convention concept ref",
}
STATES = ("open", "resolved", "outdated", "duplicate")
LEAST = 50


def _ranked(df: DataFrame, section: int, line: Column, *order, most: int) -> DataFrame:
    """(path, section, pos, line): the first `most` lines of each path."""
    w = W.partitionBy("path").orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("path", F.lit(section).alias("section"), "pos", line.alias("line"))


def sections(
    files: DataFrame, budget: int, designs: DataFrame | None = None, rules: DataFrame | None = None, posts: DataFrame | None = None, signals: DataFrame | None = None, links: DataFrame | None = None, playbooks: DataFrame | None = None,
    rule_limit: int = 5, issue_limit: int = 3, playbook_limit: int = 5,
) -> DataFrame:
    """(path, section, content) of files (path); each table that is given makes its section.

    designs (source, content); rules (directory, title, priority), the broadest first, the most special `rule_limit`; posts (file,
    post, title, status, votes) but stale ones, by state and falling votes; signals (directory, body) of the file's own directory;
    links (source, target, link_type), imports before others, by source, without the file's design; playbooks (title, globs) by
    specificity; siblings are the files of the same directory. A section holds no more lines than the budget of tokens could
    show, so a file with very many links is no large row.
    """
    most = budget * 4
    f = files.select("path").distinct()
    folder = lambda c: F.when(F.col(c).contains("/"), F.regexp_replace(c, r"/[^/]*$", "")).otherwise(".")
    parts = []
    if designs is not None:
        parts.append(f.join(designs.groupBy(F.col("source").alias("path")).agg(F.min("content").alias("line")), "path").select("path", F.lit(DESIGN).alias("section"), F.lit(1).alias("pos"), "line"))
    if rules is not None:
        parts.append(_ranked(rules_for(f, rules, rule_limit), RULES, F.concat(F.lit("- "), "title"), "rank", most=most))
    if posts is not None:
        state = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
        p = f.join(posts.withColumnRenamed("file", "path").where("status <> 'stale'"), "path").withColumn("o", F.when(state == 0, 9).otherwise(state))
        parts.append(_ranked(p, ISSUES, F.concat(F.lit("- ["), "status", F.lit("] "), "title"), "o", F.desc("votes"), "post", most=issue_limit))
    if signals is not None:
        s = signals.groupBy("directory").agg(F.min("body").alias("line"))
        parts.append(f.withColumn("directory", folder("path")).join(s, "directory").select("path", F.lit(SIGNALS).alias("section"), F.lit(1).alias("pos"), "line"))
    if links is not None:
        label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("link_type")), F.col("link_type"))
        own = (F.col("link_type") == "design_source") & F.col("source").endswith(F.concat("path", F.lit(".md")))
        d = f.join(links.withColumnRenamed("target", "path"), "path").where(~own).withColumn("imports", F.col("link_type") == "ast_import")
        line = F.when(F.col("imports"), F.concat(F.lit("- "), "source")).otherwise(F.concat(F.lit("- [["), "source", F.lit("]] ("), label, F.lit(")")))
        parts.append(_ranked(d, LINKS, line, F.desc("imports"), "source", "link_type", most=most))
    if playbooks is not None:
        hit = by_trigger(f.withColumnRenamed("path", "file"), playbooks).withColumnRenamed("file", "path")
        parts.append(_ranked(hit, PLAYBOOKS, F.concat(F.lit("- "), "title"), F.desc("specificity"), "title", most=playbook_limit))
    near = f.withColumn("directory", folder("path"))
    # the first files of each directory, of which a file leaves itself out
    first = near.withColumn("n", F.row_number().over(W.partitionBy("directory").orderBy("path"))).where(F.col("n") <= most + 1).select("directory", F.col("path").alias("sibling"))
    parts.append(_ranked(near.join(first, "directory").where("sibling <> path"), SIBLINGS, F.concat(F.lit("- "), F.regexp_extract("sibling", "([^/]*)$", 1)), "sibling", most=most))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return out.where("line <> ''").groupBy("path", "section").agg(whole.alias("content")).where("content <> ''")


def within(rows: DataFrame, budget: int) -> DataFrame:
    """(path, section, content, truncated): sections of each path by importance until the budget of tokens, a quarter of the characters each.

    The first that does not fit is cut to what is left if that is more than LEAST tokens, and ends the list.
    """
    tokens = F.floor(F.length("content") / 4)
    before = F.coalesce(F.sum(tokens).over(W.partitionBy("path").orderBy("section").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = rows.withColumn("before", before).withColumn("left", F.lit(budget) - F.col("before"))
    fits = tokens <= F.col("left")
    # what comes after one that did not fit has more than the budget before it
    d = d.where(F.col("before") <= budget).where(fits | (F.col("left") > LEAST))
    cut = F.concat(F.substring("content", F.lit(1), (F.col("left") * 4).cast("int")), F.lit("\n... truncated due to token budget\n"))
    return d.select("path", "section", F.when(fits, F.col("content")).otherwise(cut).alias("content"), (~fits).alias("truncated"))


def stale_designs(files: DataFrame, designs: DataFrame) -> DataFrame:
    """(path, description, is_stale) of files (path, hash) with a design (source, title, source_hash): stale where the hash is another."""
    d = files.join(designs.groupBy(F.col("source").alias("path")).agg(F.min(F.struct("title", "source_hash")).alias("d")), "path")
    return d.select("path", F.col("d.title").alias("description"), (~F.col("hash").eqNullSafe(F.col("d.source_hash"))).alias("is_stale"))
