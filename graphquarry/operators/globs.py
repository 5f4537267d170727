"""Ignore-file patterns and globs against many paths: equality joins on what is literal in a pattern, expressions on the rest."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import ancestors

RULE = "negated boolean, kind string, literal string, expression string"
_WILD = re.compile(r"[*?\[\\]")


def _segment(s: str) -> str:
    """A segment's wildcards as a regular expression."""
    out, i = "", 0
    while i < len(s):
        c, end = s[i], s.find("]", i + 2) if s[i] == "[" else -1
        if c == "\\" and i + 1 < len(s):
            out, i = out + re.escape(s[i + 1]), i + 1
        elif end > 0:
            inner = s[i + 1 : end]
            out, i = out + "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return re.sub(r"(\[\^/\]\*)+", "[^/]*", out)


def glob_rule(pattern: str) -> tuple[bool, str, str, str] | None:
    """RULE of a line of an ignore file; None for blanks and comments.

    A pattern without a slash, but for one at its end, matches at any depth, others from the top; a match of a directory covers
    all below it; with a slash at the end only directories match. The literal part is a directory that paths lie below (dir;
    '.' for all), or how a segment of the path begins (pre) or ends (suf).
    """
    p = pattern.rstrip("\n")
    p = p if p.endswith("\\ ") else p.rstrip()
    if not p or p.startswith("#"):
        return None
    negated, p = p.startswith("!"), p.removeprefix("!")
    folder, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    while p.startswith("**/"):
        p = p[3:]
        anchored = "/" in p and not p.startswith("**/")
        if anchored:
            # below any directory, but several segments in a row
            parts = p.split("/")
            return negated, *_literal(next((s for s in parts if s != "**"), "")), "^(?:.*/)?" + _body(parts) + _end(parts, folder)
    if not p:
        return None
    parts = p.split("/")
    if not anchored:
        return (negated, "dir", ".", "^.+$") if p == "**" else (negated, *_literal(p), "^(?:.*/)?" + _segment(p) + _end(parts, folder))
    plain = []
    for s in parts:
        if _WILD.search(s):
            break
        plain.append(s)
    return negated, "dir", "/".join(plain) or ".", "^" + _body(parts) + _end(parts, folder)


def _body(parts: list[str]) -> str:
    out = ""
    for i, s in enumerate(parts):
        if s == "**":
            out += ".+" if i == len(parts) - 1 else "(?:.*/)?"
        else:
            out += _segment(s) + ("/" if i < len(parts) - 1 else "")
    return out


def _end(parts: list[str], folder: bool) -> str:
    return "$" if parts[-1] == "**" else "/.*$" if folder else "(?:/.*)?$"


def _literal(s: str) -> tuple[str, str]:
    """What a segment of any path must begin or end with: the longer of the two; a directory '.' where neither is literal."""
    m = _WILD.search(s)
    pre, suf = (s, "") if not m else (s[: m.start()], re.search(r"[^*?\[\]\\]*$", s)[0])
    return ("pre", pre) if pre and len(pre) >= len(suf) else ("suf", suf) if suf else ("dir", ".")


def glob_rules(patterns: DataFrame) -> DataFrame:
    """patterns' columns and RULE of its column `pattern`; blanks and comments go."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patterns.schema.fields) + f", {RULE}"

    def run(batches):
        for pdf in batches:
            got = [glob_rule(p) if p else None for p in pdf["pattern"]]
            out = pdf[[g is not None for g in got]].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame([g for g in got if g], columns=["negated", "kind", "literal", "expression"])], axis=1)

    return patterns.mapInPandas(run, schema)


def glob_hits(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """paths with each of rules (from glob_rules) that it matches, rules' columns beside.

    A path is looked up by the directories above it and by how its segments begin and end, in as many lengths as patterns
    have; a pattern's expression is tried on those paths alone. A pattern without anything literal is tried on all.
    """
    sizes = rules.where("kind <> 'dir'").select("kind", F.length("literal").alias("n")).distinct().collect()  # at most as many as a segment is long
    lengths = {k: sorted(r["n"] for r in sizes if r["kind"] == k) for k in ("pre", "suf")}
    segments = F.split(F.col(path), "/")
    keys: list[Column] = [F.transform(ancestors(F.col(path)), lambda d: F.struct(F.lit("dir").alias("kind"), d.alias("literal")))]
    for k, cut in (("pre", F.left), ("suf", F.right)):
        for n in lengths[k]:
            keys.append(F.transform(_long(segments, n), _struct(k, cut, n)))
    each = paths.withColumn("_k", F.explode(F.array_distinct(F.concat(*keys)))).withColumns({"_kind": F.col("_k.kind"), "_literal": F.col("_k.literal")}).drop("_k")
    # patterns are lines that people write; estimates would have the exploded paths broadcast instead
    hit = each.join(F.broadcast(rules), (F.col("_kind") == F.col("kind")) & (F.col("_literal") == F.col("literal"))).drop("_kind", "_literal")
    return hit.where(F.expr(f"`{path}` RLIKE expression")).distinct()


def _long(segments: Column, n: int) -> Column:
    return F.filter(segments, lambda s: F.length(s) >= n)


def _struct(kind: str, cut, n: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), cut(s, F.lit(n)).alias("literal"))


def ignore_lines(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """(layer, directory, pos, pattern) of the ignore files among files (path, text): a layer each, for what lies below its directory."""
    own = files.where((F.col("path") == name) | F.col("path").endswith(f"/{name}"))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".")
    return own.select(F.col("path").alias("layer"), directory.alias("directory"), F.posexplode(F.split("text", "\n")).alias("pos", "pattern"))


def layer(patterns: DataFrame, name: str) -> DataFrame:
    """(layer, directory, pos, pattern) of a list (pos, pattern) that holds everywhere, as the configured one."""
    return patterns.select(F.lit(name).alias("layer"), F.lit(".").alias("directory"), "pos", "pattern")


def ignored(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """(path) of paths that some layer of lines (layer, directory, pos, pattern) ignores; directories come with a slash at the end.

    Within a layer the last pattern that matches decides. Patterns of a layer match paths from the top, those below its
    directory alone.
    """
    rules = glob_rules(lines)
    hit = glob_hits(paths.select("path").distinct(), rules)
    hit = hit.where((F.col("directory") == ".") | F.col("path").startswith(F.concat("directory", F.lit("/"))))
    last = hit.groupBy("path", "layer").agg(F.max_by("negated", "pos").alias("negated"))
    return last.where("NOT negated").select("path").distinct()


def reachable(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """paths that a walk finds: not ignored, and below no directory that is, as a walk does not go down into those.

    Both joins are merged: what is left out may be as long as the paths, and paths shrink so well in a shuffle that its size
    would have them broadcast.
    """
    d = paths.select("path").distinct()
    up = d.select("path", F.explode(ancestors("path")).alias("above")).where("above <> '.' AND above <> path").withColumn("above", F.concat("above", F.lit("/")))
    closed = ignored(up.select(F.col("above").alias("path")).distinct(), lines).withColumnRenamed("path", "above")
    shut = up.join(closed.hint("merge"), "above", "left_semi").select("path").union(ignored(d, lines))
    return d.join(shut.distinct().hint("merge"), "path", "left_anti")
