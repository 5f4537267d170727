"""Close matches for many names at once: a similarity join by rare characters, and the likeness step of name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.norm import norm_concept, strip
from ..functions.text_udf import similarity

#: Letters from the commonest in English on; other characters count as rarer.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"


def _marks(name) -> Column:
    """The characters of a name, each with how often it occurred before, rarest first: equal sets of them mean equal multisets of characters."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    each = F.transform(chars, lambda c, i: F.struct(F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).alias("n"), c.alias("c")))
    order = lambda x: F.struct((-x["n"]).alias("n"), F.when(F.position(x["c"], F.lit(_COMMON)) > 0, -F.position(x["c"], F.lit(_COMMON))).otherwise(-99).alias("r"), x["c"].alias("c"))
    return F.transform(F.array_sort(F.transform(each, order)), lambda x: F.concat(x["c"], F.lit("#"), x["n"].cast("string")))


def _sided(names: DataFrame, cutoff: float) -> DataFrame:
    """(name, size, marks, head): head has as many marks that a name with enough in common has one of them too."""
    d = names.where("name IS NOT NULL AND name <> ''").select("name").distinct().withColumn("marks", _marks(F.col("name"))).withColumn("size", F.size("marks"))
    least = F.ceil(F.col("size") * (cutoff / (2 - cutoff)) - 1e-9)
    return d.withColumn("head", F.slice("marks", F.lit(1), (F.col("size") - least + 1).cast("int")))


def close_matches(names: DataFrame, candidates: DataFrame, n: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(name, candidate, ratio, rank): of each name (name) the n most like candidates (name) by Ratcliff-Obershelp, from cutoff on; ties go to the greater name.

    A ratio r needs r / 2 of both sizes' sum in common characters, whatever their order. So a pair that reaches cutoff shares
    one of its rarest characters (numbered by occurrence), the sizes are within a bound, and what comes after the first shared
    one suffices: pairs that meet all that are compared as multisets, and what is left by the ratio itself. Nothing else is
    left out. Names are compared as they come; null and empty ones have no match.
    """
    a, b = _sided(names, cutoff), _sided(candidates, cutoff)
    left = a.select(F.col("name").alias("a"), F.col("size").alias("la"), F.posexplode("head").alias("i", "mark"))
    right = b.select(F.col("name").alias("b"), F.col("size").alias("lb"), F.posexplode("head").alias("j", "mark"))
    enough = F.ceil((F.col("la") + F.col("lb")) * (cutoff / 2) - 1e-9)
    can = F.least(F.col("la"), F.col("lb"))
    met = left.join(right, "mark").where((can >= enough) & (F.least(F.col("la") - F.col("i"), F.col("lb") - F.col("j")) >= enough)).select("a", "b").distinct()
    both = met.join(a.select(F.col("name").alias("a"), F.col("marks").alias("ma")), "a").join(b.select(F.col("name").alias("b"), F.col("marks").alias("mb")), "b")
    both = both.where(F.size(F.array_intersect("ma", "mb")) >= F.ceil((F.size("ma") + F.size("mb")) * (cutoff / 2) - 1e-9))
    d = both.select(F.col("a").alias("name"), F.col("b").alias("candidate"), similarity(F.col("b"), F.col("a")).alias("ratio")).where(F.col("ratio") >= cutoff)
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("ratio"), F.desc("candidate"))))
    return d.where(F.col("rank") <= n)


def resolve_by_likeness(names: DataFrame, known: DataFrame, n: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(name, kind, target, suggestions) of names that nothing resolves exactly; known: (name, title, kind, path), a row for each title and alias.

    The likest known name decides: where a concept has it as title or alias, with spaces, hyphens and underscores left out, the
    name means that concept, else the playbook of that title. Otherwise it stays open, with up to n suggestions, likest first.
    """
    k = known.where("name IS NOT NULL").select("name", F.lower("name").alias("low"), "title", "kind", "path")
    asked = names.select("name", F.lower(strip("name")).alias("low")).distinct()
    near = close_matches(asked.select(F.col("low").alias("name")), k.select(F.col("low").alias("name")), n, cutoff)
    shown = k.groupBy("low").agg(F.max("name").alias("shown"))
    near = near.join(shown, near["candidate"] == shown["low"]).select(near["name"].alias("low"), "candidate", "shown", "rank")
    concept = k.where("kind = 'concept'").groupBy(norm_concept("name").alias("key")).agg(F.min("path").alias("concept"))
    play = k.where("kind = 'playbook' AND name = title").groupBy("low").agg(F.min("path").alias("playbook")).withColumnRenamed("low", "candidate")
    best = near.where("rank = 1").withColumn("key", norm_concept("candidate")).join(concept, "key", "left").join(play, "candidate", "left")
    best = best.select("low", F.coalesce("concept", "playbook").alias("target"), F.when(F.col("concept").isNotNull(), "concept").when(F.col("playbook").isNotNull(), "playbook").alias("kind"))
    most = near.groupBy("low").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]).alias("suggestions"))
    out = asked.join(best, "low", "left").join(most, "low", "left")
    return out.select("name", "kind", "target", F.when(F.col("target").isNull(), F.coalesce("suggestions", F.array().cast("array<string>"))).alias("suggestions"))
