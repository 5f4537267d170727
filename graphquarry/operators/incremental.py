"""Incremental maintenance, change levels, triage and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kind_of(path: str, top: str = ".kb"):
    """A path's kind by its folder below top; others are sources."""
    p = F.col(path)
    e = F.when(p.startswith(f"{top}/concepts/"), "concept")
    for d, k in (("conventions", "convention"), ("playbooks", "playbook"), ("stack", "stack"), ("designs", "design")):
        e = e.when(p.startswith(f"{top}/{d}/"), k)
    return e.otherwise("source")


def merge(base: DataFrame, changed: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """base without the keys that changed or went, and the changed rows."""
    gone = changed.select(key).distinct()
    if deleted is not None:
        gone = gone.union(deleted.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(changed)


def full_rebuild(changed: int, files: int, share: float = 0.3) -> bool:
    return files == 0 or changed > share * files


def change_level(df: DataFrame) -> DataFrame:
    """How much a source changed against its design, by the hashes stored in the design and those found now.

    now_design is null without a design, stored_source without stored metadata, now_interface for what is no code;
    updated_by names the design's last writer.
    """
    same = F.when(F.col("updated_by") == "skeleton-fallback", "skeleton_only").otherwise("unchanged")
    level = (
        F.when(F.col("now_design").isNull(), "new_file")
        .when(F.col("stored_source").isNull(), "agent_updated")
        .when(F.col("stored_source") == F.col("now_source"), same)
        .when(F.col("stored_design") != F.col("now_design"), "agent_updated")
        .when(F.col("now_interface").isNull(), "content_changed")
        .when(F.col("stored_interface").eqNullSafe(F.col("now_interface")), "content_only")
        .otherwise("interface_changed")
    )
    return df.withColumn("level", level)


def renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new): files that went and one that came with the same content; the first new path counts for each hash."""
    n = new.groupBy("hash").agg(F.min("path").alias("new"))
    return gone.select(F.col("path").alias("old"), "hash").join(n, "hash").select("old", "new")


def triage(designs: DataFrame, deps: DataFrame) -> DataFrame:
    """Designs (path, source_stale, interface_stale) by priority: 100 for a stale interface, 50 for a stale source, 5 for each dependent."""
    n = deps.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("interface_stale").cast("int") * 100 + F.col("source_stale").cast("int") * 50 + 5 * F.coalesce("n", F.lit(0))
    return designs.join(n, "path", "left").select("path", p.cast("long").alias("priority")).orderBy(F.desc("priority"), "path")


def fingerprints(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with the hash of their normalised columns, of equal hashes the first key; the others count."""
    norm = F.regexp_replace(F.lower(F.concat_ws("\u001f", *columns)), r"\s+", " ")
    k = df.withColumn("fingerprint", F.sha2(norm, 256))
    return k.groupBy("fingerprint").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))


def directory_hash(files: DataFrame) -> DataFrame:
    """Of each directory the hash of its sorted names, a line each."""
    return files.groupBy("directory").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "\n"), 256).alias("hash"))


def language_mix(files: DataFrame, top: int = 3) -> DataFrame:
    c = files.where("language IS NOT NULL").groupBy("directory", "language").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("directory").orderBy(F.desc("n"), "language"))).where(F.col("rank") <= top)


def expired_signals(signals: DataFrame, now, ttl_hours: float = 72) -> DataFrame:
    """Signals whose directory is gone (orphan), or of more than ttl_hours; one of no readable time is expired."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("created").cast("timestamp"))) / 3.6e9
    why = F.when(~F.col("dir_exists"), "orphan").when(F.col("created").isNull() | (age > ttl_hours), "expired")
    return signals.withColumn("why", why).where("why IS NOT NULL")


#: Verbs that may open a description, and one small word after them.
_LEADING_VERB = (
    r"(?i)^(?:Acts?\s+as|Defines?|Reads?|Wraps?|[A-Z][a-zA-Z]+(?:izes?|ates?|ures?|ides?|dles?|oses?|ages?|ers?\b|ains\b|ites\b|ilds\b|ments\b))"
    r"(?:\s+(?:a|an|the|and|or|is|its|all|this|that|any))?\s+"
)
#: What ends a fragment, words cut from its end, words that count for nothing.
_CLAUSES = (" that ", " so ", " which ", " without ", " keeping ", " used by ", " used to ")
_TRAILING = "a an the to by for of and or how that with from is its as in on at so but because when where which while if".split()
_STOP = (
    "the a an for in of to as by and or is are was were be been with from on at it its this that "
    "small stable simple single centralized lightweight reusable focused strict tolerant function utility helper module package file"
).split()


def fragment(x) -> Column:
    """A description without its opening verb, up to the first kind of clause that starts after ten characters, and without small words at its end."""
    body = F.regexp_replace(x, _LEADING_VERB, "")
    end = F.lit(None).cast("int")
    for c in reversed(_CLAUSES):
        at = F.locate(c, body) - 1
        end = F.when(at >= 10, at).otherwise(end)
    words = F.filter(F.split(F.when(end.isNotNull(), F.substring(body, F.lit(1), end)).otherwise(body), r"\s+"), lambda w: w != "")
    small = F.transform(words, lambda w: F.lower(w).isin(_TRAILING))
    keep = F.aggregate(F.transform(small, lambda b, i: F.when(b, F.lit(0)).otherwise(i + 1)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.array_join(F.slice(words, F.lit(1), keep), " ")


def billboards(entries: DataFrame, top: int = 3) -> DataFrame:
    """(directory, billboard) of entries (directory, pos, description): the fragments of all clauses joined by "; ", if more than `top`
    those whose words occur most among all, none of which shares over half of its words with a better one.

    Words are counted by grouped sums, and `top` picks pass over a directory's ranked fragments; a group is one directory
    of a repository.
    """
    part = entries.select("directory", "pos", F.posexplode(F.split("description", ";")).alias("clause", "d")).where(F.trim("d") != "")
    part = part.select("directory", F.struct("pos", "clause").alias("at"), fragment(F.trim("d")).alias("text"))
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0), F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(_STOP)))
    part = part.withColumn("words", words)
    each = part.select("directory", "at", F.explode("words").alias("w"))
    freq = each.groupBy("directory", "w").agg(F.count(F.lit(1)).alias("n"))
    score = each.join(freq, ["directory", "w"]).groupBy("directory", "at").agg(F.sum("n").alias("score"))
    part = part.join(score, ["directory", "at"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "at", "text", "words")))
    plain = F.array_sort(F.collect_list(F.struct("at", "text")))
    g = part.groupBy("directory").agg(F.count(F.lit(1)).alias("n"), ranked.alias("ranked"), plain.alias("plain"))

    def step(kept, x):
        near = F.exists(kept, lambda k: (F.size(k["words"]) > 0) & (F.size(F.array_intersect(k["words"], x["words"])) * 2 > F.size(x["words"])))
        return F.when((F.size(kept) >= top) | ((F.size(x["words"]) > 0) & near), kept).otherwise(F.concat(kept, F.array(x)))

    picked = F.aggregate("ranked", F.filter("ranked", lambda x: F.lit(False)), step)
    chosen = F.when(F.col("n") <= top, F.transform("plain", lambda x: x["text"])).otherwise(F.transform(picked, lambda x: x["text"]))
    return g.select("directory", F.array_join(chosen, "; ").alias("billboard"))


def topology(files: DataFrame) -> DataFrame:
    """(directory, extension, files): of each directory its commonest extension (ties by name) and how many files it has."""
    f = files.withColumn("extension", F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1)))
    c = f.groupBy("directory", "extension").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("extension", F.struct((-F.col("n")).alias("neg"), "extension"))
    return c.groupBy("directory").agg(best.alias("extension"), F.sum("n").alias("files"))
