"""Full-text search: tokens, inverted lists, BM25, phrases, and the routes of unified search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Latin letters with marks and those without.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def words(x):
    return F.regexp_extract_all(F.translate(F.lower(x), _MARKED, _PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


def postings(docs: DataFrame, key: str, *columns: str, stem=None) -> DataFrame:
    """(key, term, pos) of the columns' words, all columns pooled; stem: a function of a Column."""
    w = words(F.concat_ws(" ", *columns))
    p = docs.select(key, F.posexplode(w).alias("pos", "term"))
    return p.withColumn("term", stem(F.col("term"))) if stem else p


def lengths(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, len): words of each document, counted in the scan."""
    return docs.select(key, F.size(words(F.concat_ws(" ", *columns))).cast("long").alias("len"))


def phrase_hits(posts: DataFrame, key: str, phrase: list[str]) -> DataFrame:
    """(key, tf): how often the words of phrase stand one after another."""
    hit = posts.where(F.col("term") == phrase[0]).select(key, "pos")
    for i, t in enumerate(phrase[1:], 1):
        hit = hit.join(posts.where(F.col("term") == t).select(key, (F.col("pos") - i).alias("pos")), [key, "pos"])
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("tf"))


def bm25(posts: DataFrame, docs: DataFrame, key: str, phrases: list[list[str]], match=None, limit: int = 20, columns: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """(key, rank): the limit best documents, best first (rank is negative), ties by key.

    phrases are lists of words that each count as one term. match is a condition on the columns h0, h1, ... (occurrences
    of each phrase); by default any of them has to occur. columns are those that the postings are made of.
    """
    size = lengths(docs, key, *columns)
    posts = posts.where(F.col("term").isin(sorted({t for p in phrases for t in p})))
    total = size.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg"))
    hits = None
    for i, p in enumerate(phrases):
        h = phrase_hits(posts, key, p).select(key, F.lit(i).alias("i"), "tf")
        hits = h if hits is None else hits.union(h)
    df = hits.groupBy("i").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    idf = F.when(F.col("n") - F.col("df") + 0.5 > F.col("df") + 0.5, idf).otherwise(F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    d = hits.join(F.broadcast(df), "i").join(size, key).crossJoin(F.broadcast(total))  # as many rows as phrases; one row
    counts = [F.sum(F.when(F.col("i") == i, F.col("tf")).otherwise(0)).alias(f"h{i}") for i in range(len(phrases))]
    d = d.groupBy(key).agg((-F.sum(part)).alias("rank"), *counts)
    return (d.where(match) if match is not None else d).select(key, "rank").orderBy("rank", key).limit(limit)


def compound(query: str) -> list[str]:
    import re

    q = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", query)
    return [t for t in re.split(r"[_\-./\s]+", q.lower()) if t]


def search_texts(docs: DataFrame, key: str, query: str, *columns: str, limit: int = 20) -> DataFrame:
    """A compound query matches as a phrase or by all of its words, all of which count in the rank; nothing matches no words."""
    t = compound(query)
    posts = postings(docs, key, *columns)
    if not t:
        return docs.select(key, F.lit(0.0).alias("rank")).limit(0)
    if t == [query.lower()]:
        return bm25(posts, docs, key, [t], limit=limit, columns=columns)
    every = F.lit(True)
    for i in range(1, len(t) + 1):
        every = every & (F.col(f"h{i}") > 0)
    return bm25(posts, docs, key, [t, *[[x] for x in t]], match=(F.col("h0") > 0) | every, limit=limit, columns=columns)


def scan(docs: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows in which a column holds query, A-Z folded or not; of a compound query also those that hold all of its words."""
    text = F.lower(F.concat_ws("\n", *columns))
    t = compound(query)
    hit = text.contains(query.lower())
    if t and t != [query.lower()]:
        every = F.lit(True)
        for x in t:
            every = every & text.contains(x)
        hit = hit | every
    return docs.where(hit)


def included(status: str | None = None, kind: str | None = None, deprecated: bool = False, stale: bool = False, default: str = "active") -> object:
    """Which hits show: those of the asked kind and status (none counts as default, or open for a post).

    Deprecated concepts and conventions stay hidden unless `deprecated`; stale posts unless `stale` or asked for by status.
    """
    s = F.coalesce(F.col("status"), F.when(F.col("kind") == "stack", "open").otherwise(default))
    shown = F.lit(True) if deprecated else ~((s == "deprecated") & F.col("kind").isin("concept", "convention"))
    if not stale and status != "stale":
        shown = shown & ~((s == "stale") & (F.col("kind") == "stack"))
    shown = shown if kind is None else shown & (F.col("kind") == kind)
    return shown if status is None else shown & (s == status)


def normalized(x):
    return tokens(x)


def route(query: str, tags: list[str] | None, indexed: bool) -> str:
    """Which plan answers a search: a code is looked up, tags go to the tag table, texts to the inverted lists, else rows are scanned."""
    import re

    if re.fullmatch(r"[A-Z]{2}-\d{3,}", query or ""):
        return "code"
    if tags:
        return "tags" if indexed else "scan"
    return "text" if indexed and compound(query or "") else "scan"


def suggestions(candidates: DataFrame, query: str, n: int = 3, cutoff: float = 0.6) -> DataFrame:
    """The n candidates (name) most like query by Ratcliff-Obershelp; the ratio bounds the lengths that are compared at all."""
    from ..functions.text_udf import similarity

    k = len(query)
    near = candidates.select("name").distinct().where((F.length("name") * (2 - cutoff) >= k * cutoff) & (k * (2 - cutoff) >= F.length("name") * cutoff))
    d = near.withColumn("ratio", similarity(F.lower("name"), F.lit(query.lower()))).where(F.col("ratio") >= cutoff)
    return d.orderBy(F.desc("ratio"), F.desc("name")).limit(n)
