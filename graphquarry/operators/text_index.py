"""A stored inverted index: postings by term in blocks with bounds, from which searches read their own terms only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import Snapshot
from .text import K1, LEAST_IDF, B, compound, words

#: Documents of a block, about.
BLOCK = 128
#: Classes of frequency, powers of 2; the last has no end.
LEVELS = 6
#: Blocks of one bucket that a task makes, about.
PART = 512


def _part(tf, length, avg) -> Column:
    """What tf occurrences in a document of that length are worth, before the term's weight."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / avg))


def _idf(n, df) -> Column:
    up, down = F.lit(n) - df + 0.5, df + F.lit(0.5)
    return F.when(up > down, F.greatest(F.log(up / down), F.lit(LEAST_IDF))).otherwise(F.lit(LEAST_IDF))


def _grouped(w: DataFrame) -> DataFrame:
    """(doc, len, term, pos: array) of rows (doc, w: array of words): a row's words are sorted and cut where the next begins, without a shuffle."""
    d = w.select("doc", F.size("w").alias("len"), F.array_sort(F.transform("w", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))).alias("s")).where("len > 0")
    d = d.withColumn("at", F.expr("filter(sequence(0, len - 1), i -> i = 0 OR s[i].term <> s[i - 1].term)"))
    run = F.expr("transform(at, (a, k) -> named_struct('term', s[a].term, 'pos', transform(slice(s, a + 1, coalesce(get(at, k + 1), len) - a), x -> x.pos)))")
    return d.select("doc", "len", F.inline(run))


class TextIndex:
    """Postings of documents' words in a Snapshot bucketed by term.

    A block is a row: some documents of one term and one class of frequency, dealt by a hash of the document, with what bounds
    their scores whatever the average length is: the largest frequency and the smallest length. A term in a third of all
    documents has that many blocks, not one row. Lengths stand with the postings, so a search joins no table of documents.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "long", buckets: int = 256):
        self.spark, self.key = spark, key
        posting = f"array<struct<doc:{kind},tf:int,len:int,pos:array<int>>>"
        tables = {"postings": ("term", f"term string, level int, block long, n int, most int, shortest int, docs {posting}"), "size": ("one", "one int, n long, total long")}
        self.store = Snapshot(spark, folder, tables, buckets, order={"postings": ["term", "level", "block"]})

    def build(self, docs: DataFrame, *columns: str) -> int:
        """Index the columns' words, all pooled; one pass over the texts. A document is a row; rows of one key are one document of their words."""
        w = docs.select(F.col(self.key).alias("doc"), words(F.concat_ws(" ", *columns)).alias("w"))
        size = w.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).cast("long").alias("total"))
        have = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(self.key).alias("keys")).first()
        blocks = max(1, -(-have["rows"] // BLOCK))
        if have["rows"] == have["keys"]:
            each = _grouped(w)
        else:
            each = w.select("doc", F.size("w").alias("len"), F.posexplode("w").alias("pos", "term")).groupBy("doc", "term").agg(F.first("len").alias("len"), F.array_sort(F.collect_list("pos")).alias("pos"))
        each = each.withColumn("tf", F.size("pos")).withColumn("level", F.least(F.floor(F.log2("tf")).cast("int"), F.lit(LEVELS - 1)))
        each = each.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)))
        # postings go once to where their block is made, sorted and written: a bucket's share of PART blocks
        dealt = each.withColumns({"bucket": self.store.bucket("term"), "part": F.floor(F.col("block") / PART)}).repartition("bucket", "part")
        block = dealt.groupBy("bucket", "part", "term", "level", "block").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most"), F.min("len").alias("shortest"), F.array_sort(F.collect_list(F.struct("doc", "tf", "len", "pos"))).alias("docs")).drop("part")
        return self.store.commit(self.store.newest(), {"postings": (block, None), "size": (size, None)})

    def _heads(self, terms: list[str]) -> DataFrame:
        """Blocks of the terms, read from their buckets; what a search does not select of them is not read either."""
        names = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return self.store.read("postings", self.store.newest(), self.store.buckets_of(names, "term")).where(F.col("term").isin(terms))

    def _size(self) -> tuple[int, float]:
        r = self.store.read("size", self.store.newest()).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        return r["n"] or 0, (r["total"] or 0) / (r["n"] or 1)

    def best(self, term: str, limit: int = 20) -> DataFrame:
        """(key, rank): the limit best documents of one term, best first (rank is negative), ties by key.

        The `limit` blocks of the highest bounds hold as many documents at least; the worst of the best `limit` of those is a
        score that no document of a block bounded below it reaches, so such blocks' documents are not read.
        """
        n, avg = self._size()
        heads = self._heads([term])
        df = F.lit(heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        bound = _part("most", "shortest", avg)
        top = heads.select("level", "block", bound.alias("bound")).orderBy(F.desc("bound"), "level", "block").limit(limit)
        rank = (-_idf(n, df) * _part("tf", "len", avg)).alias("rank")
        scored = lambda h: h.select(F.inline("docs")).select(F.col("doc").alias(self.key), "tf", "len").select(self.key, rank)
        first = scored(heads.join(F.broadcast(top.select("level", "block")), ["level", "block"], "left_semi")).orderBy("rank").limit(limit)  # at most `limit` rows
        worst = first.agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank")).first()
        if worst["n"] >= limit:
            # a bound and a score that are equal may differ by rounding
            held = -_idf(n, df) * bound <= worst["rank"] * (1 - 1e-12)
            levels = [r["level"] for r in heads.where(held).select("level").distinct().collect()]
            heads = heads.where(F.col("level").isin(levels)).where(held)
        return scored(heads).orderBy("rank", self.key).limit(limit)

    def _phrase(self, phrase: list[str]) -> DataFrame:
        """(doc, tf, len): how often the words of phrase stand one after another."""
        hit = None
        for i, t in enumerate(phrase):
            d = self._heads([t]).select(F.inline("docs")).select("doc", "len", F.expr(f"transform(pos, p -> p - {i})").alias(f"p{i}"))
            hit = d if hit is None else hit.join(d.drop("len"), "doc")
        for i in range(1, len(phrase)):
            hit = hit.withColumn("p0", F.array_intersect("p0", f"p{i}"))
        return hit.select("doc", F.size("p0").alias("tf"), "len").where("tf > 0")

    def bm25(self, phrases: list[list[str]], match=None, limit: int = 20) -> DataFrame:
        """As text.bm25: (key, rank) of the best documents; match is a condition on h0, h1, ... (occurrences of each phrase)."""
        if match is None and len(phrases) == 1 and len(phrases[0]) == 1:
            return self.best(phrases[0][0], limit)
        n, avg = self._size()
        hits = None
        for i, p in enumerate(phrases):
            h = self._phrase(p) if len(p) > 1 else self._heads(p).select(F.inline("docs")).select("doc", "tf", "len")
            h = h.select("doc", F.lit(i).alias("i"), "tf", "len")
            hits = h if hits is None else hits.union(h)
        df = hits.groupBy("i").agg(F.count(F.lit(1)).alias("df"))
        d = hits.join(F.broadcast(df), "i")  # as many rows as phrases
        counts = [F.sum(F.when(F.col("i") == i, F.col("tf")).otherwise(0)).alias(f"h{i}") for i in range(len(phrases))]
        d = d.groupBy(F.col("doc").alias(self.key)).agg((-F.sum(_idf(n, F.col("df")) * _part("tf", "len", avg))).alias("rank"), *counts)
        return (d.where(match) if match is not None else d).select(self.key, "rank").orderBy("rank", self.key).limit(limit)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """As text.search_texts: a compound query matches as a phrase or by all of its words, all of which count in the rank."""
        t = compound(query)
        if not t:
            return self.best("", limit)
        if t == [query.lower()]:
            return self.bm25([t], limit=limit)
        every = F.lit(True)
        for i in range(1, len(t) + 1):
            every = every & (F.col(f"h{i}") > 0)
        return self.bm25([t, *[[x] for x in t]], match=(F.col("h0") > 0) | every, limit=limit)
