"""Quality classifier: document evidence joined with posteriors of hosts and paths by hierarchical empirical Bayes."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality_rules import measure

BINS = 16


def _bin(n: str, d: str, scale: float) -> Column:
    return F.least(F.lit(BINS - 1), F.ceil(F.col(n) * scale / F.greatest(F.col(d), F.lit(1)))).cast("int")


def _features() -> dict[str, Column]:
    return {
        "size": F.least(F.lit(BINS - 1), F.floor(F.log2(F.col("n_words") + 1))).cast("int"),
        "long": _bin("word_chars", "n_words", 1.0),
        "symbols": _bin("n_symbols", "n_words", 20.0),
        "exclaims": _bin("n_exclaims", "n_words", 20.0),
        "lines": _bin("n_dup_lines", "n_lines", 10.0),
        "repeats": _bin("n_repeat_words", "n_words", 10.0),
        "stops": F.least(F.lit(BINS - 1), F.col("n_stop_words")).cast("int"),
    }


def _strength(level: DataFrame) -> tuple[float, float]:
    """(mean, strength) of the Beta prior of a level's rates, by moments over its groups (n, pos): two numbers come to the driver."""
    g = level.where("n > 0")
    r = g.agg(F.sum("pos").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (F.col("pos") / F.col("n")) * (F.col("pos") / F.col("n"))).alias("q")).first()
    if not r["n"]:
        return 0.5, 10.0
    n, k, mean = float(r["n"]), r["k"], (float(r["s"]) + 1) / (float(r["n"]) + 2)
    within = mean * (1 - mean)
    between = float(r["q"]) / n - (float(r["s"]) / n) ** 2 - within * k / n  # spread beyond that of counting
    return mean, min(1000.0, max(2.0, within / between - 1)) if between > 1e-9 else 1000.0


def site_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, doc_logit, host_rate, path_rate, score (0 to 1) and kept for every row of docs (doc_id, text, host, path).

    labels (doc_id, quality 0 or 1) teach a naive Bayes score of each document's measures. Hosts' shares of good labels are
    shrunk towards the global share, and paths' towards their host's, each by a strength that the spread of its level gives:
    a site with few labels stands close to its parent. score adds the path's log-odds to the document's evidence.

    A null host or path is a group of its own; so is one without labels, at its parent's rate. Null qualities are left out, of
    several labels of a document the lowest counts. A null or empty text has the evidence of such texts. Without labels
    every score is 0.5. Rows that repeat are scored alike. Only sums by group are shuffled, and hot groups are summed
    before they are.
    """
    m = measure(docs.select("doc_id", "text", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path")))
    feats = materialize(m.select("doc_id", "host", "path", *[v.alias(k) for k, v in _features().items()]), "features")
    names = list(_features())
    good = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    taught = materialize(feats.join(good, "doc_id"), "taught")
    pairs = F.array(F.struct(F.lit("all").alias("k"), F.lit(0).alias("v")), *[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in names])
    n = {(r["k"], r["v"], r["y"]): r["n"] for r in taught.select("y", F.explode(pairs).alias("x")).groupBy("x.k", "x.v", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(("all", 0, 1), 0), n.get(("all", 0, 0), 0)

    def weight(k: str) -> Column:
        return F.get(F.array(*[F.lit(log((n.get((k, v, 1), 0) + 0.5) / (pos + 0.5 * BINS)) - log((n.get((k, v, 0), 0) + 0.5) / (neg + 0.5 * BINS))) for v in range(BINS)]), F.col(k))

    paths = materialize(taught.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    mean, host_m = _strength(hosts)
    _, path_m = _strength(paths)
    host = hosts.select("host", ((F.col("pos") + host_m * mean) / (F.col("n") + host_m)).alias("host_rate"))
    path = paths.join(host.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "host_rate", ((F.col("pos") + path_m * F.col("host_rate")) / (F.col("n") + path_m)).alias("path_rate"))
    d = feats.withColumn("doc_logit", sum((weight(k) for k in names), F.lit(0.0)))
    d = d.join(host.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    p = path.select(F.col("host").alias("h"), F.col("path").alias("q"), "path_rate")
    d = d.join(p, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    rate = F.coalesce("path_rate", "host_rate", F.lit(mean))
    score = 1 / (1 + F.exp(-(F.col("doc_logit") + F.log(rate / (1 - rate)))))
    out = d.select("doc_id", "host", "path", "doc_logit", F.coalesce("host_rate", F.lit(mean)).alias("host_rate"), rate.alias("path_rate"), (F.lit(0.5) if not pos + neg else score).alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)
