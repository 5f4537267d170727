"""Embedding near-dedup: collisions of sorted one-dimensional projections, then exact cosine."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: Projections counted for a pair, the half width of their window in standard deviations, and the share of true pairs that may be missed at each test.
PROJECTIONS, WINDOW, MISS = 24, 1.5, 1e-6
#: Vectors of a block; queries counted at once.
BLOCK, QUERIES = 2048, 256


def least_count(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches but for a probability of miss: collisions are binomial."""
    p = 2 * NormalDist().cdf(window) - 1
    below, c = 0.0, 0
    while (below := below + math.comb(projections, c) * p**c * (1 - p) ** (projections - c)) <= miss:
        c += 1
    return c


def directions(dim: int, count: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((count, dim))


def collisions(points: np.ndarray, queries: np.ndarray, half: float) -> np.ndarray:
    """For each query and point the projections (rows) in which the point is in the window around the query, each projection sorted once."""
    count = np.zeros((queries.shape[1], points.shape[1]), np.int16)
    for x, q in zip(points, queries, strict=True):
        order = np.argsort(x, kind="stable")
        lo, hi = np.searchsorted(x[order], q - half), np.searchsorted(x[order], q + half, "right")
        edge = np.zeros((len(q), len(x) + 1), np.int8)
        np.add.at(edge, (np.arange(len(q)), lo), 1)
        np.add.at(edge, (np.arange(len(q)), hi), -1)
        count[:, order] += np.cumsum(edge[:, :-1], axis=1, dtype=np.int8)
    return count


def _compare(cosine: float):
    """applyInPandas body over two blocks: vec_id, n (links of other vectors), root (a forest of the links)."""
    half = WINDOW * math.sqrt(2 - 2 * cosine)
    least = least_count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, times, left = pdf["vec_id"].to_numpy(), pdf["times"].to_numpy(), pdf["left"].to_numpy()
        x = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        proj = directions(x.shape[1], PROJECTIONS) @ unit.T
        own = np.flatnonzero(left)
        other = own if left.all() else np.flatnonzero(~left)
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a in range(0, len(own), QUERIES):
            q = own[a : a + QUERIES]
            i, j = np.nonzero(collisions(proj[:, other], proj[:, q], half) >= least)
            i, j = q[i], other[j]
            i, j = (i[i < j], j[i < j]) if left.all() else (i, j)
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                hit = (unit[u] * unit[v]).sum(1) >= cosine
                u, v = u[hit], v[hit]
                np.add.at(n, u, times[v])
                np.add.at(n, v, times[u])
                while len(u):  # hook and jump until no link joins two roots
                    lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
                    u, v = u[lo < hi], v[lo < hi]
                    np.minimum.at(root, hi, lo)
                    while (root[root] != root).any():
                        root = root[root]
        k = n > 0
        small = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(small, root, ids)
        return pd.DataFrame({"vec_id": ids[k], "n": n[k], "root": small[root[k]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors of one label (not null) and one length are linked at a cosine of at least `cosine` in double precision. A pair
    is a candidate if its projections collide in the windows of enough directions; each test misses a pair at the
    threshold with probability MISS. A grid over the first two directions keeps far vectors from meeting; a full cell is
    cut into blocks and each pair of blocks is a task, so none holds over two blocks. Equal vectors are compared once.

    A vector that is null, empty, zero or has null or non-finite components, or no label, links with nothing. Rows that
    repeat a vec_id are vectors of their own whose links count together. A null vec_id: component null, kept true. An empty
    table gives an empty result; other columns are not read, whatever their names.
    """
    e = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    big = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (big > 0)
    # scaled by the largest component, so that squares neither overflow nor vanish
    good = e.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").where(fine).withColumn("embedding", F.transform("embedding", lambda x: x / big))
    key = ["label", "embedding"]
    reps = materialize(good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")), "vectors")
    width = NormalDist().inv_cdf(1 - MISS / 2) * math.sqrt(2 - 2 * cosine)

    @F.pandas_udf("x int, y int")
    def cell(v: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(v), 2), np.int32)
        size = v.map(len).to_numpy()
        for d in np.unique(size):
            x = np.stack(list(v[size == d])).astype(np.float64)
            p = directions(d, PROJECTIONS)[:2] @ (x / np.sqrt((x * x).sum(1))[:, None]).T
            out[size == d] = np.floor(p / width).T
        return pd.DataFrame(out, columns=["x", "y"])

    placed = reps.withColumn("dim", F.size("embedding")).withColumn("c", cell("embedding"))
    placed = placed.withColumn("cell", F.struct("c.x", "c.y")).drop("c")
    full = materialize(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cells")
    placed = placed.join(full, ["label", "dim", "cell"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # each cell against itself and four of its eight neighbours: as the left side here, as the right side there; a row goes to
    # as many blocks as the other cell has, and nowhere where that is empty
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))]))
    beside = lambda sign: F.struct((F.col("cell.x") + sign * F.col("o.i")).alias("x"), (F.col("cell.y") + sign * F.col("o.j")).alias("y"))
    there = full.select("label", "dim", F.col("cell").alias("there"), F.col("blocks").alias("others"))
    dealt = placed.withColumn("o", around)
    sides = []
    for left, sign in ((True, 1), (False, -1)):
        d = dealt.withColumn("there", beside(sign)).join(there, ["label", "dim", "there"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        d = d.where("o.i <> 0 OR o.j <> 0 OR " + ("other >= b" if left else "other < b"))
        b, other = F.col("b"), F.col("other")
        sides.append(d.select("label", "dim", F.col("cell" if left else "there").alias("cell"), "o", (b if left else other).alias("bl"), (other if left else b).alias("br"), "rep", "times", "embedding", F.lit(left).alias("left")))
    body = _compare(cosine)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["o"].map(lambda o: (o["i"], o["j"]) == (0, 0)).iloc[0] and pdf["bl"].iloc[0] == pdf["br"].iloc[0]
        if not same and (pdf["left"].all() or not pdf["left"].any()):
            return pd.DataFrame({"vec_id": [], "n": [], "root": []}, dtype="int64")
        return body(pdf.rename(columns={"rep": "vec_id"}))

    found = sides[0].unionByName(sides[1]).groupBy("label", "dim", "cell", "o", "bl", "br").applyInPandas(run, "vec_id long, n long, root long")
    found = materialize(found.withColumnRenamed("vec_id", "rep"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    member = good.join(reps, key).select("vec_id", "rep", "times")
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(member.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))).where("a <> b")
    links = member.join(counts, "rep", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    comp = connected_components(good.select(F.col("vec_id").alias("id")), edges).withColumnsRenamed({"id": "vec_id", "component": "c"})
    out = e.select("vec_id").join(links, "vec_id", "left").join(comp, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
