"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, grouping by links."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_texts, materialize, mix64, prefix_hash, range_hash

#: Rows a band and bands. A pair at 0.8 is missed with probability (1 - 0.8**5)**26, about 3e-5.
ROWS, BANDS = 5, 26
#: A pair left to direct comparison must agree in this much less than the wanted share of registers (5.7 standard deviations: one
#: pair in 10**8 at the threshold is missed, against 3 in 10**5 that share no band).
SLACK = 0.2
#: Bounds of a block of nodes that are compared directly.
BLOCK_NODES, BLOCK_SHINGLES = 512, 4 << 20
_BLOCK = 1 << 18  # shingles that a pass holds at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; the whole sequence where there are fewer words; empty without words."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    gap = np.empty(len(buf) + 2, bool)
    gap[0] = gap[-1] = True
    np.take(_SPACE, buf, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    w = range_hash(prefix_hash(buf), start, end) if len(start) else np.zeros(0, np.uint64)
    at = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in raw)]))

    def windows(k: int, w: np.ndarray) -> np.ndarray:
        h = np.zeros(max(0, len(w) - k + 1), np.uint64)
        for i in range(k if len(h) else 0):
            h = mix64(h * np.uint64(0x9FB21C651E98DF25) + w[i : i + len(h)])
        return h

    h = windows(k, w)
    return [_distinct(h[a : b - k + 1] if b - a >= k else windows(b - a, w[a:b]) if b > a else w[:0]) for a, b in zip(at[:-1], at[1:], strict=True)]


def super_minhash(values: np.ndarray, owner: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (docs, m) as float64 of element hashes `values` owned by row numbers `owner` (ascending).

    Each element has its own pseudo-random permutation of the m registers: at rank j it offers j plus a uniform number to
    the register its permutation names there. Ranks are taken in turn over all elements at once, so registers below
    j + 1 are final after rank j; a document leaves as soon as all of its registers are (early stopping).
    """
    sig = np.full(docs * m, np.inf)
    at, own, state = 0, owner.astype(np.int64), values.copy()
    perm = rows = np.arange(len(values))
    while len(rows) and at < m:
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        r = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        k = at + ((state >> np.uint64(32)) * np.uint64(m - at) >> np.uint64(32)).astype(np.int64)
        if at:
            slot = perm[rows, k]
            perm[rows, k] = perm[rows, at]
        else:
            slot = k  # no rank has moved yet
        np.minimum.at(sig, own * m + slot, r + at)
        at += 1
        live = (sig.reshape(docs, m) >= at).any(1)[own]
        if at == 1:
            own, state, k = own[live], state[live], k[live]
            rows = np.arange(len(own))
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(own), 1))
            perm[rows, k] = 0
        elif not live.all():
            rows, own, state = rows[live], own[live], state[live]
    return sig.reshape(docs, m)


def _signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Rows of sets without elements stay infinite; a set over _BLOCK is folded in parts (a minimum of minima)."""
    out = np.full((len(sets), m), np.inf)
    batch: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal batch, size
        if batch:
            own = np.repeat(np.arange(len(batch)), [len(x) for _, x in batch])
            sig = super_minhash(np.concatenate([x for _, x in batch]), own, len(batch), m)
            for (i, _), row in zip(batch, sig, strict=True):
                np.minimum(out[i], row, out=out[i])
        batch, size = [], 0

    for i, s in enumerate(sets):
        for a in range(0, len(s), _BLOCK):
            part = s[a : a + _BLOCK]
            if size + len(part) > _BLOCK:
                flush()
            batch.append((i, part))
            size += len(part)
    flush()
    return out


def _band_hashes(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    bits = mix64(sig.view(np.uint64)).reshape(len(sig), bands, rows)
    h = np.zeros(bits.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + bits[:, :, j])
    return h


def _bytes_of(sig: np.ndarray) -> np.ndarray:
    """A byte of each register, eight to a long."""
    low = (mix64(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
    pad = -low.shape[1] % 8
    return np.ascontiguousarray(np.pad(low, ((0, 0), (0, pad)))).view(np.int64)


def _block_links(percent: int, least: int):
    """applyInPandas body over two blocks of a cluster: the links between different parts, as a forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        root, node = pdf["part"].to_numpy().copy(), pdf["node"].to_numpy()
        n, sets = pdf["n_shingles"].to_numpy(), [np.asarray(x).view(np.uint64) for x in pdf["s"]]
        bands = np.stack([np.asarray(x, np.int64) for x in pdf["bands"]])
        sketch = np.stack([np.asarray(x, np.int64) for x in pdf["sketch"]]).view(np.uint8)
        out = []
        for i in range(len(pdf) - 1):
            j = np.arange(i + 1, len(pdf))
            j = j[(root[j] != root[i]) & (n[j] * 100 >= n[i] * percent) & (n[i] * 100 >= n[j] * percent)]
            j = j[(bands[j] == bands[i]).any(1)]
            agree = (sketch[j] == sketch[i]).sum(1)
            for x in j[np.argsort(-agree, kind="stable")][: (agree >= least).sum()]:
                if root[x] != root[i]:
                    common = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                    if 100 * common >= percent * (n[i] + n[x] - common):
                        out.append((node[i], node[x]))
                        root[root == root[x]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _rest(m: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Links between nodes (node, part, leader) of buckets whose leader left several parts.

    Nodes whose buckets touch form a cluster; a cluster is cut into blocks of a bounded number of nodes and shingles, and
    each pair of blocks is one task. Only pairs of different parts that share a band are compared, and a task returns a
    forest of the links that it confirmed, so its output is at most one row a node.
    """
    ids = m.select(F.col("node").alias("id")).distinct()
    g = connected_components(ids, m.select(F.col("node").alias("a"), F.col("leader").alias("b"))).withColumnsRenamed({"id": "node", "component": "g"})
    w = m.select("node", "part", "n_shingles").distinct().join(g, "node")
    cut = w.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sketches = nodes.select(F.col("doc_id").alias("node"), "bands", "sketch")
    w = w.join(cut, "g").join(sketches, "node").join(sets.withColumnRenamed("doc_id", "node"), "node")
    w = w.withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")]
    return w.groupBy(*key).applyInPandas(lambda pdf: _block_links(percent, least)(pdf), "a long, b long")


def _sketch(k: int, rows: int, bands: int):
    def work(texts: list[str | None]):
        sets = shingle_sets(texts, k)
        sig = _signatures(sets, rows * bands)
        b = _band_hashes(sig, rows, bands).view(np.int64)
        digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
        return [len(s) for s in sets], digest[:, 0], digest[:, 1], [x if len(s) else None for x, s in zip(b, sets, strict=True)], [*_bytes_of(sig)]

    return work


def _sets(k: int):
    return lambda texts: ([s.view(np.int64) for s in shingle_sets(texts, k)],)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.where(F.size("sa") * 100 >= F.size("sb") * percent).where(F.size("sb") * 100 >= F.size("sa") * percent)
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return common.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents (doc_id, text) are linked when the Jaccard similarity of their distinct k-word shingles (A-Z lower-cased,
    words apart by ASCII white space) is at least percent / 100. Documents with equal sets become one node; nodes that
    share a band meet in its bucket. Each bucket first compares all of its nodes with one leader, not with each other:
    a group of copies costs a row a node. What is then still apart in a bucket is compared directly, behind a filter on
    the sketches, so no link between different texts that share a band is lost. Every link is confirmed on full sets: equal
    sets by a cryptographic digest of the whole sorted set, others by their intersection.

    Null or empty texts: no shingles, linked with nothing. A null doc_id: component null, kept true. Rows that repeat a
    doc_id are one node with the links of all of them. An empty table gives an empty result. Texts are read whole: a very
    long one is sketched in parts. Other columns of docs are not read, whatever their names.
    """
    texts = docs.select("doc_id", "text")
    a = materialize(map_texts(texts, lambda: _sketch(k, rows, bands), "n_shingles long, h1 long, h2 long, bands array<bigint>, sketch array<bigint>"), "sketch")
    full = a.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    copies = materialize(full.select("doc_id", "n_shingles", "h1", "h2").join(reps, ["n_shingles", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "n_shingles", "h1", "h2").where("a <> b").distinct(), "copies")
    # a row goes for its own set only: another text of the same doc_id stays
    nodes = full.join(copies.select(F.col("a").alias("doc_id"), "n_shingles", "h1", "h2"), ["doc_id", "n_shingles", "h1", "h2"], "left_anti")
    rows_ = nodes.select(F.col("doc_id").alias("node"), "n_shingles", F.explode("bands").alias("band"))
    shared = rows_.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    member = rows_.join(shared, "band")
    # the node that meets most others leads: of a group made from one text, that text
    weight = member.groupBy("node").agg(F.sum("c").alias("weight"))
    member = materialize(member.drop("c").join(weight, "node"), "buckets")

    lead = member.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("neg"))).alias("top")).select("band", (-F.col("top.neg")).alias("leader"))
    star = materialize(member.join(lead, "band").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    # full sets of the documents that meet another: the one pass that deals out texts, by a merge join at every size
    ids = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    sets = materialize(map_texts(texts.join(ids.hint("merge"), "doc_id", "left_semi"), lambda: _sets(k), "s array<bigint>"), "sets")
    links = materialize(_linked(star, sets, percent), "links")
    part = connected_components(member.select(F.col("node").alias("id")), links).withColumnsRenamed({"id": "node", "component": "part"})
    m = member.join(part, "node")
    apart = m.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").join(lead, "band")
    m = materialize(m.join(apart.select("band", "leader"), "band").select("node", "part", "leader", "n_shingles").distinct(), "apart")
    more = _rest(m, nodes, sets, percent, int(rows * bands * (percent / 100 - SLACK)))
    edges = copies.select("a", "b").unionByName(links).unionByName(more)
    comp = connected_components(full.select(F.col("doc_id").alias("id")), edges)
    out = a.select("doc_id", "n_shingles").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
