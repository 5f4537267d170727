"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found through block-max inverted lists."""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_texts, materialize, text_slices

#: Bound of what is learned from: twice as many examples, those of smallest hash whatever their label.
EXAMPLES = 6000
#: Examples that are scored without themselves to calibrate votes; clusters of examples and common terms they are told apart by.
CALIBRATION, CLUSTERS, SIGNS = 1500, 8, 512
#: A term in one of so many examples of a cluster is common there: its weights stand in a table, those of the others in lists.
COMMON = 12
#: Neighbours, examples of a block, queries at once; weight that draws votes to the common share; least weight of a term.
NEAREST, BLOCK, QUERIES, PRIOR, SMALL = 15, 32, 256, 0.06, 0.01
#: More than twice what single precision can lose of a cosine.
MARGIN = np.float32(2e-4)
_FOLD = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def _folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD)


def words_of(text: str | None) -> list[bytes]:
    return _folded(text).split()


def terms_of_word(word: bytes) -> list[bytes]:
    """The word and, marked by a caret, its first four and five bytes: inflected forms share those."""
    n = len(word)
    return [word, b"^" + word[:4], b"^" + word[:5]] if n > 5 else [word, b"^" + word[:4]] if n > 4 else [word]


def terms_of(words: list[bytes]) -> Counter[bytes]:
    """How often the terms of words occur."""
    c: Counter[bytes] = Counter()
    for x, n in Counter(words).items():
        for t in terms_of_word(x):
            c[t] += n
    return c


def _numbers(terms, get) -> np.ndarray:
    """What get has for each of an Arrow column of terms; -1 where it has nothing."""
    return np.fromiter(map(get, terms.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, len(terms))


class Numbers:
    """Numbers of the terms of texts. Words and both kinds of beginnings are looked up apart, so no term is put together."""

    def __init__(self, number: dict[bytes, int]):
        begin = {n: {t[1:]: i for t, i in number.items() if len(t) == n + 1 and t[:1] == b"^"} for n in (4, 5)}
        self.word, self.four, self.five = number.get, begin[4].get, begin[5].get

    def counts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its numbered terms, ascending, and how often each occurs. Arrow cuts and numbers the words of all
        texts, so that each different word is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        folded = pa.array([_folded(t) for t in texts], pa.large_binary()).view(pa.large_string())
        words = pc.ascii_split_whitespace(folded)
        coded = words.values.dictionary_encode()
        known = coded.dictionary.view(pa.large_binary())
        size = pc.binary_length(known).to_numpy()
        # for each different word: its number and those of its beginnings, -1 for none
        at = np.full((3, len(known)), -1, np.int64)
        at[0] = _numbers(known, self.word)
        for side, n, get in ((1, 4, self.four), (2, 5, self.five)):
            begin = pc.binary_slice(known.filter(pa.array(size > n)), 0, n).dictionary_encode()
            at[side, size > n] = _numbers(begin.dictionary, get)[begin.indices.to_numpy()]
        at = at[:, coded.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts), dtype=np.int64) << 32, np.diff(words.offsets.to_numpy()))
        key, n = np.unique((at + text)[at >= 0], return_counts=True)
        cut = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << 32).tolist()
        key &= 0xFFFFFFFF
        return [(key[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def clusters(x: np.ndarray, k: int, steps: int = 6) -> np.ndarray:
    """The cluster of each row of unit vectors: spherical k-means from rows that are each farthest from those before."""
    seeds = [0]
    near = x @ x[0]
    for _ in range(k - 1):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centre = x[seeds]
    for _ in range(steps):
        own = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre)
    return (x @ centre.T).argmax(axis=1)


class Index:
    """Examples as TF-IDF vectors over all their terms, in clusters and those in blocks of BLOCK: a table for each cluster has
    its common terms with the largest weight of each in each block, inverted lists have the others. telling, if given, scales
    each term's weight."""

    def __init__(self, terms: list[bytes], df: np.ndarray, n: int, rows: Iterable[tuple[int, dict[int, int]]], label: np.ndarray, base: float, telling: np.ndarray | None = None):
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = np.log((1 + n) / (1 + df)) + 1
        plain = self.idf
        if telling is not None:
            self.idf = self.idf * telling
        self.numbers, self.tables = Numbers(self.number), None
        ids, ks, cs, norms = [], [], [], []
        for i, tf in rows:
            ids.append(i)
            ks.append(np.fromiter(tf.keys(), np.int32, len(tf)))
            cs.append(np.fromiter(tf.values(), np.int32, len(tf)))
            w = (1 + np.log(cs[-1])) * self.idf[ks[-1]]
            norms.append(math.sqrt(float(w @ w)))
        self.ids, self.label, self.base, self.norm = np.array(ids, np.int64), label, base, np.array(norms)
        self.start = np.cumsum([0] + [len(k) for k in ks])
        self.term, self.tf = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (ks, cs))
        self.scale = None
        self.cluster = np.zeros(len(ids), np.int32)
        if len(ids) > CLUSTERS * BLOCK:
            sign = np.full(len(self.idf), -1)
            top = np.argsort(-np.bincount(self.term, minlength=len(self.idf)), kind="stable")[:SIGNS]
            sign[top] = np.arange(len(top))
            x = np.zeros((len(ids), len(top)), np.float32)
            at = np.repeat(np.arange(len(ids)), np.diff(self.start))
            some = sign[self.term] >= 0
            x[at[some], sign[self.term[some]]] = (1 + np.log(self.tf[some])) * plain[self.term[some]]
            self.cluster = clusters(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6), CLUSTERS).astype(np.int32)

    def __getstate__(self):
        """What examples hold, deflated: every executor keeps a copy. Tables and lists are made where they are used."""
        lost = {"scale", "number", "numbers", "tables", "lists", "cuts", "log", "column", "example", "blocks", "term", "tf"}
        step = np.diff(self.term, prepend=np.int32(0)).astype("<i4")
        packed = [zlib.compress(x.tobytes(), 1) for x in (step.view(np.uint8).reshape(-1, 4).T, self.tf.astype("<i4").view(np.uint8).reshape(-1, 4).T)]
        terms = zlib.compress(b" ".join(self.number), 1)
        return {k: v for k, v in self.__dict__.items() if k not in lost} | {"packed": packed, "terms": terms}

    def __setstate__(self, d):
        step, tf = (np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<i4").ravel() for x in d.pop("packed"))
        terms = zlib.decompress(d.pop("terms"))
        self.number = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.__dict__.update(d)
        self.term, self.tf = np.cumsum(step, dtype=np.int32), tf.astype(np.min_scalar_type(tf.max(initial=0)))
        self.tables, self.numbers, self.scale = None, Numbers(self.number), None

    def _build(self) -> None:
        n, width = len(self.ids), len(self.idf)
        self.log = 1 + np.log(np.maximum(np.arange(int(self.tf.max(initial=0)) + 1), 1))
        at = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start))
        weight = np.zeros(len(at), np.float32)
        for a in range(0, len(at), 1 << 20):
            e = slice(a, a + (1 << 20))
            weight[e] = self.log[self.tf[e]] * self.idf[self.term[e]] / self.norm[at[e]]
        # a column for each example; clusters begin at whole blocks
        self.column, example, self.tables = np.zeros(n, np.int32), [], []
        listed = np.ones(len(at), bool)
        for c in range(int(self.cluster.max(initial=0)) + 1):
            # like lengths stand together: a short text's large weights would loosen the bounds of long ones in its block
            own = np.flatnonzero(self.cluster == c)
            own = own[np.argsort(self.norm[own], kind="stable")]
            if not len(own):
                continue
            first = len(example)
            self.column[own] = first + np.arange(len(own))
            example += own.tolist() + [-1] * (-len(own) % BLOCK)
            post = np.flatnonzero(self.cluster[at] == c).astype(np.int32)
            common = np.flatnonzero(np.bincount(self.term[post], minlength=width) * COMMON >= len(own))
            place = np.full(width, -1, np.int32)
            place[common] = np.arange(len(common))
            dense = post[place[self.term[post]] >= 0]
            listed[dense] = False
            table = np.zeros(((len(example) - first) // BLOCK, len(common), BLOCK), np.float32)
            column = self.column[at[dense]] - first
            table[column // BLOCK, place[self.term[dense]], column % BLOCK] = weight[dense]
            self.tables.append((first // BLOCK, common, table, np.ascontiguousarray(table.max(axis=2).T)))
        self.example, self.blocks = np.array(example, np.int64), len(example) // BLOCK
        rest = np.flatnonzero(listed).astype(np.int32)
        rest = rest[np.argsort(self.term[rest], kind="stable")]
        self.lists = self.column[at[rest]], weight[rest]
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(self.term[rest], minlength=width))))

    def _vector(self, k: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.idf[k]
        return k, w / math.sqrt(float(w @ w))

    def weigh(self, tf: dict[int, int]) -> dict[int, float]:
        k, w = self._vector(np.array(sorted(tf), np.int64), np.array([tf[t] for t in sorted(tf)]))
        return dict(zip(k.tolist(), w.tolist(), strict=True))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], nearest: int | None = None) -> list[list[tuple[float, int]]]:
        """For each query the exact NEAREST examples of positive cosine, by falling cosine and then place."""
        if not len(self.ids):
            return [[] for _ in queries]
        if self.tables is None:
            self._build()
        return [x for a in range(0, len(queries), QUERIES) for x in self._search(queries[a : a + QUERIES], nearest or NEAREST)]

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], nearest: int) -> list[list[tuple[float, int]]]:
        """Lists are summed first. What they give bounds the last nearest cosine from below, and a block is opened for the
        queries whose largest sum in it can reach that. Examples that single precision leaves in question are summed again.
        """
        m, wide = len(queries), self.blocks * BLOCK
        k, w = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        row = np.repeat(np.arange(m), [len(q[0]) for q in queries])
        s = np.empty((m, wide), np.float32)
        for x, (t, v) in enumerate(queries):
            start = self.cuts[t]
            size = self.cuts[t + 1] - start
            some = size > 0
            start, size, v = start[some], size[some], v[some].astype(np.float32)
            end = np.cumsum(size)
            post = np.arange(int(end[-1]) if len(end) else 0)
            post += np.repeat(start - end + size, size)
            s[x] = np.bincount(self.lists[0][post], np.repeat(v, size) * self.lists[1][post], wide)
        s = s.reshape(m, self.blocks, BLOCK)
        bound = s.max(axis=2)
        given = []
        for first, common, table, most in self.tables:
            at = np.searchsorted(common, k)
            hit = common[np.minimum(at, len(common) - 1)] == k if len(common) else np.zeros(len(k), bool)
            q = np.zeros((m, len(common)), np.float32)
            q[row[hit], at[hit]] = w[hit]
            given.append(q)
            bound[:, first : first + len(table)] += q @ most
        flat = s.reshape(m, wide)
        opened = np.zeros(bound.shape, bool)
        best = np.argsort(-bound, axis=1)[:, : max(1, self.blocks // 16, -(-nearest // BLOCK))]  # the best blocks of each query raise what others must reach
        np.put_along_axis(opened, best, True, axis=1)
        self._open(opened, given, s)
        # what the last nearest of those blocks has is a bound that examples of other blocks must reach
        near = np.take_along_axis(s, best[:, :, None], axis=1).reshape(m, -1)
        last = max(0, near.shape[1] - nearest)
        least = np.partition(near, last, axis=1)[:, last, None]
        self._open((bound >= least - MARGIN) & ~opened, given, s)
        rows, cols = np.nonzero((flat > 0) & (flat >= least - MARGIN) & (self.example >= 0))
        out, dense, cut = [], np.zeros(len(self.idf)), np.searchsorted(rows, np.arange(m + 1))
        for x, (k, w) in enumerate(queries):
            c = cols[cut[x] : cut[x + 1]]
            if len(c) > nearest:
                v = flat[x, c]
                c = c[v >= np.partition(v, len(v) - nearest)[len(v) - nearest] - MARGIN]
            if not len(c):
                out.append([])
                continue
            a = self.example[c]
            size = self.start[a + 1] - self.start[a]
            end = np.cumsum(size)
            post = np.arange(int(end[-1])) + np.repeat(self.start[a] - end + size, size)
            dense[k] = w * self.idf[k]
            v = np.add.reduceat(dense[self.term[post]] * self.log[self.tf[post]], end - size) / self.norm[a]
            dense[k] = 0
            out.append([(-v, a) for v, a in sorted(zip((-v.round(12)).tolist(), a.tolist(), strict=True))[:nearest]])
        return out

    def _open(self, wanted: np.ndarray, given: list[np.ndarray], s: np.ndarray) -> None:
        for q, (first, _, table, _) in zip(given, self.tables, strict=True):
            for b in np.flatnonzero(wanted[:, first : first + len(table)].any(axis=0)).tolist():
                x = np.flatnonzero(wanted[:, first + b])
                s[x, first + b] += q[x] @ table[b]

    def nearest(self, query: dict[int, float]) -> list[tuple[float, int]]:
        return self.search([(np.array(list(query), np.int64), np.array(list(query.values())))])[0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of toxic ones among the nearest, each weighing its cosine to the fourth, drawn toward their common share."""
        up = PRIOR * self.base + sum(c**4 * self.label[a] for c, a in near)
        return float(up / (PRIOR + sum(c**4 for c, _ in near)))

    def samples(self) -> np.ndarray:
        """Places of at most CALIBRATION examples."""
        return np.arange(0, len(self.ids), max(1, math.ceil(len(self.ids) / CALIBRATION)))

    def left_out(self, places: list[int]) -> list[float]:
        """The votes on the examples at these places, none of which votes for itself."""
        cut = [slice(self.start[a], self.start[a + 1]) for a in places]
        near = self.search([self._vector(self.term[e], self.tf[e]) for e in cut], NEAREST + 1)
        return [self.vote([n for n in found if n[1] != a][:NEAREST]) for a, found in zip(places, near, strict=True)]

    def calibrate(self, votes: list[float] | None = None) -> None:
        """Fits the logistic map of votes to probabilities on samples() whose own vote is left out; votes: theirs, if they are known."""
        some = self.samples()
        y = self.label[some]
        if not len(y) or not 0 < y.mean() < 1:
            return
        x = np.array([_logit(v) for v in (self.left_out(some.tolist()) if votes is None else votes)])
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        f, t = np.stack([x, np.ones(len(x))], axis=1), np.array([1.0, 0.0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(f @ t, -30, 30)))
            step = np.linalg.solve(f.T @ (f * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-6]), f.T @ (p - goal) + np.array([1e-3 * (t[0] - 1), 0]))
            t = t - step * min(1.0, 2.0 / max(2.0, float(np.abs(step).max())))
        if np.isfinite(t).all() and t[0] > 0:
            self.scale = float(t[0]), float(t[1])

    def score(self, texts: list[str | None], scale: tuple[float, float] | None = None) -> list[tuple[float, list[int]]]:
        """Calibrated votes of the nearest, and the ids of those."""
        scale = scale or self.scale
        tfs = self.numbers.counts(texts)
        near = iter(self.search([self._vector(*tf) for tf in tfs if len(tf[0])]))
        out = []
        for tf in tfs:
            found = next(near) if len(tf[0]) else []
            v = self.vote(found)
            if scale:
                v = 1 / (1 + math.exp(-(scale[0] * _logit(v) + scale[1])))
            out.append((v, [int(self.ids[a]) for _, a in found]))
        return out


def _logit(v: float) -> float:
    v = min(max(v, 1e-4), 1 - 1e-4)
    return math.log(v / (1 - v))


def _term_counts(docs: DataFrame, number: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many texts of docs each numbered term occurs, and how many texts there are. A task sends one row a term."""
    schema = T._parse_datatype_string("term int, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        total, seen, numbers = 0, np.zeros(len(number), np.int64), Numbers(number)
        for batch in batches:
            total += batch.num_rows
            for a, n in text_slices(batch.column("text")):
                found = numbers.counts(batch.column("text").slice(a, n).to_pylist())
                seen += np.bincount(np.concatenate([t for t, _ in found]), minlength=len(number))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], total))], schema=arrow)

    out = docs.select("text").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = out["term"].to_numpy(), out["n"].to_numpy()
    df = np.zeros(len(number))
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    """An index over at most twice EXAMPLES documents of docs (doc_id, text) with a label in labels (doc_id, toxic 0 or 1).

    Documents are taken by a hash of doc_id alone, so the sample is the same at every run and labels keep their shares at
    every size; null labels and ids are left out, and of several labels of a document the highest counts. Only the ids that
    were taken, at most twice EXAMPLES, are broadcast. All terms of the examples are indexed; document frequencies are counted
    over all docs. A term weighs the more the surer its shares of toxic and other examples differ: by the logarithm of
    their ratio (shrunk by one row at the common share) less its standard error; no term weighs nothing. Votes are calibrated
    on examples that do not vote for themselves. Without examples every score is 0.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * EXAMPLES)
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "examples").select("doc_id", "toxic", "text")
    schema = T._parse_datatype_string("term binary, toxic int")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, n in text_slices(batch.column("text")):
                part = batch.slice(a, n)
                found = [(t, y) for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True) for t in terms_of(words_of(text))]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())], schema=arrow)

    seen = texts.mapInArrow(run, schema).groupBy("term").agg(F.sum("toxic").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("df")).orderBy(F.desc("df"), "term").toArrow()
    terms = seen["term"].to_pylist()
    p, q = seen["p"].to_numpy(), seen["df"].to_numpy() - seen["p"].to_numpy()
    number = {t: i for i, t in enumerate(terms)}

    def body():
        def work(texts: list[str | None]):
            out = [terms_of(words_of(t)) for t in texts]
            out = [sorted((number[x], n) for x, n in c.items()) for c in out]
            return tuple([np.array([x[side] for x in c], "<i4").tobytes() for c in out] for side in (0, 1))

        return work

    vectors = map_texts(texts, body, "at binary, tf binary").orderBy("doc_id").toArrow()
    label = vectors["toxic"].to_numpy().astype(float)
    base = float(label.mean()) if len(label) else 0.0
    telling = np.ones(len(terms))
    if 0 < base < 1:
        ratio = (p + base) / (label.sum() + base) * (len(label) - label.sum() + 1 - base) / (q + 1 - base)
        error = np.sqrt(1 / (p + base) + 1 / (q + 1 - base))
        telling = np.maximum(np.abs(np.log(ratio)) - error, SMALL)
    some = np.array([len(x) > 0 for x in vectors["at"].to_pylist()], bool)
    vectors, label = vectors.filter(some), label[some]
    # one example at a time is a dictionary: all at once would not fit the driver
    rows_ = ((i.as_py(), dict(zip(np.frombuffer(k.as_py(), "<i4").tolist(), np.frombuffer(c.as_py(), "<i4").tolist(), strict=True))) for i, k, c in zip(vectors["doc_id"], vectors["at"], vectors["tf"], strict=True))
    df, n = _term_counts(docs, number)
    index = Index(terms, df, n, rows_, label, base, telling)
    if len(index.ids):
        index.calibrate(_left_out(docs.sparkSession, index))
    return index


def _left_out(spark: SparkSession, index: Index) -> list[float]:
    """Votes on index.samples(), made by tasks: a bounded number of rows comes back."""
    packed = pickle.dumps(index)
    key, some = (zlib.crc32(packed), len(packed)), index.samples().tolist()
    schema = T._parse_datatype_string("id long, vote double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_load(key, packed).left_out([some[i] for i in ids]))], schema=arrow)

    tasks = min(12, max(1, len(some) // QUERIES))
    return [r["vote"] for r in spark.range(0, len(some), 1, tasks).mapInArrow(run, schema).orderBy("id").collect()]


_LOADED: dict[tuple[int, int], Index] = {}


def _load(key: tuple[int, int], packed: bytes) -> Index:
    """The unpacked index, made once a Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = pickle.loads(packed)
    return _LOADED[key]


def score(docs: DataFrame, index: Index, threshold: float = 0.7) -> DataFrame:
    """docs' columns but text, then score (0 to 1), predicted (1 from threshold) and evidence (doc_ids of the examples that voted, nearest first).

    The index is bounded (EXAMPLES) and goes to the tasks with the code. A null or empty text, or one without a term of any
    example, has no evidence and the score of such a vote. Rows that repeat are scored alike, texts are read whole however
    long, other columns pass through but for those named like a result, which it replaces; an empty table gives none.
    """

    packed, scale = pickle.dumps(index), index.scale
    key = zlib.crc32(packed), len(packed)

    def body():
        own = _load(key, packed)

        def work(texts: list[str | None]):
            found = own.score(texts, scale)
            return [f[0] for f in found], [int(f[0] >= threshold) for f in found], [f[1] for f in found]

        return work

    return map_texts(docs, body, "score double, predicted int, evidence array<bigint>")
