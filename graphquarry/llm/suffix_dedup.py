"""Suffix-array dedup: bytes covered by long strings that start earlier, by a logarithmic family of suffix arrays.

A string of `least` bytes is found through its anchor, the smallest 32-byte hash in it. Neighbouring strings with one
anchor form a segment. Two strings can only be equal if their anchors are, so segments whose anchor is nowhere else drop
out, and of segments with equal anchor and bytes the first stands for all. What is left goes, in document order, to index
families, each of which has whole anchors; their suffix arrays find the strings that an earlier segment has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, mix64, prefix_hash, range_hash, text_slices, tidy, window_hash

#: Bytes of an anchor; bytes scanned at once (below 2**24); bytes of an index batch; suffixes of a family, about; suffixes compared at once.
ANCHOR, PIECE, BATCH, FAMILY, STEP = 32, 512 << 10, 1 << 20, 2_000_000, 1 << 16
#: Different segments from which an anchor is hot: its strings are dealt out by content, so that it loads no single task.
HOT = 50_000
#: Texts of a task whose copies are left out of the count, those met last; a copy of an earlier text is settled as a whole.
REMEMBERED = 1 << 15


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    y = np.concatenate((x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def segments(raw: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(text number, first string, strings, anchor hash, segment hash) of all segments of the texts in raw."""
    out: list[tuple[np.ndarray, ...]] = []
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal part, size
        if not part:
            return
        pre = prefix_hash(np.frombuffer(b"".join(x for _, _, x in part), np.uint8))
        g = window_hash(pre, ANCHOR)
        low = np.uint64((1 << 24) - 1)
        at = (_slide_min((g & ~low) | np.arange(len(g), dtype=np.uint64), least - ANCHOR + 1) & low).astype(np.int64)
        begin = np.cumsum([0, *(len(x) for _, _, x in part)])
        owner = np.repeat(np.arange(len(part)), np.diff(begin))[: len(at)]
        p = np.flatnonzero(np.arange(len(at)) + least <= begin[owner + 1])
        cut = np.flatnonzero(np.concatenate(([True], (at[p][1:] != at[p][:-1]) | (owner[p][1:] != owner[p][:-1]))))
        lo, own = p[cut], owner[p[cut]]
        hi = p[np.concatenate((cut[1:], [len(p)])) - 1]
        text, shift = np.array([i for i, _, _ in part])[own], np.array([s for _, s, _ in part])[own]
        out.append((text, lo - begin[own] + shift, hi - lo + 1, g[at[lo]], range_hash(pre, lo, hi + least)))
        part, size = [], 0

    for i, b in enumerate(raw):
        for a in range(0, len(b) - least + 1, PIECE):
            x = b[a : a + PIECE + least - 1]
            part.append((i, a, x))
            size += len(x)
            if size >= PIECE:
                flush()
    flush()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


class Level:
    """A suffix array: starts of suffixes of text, in the order of their first `least` bytes, each such prefix once."""

    def __init__(self, text: np.ndarray, at: np.ndarray, least: int):
        self.text, self.at, self.least = text, at, least

    def __len__(self) -> int:
        return len(self.at)

    def prefixes(self, a: int, b: int) -> np.ndarray:
        """The first `least` bytes of the suffixes a to b; numpy compares such strings byte by byte over their whole width."""
        every = np.ndarray(max(0, len(self.text) - self.least + 1), f"S{self.least}", self.text, strides=(1,))
        return every[self.at[a:b]]


def merge_scan(level: Level, other: Level) -> tuple[np.ndarray, np.ndarray]:
    """(place, equal): where in level each suffix of other belongs, and whether the one there has as long a match.

    Both arrays are read once, in order, STEP suffixes at a time.
    """
    place, equal = np.full(len(other), len(level), np.int64), np.zeros(len(other), bool)
    start, mine = 0, level.prefixes(0, STEP)
    for j in range(0, len(other), STEP):
        theirs, done = other.prefixes(j, j + STEP), 0
        while done < len(theirs) and len(mine):
            at = np.searchsorted(mine, theirs[done:])
            n = int(np.searchsorted(at, len(mine)))  # suffixes beyond this stretch of level wait for the next
            place[j + done : j + done + n] = start + at[:n]
            equal[j + done : j + done + n] = mine[at[:n]] == theirs[done : done + n]
            done += n
            if done < len(theirs):
                start += len(mine)
                mine = level.prefixes(start, start + STEP)
    return place, equal


class Family:
    """Suffix arrays of sizes that at least halve from one to the next.

    A batch gets its suffix array, which is scanned against every level by merging; matches of `least` bytes are equal
    neighbours there. What the batch adds becomes a level, and levels of like size merge.
    """

    def __init__(self, least: int):
        self.least, self.levels = least, []

    def add(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the suffixes of text at `at`, in text order, match one before: in an earlier batch or earlier in this one."""
        whole = Level(text, at, self.least)
        keys = whole.prefixes(0, len(at))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = order[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(order) else order
        del keys
        batch = Level(text, at[first], self.least)
        known = np.zeros(len(batch), bool)
        for level in self.levels:
            known |= merge_scan(level, batch)[1]
        new = np.zeros(len(at), bool)
        new[first[~known]] = True
        batch.at = batch.at[~known]
        if len(batch):
            while self.levels and len(self.levels[-1]) <= 2 * len(batch):
                batch = self._merge(self.levels.pop(), batch)
            self.levels.append(batch)
        return ~new

    def _merge(self, a: Level, b: Level) -> Level:
        place, _ = merge_scan(a, b)
        return Level(np.concatenate((a.text, b.text)), np.insert(a.at, place, b.at + len(a.text)), self.least)


def _runs(flag: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true flags that stay in one row."""
    change = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    start = flag & (change | ~np.concatenate(([False], flag[:-1])))
    stop = flag & np.concatenate((change[1:] | ~flag[1:], [True]))
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def repeated_spans(docs: DataFrame, least: int = 100, hot: int = HOT, carry: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, spans and kept.

    Texts are UTF-8 bytes (null: empty). spans are the maximal runs of bytes that some string of `least` bytes covers which
    also starts earlier: in a smaller doc_id, or before in the same document; overlaps count. kept (binary) is the rest; if
    asked, kept_text is the rest as text, where a character that a cut leaves in part goes too. Columns named in carry come
    along as the struct `carried`.
    Rows with a null doc_id match nothing and stay whole. Rows that share a doc_id but not a text are ordered by a hash of
    the text; rows that repeat both are one document with one result. An empty table gives an empty result. Long texts are
    scanned PIECE bytes at a time. Other columns are not read, whatever their names, and the result has only those named
    here. Equal segments and whole copies are known by 128 bits of hash, windows of anchors that more than `hot` segments share by
    64 bits; all other matches are compared byte by byte.
    """
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0)]).alias("carried"))
    # th tells rows of one doc_id apart; where ids are unique it is 0 and costs nothing in what is shuffled
    unique = t.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    t = t.select("doc_id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("th"), "text", "carried")
    # whole copies of an earlier text
    names = t.where(f"doc_id IS NOT NULL AND octet_length(text) >= {least}").select("doc_id", "th", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.octet_length("text").alias("size"))
    first = names.groupBy("t1", "t2", "size").agg(F.min("doc_id").alias("first"))
    copies = names.join(first, ["t1", "t2", "size"]).where("doc_id <> first").select("doc_id", "th", F.lit(0).alias("p"), (F.col("size") - (least - 1)).alias("n")).distinct()

    # made twice, once for counts alone: they are cheaper to make than to keep
    seg = _all_segments(t.where("doc_id IS NOT NULL").drop("carried"), least)
    common = seg.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    again = materialize(seg.join(common, "h").select("doc_id", "th", "h", "f", "c", F.shiftright("pn", 16).cast("int").alias("p"), F.col("pn").bitwiseAND(F.lit(65535)).cast("int").alias("n")), "again")
    place = F.struct("doc_id", "th", "p").alias("place")
    head = again.groupBy("h", "f").agg(F.min(place).alias("head"))
    mixed = again.groupBy("h").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo < hi").select("h")
    at = F.struct(F.col("doc_id"), F.col("th"), F.col("p"))
    marked = again.join(head, ["h", "f"]).withColumn("is_head", at == F.col("head"))
    equal = marked.where("NOT is_head").select("doc_id", "th", "p", "n")
    open_ = marked.where("is_head").join(mixed, "h", "left_semi").select("doc_id", "th", "h", "p", "n", (F.col("c") > hot).alias("hot"))
    # rows that repeat both doc_id and text are one document here
    open_ = materialize(open_ if unique else open_.distinct(), "open")
    source = t.drop("carried") if unique else t.drop("carried").dropDuplicates(["doc_id", "th"])

    want = open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("p", "n", "h", "hot")).alias("segs"))
    strings = materialize(_strings(source.join(want.hint("merge"), ["doc_id", "th"]), least), "strings")
    usual = strings.where("NOT hot").select("doc_id", "th", "h", "p", "bytes")
    windows = strings.where("NOT hot").agg(F.sum(F.octet_length("bytes") - (least - 1))).first()[0] or 0
    found = _indexed(usual, least, int(windows // FAMILY) + 1)
    # strings of anchors that very many segments share: each alone, by a grouped minimum
    single = strings.where("hot").select("doc_id", "th", "p", "h")
    earliest = single.groupBy("h").agg(F.min(place).alias("head"))
    late = single.join(earliest, "h").where(at != F.col("head")).select("doc_id", "th", "p", F.lit(1).alias("n"))
    dup = copies.unionByName(equal).unionByName(found).unionByName(late)
    runs = dup.groupBy("doc_id", "th").agg(F.collect_list(F.struct("p", "n")).alias("runs"))
    out = _cut(t.join(runs.hint("merge"), ["doc_id", "th"], "left"), least, texts)
    return out if carry else out.drop("carried")


def _all_segments(t: DataFrame, least: int) -> DataFrame:
    schema = T._parse_datatype_string("doc_id long, th long, h long, f long, pn long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        seen: dict[bytes, int] = {}
        for batch in batches:
            for a, rows in text_slices(batch.column("text")):
                part = batch.slice(a, rows)
                ids, th = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("th").to_numpy(zero_copy_only=False)
                raw = []
                for i, text in zip(ids.tolist(), part.column("text").to_pylist(), strict=True):
                    b = text.encode("utf-8", "surrogatepass")
                    k = hashlib.blake2b(b, digest_size=16).digest()
                    raw.append(b"" if seen.get(k, i) < i else b)
                    seen[k] = min(i, seen.pop(k, i))
                    if len(seen) > REMEMBERED:
                        del seen[next(iter(seen))]
                own, p, n, h, f = segments(raw, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(th[own]), pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(p.astype(np.int64) << 16 | n.astype(np.int64))], schema=arrow)

    return t.mapInArrow(tidy(run), schema)


def _strings(t: DataFrame, least: int) -> DataFrame:
    """The bytes of the wanted segments; those of hot anchors string by string, h then the string's own hash."""
    schema = T._parse_datatype_string("doc_id long, th long, h long, p int, bytes binary, hot boolean")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, n in text_slices(batch.column("text"), 256 << 10):
                part = batch.slice(a, n)
                rows = []
                for i, th, text, segs in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text", "segs")), strict=True):
                    b = text.encode("utf-8", "surrogatepass")
                    for s in segs:
                        x = b[s["p"] : s["p"] + s["n"] + least - 1]
                        if s["hot"]:
                            keys = window_hash(prefix_hash(np.frombuffer(x, np.uint8)), least)
                            keys = mix64(keys ^ np.uint64(s["h"] & (1 << 64) - 1)).view(np.int64)
                            rows += [(i, th, int(k), s["p"] + j, None, True) for j, k in enumerate(keys)]
                        else:
                            rows.append((i, th, s["h"], s["p"], x, False))
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return t.select("doc_id", "th", "text", "segs").mapInArrow(tidy(run), schema)


def _indexed(strings: DataFrame, least: int, families: int) -> DataFrame:
    """Runs of strings that an earlier segment has, found in one family for each partition of anchors, in document order.

    There are at least as many partitions as families, so that none holds much more than FAMILY suffixes and a hot anchor's.
    """
    schema = T._parse_datatype_string("doc_id long, th long, p int, n int")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        family = Family(least)
        for batch in batches:
            for a, rows in text_slices(batch.column("bytes"), BATCH, 1 << 20):
                part = batch.slice(a, rows)
                raw = part.column("bytes")
                size = pc.binary_length(raw).to_numpy().astype(np.int64)
                text = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
                n = size - (least - 1)
                row = np.repeat(np.arange(rows), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                known = family.add(text, (np.cumsum(size) - size)[row] + step)
                s, e = _runs(known, row)
                own = row[s]
                ids, th, p = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th", "p"))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(th[own]), pa.array((p[own] + step[s]).astype(np.int32)), pa.array((e - s).astype(np.int32))], schema=arrow)

    least_parts = max(families, int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return strings.repartition(least_parts, "h").sortWithinPartitions("doc_id", "th", "p").mapInArrow(tidy(run), schema)


def _cut(t: DataFrame, least: int, texts: bool) -> DataFrame:
    made = "n_bytes long, spans array<struct<start:int,stop:int>>, kept binary" + ", kept_text string" * texts
    schema = T.StructType([t.schema["doc_id"], t.schema["carried"], *T._parse_datatype_string(made)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, n in text_slices(batch.column("text")):
                part = batch.slice(a, n)
                size, spans, kept = [], [], []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    b = text.encode("utf-8", "surrogatepass")
                    own: list[list[int]] = []
                    for p, stop in sorted((r["p"], r["p"] + r["n"] + least - 1) for r in runs or ()):
                        if own and p <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], stop)
                        else:
                            own.append([p, stop])
                    cut = [0, *(x for r in own for x in r), len(b)]
                    size.append(len(b))
                    spans.append([{"start": s, "stop": e} for s, e in own])
                    kept.append(b"".join(b[s:e] for s, e in zip(cut[::2], cut[1::2], strict=True)))
                more = [pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())] if texts else []
                carried = part.column("carried").cast(arrow.field("carried").type)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), carried, pa.array(size, pa.int64()), pa.array(spans, arrow.field("spans").type), pa.array(kept, pa.binary()), *more], schema=arrow)

    return t.select("doc_id", "carried", "text", "runs").mapInArrow(tidy(run), schema)
