"""Token ids as raw payloads with a minimal perfect hash index for each shard."""

from __future__ import annotations

import json
import struct
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import mix64, shared_folder, text_slices
from .pretokens import BYTE_LEVEL, TextEncoder

#: Ids and documents after which a shard ends.
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 14
#: The file format: raw id payloads (little-endian, document after document) in files of their own, a file a task, and one
#: index record a shard. Spark's committer keeps the records of one attempt of each task, so the payload that a lost
#: executor left behind has no record that names it.
SHARD = T.StructType(
    [
        T.StructField("part", T.LongType()),  # of the write, ascending with the keys
        T.StructField("shard", T.LongType()),  # in the part, ascending with the keys
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),  # of the shard's payload in the file, in bytes
        T.StructField("before", T.LongType()),  # ids of the part's earlier shards
        T.StructField("low", T.LongType()),  # smallest and largest key
        T.StructField("high", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("width", T.IntegerType()),  # bytes of an id
        T.StructField("keys", T.BinaryType()),  # int64 in document order; the first n_null have no key
        T.StructField("n_null", T.LongType()),
        T.StructField("ends", T.BinaryType()),  # uint64: ids up to the end of each document
        T.StructField("seeds", T.BinaryType()),  # int32 for each bucket of the hash
        T.StructField("prints", T.BinaryType()),  # uint32 for each slot
        T.StructField("slots", T.BinaryType()),  # uint32 for each slot: first document with that key
    ]
)


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return mix64(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(seed).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, prints, slots) of a minimal perfect hash over the distinct int64 keys, which are sorted.

    Buckets of about four keys take, largest first, the first seed that sends all of their keys to free slots; a bucket of
    one key stores its slot itself as -1 - slot.
    """
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    k = keys[first]
    n, buckets = len(k), max(1, len(k) // 4)
    seeds, place, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    bucket = (_hash(k, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    groups = sorted((g for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(g)), key=len, reverse=True)
    at = next((i for i, g in enumerate(groups) if len(g) == 1), len(groups))
    for g in groups[:at]:
        # the last buckets find few free slots and try thousands of seeds: many at once
        first_seed, many = 1, 32
        while True:
            s = (_hash(k[g], np.arange(first_seed, first_seed + many)[:, None]) % np.uint64(n)).astype(np.int64)
            fits = np.flatnonzero(~taken[s].any(axis=1))
            apart = np.sort(s[fits], axis=1)
            fits = fits[(apart[:, 1:] != apart[:, :-1]).all(axis=1)]
            if len(fits):
                break
            first_seed, many = first_seed + many, min(2 * many, 1024)
        s = s[fits[0]]
        seeds[bucket[g[0]]], place[g], taken[s] = first_seed + fits[0], s, True
    for g, s in zip(groups[at:], np.flatnonzero(~taken), strict=True):
        seeds[bucket[g[0]]], place[g] = -1 - s, s
    prints, slots = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    prints[place] = (_hash(k, 0) >> np.uint64(32)).astype(np.uint32)
    slots[place] = first
    return seeds, prints, slots


def find(keys: np.ndarray, seeds: np.ndarray, prints: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The first document of each key in a shard, in constant time a key; -1 where the fingerprint says it is not there."""
    if not len(slots):
        return np.full(len(keys), -1, np.int64)
    d = seeds[(_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    s = np.where(d < 0, -1 - d, (_hash(keys, np.maximum(d, 0)) % np.uint64(len(slots))).astype(np.int64))
    return np.where(prints[s] == (_hash(keys, 0) >> np.uint64(32)).astype(np.uint32), slots[s].astype(np.int64), -1)


@lru_cache(maxsize=2)
def load(path: str):
    """(encode, size of the vocabulary) of a file of the tokenizers library; kept by each Python worker.

    Where the file asks for plain byte-level matches, equal matches have equal ids: the library encodes each once and the
    ids are remembered. Else it encodes whole texts.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    special = [x["content"] for x in d["added_tokens"]]

    def batch(found: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch_fast(found, add_special_tokens=False)]

    size = np.zeros(t.get_vocab_size(), np.int64)  # bytes of each token: such vocabularies write a character for a byte
    for token, i in t.get_vocab().items():
        size[i] = len(token)

    def joined(found: list[str], between: str) -> list[bytes]:
        """found (letters), each behind a space or line end, encoded many at a time as one text that the library parts again."""
        out: list[bytes] = []
        mark, skip = ord(between), 0 if between == " " else 1  # a line end is a match of its own
        for a in range(0, len(found), 4000):
            part = found[a : a + 4000]
            text = between.join(["", *part])
            ids = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            byte = np.concatenate(([0], np.cumsum(size[ids])))
            start = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == mark)
            i, j = np.searchsorted(byte, start + skip), np.searchsorted(byte, np.append(start[1:], byte[-1]))
            if len(start) != len(part) or (byte[i] != start + skip).any() or (byte[j[:-1]] != start[1:]).any():
                out += batch([(" " if between == " " else "") + m for m in part])
                continue
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip((i * 4).tolist(), (j * 4).tolist(), strict=True)]
        return out

    def matches(found: list[str]) -> list[bytes]:
        bare = [m for m in found if m.isalpha()]
        rest = [m for m in found if not m.isalpha()]
        out = dict(zip(bare, joined(bare, "\n"), strict=True)) | dict(zip(rest, batch(rest), strict=True))
        return [out[m] for m in found]

    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("normalizer") and all(x["special"] for x in d["added_tokens"]):
        own = TextEncoder(BYTE_LEVEL, matches, lambda found: joined(found, " "))

        def encode(texts: list[str | None]) -> list[bytes]:
            """The library's ids; texts that hold a special token's string are its own to cut."""
            whole = [i for i, x in enumerate(texts) if x and any(s in x for s in special)]
            if not whole:
                return own.encode(texts)
            out = own.encode([None if i in set(whole) else x for i, x in enumerate(texts)])
            for i, ids in zip(whole, batch([texts[i] for i in whole]), strict=True):
                out[i] = ids
            return out

        return encode, t.get_vocab_size()
    return (lambda texts: batch([x or "" for x in texts])), t.get_vocab_size()


def _open(folder: str):
    """(file system, path) of a folder that all executors share, by any scheme that pyarrow opens."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _shard(keys: list[int | None], ids: list[bytes], width: int) -> tuple[dict, bytes]:
    null = sum(k is None for k in keys)
    k = np.array(keys[null:], np.int64)
    seeds, prints, slots = build_index(k)
    flat = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    low, high = (int(k[0]), int(k[-1])) if len(k) else (None, None)
    index = {"keys": k, "ends": ends, "seeds": seeds, "prints": prints, "slots": slots + np.uint32(null)}
    return {"low": low, "high": high, "n_docs": len(ids), "n_ids": len(flat), "width": width, "n_null": null} | {c: x.tobytes() for c, x in index.items()}, flat.tobytes()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, partitions: int | None = None) -> str:
    """Writes the ids of every row of docs (doc_id, text), each text followed by end_id, in ascending doc_id order; returns the folder.

    Ids are the library's with add_special_tokens=False: the string of a special token in a text becomes that token. Null
    doc_ids come first; rows that repeat one are ordered by text; other columns are not read. A null or empty text is end_id
    alone. An empty table gives a folder without shards. A very long text is a shard of its own. folder must be one that
    all executors share and that pyarrow can open; by default a new one below spark.checkpoint.dir. The texts are dealt by
    ranges of doc_id, so each task writes neighbouring documents, and no task holds more than a shard.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    arrow = to_arrow_schema(SHARD)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, size = load(tokenizer)
        width, end = 2 if max(size, end_id + 1) <= 1 << 16 else 4, np.array([end_id], "<u4").tobytes()
        part, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.bin"
        store, top = _open(folder)
        store.create_dir(f"{top}/payload", recursive=True)
        seq, offset, before, total, keys, ids = 0, 0, 0, 0, [], []
        with store.open_output_stream(f"{top}/payload/{name}") as out:

            def record():
                nonlocal seq, offset, before, total, keys, ids
                index, payload = _shard(keys, ids, width)
                out.write(payload)
                row = {"part": part, "shard": seq, "file": name, "offset": offset, "before": before} | index
                seq, offset, before, total, keys, ids = seq + 1, offset + len(payload), before + index["n_ids"], 0, [], []
                return pa.RecordBatch.from_pylist([row], arrow)

            for batch in batches:
                text = batch.column("text")
                made = (x for a, n in text_slices(text, 4 << 20) for x in encode(text.slice(a, n).to_pylist()))
                for key, one in zip(batch.column("doc_id").to_pylist(), made, strict=True):
                    ids.append(one + end)
                    keys.append(key)
                    total += len(ids[-1]) // 4
                    if total >= SHARD_IDS or len(ids) >= SHARD_DOCS:
                        yield record()
            if ids:
                yield record()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD).write.parquet(f"{folder}/index")
    return folder


def _parts(index: DataFrame) -> list:
    """(part, ids, lowest and highest key), a row a task of the write: that many come to the driver, whatever the tasks held."""
    return index.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("part").collect()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder of shards; ids as little-endian unsigned 32-bit, start counts the ids of all before.

    Each document is found through the shard's index, and its ids are read from the payload; repeats of a key follow its
    first document. Nothing is shuffled.
    """
    index = spark.read.schema(SHARD).parquet(f"{folder}/index")
    parts = _parts(index.select("part", "n_ids", "low", "high"))
    base = dict(zip([r["part"] for r in parts], np.cumsum([0, *(r["n"] for r in parts)]).tolist()))
    out = T._parse_datatype_string("doc_id long, start long, n_tokens long, ids binary")
    arrow = to_arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        store, top = _open(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                keys, ends = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["ends"], np.uint64).astype(np.int64)
                at = find(keys, *(np.frombuffer(r[c], t) for c, t in (("seeds", np.int32), ("prints", np.uint32), ("slots", np.uint32))))
                repeat = np.arange(len(keys)) - np.searchsorted(keys, keys)
                doc = np.concatenate((np.arange(r["n_null"]), at + repeat))
                begin = np.concatenate(([0], ends))[doc]
                with store.open_input_file(f"{top}/payload/{r['file']}") as f:
                    flat = np.frombuffer(f.read_at(r["n_ids"] * r["width"], r["offset"]), f"<u{r['width']}").astype("<u4").tobytes()
                ids = [flat[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends[doc].tolist(), strict=True)]
                start = base[r["part"]] + r["before"] + begin
                yield pa.RecordBatch.from_arrays([pa.array([None] * r["n_null"] + keys.tolist(), pa.int64()), pa.array(start), pa.array(ends[doc] - begin), pa.array(ids, pa.binary())], schema=arrow)

    return index.mapInArrow(run, out)


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) for those doc_ids of keys that the shards hold; of a repeated doc_id its first text.

    A key is dealt to the part whose range holds it, by binary search over the parts, and meets the part's shards by an
    equi-join. The shard's hash gives its place in constant time; only its own bytes of the payload are read.
    """
    index = spark.read.schema(SHARD).parquet(f"{folder}/index")
    parts = [r for r in _parts(index.select("part", "n_ids", "low", "high")) if r["low"] is not None]
    low, high, number = (np.array([r[c] for r in parts], np.int64) for c in ("low", "high", "part"))
    spot = T._parse_datatype_string("doc_id long, part long")
    spot_arrow = to_arrow_schema(spot)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            k = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.searchsorted(low, k, "right") - 1
            ok = (at >= 0) & (k <= high[np.maximum(at, 0)]) if len(low) else np.zeros(len(k), bool)
            yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array(number[at[ok]])], schema=spot_arrow)

    want = keys.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct().mapInArrow(place, spot)
    ranges = index.select("part", "shard", "low", "high")
    at = want.join(ranges, "part").where("doc_id >= low AND doc_id <= high").groupBy("part", "shard").agg(F.collect_list("doc_id").alias("want"))
    out = T._parse_datatype_string("doc_id long, ids binary")
    arrow = to_arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        store, top = _open(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                keys, ends = np.array(r["want"], np.int64), np.concatenate(([0], np.frombuffer(r["ends"], np.uint64).astype(np.int64)))
                at = find(keys, *(np.frombuffer(r[c], t) for c, t in (("seeds", np.int32), ("prints", np.uint32), ("slots", np.uint32))))
                own, rows = np.frombuffer(r["keys"], np.int64), []
                with store.open_input_file(f"{top}/payload/{r['file']}") as f:
                    for k, a in zip(keys.tolist(), at.tolist(), strict=True):
                        if a >= 0 and own[a - r["n_null"]] == k:  # the fingerprint lets one of 2**32 strangers pass
                            x = f.read_at(int(ends[a + 1] - ends[a]) * r["width"], r["offset"] + int(ends[a]) * r["width"])
                            rows.append({"doc_id": k, "ids": np.frombuffer(x, f"<u{r['width']}").astype("<u4").tobytes()})
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return index.join(at, ["part", "shard"]).mapInArrow(run, out)
