"""Shared pieces of the training-data operators: reading, materialising, grouping by links."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_CLEAN: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Where it is unset: a new one if Spark runs in this process alone, else an error."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="graphquarry-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/graphquarry-{spark.sparkContext.applicationId}"
    if path not in _CLEAN:
        _CLEAN[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _CLEAN.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def materialize(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, a folder for each value of `by`, read again with its schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    # Spark deletes the shuffle files of the step that ended when the driver finds its plan to be garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def text_slices(column, most: int = 2 << 20, rows: int = 4096):
    """(first row, rows) of slices of an Arrow text column that hold at most `most` bytes and `rows` rows, or one row."""
    import pyarrow.compute as pc

    end = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(end):
        b = int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right"))
        b = min(max(b, a + 1), a + rows)
        yield a, min(b, len(end)) - a
        a = b


def tidy(run):
    """run, for mapInArrow, giving freed memory back to the system as its task ends: Python workers stay, and would hold it."""

    def go(batches):
        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a call of the GNU C library
            ctypes.CDLL(None).malloc_trim(0)

    return go


def map_texts(df: DataFrame, body, fields: str, most: int = 2 << 20) -> DataFrame:
    """df's columns but `text`, then `fields`, which body makes from a list of whole texts (None: null).

    body is made once a task by body(); it returns a list of values for each field. A list holds at most `most` bytes, or one
    text. Other columns pass through Arrow unchanged, so ids keep their type and nulls; those named like a field are replaced.
    """
    made = T._parse_datatype_string(fields).fields
    new = {f.name.lower() for f in made}
    keep = [c for c in df.columns if c != "text" and c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in keep] + list(made))
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        work = body()
        for batch in batches:
            text = len(keep)
            for a, n in text_slices(batch.column(text), most):
                part = batch.slice(a, n)
                got = work(part.column(text).to_pylist())
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(text)]
                cols += [pa.array(v, arrow.field(text + i).type) for i, v in enumerate(got)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(tidy(run), schema)


def id_crc_mod3(col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; 1 marks the held-out fold."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3)).cast("int")


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64, in wrap-around arithmetic."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POW: dict[int, np.ndarray] = {}


def _pow(n: int, base: int) -> np.ndarray:
    if len(_POW.get(base, ())) < n:
        _POW[base] = _powers(max(n, 1 << 16), base)
    return _POW[base][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers of a base, length len(buf) + 1; range_hash reads ranges from it."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buf] * _pow(len(buf), _BASE), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes [start, end): equal bytes give equal hashes wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * _pow(len(prefix), _INV)[start] + (end - start).astype(np.uint64))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """range_hash of every window of `width` bytes."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix64((prefix[width:] - prefix[:-width]) * _pow(n, _INV) + np.uint64(width))


def connected_components(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, component): the smallest id reachable over edges (a, b), itself included.

    Distributed min-label hooking with pointer jumping: labels only fall, each round is cut by a table in the shared
    folder, and ids without an edge never enter the rounds. Rounds grow with the logarithm of the longest chain.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lab = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(lab.select(F.col("id").alias("b"), "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        hooked = lab.join(near, "id").select("id", "l", F.least("l", "m").alias("m"))
        # a label's own node takes the smallest label seen by those it labels
        pulled = hooked.groupBy(F.col("l").alias("id")).agg(F.min("m").alias("p"))
        step = hooked.join(pulled, "id", "left").select("id", "l", F.least("m", F.coalesce("p", "m")).alias("m"))
        jump = step.select(F.col("id").alias("m"), F.col("m").alias("j"))
        new = materialize(step.join(jump, "m", "left").select("id", F.col("l").alias("old"), F.least("m", F.coalesce("j", "m")).alias("l")), "labels")
        changed = new.where("old <> l").limit(1).count()
        lab = new.select("id", "l")
        if not changed:
            break
    return nodes.select(key).distinct().join(lab.withColumnRenamed("id", key), key, "left").select(key, F.coalesce("l", key).alias("component"))
