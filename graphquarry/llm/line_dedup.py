"""Line dedup against levelled sorted runs of line hashes, in built-in expressions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, materialize, shared_folder
from .quality_rules import _once

#: A key that one batch alone may count in this share of all (document, key) pairs is heavy: there are at most batches / HEAVY.
HEAVY = 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case; lower() does that alone where all bytes are ASCII."""
    x = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def _digest(*cols: Column) -> Column:
    """128 bits of hash of the columns, as two numbers."""
    return F.struct(F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(7), *cols, F.lit(13)).alias("g"))


class LineIndex:
    """How many documents hold each line key, as runs of (h, g, n): h and g are 128 bits of the key's hash, n counts documents.

    A run is a table bucketed and sorted by its key, so that joins and merges of runs shuffle none of them. A batch is counted,
    its keys that some run already counts `least` times are taken out by a merge anti-join with each run, and the rest becomes
    a run of level 0; two runs of a level are merged to one of the next. A document is a row. What is written is complete before
    the list of runs changes, so a failed batch can be added again.
    """

    def __init__(self, spark: SparkSession, least: int):
        self.spark, self.least, self.runs, self.name = spark, least, [], f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, counted: DataFrame) -> tuple[str, str]:
        table, path = f"{self.name}_{uuid.uuid4().hex[:8]}", f"{shared_folder(self.spark)}/run-{uuid.uuid4().hex}"
        counted.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", path).format("parquet").saveAsTable(table)
        return table, path

    def add(self, keys: DataFrame) -> None:
        """keys: (h, g), one row for each document and different key of it."""
        new = keys.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
        for _, table, _ in self.runs:
            new = new.join(self.spark.table(table).where(F.col("n") >= self.least).hint("merge"), ["h", "g"], "left_anti")
        self.runs.append((0, *self._write(new)))
        while len(self.runs) > 1 and self.runs[-2][0] == self.runs[-1][0]:
            self._merge()

    def _merge(self) -> None:
        """The last two runs become one, by an outer merge join of equal buckets: no run is shuffled."""
        a, b = self.runs[-2:]
        both = self.spark.table(a[1]).withColumnRenamed("n", "m").join(self.spark.table(b[1]).hint("merge"), ["h", "g"], "full_outer")
        total = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        self.runs[-2:] = [(a[0] + 1, *self._write(both.select("h", "g", total.cast("long").alias("n"))))]
        self._drop([a, b])

    def frequent(self) -> DataFrame:
        """(h, g, n) of the keys in at least `least` documents, all runs merged; n leaves out documents that came when that was known."""
        while len(self.runs) > 1:
            self._merge()
        return self.spark.table(self.runs[0][1]).where(F.col("n") >= self.least)

    def _drop(self, runs: list[tuple[int, str, str]]) -> None:
        for _, table, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(self.spark, path)

    def close(self) -> None:
        self._drop(self.runs)
        self.runs = []


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 8) -> DataFrame:
    """docs' doc_id, n_lines, n_dropped and kept_text: without the lines whose key is in at least `least` documents.

    Texts are split at \\n; a null or empty text is one empty line. A line's key is the line without white space at both ends,
    A-Z in lower case; lines with an empty key stay. A document is a row: rows that repeat a doc_id, or are equal, count each.
    Whole texts are read. Documents without a line give none, an empty table an empty result. Other columns are not read,
    whatever their names. Keys are compared by 128 bits of hash.

    Documents go to `batches` batches by a hash, each of which is looked up in and added to a LineIndex. Lines are then met
    with the frequent keys: the heavy ones (at most batches / HEAVY rows, by their share) are broadcast, the others joined by merging,
    so no task gets all copies of one line. Texts are shuffled once, by (doc_id, digest), to drop lines by their places.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("_d", _digest("doc_id", "t")).select("doc_id", "t", F.col("_d.h").alias("d1"), F.col("_d.g").alias("d2"))
    lines = materialize(_line_hashes(d, batches), "lines", by=["batch"])
    index = LineIndex(docs.sparkSession, least)
    for b in range(batches):
        index.add(lines.where((F.col("batch") == b) & F.col("first")).select("h", "g"))
    frequent = materialize(index.frequent(), "frequent")
    index.close()
    places = _places(lines, frequent, HEAVY / batches)
    whole = d.join(places.hint("merge"), ["d1", "d2"], "left").withColumn("line", _once(F.split("t", "\n", -1)))
    n = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    return whole.select("doc_id", F.size("line").cast("long").alias("n_lines"), n.alias("n_dropped"), F.when(n == 0, F.col("t")).otherwise(_without("line", "places")).alias("kept_text"))


def _line_hashes(d: DataFrame, batches: int) -> DataFrame:
    """A row for each line with a key: its document's digest, place, hash, and whether it is the document's first of that key."""
    keys = F.filter(F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos"))), lambda x: x["key"] != "")
    hashed = F.transform(keys, lambda x: F.struct(F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(7), x["key"], F.lit(13)).alias("g"), x["pos"].alias("pos")))
    s = d.select("d1", "d2", _once(F.array_sort(hashed)).alias("s"))
    new = lambda x, i: (i == 0) | (F.get("s", i - 1)["h"] != x["h"]) | (F.get("s", i - 1)["g"] != x["g"])
    marked = F.transform("s", lambda x, i: F.struct(x["h"].alias("h"), x["g"].alias("g"), x["pos"].alias("pos"), new(x, i).alias("first")))
    return s.select("d1", "d2", F.inline(marked)).withColumn("batch", F.pmod("d1", F.lit(batches)).cast("int"))


def _places(lines: DataFrame, frequent: DataFrame, share: float) -> DataFrame:
    """(d1, d2, places): the places of lines with a frequent key, ascending, for each document that has one."""
    total = lines.where("first").count()
    heavy = F.col("n") >= F.lit(share * total)
    own = lines.select("d1", "d2", "pos", "h", "g")
    many = own.join(F.broadcast(frequent.where(heavy).select("h", "g", F.lit(True).alias("heavy"))), ["h", "g"], "left")  # at most 1 / share rows
    few = many.where("heavy IS NULL").join(frequent.where(~heavy).hint("merge"), ["h", "g"], "left_semi")
    found = many.where("heavy").select("d1", "d2", "pos").union(few.select("d1", "d2", "pos"))
    return found.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("pos")).alias("places"))


def _without(line: str, places: str) -> Column:
    """The lines between the places, joined by \\n: a slice a gap, so a text costs its own length."""
    gap = lambda j: F.slice(line, F.coalesce(F.get(places, j - 1) + 2, F.lit(1)), F.coalesce(F.get(places, j), F.size(line)) - F.coalesce(F.get(places, j - 1) + 1, F.lit(0)))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), gap)), "\n")


def oracle_sql(least: int = 10) -> str:
    """The query's rows in DuckDB SQL over documents."""
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, i, ls[i] AS x, translate(regexp_replace(regexp_replace(ls[i], '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS k
      FROM t, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= {least}),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '') AS kept FROM l LEFT JOIN f USING (k) GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM t JOIN g USING (r)"""
