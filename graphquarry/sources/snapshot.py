"""Tables that change together: stored in buckets, with a manifest that names one version of each bucket of each table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed first."""


class Snapshot:
    """A folder of tables, each dealt to buckets by a hash of its key.

    A commit writes the buckets that it changes as new files and then a manifest: for each table and bucket the version that
    wrote it last. The manifest appears by one rename, so a reader, who pins the manifest that it found, sees all tables as of
    one commit, before and after, and a failed commit leaves nothing that counts. Two writers from one version conflict: the
    second one's rename fails. A manifest has tables times buckets numbers, whatever the size of the tables.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]], buckets: int = 64, order: dict[str, list[str]] | None = None):
        """tables: name -> (key column, schema); order: name -> columns that its files are sorted by, for reads that skip row groups."""
        self.spark, self.folder, self.tables, self.order = spark, folder.rstrip("/"), tables, order or {}
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._manifest(v)["buckets"] if (v := self.newest()) is not None else buckets

    # manifests

    def versions(self) -> list[int]:
        top = self._path(f"{self.folder}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def newest(self) -> int | None:
        return max(self.versions(), default=None)

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"buckets": self.buckets, "tables": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifest/v{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        temp, final = (self._path(f"{self.folder}/manifest/{n}") for n in (f"_{uuid.uuid4().hex}", f"v{version}.json"))
        stream = self._fs.create(temp)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise Conflict(f"version {version} exists")

    # tables

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets that hold the keys: at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in keys.select(self.bucket(column).alias("b")).distinct().collect())

    def read(self, table: str, at: int | None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of version `at`, or those of its buckets: no other file is opened."""
        key, schema = self.tables[table]
        have = self._manifest(at)["tables"].get(table, {})
        want = [b for b in have if buckets is None or int(b) in set(buckets)]
        if not want:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table}/{have[b]}/bucket={b}" for b in want])

    def commit(self, at: int | None, changes: dict[str, tuple[DataFrame, list[int] | None]]) -> int:
        """changes: table -> (rows, the buckets that they replace; None: all). Returns the new version, made from version `at`. Rows with a column `bucket` have been dealt out already."""
        manifest, version = self._manifest(at), 0 if at is None else at + 1
        mark = f"v{version}-{uuid.uuid4().hex[:8]}"
        for table, (rows, touched) in changes.items():
            key, _ = self.tables[table]
            if touched == []:
                continue
            path = f"{self.folder}/{table}/{mark}"
            # AQE shares out a bucket that is large, as that of a key with very many rows
            dealt = rows if "bucket" in rows.columns else rows.withColumn("bucket", self.bucket(key)).hint("rebalance", F.col("bucket"))
            dealt.sortWithinPartitions("bucket", *self.order.get(table, [])).write.partitionBy("bucket").parquet(path)
            new = {f.getPath().getName()[7:] for f in self._fs.listStatus(self._path(path)) if f.getPath().getName().startswith("bucket=")}
            gone = set(map(str, touched)) if touched is not None else set(manifest["tables"].get(table, {}))
            manifest["tables"][table] = {b: v for b, v in manifest["tables"].get(table, {}).items() if b not in gone} | dict.fromkeys(new, mark)
        self._publish(version, manifest)
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last `keep` manifests and the files that only they name. Readers of those versions must have ended."""
        have = self.versions()
        used = {(t, m) for v in have[-keep:] for t, b in self._manifest(v)["tables"].items() for m in b.values()}
        for table in self.tables:
            top = self._path(f"{self.folder}/{table}")
            for f in self._fs.listStatus(top) if self._fs.exists(top) else []:
                mark = f.getPath().getName()
                if (table, mark) not in used and int(mark[1:].split("-")[0]) <= have[-1]:
                    self._fs.delete(f.getPath(), True)
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifest/v{v}.json"), False)
