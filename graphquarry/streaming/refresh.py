"""Refresh of a table from a stream of changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import merge
from ..sources.store import newest, versions


def current(spark: SparkSession, top: str) -> DataFrame:
    """The newest version of a table: each is a folder of its own, and the largest number that is complete counts."""
    return spark.read.parquet(newest(spark, top))


def refresh(changes: DataFrame, top: str, key: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Merges each batch of changes (rows with `deleted`) into the table in top, as a new version.

    Of several changes to a key in one batch the last by `changed_at` counts. The first batch of a checkpoint finds the
    newest version and notes it there; batch n writes the n-th version after that, an empty batch a copy. So a batch that is
    run again writes the same version again, and a lost executor or driver repeats no change.
    """

    def first(spark: SparkSession, number: int) -> int:
        """The version that the checkpoint's first batch started from."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        note = hadoop.Path(f"{checkpoint}/first-version")
        fs = note.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(note):
            out = fs.create(note, True)
            out.writeLong(versions(spark, top)[-1] - number)
            out.close()
        at = fs.open(note)
        base = at.readLong()
        at.close()
        return base

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = first(spark, number) + number
        fields = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*fields), "changed_at").alias("r")).select(key, "r.*")
        base = spark.read.parquet(f"{top}/v{at}")
        gone = last.where("deleted").select(key)
        new = merge(base, last.where("NOT deleted").select(*base.columns), key, gone)
        new.write.mode("overwrite").parquet(f"{top}/v{at + 1}")

    w = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type; later events than `late` are left out in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
