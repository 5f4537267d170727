"""Stored engine tables: versions swapped whole, opened leniently, and the crawl cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

#: Schemas of the stored tables.
SCHEMAS = {
    "artifacts": "path string, kind string, title string, status string, code string",
    "links": "source string, target string, link_type string, link_context string",
    "symbols": "id long, file string, name string, qualified_name string, symbol_type string, line_start long, line_end long, visibility string",
}


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions of a table, ascending: each is a folder v<number> that Spark's committer finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(folder, f"{n}/_SUCCESS")))


def replace(df: DataFrame, folder: str, keep: int = 2) -> None:
    """Writes df as the next version of the table in folder; older versions but the last `keep` go.

    The version counts from the moment its commit marker exists, so readers see the old table or the new one, and a failed
    write changes nothing. df may read the table that it replaces.
    """
    spark = df.sparkSession
    have = versions(spark, folder)
    number = have[-1] + 1 if have else 0
    df.write.mode("overwrite").parquet(f"{folder}/v{number}")
    for old in [*have, number][:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def newest(spark: SparkSession, folder: str) -> str:
    """The folder of the newest version; folder itself for a table without versions."""
    have = versions(spark, folder)
    return f"{folder}/v{have[-1]}" if have else folder


def open_table(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The table in folder; an empty one of that schema where it is missing, unreadable or of other columns."""
    empty = spark.createDataFrame([], schema)
    try:
        df = spark.read.parquet(newest(spark, folder))
    except AnalysisException:
        return empty
    return df.select(empty.columns) if {(f.name, f.dataType) for f in empty.schema} <= {(f.name, f.dataType) for f in df.schema} else empty


def crawl_changes(cache: DataFrame, files: DataFrame) -> DataFrame:
    """(path, hash, state): new, changed, same or gone, from the cached and the current hash of each path."""
    c, f = cache.select("path", F.col("hash").alias("old")), files.select("path", F.col("hash").alias("hash"))
    state = F.when(F.col("hash").isNull(), "gone").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "same").otherwise("changed")
    return c.join(f, "path", "full").select("path", "hash", state.alias("state"))
