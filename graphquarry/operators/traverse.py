"""Traversals: paths to a bounded depth, first-visit search, reachability."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HOPS = 10
PARTS = 8
#: Fixed value: a checkpoint of more bytes than this, which are compressed, is joined by merging, never sent through the driver.
MOST_SENT = 256 << 10


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints: below that which spark.checkpoint.dir names; where it is unset, a new one if Spark runs in this process alone, else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not top and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="graphquarry-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df behind a checkpoint in the shared folder.

    Spark keeps the size that it guessed for df from the files behind it, which knows nothing of what a parser or an explode
    adds, and would broadcast long tables by that. What a checkpoint holds is known: if it is more than MOST_SENT, joins merge.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    at = spark._jvm.org.apache.hadoop.fs.Path(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    held = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return out.hint("merge") if held > MOST_SENT else out


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as columns and read back: of long tables that several plans read, a fraction of a checkpoint's size."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def walk(edges: DataFrame, start: DataFrame, depth: int = 3, inbound: bool = False, types: list[str] | None = None) -> DataFrame:
    """(start, node, depth, link_type), distinct: the ends of all paths from start that visit no node twice.

    The start itself counts as visited from the second hop on, so only a self-loop leads back to it; a depth below 1 still
    gives the first hop; depth is at most MOST_HOPS. Each hop is one join of the paths before it, which a checkpoint keeps:
    no hop is computed twice. Paths, unlike nodes, may grow exponentially with depth; first_visits is the way to reachability.
    """
    e = edges if types is None else edges.where(F.col("link_type").isin(types))
    e = e.select(F.col("target" if inbound else "source").alias("from"), F.col("source" if inbound else "target").alias("to"), "link_type")
    now = start.select("start").distinct().join(e, F.col("start") == F.col("from")).select("start", F.col("to").alias("node"), "link_type", F.array("from", "to").alias("seen"))
    last = min(depth, MOST_HOPS)
    now = cut(now) if last > 1 else now
    out = now.select("start", "node", F.lit(1).alias("depth"), "link_type")
    for d in range(2, last + 1):
        # paths that differ in a link's type alone go on as one
        now = now.drop("link_type").distinct().join(e, F.col("node") == F.col("from")).where(~F.array_contains("seen", F.col("to")))
        now = now.select("start", F.col("to").alias("node"), "link_type", F.array_append("seen", F.col("to")).alias("seen"))
        now = cut(now) if d < last else now
        out = out.union(now.select("start", "node", F.lit(d).alias("depth"), "link_type"))
    return out.distinct()


def first_visits(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes by their least number of hops from any start (depth 0), over edges (source, target).

    Each level is cut by a checkpoint; the visited set grows by a frontier, and every PARTS levels becomes one table again, so
    that a level reads few of them however long the chains are. A union keeps no hint of its parts, so it has its own.
    """
    seen = cut(start.select(F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        front = cut(step.join(seen.hint("merge"), "node", "left_anti").select("node", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.union(front)
        seen = cut(seen) if d % PARTS == 0 else seen
    return seen


def call_context(calls: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """Distinct call edges (caller, callee, line, side) met by breadth-first search from start, both ways."""
    out = None
    for side, a, b in (("callers", "callee", "caller"), ("callees", "caller", "callee")):
        e = calls.select(F.col(a).alias("source"), F.col(b).alias("target"))
        near = first_visits(e, start, depth - 1).select("node")
        hit = calls.join(near, calls[a] == near["node"], "left_semi").select("caller", "callee", "line", F.lit(side).alias("side")).distinct()
        out = hit if out is None else out.union(hit)
    return out


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node that roots reach over edges, roots included; stops when a level adds nothing."""
    return first_visits(edges, roots, 1 << 30).select("node")


def impact(links: DataFrame, artifacts: DataFrame, posts: DataFrame, start: str, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """Inbound walk of 1 to 3 hops with each node's title and its open posts (path, title) as sorted texts.

    links and posts may repeat rows. What the walk met is stored, so that only the posts about it are joined and grouped.
    """
    s = links.sparkSession.createDataFrame([(start,)], "start string")
    near = stored(walk(links, s, max(1, min(3, depth)), inbound=True, types=types).select(F.col("node").alias("path"), "depth", "link_type"))
    met = posts.where("status = 'open'").join(near.select(F.col("path").alias("about")).distinct(), "about", "left_semi")
    open_ = met.groupBy("about").agg(F.array_sort(F.collect_set(F.concat("path", F.lit(" ("), "title", F.lit(")")))).alias("open_posts"))
    return near.join(artifacts.select("path", "kind", "title"), "path", "left").join(open_, F.col("path") == F.col("about"), "left").select("path", "kind", "title", "depth", "link_type", F.array_join(F.coalesce("open_posts", F.array().cast("array<string>")), "; ").alias("open_posts"))


def cascade(links: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(path, reach): direct dependents, and those met only further away."""
    s = links.sparkSession.createDataFrame([(start,)], "start string")
    far = walk(links, s, depth, inbound=True).groupBy("node").agg(F.min("depth").alias("d"))
    return far.select(F.col("node").alias("path"), F.when(F.col("d") == 1, "direct").otherwise("transitive").alias("reach"))


def resolve_in_bases(inherits: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, name, owner): for each class the nearest class by inherits (cls, base, line) that owns each method (owner, name); ties by line, then base.

    Bases are walked until no class gains one; each level is cut by a checkpoint and keeps the first way to each base.
    """
    at = classes.select("cls", F.col("cls").alias("owner"), F.array(F.struct(F.lit(0).cast("long").alias("line"), F.col("cls").alias("id"))).alias("way"))
    all_ = now = at = cut(at.distinct())
    while True:
        step = now.join(inherits.select(F.col("cls").alias("owner"), "base", "line"), "owner")
        step = step.select("cls", F.col("base").alias("owner"), F.array_append("way", F.struct(F.col("line").cast("long").alias("line"), F.col("base").alias("id"))).alias("way"))
        # a base met before was met by a shorter way, which all ways beyond it share
        first = step.groupBy("cls", "owner").agg(F.min("way").alias("way"))
        # a union keeps no hint of its parts
        now = cut(first.join(all_.select("cls", "owner").hint("merge"), ["cls", "owner"], "left_anti"))
        if now.isEmpty():
            break
        all_ = all_.union(now)
    rank = F.struct(F.size("way").alias("n"), F.col("way"))
    return all_.hint("merge").join(methods, "owner").groupBy("cls", "name").agg(F.min_by("owner", rank).alias("owner"))
