"""Engine tables over the star-schema Parquet files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _path(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


class Views:
    """Lazily built tables: artifacts, links, tags, aliases, symbols, calls, members, posts, scopes, logs, texts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def artifacts(self) -> DataFrame:
        t, none = self.table, F.lit(None).cast("string")
        parts = [
            t("region").select(_path("region", "r_regionkey").alias("path"), F.lit("concept").alias("kind"), F.col("r_name").alias("title"), F.lit("active").alias("status"), F.format_string("CN-%03d", F.col("r_regionkey").cast("int")).alias("code")),
            t("nation").select(_path("nation", "n_nationkey"), F.lit("convention"), "n_name", F.when(F.col("n_nationkey") % 5 == 0, "deprecated").otherwise("active"), F.format_string("CV-%03d", F.col("n_nationkey").cast("int"))),
            t("supplier").select(_path("supplier", "s_suppkey"), F.lit("playbook"), "s_name", F.lit("active"), F.format_string("PB-%03d", F.col("s_suppkey").cast("int"))),
            t("customer").select(_path("customer", "c_custkey"), F.lit("design"), "c_name", F.lit("active"), F.format_string("DS-%03d", F.col("c_custkey").cast("int"))),
            t("orders").select(_path("orders", "o_orderkey"), F.lit("stack"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("stale"), F.format_string("ST-%03d", F.col("o_orderkey").cast("int"))),
            t("part").select(_path("part", "p_partkey"), F.lit("source"), "p_name", none, none),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    @cached_property
    def links(self) -> DataFrame:
        return self._links(lambda lines: lines.distinct())

    @cached_property
    def link_rows(self) -> DataFrame:
        """links, those of several lines of an order once a line: for operators whose results are distinct, it needs no shuffle."""
        return self._links(lambda lines: lines)

    def _links(self, of_lines) -> DataFrame:
        t = self.table
        line = t("lineitem")
        return (
            t("nation").select(_path("nation", "n_nationkey").alias("source"), _path("region", "n_regionkey").alias("target"), F.lit("convention_concept_ref").alias("link_type"))
            .union(t("customer").select(_path("customer", "c_custkey"), _path("nation", "c_nationkey"), F.lit("wikilink")))
            .union(t("supplier").select(_path("supplier", "s_suppkey"), _path("nation", "s_nationkey"), F.lit("wikilink")))
            .union(t("orders").select(_path("orders", "o_orderkey"), _path("customer", "o_custkey"), F.lit("stack_concept_ref")))
            .union(of_lines(line.select(_path("orders", "l_orderkey"), _path("part", "l_partkey"), F.lit("stack_file_ref"))))
            .union(of_lines(line.select(_path("orders", "l_orderkey"), _path("supplier", "l_suppkey"), F.lit("design_stack_ref"))))
        )

    @cached_property
    def cyclic(self) -> DataFrame:
        d = self.table("documents").select("doc_id")
        n = d.agg(F.count(F.lit(1)).alias("n"))
        d = d.crossJoin(F.broadcast(n))  # one row
        a = d.select(F.col("doc_id").alias("source"), ((F.col("doc_id") * 3 + 1) % F.col("n")).alias("target"))
        return a.union(d.select("doc_id", (F.col("doc_id") * 7 + 2) % F.col("n"))).distinct().withColumn("link_type", F.lit("ast_import"))

    @cached_property
    def tags(self) -> DataFrame:
        d = self.table("documents").join(self.table("labels"), "doc_id", "left")
        each = F.array(F.col("lang"), F.col("source"), F.concat(F.lit("quality-"), F.col("quality").cast("string")), F.concat(F.lit("toxic-"), F.col("toxic").cast("string")))
        return d.select("doc_id", F.explode(each).alias("tag")).where("tag IS NOT NULL")

    @cached_property
    def aliases(self) -> DataFrame:
        p = self.table("part").select(_path("part", "p_partkey").alias("path"), F.upper("p_name").alias("alias"), F.col("p_partkey").cast("long").alias("pos"))
        return p.union(self.table("nation").select(_path("nation", "n_nationkey"), F.lower("n_name"), F.col("n_nationkey").cast("long")))

    @cached_property
    def symbols(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ("function", "method", "class", "enum", "constant"))), (F.col("p_size") % 5 + 1).cast("int"))
        return self.table("part").select(
            F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("qualified_name"), kind.alias("symbol_type"),
            F.col("p_partkey").cast("long").alias("line_start"), (F.col("p_partkey") + F.col("p_size")).cast("long").alias("line_end"), F.when(F.col("p_size") % 3 == 0, "private").otherwise("public").alias("visibility"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
        c = self.table("lineitem").select(F.col("l_partkey").cast("long").alias("caller"), F.lead("l_partkey").over(w).cast("long").alias("callee"), F.col("l_linenumber").cast("long").alias("line"))
        return c.where("callee IS NOT NULL").distinct()

    @cached_property
    def members(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("long").alias("symbol"), F.col("p_name").alias("name"), F.col("p_type").alias("value"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("ordinal"))

    @cached_property
    def class_edges(self) -> DataFrame:
        """Every class inherits from the class, if it is one, at half its number."""
        s = self.symbols
        up = s.select(F.col("id").alias("source"), F.floor(F.col("id") / 2).alias("target")).where("source > 0")
        return up.withColumn("edge_type", F.when(F.col("source") % 3 == 0, "instantiates").otherwise("inherits")).withColumn("line", F.col("source"))

    @cached_property
    def posts(self) -> DataFrame:
        c = self.table("conversations")
        f = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("votes"), F.max_by("text", "turn").alias("last"), F.min_by("text", "turn").alias("problem"))
        status = F.element_at(F.array(*map(F.lit, ("open", "resolved", "outdated", "duplicate", "stale"))), (F.col("conv_id") % 5 + 1).cast("int"))
        return f.select(F.col("conv_id").alias("post"), "votes", "problem", "last", status.alias("status"))

    @cached_property
    def rules(self) -> DataFrame:
        """Conventions: each page's directory, its priority, and its place in the directory by page."""
        p = self.table("pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]*)/[^/?#]*", 1).alias("directory"))
        o = F.row_number().over(W.partitionBy("directory").orderBy("page_id")) - 1
        status = F.when(F.col("page_id") % 6 == 0, "deprecated").when(F.col("page_id") % 6 == 1, "draft").otherwise("active")
        return p.select("page_id", "directory", (F.col("page_id") % 7).cast("int").alias("priority"), status.alias("status"), o.cast("int").alias("ordinal"))

    @cached_property
    def log(self) -> DataFrame:
        action = F.create_map(*[F.lit(x) for kv in {"view": "unchanged", "click": "updated", "purchase": "created", "error": "failed", "signup": "deleted"}.items() for x in kv])
        return self.table("events").select("event_id", F.to_date("ts").alias("build_started"), action[F.col("event_type")].alias("action"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"))

    @cached_property
    def texts(self) -> DataFrame:
        d = self.table("documents")
        return d.select("doc_id", F.split("text", "\n", 2)[0].alias("title"), F.coalesce(F.get(F.split("text", "\n", 2), F.lit(1)), F.lit("")).alias("body"), "text", "lang", "source")
