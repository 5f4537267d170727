"""Filter interaction audit: how the order of five filters decides which of them removes a document."""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_UPPER, _INNER = bytes(range(65, 91)), bytes(range(128, 192))


def _judge():
    def judge(texts: list[bytes]) -> list[list]:
        fails, digests = [], []
        for b in texts:
            words, points = b.split(), len(b.translate(None, _INNER))  # bytes split at \x20 and \x09-\x0D; inner bytes of a character go
            n, upper = len(words), len(b) - len(b.translate(None, _UPPER))
            failed = (n < MIN_WORDS, 100 * len(set(words)) < DISTINCT * n, 100 * upper > CAPITALS * points, len(b.translate(None, SIGNS)) < len(b))
            fails.append(sum(x << i for i, x in enumerate(failed)))
            digests.append(hashlib.sha256(b).digest())
        return [fails, digests]

    return judge


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, source and mask for every row of docs (doc_id, text, source): bit i is set where the text fails filter i of ABCDE.

    A under 50 words (maximal `[^\\x20\\x09-\\x0D]+`), B under 65 % different words, C over 5 % of characters in A-Z, D one of
    `#$%&*|`, E the text of some smaller doc_id, whatever else that one fails. A null text counts as empty, so it equals an
    empty one; a null doc_id is not smaller than any and none is smaller. Whole texts are read; equal texts are those of equal
    SHA-256. The smallest doc_id of a text comes from a grouped minimum and is joined by (doc_id, digest), so that a text with
    very many copies is no hot key.
    """
    d = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    d = materialize(map_texts(d, _judge, "fails int, digest binary"), "fails")
    first = d.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    e = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return d.join(first.hint("merge"), ["doc_id", "digest"], "left").select("doc_id", "source", (F.col("fails") + e).alias("mask"))


def lattice_edges() -> list[tuple[int, int]]:
    """(filters already applied as a mask, next filter): the 80 edges of the lattice of subsets."""
    n = len(FILTERS)
    return [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each source (part), each of the 120 orders of the filters and each step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    What a step does depends only on the set of filters applied before it and on its filter, not on their order. So documents
    are counted by source, mask and labels, those counts go to the 80 edges of the lattice of subsets, and the 600 steps of the
    orders are paths over the summed edges. shapley sums removed over all orders, in which an edge lies as often as its subset
    and the rest can be ordered.

    labels: (doc_id, quality, toxic); where a doc_id has several rows, any quality = 1 or toxic = 1 counts. A document is a row
    of docs: rows that repeat a doc_id count each. A null source is the part ''. Every occurring part has 600 rows, with zeros;
    an empty table has none. Other columns are not read, whatever their names. For nulls and ties of texts see failures.
    """
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    marked = failures(docs).join(marks.hint("merge"), "doc_id", "left")
    kinds = marked.groupBy(F.col("source").alias("part"), "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    # at most 128 kinds a part, which meet 80 edges
    mask, bit = F.col("mask"), F.col("bit")
    fails, alive = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(F.col("applied")) == 0
    cases = {"kept": ~fails & alive, "removed": fails & alive, "redundant": fails & ~alive, "unique_fails": mask == bit, "good_lost": fails & alive & (F.col("good") == 1), "toxic_lost": fails & alive & (F.col("toxic") == 1)}
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for s, f in lattice_edges()]))
    met = kinds.withColumn("e", pairs).select("part", "mask", "good", "toxic", "n", "e.applied", "e.filter", "e.bit")
    edges = met.groupBy("part", "applied", "filter").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long").alias(k) for k, c in cases.items()])
    return _paths(spark, edges)


def _paths(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The edges' counts at each step of each order, with shapley."""
    steps = [("".join(FILTERS[f] for f in order), i + 1, sum(1 << f for f in order[:i]), f) for order in permutations(range(len(FILTERS))) for i, f in enumerate(order)]
    table = spark.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    often = table.groupBy("applied", "filter").agg(F.count(F.lit(1)).alias("orders"))
    shapley = edges.join(F.broadcast(often), ["applied", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))  # 80 rows
    paths = edges.join(F.broadcast(table), ["applied", "filter"])  # 600 rows
    return paths.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def oracle_sql() -> str:
    """The same in DuckDB SQL over documents and labels."""
    words = "list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    at = lambda i: f"instr('{FILTERS}', substr(o, {i}, 1)) - 1"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS part FROM documents),
f AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
m AS (SELECT doc_id, part, {words} AS ws, x, coalesce(doc_id > first, false) AS e FROM t JOIN f USING (x)),
k AS (SELECT doc_id, part, (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {DISTINCT} * len(ws))::INT
        + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > {CAPITALS} * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * e::INT AS mask FROM m),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM k LEFT JOIN l USING (doc_id) GROUP BY ALL),
s1 AS (SELECT unnest(string_split('{FILTERS}', '')) AS a),
o AS (SELECT p.a || q.a || r.a || s.a || t.a AS o FROM s1 p, s1 q, s1 r, s1 s, s1 t WHERE len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
st AS (SELECT o, step, (1 << ({at("step")})) AS bit, list_sum(list_transform(range(1, step), lambda i: 1 << ({at("i")})))::INT AS applied FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, o AS filter_order, step, bit, sum(n) FILTER (WHERE mask & (coalesce(applied, 0) | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & coalesce(applied, 0) = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (WHERE mask & coalesce(applied, 0) > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
        sum(n) FILTER (WHERE mask & coalesce(applied, 0) = 0 AND mask & bit > 0 AND good = 1) AS good_lost, sum(n) FILTER (WHERE mask & coalesce(applied, 0) = 0 AND mask & bit > 0 AND toxic = 1) AS toxic_lost
      FROM c, st GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in COUNTS)}, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""
