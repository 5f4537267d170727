"""Registered queries over the engine tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import norm as N
from ..functions.text_udf import stem
from ..operators import build as B
from ..operators import checks as K
from ..operators import delta as D
from ..operators import globs as G
from ..operators import incremental as I
from ..operators import indexes as X
from ..operators import js as J
from ..operators import linkgraph as L
from ..operators import lookup as Q
from ..operators import resolve as R
from ..operators import symbol_build as Z
from ..operators import symbols as Y
from ..operators import text as T
from ..operators import traverse as V
from ..operators.close import close_matches
from ..operators.symbol_delta import SymbolStore
from ..operators.text_index import TextIndex
from ..sources import artifacts as A
from ..sources import python_code as P
from ..sources.views import Views
from .oracle_views import complete

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = complete(sql)
        return f

    return add


def one(v: Views, **values) -> DataFrame:
    return v.spark.createDataFrame([tuple(values.values())], list(values))


# link graph


@query("SELECT path, kind, title, status, code FROM artifacts WHERE path = 'nation/5'")
def artifact_by_path(v):
    return L.by_path(v.artifacts, "nation/5")


@query("SELECT path, kind, title, status, code FROM artifacts WHERE code = 'PB-007'")
def artifact_by_code(v):
    return L.by_code(v.artifacts, "PB-007")


@query("SELECT n.name, a.path, a.kind FROM (VALUES ('RED widget'), ('Nation_3'), ('none')) n(name) JOIN (SELECT lower(alias) AS key, path FROM alias_rows QUALIFY row_number() OVER (PARTITION BY lower(alias) ORDER BY pos, path) = 1) x ON lower(n.name) = x.key JOIN artifacts a USING (path)")
def alias_lookup_nocase(v):
    names = v.spark.createDataFrame([("RED widget",), ("Nation_3",), ("none",)], "name string")
    return L.resolve_aliases(names, v.aliases, v.artifacts)


@query("SELECT a.path, a.kind, l.link_type FROM links l JOIN artifacts a ON a.path = l.source WHERE l.target = 'nation/3'")
def reverse_deps_all(v):
    return L.reverse_deps(v.links, v.artifacts, "nation/3")


@query("SELECT a.path, a.kind, l.link_type FROM links l JOIN artifacts a ON a.path = l.source WHERE l.target = 'part/7' AND l.link_type = 'stack_file_ref'")
def reverse_deps_typed(v):
    return L.reverse_deps(v.links, v.artifacts, "part/7", "stack_file_ref")


@query("SELECT DISTINCT a.path FROM links l JOIN artifacts a ON a.path = l.source WHERE l.target = 'customer/4' AND l.link_type = 'stack_concept_ref'")
def importers_sorted(v):
    return L.dependents(v.links, v.artifacts, "customer/4", "stack_concept_ref")


@query("SELECT doc_id FROM doc_tags WHERE tag IN ('en', 'quality-1', 'toxic-0') GROUP BY doc_id HAVING count(DISTINCT tag) = 3")
def tag_search_and(v):
    return L.with_all_tags(v.tags, "doc_id", ["en", "quality-1", "toxic-0"])


@query("WITH top AS (SELECT directory FROM rules GROUP BY directory ORDER BY count(*) DESC, directory LIMIT 3) SELECT page_id, directory, priority, ordinal, status FROM rules JOIN top USING (directory) WHERE status <> 'deprecated'")
def conventions_inherit(v):
    top = v.rules.groupBy("directory").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "directory").limit(3)
    dirs = [r["directory"] for r in top.collect()]  # three names, as a caller would pass
    return L.inherited_rules(v.rules, dirs).select("page_id", "directory", "priority", "ordinal", "status")


@query("SELECT page_id, directory, ordinal FROM rules")
def convention_ordinals(v):
    return L.ordinals(v.rules.select("page_id", "directory"), "directory", "page_id")


@query("SELECT action, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM log WHERE build_started = (SELECT max(build_started) FROM log) GROUP BY action")
def build_summary_latest(v):
    return L.latest_build(v.log)


@query("SELECT CAST(build_started AS VARCHAR) AS build_started, count(*) AS n FROM log WHERE build_started >= (SELECT max(build_started) FROM log) - INTERVAL 10 DAY GROUP BY 1")
def log_retention(v):
    return L.keep_recent(v.log, 10).groupBy(F.col("build_started").cast("string").alias("build_started")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT target AS path, 'concept' AS kind, true AS is_stub FROM (SELECT target FROM links UNION ALL SELECT 'nation/' || (n_nationkey + 20) FROM nation) WHERE target NOT IN (SELECT path FROM artifacts)")
def stubs_for_unresolved(v):
    extra = v.table("nation").select(F.lit("x").alias("source"), F.concat(F.lit("nation/"), (F.col("n_nationkey") + 20).cast("string")).alias("target"), F.lit("wikilink").alias("link_type"))
    return L.stubs(v.links.union(extra), v.artifacts)


@query("SELECT (SELECT count(*) FROM artifacts) AS artifacts, (SELECT count(*) FROM links) AS links")
def index_health(v):
    return L.health(v.artifacts, v.links)


_WALK = """WITH RECURSIVE w AS (SELECT e.a AS start, e.b AS node, 1 AS depth, link_type, [e.a, e.b] AS seen FROM e WHERE e.a = {start}
UNION ALL SELECT w.start, e.b, w.depth + 1, e.link_type, list_append(w.seen, e.b) FROM w JOIN e ON e.a = w.node WHERE w.depth < {depth} AND NOT list_contains(w.seen, e.b))"""


def _walk(edges: str, inbound: bool, start: str, depth: int, rest: str) -> str:
    a, b = ("target", "source") if inbound else ("source", "target")
    body = _WALK.format(start=start, depth=depth).removeprefix("WITH RECURSIVE ")
    return f"WITH e AS (SELECT {a} AS a, {b} AS b, link_type FROM {edges}), {body} {rest}"


@query(_walk("links", True, "'region/0'", 3, "SELECT DISTINCT node, depth, link_type FROM w"))
def traverse_in(v):
    return V.walk(v.link_rows, one(v, start="region/0"), 3, inbound=True).select("node", "depth", "link_type")


@query(_walk("links", False, "'orders/11'", 4, "SELECT DISTINCT node, depth, link_type FROM w"))
def traverse_out(v):
    return V.walk(v.link_rows, one(v, start="orders/11"), 4).select("node", "depth", "link_type")


@query(_walk("(SELECT * FROM links WHERE link_type IN ('wikilink', 'convention_concept_ref'))", True, "'region/1'", 3, "SELECT DISTINCT node, depth, link_type FROM w"))
def traverse_typed(v):
    return V.walk(v.link_rows, one(v, start="region/1"), 3, inbound=True, types=["wikilink", "convention_concept_ref"]).select("node", "depth", "link_type")


@query(_walk("cyclic", False, "33", 5, "SELECT DISTINCT node, depth FROM w"))
def traverse_cyclic_depth5(v):
    return V.walk(v.cyclic, one(v, start=33), 5).select("node", "depth")


@query(_walk("links", True, "'nation/3'", 2, "SELECT DISTINCT w.node AS path, a.kind, a.title, w.depth, w.link_type, coalesce(o.p, '') AS open_posts FROM w LEFT JOIN artifacts a ON a.path = w.node LEFT JOIN (SELECT l.target, string_agg(DISTINCT x.path || ' (' || x.title || ')', '; ' ORDER BY x.path || ' (' || x.title || ')') AS p FROM links l JOIN artifacts x ON x.path = l.source WHERE x.kind = 'stack' AND x.status = 'open' GROUP BY l.target) o ON o.target = w.node"))
def impact_enriched(v):
    s = v.artifacts.where("kind = 'stack'").select("path", "title", "status")
    posts = s.join(v.link_rows.select(F.col("source").alias("path"), F.col("target").alias("about")), "path")
    return V.impact(v.link_rows, v.artifacts, posts, "nation/3", 2)


@query(_walk("links", True, "'nation/2'", 3, "SELECT node AS path, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS reach FROM w GROUP BY node"))
def cascade_split(v):
    return V.cascade(v.link_rows, "nation/2", 3)


@query("""WITH s AS (SELECT 17 AS id), up AS (SELECT id FROM s UNION SELECT caller FROM calls WHERE callee = 17), down AS (SELECT id FROM s UNION SELECT callee FROM calls WHERE caller = 17)
SELECT DISTINCT caller, callee, line, 'callers' AS side FROM calls WHERE callee IN (SELECT id FROM up) UNION ALL SELECT DISTINCT caller, callee, line, 'callees' FROM calls WHERE caller IN (SELECT id FROM down)""")
def call_context_bfs(v):
    return V.call_context(v.calls, one(v, start=17), 2)


@query("""WITH RECURSIVE r AS (SELECT id FROM symbols WHERE symbol_type = 'enum' UNION SELECT e.source FROM r JOIN class_edges e ON e.target = r.id WHERE e.edge_type = 'inherits') SELECT id FROM r""")
def enum_promotion_closure(v):
    up = v.class_edges.where("edge_type = 'inherits'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return V.closure(up, v.symbols.where("symbol_type = 'enum'").select(F.col("id").alias("start"))).select(F.col("node").alias("id"))


# symbol graph

_S = "id, file, name, qualified_name, symbol_type, line_start, line_end, visibility"


@query(f"SELECT {_S} FROM symbols WHERE name = 'red widget'")
def symbols_by_name(v):
    return Y.named(v.symbols, "red widget")


@query(f"SELECT {_S} FROM symbols WHERE qualified_name LIKE 'Brand#17.red widget.1'")
def symbols_by_qualified_name(v):
    return Y.named(v.symbols, "Brand#17.red widget.1", qualified=True)


@query(f"SELECT {_S} FROM symbols WHERE file = 'Brand#4'")
def symbols_in_file(v):
    return Y.in_file(v.symbols, "Brand#4")


@query(f"SELECT {_S} FROM symbols WHERE id IN (SELECT symbol FROM members WHERE lower(value) LIKE '%econ%')")
def symbols_member_value_like(v):
    return Y.by_member_value(v.symbols, v.members, "EcoN").select(*_S.split(", "))


@query("SELECT c.caller, s.name AS caller_name, s.file AS caller_file, c.line FROM calls c JOIN symbols s ON s.id = c.caller WHERE c.callee = 42")
def callers_of(v):
    return Y.callers_of(v.symbols, v.calls, 42)


@query("SELECT c.callee, s.name AS callee_name, s.file AS callee_file, c.line FROM calls c JOIN symbols s ON s.id = c.callee WHERE c.caller = 42")
def callees_of(v):
    return Y.callees_of(v.symbols, v.calls, 42)


@query("SELECT s.id, s.name, coalesce(a.n, 0) AS callers, coalesce(b.n, 0) AS callees FROM symbols s LEFT JOIN (SELECT callee, count(*) AS n FROM calls GROUP BY callee) a ON a.callee = s.id LEFT JOIN (SELECT caller, count(*) AS n FROM calls GROUP BY caller) b ON b.caller = s.id")
def symbol_call_counts(v):
    return Y.call_counts(v.symbols, v.calls)


@query("SELECT e.source, e.edge_type, e.target, s.file AS target_file, e.line FROM class_edges e JOIN symbols s ON s.id = e.target")
def class_edges_out(v):
    return Y.class_edges_from(v.symbols, v.class_edges)


@query("SELECT source, edge_type, target, line FROM (SELECT source, edge_type, CASE WHEN source % 10 = 0 THEN target + 1000000 ELSE target END AS target, line FROM class_edges) WHERE target NOT IN (SELECT id FROM symbols)")
def class_edges_unresolved(v):
    """All edges, those of a tenth of the sources led astray."""
    e = v.class_edges.withColumn("target", F.when(F.col("source") % 10 == 0, F.col("target") + 1000000).otherwise(F.col("target")))
    return Y.unresolved_edges(v.symbols, e)


@query("SELECT symbol, name, value, ordinal, row_number() OVER (PARTITION BY symbol ORDER BY ordinal NULLS LAST, name) AS place FROM members")
def members_nulls_last(v):
    """All members, each placed within its symbol."""
    return v.members.withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy(F.asc_nulls_last("ordinal"), "name")).cast("long")).select("symbol", "name", "value", "ordinal", "place")


@query("""WITH a AS (SELECT id, name, 0.0 AS score FROM symbols WHERE lower(name) LIKE '%ring%' OR lower(qualified_name) LIKE '%ring%' UNION ALL SELECT id, name, 0.5 FROM symbols WHERE id IN (SELECT symbol FROM members WHERE lower(value) LIKE '%ring%'))
SELECT id, name, CAST(min(score) AS DOUBLE) AS score FROM a GROUP BY id, name ORDER BY score, name, id LIMIT 20""")
def symbol_search_two_pass(v):
    return Y.search(v.symbols, v.members, "ring", 20)


@query("SELECT DISTINCT name FROM symbols ORDER BY name LIMIT 200")
def symbol_names(v):
    return Y.distinct_names(v.symbols)


@query("""SELECT s.id, s.qualified_name, (SELECT count(DISTINCT caller) FROM calls WHERE callee = s.id) AS callers, (SELECT count(DISTINCT callee) FROM calls WHERE caller = s.id) AS callees,
(SELECT count(DISTINCT source) FROM class_edges WHERE target = s.id) AS children, (SELECT count(DISTINCT value) FROM members WHERE symbol = s.id) AS vals FROM symbols s WHERE s.name = 'red widget'""")
def trace_nested(v):
    t = Y.trace(v.symbols, v.calls, v.class_edges, v.members, "red widget")
    n = lambda c, a: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(a)
    t = t.select("id", "qualified_name", *[F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")).alias(c) for c in ("callers", "callees", "children", "values")])
    return t.select("id", "qualified_name", n("callers", "callers"), n("callees", "callees"), n("children", "children"), n("values", "vals"))


@query("""WITH s AS (SELECT doc_id AS file, md5(text) AS hash FROM documents), c AS (SELECT doc_id AS file, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT s.file, CASE WHEN c.hash IS NULL THEN 'missing' ELSE 'changed' END AS state FROM s LEFT JOIN c USING (file) WHERE s.hash IS DISTINCT FROM c.hash""")
def stale_hash_files(v):
    d = v.table("documents")
    now = F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return Y.stale(d.select(F.col("doc_id").alias("file"), F.md5("text").alias("hash")), d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("file"), now.alias("hash")))


@query("""WITH k AS (SELECT file, id, name, symbol_type, row_number() OVER (PARTITION BY file ORDER BY line_start, id) AS rank, count(*) OVER (PARTITION BY file) AS total FROM symbols WHERE symbol_type = 'method' OR symbol_type IN ('function', 'class') AND visibility = 'public') SELECT * FROM k WHERE rank <= 10""")
def key_symbols_cap10(v):
    return Y.key_symbols(v.symbols).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT c.id, c.name, (SELECT count(*) FROM class_edges e JOIN symbols s ON s.id = e.target WHERE e.source = c.id AND e.edge_type = 'inherits') AS bases,
(SELECT count(*) FROM class_edges e WHERE e.source = c.id AND e.edge_type = 'inherits' AND e.target NOT IN (SELECT id FROM symbols)) AS unresolved, (SELECT count(*) FROM class_edges e WHERE e.target = c.id AND e.edge_type = 'inherits') AS subclasses,
(SELECT count(*) FROM symbols m WHERE m.symbol_type = 'method' AND m.file = c.file AND m.line_start > c.line_start AND m.line_start <= c.line_end) AS methods FROM symbols c WHERE c.symbol_type = 'class'""")
def class_hierarchy_counts(v):
    return Y.class_hierarchy(v.symbols, v.class_edges)


@query("""SELECT m.id, arg_max(c.id, c.line_start * 10000000 + c.id) AS cls FROM symbols m JOIN symbols c ON c.symbol_type = 'class' AND c.file = m.file AND c.line_start < m.line_start AND m.line_start <= c.line_end WHERE m.symbol_type = 'method' GROUP BY m.id""")
def enclosing_class_range_join(v):
    return Y.enclosing_class(v.symbols)


@query("""WITH s AS (SELECT conv_id AS doc, turn AS pos, CAST(greatest(0, length(text) // 4) AS BIGINT) AS tokens FROM conversations), b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
l AS (SELECT *, coalesce(max(CASE WHEN before + tokens > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM b)
SELECT doc, pos, CAST(CASE WHEN before + tokens <= 300 THEN tokens ELSE 300 - before END AS BIGINT) AS given, before + tokens > 300 AS truncated FROM l WHERE late = 0 AND (before + tokens <= 300 OR 300 - before > 50)""")
def lookup_budget_running_sum(v):
    s = v.table("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), N.token_estimate("text").cast("long").alias("tokens"))
    return Y.budgeted(s, 300)


@query("""WITH t AS (SELECT count(*) AS total FROM posts WHERE status <> 'stale') SELECT post, status, votes, total FROM posts, t WHERE status <> 'stale' ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'resolved' THEN 1 WHEN 'outdated' THEN 2 WHEN 'duplicate' THEN 3 ELSE 9 END, votes DESC, post LIMIT 3""")
def known_issues_ranked(v):
    return X.known_issues(v.posts)


@query("SELECT s.file AS directory, count(*) AS imports, count(DISTINCT c.caller) AS importers FROM calls c JOIN symbols s ON s.id = c.callee GROUP BY s.file")
def dir_import_counts(v):
    s = v.symbols.select(F.col("id").alias("callee"), F.col("file").alias("directory"))
    return v.calls.join(s, "callee").groupBy("directory").agg(F.count(F.lit(1)).alias("imports"), F.countDistinct("caller").alias("importers"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status IN ('deprecated', 'stale')) AS old FROM artifacts GROUP BY kind")
def status_dashboard(v):
    return v.artifacts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status").isin("deprecated", "stale")).alias("old"))


# full text and search

_INDEXES: dict[tuple, TextIndex] = {}


def _text_index(v):
    """The stored index of a table of documents, made when it is first asked for; files that change make another."""
    files = sorted(v.table("documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect())
    key = (v.spark.sparkContext.applicationId, *files)
    if key not in _INDEXES:
        index = TextIndex(v.spark, f"{V.shared_folder(v.spark)}/text-{uuid.uuid4().hex}", buckets=64)
        index.build(v.texts, "title", "body")
        _INDEXES[key] = index
    return _INDEXES[key]

_BM = """t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS av FROM sizes), d AS (SELECT i, CAST(count(*) AS DOUBLE) AS df FROM h GROUP BY i),
r AS (SELECT h.doc_id, -sum(CASE WHEN n - df + 0.5 > df + 0.5 THEN greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS rank, sum(CASE WHEN i = 0 THEN 1 ELSE 0 END) AS h0, sum(CASE WHEN i > 0 THEN 1 ELSE 0 END) AS hx
FROM h JOIN d USING (i) JOIN sizes USING (doc_id), t GROUP BY h.doc_id)"""


@query(f"WITH h AS (SELECT doc_id, 0 AS i, count(*) AS tf FROM words WHERE term = 'idiot' GROUP BY doc_id), {_BM} SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY r.rank, doc_id LIMIT 20")
def fts_bm25_term(v):
    return _text_index(v).bm25([["idiot"]]).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"WITH h AS (SELECT doc_id, 0 AS i, count(*) AS tf FROM words WHERE term = 'idiot' GROUP BY doc_id), {_BM} SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY r.rank, doc_id LIMIT 20")
def fts_bm25_term_scanned(v):
    """Without an index."""
    p = T.postings(v.texts, "doc_id", "title", "body")
    return T.bm25(p, v.texts, "doc_id", [["idiot"]]).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"WITH h AS (SELECT doc_id, i, count(*) AS tf FROM words JOIN (VALUES ('clown', 0), ('the', 1), ('idiot', 2)) q(term, i) USING (term) GROUP BY ALL), {_BM} SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY r.rank, doc_id LIMIT 30")
def fts_bm25_any_of_three(v):
    return _text_index(v).bm25([["clown"], ["the"], ["idiot"]], limit=30).select("doc_id", F.round("rank", 6).alias("rank"))


@query("""WITH t3 AS (SELECT doc_id, pos, term AS a, lead(term) OVER w AS b, lead(term, 2) OVER w AS c FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), q AS (SELECT a, b, c FROM t3 WHERE pos = 0 AND c IS NOT NULL ORDER BY doc_id LIMIT 1)
SELECT doc_id, CAST(count(*) AS INT) AS tf FROM t3 JOIN q USING (a, b, c) GROUP BY 1""")
def fts_phrase_of_three(v):
    """Documents with the first three words of the first document that has as many."""
    first = v.texts.select("doc_id", T.words(F.concat_ws(" ", "title", "body")).alias("w")).where(F.size("w") >= 3).orderBy("doc_id").select("w").first()
    return _text_index(v)._phrase(list(first["w"][:3])).select(F.col("doc").alias("doc_id"), "tf")


@query(f"""WITH h AS (SELECT a.doc_id, 0 AS i, count(*) AS tf FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'the' AND b.term = 'tionan' GROUP BY a.doc_id
UNION ALL SELECT doc_id, 1, count(*) FROM words WHERE term = 'the' GROUP BY doc_id UNION ALL SELECT doc_id, 2, count(*) FROM words WHERE term = 'tionan' GROUP BY doc_id), {_BM}
SELECT doc_id, round(rank, 6) AS rank FROM r WHERE h0 > 0 OR hx = 2 ORDER BY r.rank, doc_id LIMIT 20""")
def fts_bm25_phrase_or_and(v):
    return _text_index(v).search("the tionan").select("doc_id", F.round("rank", 6).alias("rank"))


@query()
def fts_bm25_stemmed(v):
    p = T.postings(v.texts, "doc_id", "title", "body", stem=stem)
    return T.bm25(p, v.texts, "doc_id", [["disgust"]]).select("doc_id", F.round("rank", 6).alias("rank"))


@query(r"""SELECT p_partkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[_\-./\s]+'), lambda t: lower(t)), lambda t: t <> ''), '|') AS tokens FROM (SELECT p_partkey, p_type || 'OfHTTPServer_' || replace(p_name, ' ', '-') || '.utf8Decoder' || p_size AS x FROM part)""")
def normalize_query_tokens(v):
    x = F.concat("p_type", F.lit("OfHTTPServer_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".utf8Decoder"), F.col("p_size").cast("string"))
    return v.table("part").select(F.col("p_partkey").alias("id"), F.array_join(N.tokens(x), "|").alias("tokens"))


@query("SELECT doc_id FROM texts WHERE lower(title || chr(10) || body) LIKE '%idiot clown%' OR (lower(title || chr(10) || body) LIKE '%idiot%' AND lower(title || chr(10) || body) LIKE '%clown%')")
def scan_search_and_fallback(v):
    return T.scan(v.texts, "Idiot clown", "title", "body").select("doc_id")


@query("""SELECT path, kind, status FROM artifacts WHERE kind IN ('concept', 'convention', 'stack') AND coalesce(status, 'active') NOT IN ('deprecated', 'stale')""")
def search_visible_hits(v):
    return v.artifacts.where(F.col("kind").isin("concept", "convention", "stack")).where(T.included()).select("path", "kind", "status")


@query("SELECT path, kind, coalesce(status, 'open') AS status FROM artifacts WHERE kind = 'stack' AND status = 'stale'")
def search_stale_posts(v):
    return v.artifacts.where(T.included("stale", kind="stack")).select("path", "kind", "status")


@query("SELECT doc_id FROM doc_tags WHERE tag = 'fr' INTERSECT SELECT doc_id FROM doc_tags WHERE tag = 'src3'")
def tag_route_with_scope(v):
    a = v.tags.where("tag = 'fr'").select("doc_id")
    return a.join(v.tags.where("tag = 'src3'").select("doc_id"), "doc_id", "left_semi").distinct()


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(x, '(?s)<!--.*?-->', '', 'g'), '\[\[([^\[\]]+)\]\]', 1), lambda t: trim(t)))), '|') AS n FROM (SELECT page_id, '[[ a' || (page_id % 3) || ']] <!-- [[b]] -->' || ' [[c]] [[a' || (page_id % 2) || ']]' AS x FROM pages)""")
def extract_links_no_comments(v):
    m = lambda k: (F.col("page_id") % k).cast("string")
    x = F.concat(F.lit("[[ a"), m(3), F.lit("]] <!-- [[b]] --> [[c]] [[a"), m(2), F.lit("]]"))
    return v.table("pages").select("page_id", F.array_join(F.array_sort(N.wikilinks(x)), "|").alias("n"))


@query(r"""SELECT page_id, CAST(len(list_distinct(list_filter(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), 'href="([^"]+)"', 1), lambda t: t <> ''))) AS INT) AS n FROM pages""")
def page_targets(v):
    t = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r'href="([^"]+)"'), 1)
    return v.table("pages").select("page_id", F.size(F.array_distinct(t)).alias("n"))


# resolution

_C = """cand AS (SELECT lower(code) AS key, kind, path AS target, 0 AS priority FROM artifacts WHERE code IS NOT NULL
UNION ALL SELECT lower(title), kind, path, CASE kind WHEN 'convention' THEN 1 WHEN 'concept' THEN 3 ELSE 5 END FROM artifacts WHERE kind IN ('convention', 'concept', 'playbook')
UNION ALL SELECT lower(alias), kind, path, CASE kind WHEN 'convention' THEN 2 WHEN 'concept' THEN 4 ELSE 6 END FROM alias_rows JOIN artifacts USING (path) WHERE kind IN ('convention', 'concept', 'playbook'))"""


@query(f"""WITH {_C}, n AS (SELECT lower(title) AS name FROM artifacts WHERE kind IN ('concept', 'convention', 'playbook') UNION ALL SELECT 'cv-003' UNION ALL SELECT 'nowhere')
SELECT n.name, c.kind, c.target FROM n LEFT JOIN (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, target) = 1) c ON c.key = n.name""")
def resolve_priority_chain(v):
    names = v.artifacts.where("kind IN ('concept', 'convention', 'playbook')").select(F.lower("title").alias("name"))
    names = names.union(v.spark.createDataFrame([("cv-003",), ("nowhere",)], "name string"))
    return R.by_priority(names, "name", R.wikilink_targets(v.artifacts, v.aliases, ["convention", "concept", "playbook"])).select("name", "kind", "target")


@query()
def link_suggestions(v):
    """Up to three close titles for each misspelt name: parts' names without their second letter."""
    names = v.table("part").select(F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"), F.lit("s")).alias("name"))
    return close_matches(names, v.table("part").select(F.col("p_name").alias("name")).union(v.table("nation").select("n_name")))


@query()
def did_you_mean(v):
    return T.suggestions(v.symbols.select("name"), "red wigdet")


@query("""WITH g AS (SELECT title, CASE pat WHEN 'Brand#1*' THEN '^Brand#1[^/]*$' WHEN 'Brand#?' THEN '^Brand#[^/]$' ELSE '^(?:.*/)?Brand#2[^/]*$' END AS re, 1 AS s FROM (VALUES ('one', 'Brand#1*'), ('two', 'Brand#?'), ('any', '**/Brand#2*')) x(title, pat))
SELECT DISTINCT f.file, g.title, g.s AS specificity FROM (SELECT DISTINCT file FROM symbols) f JOIN g ON regexp_matches(f.file, g.re)""")
def playbook_glob_match(v):
    p = v.spark.createDataFrame([("one", ["Brand#1*"]), ("two", ["Brand#?"]), ("any", ["**/Brand#2*"])], "title string, globs array<string>")
    return X.by_trigger(v.symbols.select("file").distinct(), p)


@query("SELECT post, votes FROM posts WHERE lower(problem) LIKE '%the%' OR lower(last) LIKE '%the%'")
def stack_search_votes(v):
    return X.search_posts(v.posts, "the", "problem", "last").select("post", "votes")


@query("""WITH p AS (SELECT doc_id, directory FROM (SELECT page_id AS doc_id, directory FROM rules)), r AS (SELECT page_id, directory, priority, printf('%05d', CAST(page_id AS INT)) AS title FROM rules), a AS (SELECT p.doc_id, '.' AS anc, 0 AS depth FROM p UNION ALL SELECT p.doc_id, array_to_string(string_split(p.directory, '/')[1:i], '/'), i FROM p, unnest(range(1, len(string_split(p.directory, '/')) + 1)) AS u(i)),
m AS (SELECT a.doc_id, r.page_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.depth, r.priority DESC, r.title) AS rank, count(*) OVER (PARTITION BY a.doc_id) AS total FROM a JOIN r ON r.directory = a.anc) SELECT doc_id, page_id, rank, total FROM m WHERE rank > total - 3""")
def rules_by_scope_limited(v):
    p = v.rules.select(F.col("directory").alias("path"), "page_id")
    r = v.rules.select(F.col("page_id").alias("rule"), "directory", "priority", F.format_string("%05d", F.col("page_id").cast("int")).alias("title"))
    found = X.rules_for(p.select("path").distinct(), r, 3)
    return p.join(found, "path").select(F.col("page_id").alias("doc_id"), F.col("rule").alias("page_id"), F.col("rank").cast("long").alias("rank"), "total")


# checks

_ISSUES = """WITH i AS (SELECT 'error' AS severity, 'file_existence' AS check_name, source AS artifact, target AS message FROM links WHERE link_type = 'stack_file_ref' AND CAST(split_part(target, '/', 2) AS INT) % 50 = 0
UNION ALL SELECT 'warning', 'deprecated_concept_usage', source, target FROM links WHERE target IN (SELECT path FROM artifacts WHERE status = 'deprecated')
UNION ALL SELECT 'warning', 'token_budgets', CAST(doc_id AS VARCHAR), CAST(greatest(1, length(text) // 4) AS VARCHAR) FROM documents WHERE greatest(1, length(text) // 4) > CASE lang WHEN 'en' THEN 400 ELSE 200 END
UNION ALL SELECT 'error', 'duplicate_aliases', path, key || ' x' || n FROM (SELECT path, lower(alias) AS key, count(*) OVER (PARTITION BY lower(alias)) AS n FROM alias_rows) WHERE n > 1)"""


def _issues(v: Views) -> DataFrame:
    refs = v.links.where("link_type = 'stack_file_ref'").select(F.col("source").alias("owner"), F.col("target").alias("ref"))
    have = v.artifacts.where("kind <> 'source' OR CAST(split_part(path, '/', 2) AS INT) % 50 <> 0")
    texts = v.table("documents").select("doc_id", "text", F.when(F.col("lang") == "en", "en").otherwise("other").alias("kind"))
    parts = [K.dangling(refs, "ref", have, "path"), K.deprecated_use(v.links, v.artifacts), K.over_budget(texts, "doc_id", "text", {"en": 400, "other": 200}), K.duplicates(v.aliases, N.ascii_lower("alias"), "path", "duplicate_aliases")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"{_ISSUES} SELECT severity, check_name, count(*) AS n FROM i GROUP BY severity, check_name")
def validation_union_summary(v):
    return K.summarize(_issues(v))


@query(f"{_ISSUES} SELECT CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 1 WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 2 ELSE 0 END AS exit_code FROM i")
def validation_exit_code(v):
    return K.exit_code(_issues(v))


@query("SELECT 'error' AS severity, 'file_existence' AS check_name, 'orders/' || o_orderkey AS artifact, 'customer/' || (o_custkey + 100) AS message FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def dangling_refs(v):
    o = v.table("orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("owner"), F.concat(F.lit("customer/"), (F.col("o_custkey") + 100).cast("string")).alias("ref"))
    return K.dangling(o, "ref", v.artifacts, "path")


@query("SELECT 'error' AS severity, 'symbol_frontmatter' AS check_name, CAST(symbol AS VARCHAR) AS artifact, 'missing ordinal' AS message FROM members WHERE ordinal IS NULL")
def required_fields(v):
    return K.required(v.members, "symbol", ["name", "value", "ordinal"], "symbol_frontmatter")


@query("SELECT 'error' AS severity, 'stack_frontmatter' AS check_name, CAST(post AS VARCHAR) AS artifact, 'bad status ' || status AS message FROM posts WHERE status NOT IN ('open', 'resolved', 'outdated', 'duplicate')")
def allowed_values(v):
    return K.allowed(v.posts, "post", "status", ["open", "resolved", "outdated", "duplicate"], "stack_frontmatter")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS src, CAST(o_orderkey % 40 AS BIGINT) AS dep FROM orders WHERE o_orderkey % 3 <> 0), g AS (SELECT DISTINCT o_custkey AS src, CAST(o_orderkey % 40 AS BIGINT) AS dep FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'warning' AS severity, 'bidirectional_deps' AS check_name, CAST(src AS VARCHAR) AS artifact, 'not in graph: ' || dep AS message FROM (SELECT * FROM d EXCEPT SELECT * FROM g) UNION ALL SELECT 'info', 'bidirectional_deps', CAST(src AS VARCHAR), 'not declared: ' || dep FROM (SELECT * FROM g EXCEPT SELECT * FROM d)""")
def bidirectional_drift(v):
    o = v.table("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 40).cast("long").alias("dep"), "o_orderkey")
    return K.drift(o.where("o_orderkey % 3 <> 0").select("src", "dep").distinct(), o.where("o_orderkey % 5 <> 0").select("src", "dep").distinct())


@query("SELECT 'error' AS severity, 'duplicate_slugs' AS check_name, CAST(p_partkey AS VARCHAR) AS artifact, replace(p_name, ' ', '-') || ' x' || n AS message FROM (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE n > 1")
def duplicate_names(v):
    return K.duplicates(v.table("part"), N.slugify("p_name"), "p_partkey", "duplicate_slugs")


@query("SELECT 'info' AS severity, 'supersession_candidate' AS check_name, 'part/' || p_partkey AS artifact, f AS message FROM (SELECT p_partkey, min('part/' || p_partkey) OVER (PARTITION BY replace(p_name, ' ', '')) AS f FROM part) WHERE 'part/' || p_partkey <> f")
def supersession_pairs(v):
    return K.supersession(v.artifacts.where("kind = 'source'").select("path", N.norm_concept("title").alias("name")))


@query("SELECT 'warning' AS severity, 'token_budgets' AS check_name, CAST(doc_id AS VARCHAR) AS artifact, CAST(greatest(1, length(text) // 4) AS VARCHAR) AS message FROM documents WHERE greatest(1, length(text) // 4) > 500")
def token_budget_violations(v):
    return K.over_budget(v.table("documents").withColumn("kind", F.lit("any")), "doc_id", "text", {"any": 500})


@query("SELECT 'info' AS severity, 'deprecated_ttl' AS check_name, CAST(event_id AS VARCHAR) AS artifact, CAST(date_diff('day', build_started, DATE '2024-01-31') AS VARCHAR) AS message FROM log WHERE action = 'deleted' AND date_diff('day', build_started, DATE '2024-01-31') > 20")
def deprecated_ttl(v):
    return K.expired(v.log.where("action = 'deleted'"), "event_id", F.datediff(F.lit("2024-01-31").cast("date"), "build_started"), 20, "deprecated_ttl")


@query("""WITH d AS (SELECT directory, count(*) AS n FROM rules GROUP BY directory HAVING count(*) >= 2) SELECT 'info' AS severity, 'convention_gap' AS check_name, directory AS artifact, CAST(n AS VARCHAR) AS message FROM d
WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.status = 'active' AND r.priority = 0 AND (r.directory = d.directory OR starts_with(d.directory, r.directory || '/')))""")
def convention_gap(v):
    return K.uncovered(v.rules.select("directory"), v.rules.where("priority = 0"), 2)


# maintenance and triage


@query("""SELECT c_custkey AS path, CAST(100 * CAST(c_custkey % 7 = 0 AS INT) + 50 * CAST(c_custkey % 3 = 0 AS INT) + 5 * coalesce(n, 0) AS BIGINT) AS priority FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def triage_priority(v):
    d = v.table("customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 3 == 0).alias("source_stale"), (F.col("c_custkey") % 7 == 0).alias("interface_stale"))
    return I.triage(d, v.table("orders").select(F.col("o_custkey").alias("path")))


@query(r"SELECT min(doc_id) AS key, count(*) AS n FROM documents GROUP BY sha256(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))")
def fingerprint_dedupe(v):
    return I.fingerprints(v.table("documents").select(F.col("doc_id").alias("key"), "text"), "text").select("key", "n")


@query("""WITH c AS (SELECT source AS directory, lang AS language, count(*) AS n FROM documents GROUP BY source, lang) SELECT directory, language, n, row_number() OVER (PARTITION BY directory ORDER BY n DESC, language) AS rank FROM c QUALIFY rank <= 3""")
def language_mix_top3(v):
    d = v.table("documents").select(F.col("source").alias("directory"), F.col("lang").alias("language"))
    return I.language_mix(d).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT p_brand AS directory, sha256(string_agg(p_name || '.' || p_partkey, chr(10) ORDER BY p_name || '.' || p_partkey)) AS hash FROM part GROUP BY p_brand")
def directory_hashes(v):
    return I.directory_hash(v.table("part").select(F.col("p_brand").alias("directory"), F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("name")))


_CASES = """SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 2 END AS ss, o_orderkey % 3 AS sd, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 5 END AS si, o_custkey % 2 AS ns, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_custkey % 3 END AS nd, CASE WHEN o_custkey % 19 <> 0 THEN o_custkey % 5 END AS ni, CASE WHEN o_orderkey % 2 = 0 THEN 'skeleton-fallback' ELSE 'agent' END AS who FROM orders"""


@query(f"""WITH c AS ({_CASES}) SELECT path, CASE WHEN nd IS NULL THEN 'new_file' WHEN ss IS NULL THEN 'agent_updated' WHEN ss = ns AND who = 'skeleton-fallback' THEN 'skeleton_only' WHEN ss = ns THEN 'unchanged' WHEN sd <> nd THEN 'agent_updated' WHEN ni IS NULL THEN 'content_changed' WHEN si IS NOT DISTINCT FROM ni THEN 'content_only' ELSE 'interface_changed' END AS level FROM c""")
def change_level_case(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = v.table("orders").select(k.alias("path"), F.when(k % 11 != 0, k % 2).alias("stored_source"), (k % 3).alias("stored_design"), F.when(k % 13 != 0, k % 5).alias("stored_interface"), (c % 2).alias("now_source"), F.when(c % 17 != 0, c % 3).alias("now_design"), F.when(c % 19 != 0, c % 5).alias("now_interface"), F.when(k % 2 == 0, "skeleton-fallback").otherwise("agent").alias("updated_by"))
    return I.change_level(d).select("path", "level")


@query("""WITH n AS (SELECT md5(text) AS h, min(doc_id) AS nw FROM documents WHERE doc_id % 2 = 1 GROUP BY h) SELECT doc_id AS old, nw AS new FROM documents JOIN n ON n.h = md5(text) WHERE doc_id % 2 = 0""")
def rename_by_hash(v):
    d = v.table("documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    return I.renames(d.where("path % 2 = 0"), d.where("path % 2 = 1"))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 NOT IN (0, 1) UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0""")
def incremental_merge(v):
    c = v.table("customer").select("c_custkey", "c_acctbal")
    return I.merge(c, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey", c.where("c_custkey % 10 = 1"))


@query("""SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'orphan' ELSE 'expired' END AS why FROM events WHERE user_id % 9 = 0 OR TIMESTAMP '2024-01-20' - ts > INTERVAL 72 HOUR""")
def signal_ttl_expiry(v):
    e = v.table("events").select("event_id", F.col("ts").alias("created"), (F.col("user_id") % 9 != 0).alias("dir_exists"))
    return I.expired_signals(e, F.lit("2024-01-20").cast("timestamp")).select("event_id", "why")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'concept' WHEN 1 THEN 'convention' WHEN 2 THEN 'playbook' WHEN 3 THEN 'stack' WHEN 4 THEN 'design' ELSE 'source' END AS kind FROM orders""")
def classify_paths(v):
    dirs = F.element_at(F.array(*map(F.lit, (".kb/concepts/", ".kb/conventions/", ".kb/playbooks/", ".kb/stack/", ".kb/designs/", "src/"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    d = v.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(dirs, F.lit("x.md")).alias("path"))
    return d.select("id", I.kind_of("path").alias("kind"))


@query("SELECT code, substr(code, 1, 2) AS prefix, CAST(substr(code, 4) AS INT) AS number, printf('%s-%03d', substr(code, 1, 2), CAST(substr(code, 4) AS INT) + 1) AS next FROM artifacts WHERE code IS NOT NULL AND kind <> 'stack'")
def artifact_codes(v):
    a = v.artifacts.where("code IS NOT NULL AND kind <> 'stack'")
    return a.select("code", N.code_prefix("code").alias("prefix"), N.code_number("code").alias("number"), N.make_code(N.code_prefix("code"), N.code_number("code") + 1).alias("next"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(v):
    from ..streaming.refresh import event_windows as windows

    return windows(v.table("events")).withColumn("total", F.round("total", 4))


def _sites(v):
    """Calls with receivers of every kind, and imports for some of them."""
    a = v.symbols.select(F.col("id").alias("caller"), "file")
    b = v.symbols.select(F.col("id").alias("callee"), "name", F.col("file").alias("bf"))
    c = V.stored(v.calls.join(a, "caller").join(b, "callee").withColumn("r", F.col("callee") % 6))
    receiver = F.when(F.col("r") == 1, "self").when(F.col("r") == 2, "super").when(F.col("r") == 3, F.concat(F.lit("m"), "bf")).when(F.col("r") == 4, F.concat(F.lit("p."), "bf", F.lit(".x"))).when(F.col("r") == 5, "obj")
    sites = c.select(F.concat_ws("/", "caller", "callee", "line").alias("site"), "file", "caller", receiver.alias("receiver"), "name")
    none = F.lit(None).cast("string").alias("original")
    modules = c.where("r = 3 AND bf > file").select("file", F.concat(F.lit("m"), "bf").alias("local"), F.col("bf").alias("module_file"), none)
    dotted = c.where("r = 4 AND bf < file").select("file", F.concat(F.lit("p."), "bf").alias("local"), F.col("bf").alias("module_file"), none)
    names = c.where("r = 5 AND bf <> file").groupBy("file", F.col("name").alias("local")).agg(F.min("bf").alias("module_file")).select("file", "local", "module_file", F.col("local").alias("original"))
    return sites, modules.distinct().union(dotted.distinct()).union(names)


_SITES = """site AS (SELECT c.caller || '/' || c.callee || '/' || c.line AS site, c.caller, a.file, b.name, b.file AS bf, c.callee % 6 AS r FROM calls c JOIN symbols a ON a.id = c.caller JOIN symbols b ON b.id = c.callee),
imp AS (SELECT DISTINCT file, 'm' || bf AS local, bf AS mf FROM site WHERE r = 3 AND bf > file UNION ALL SELECT DISTINCT file, 'p.' || bf, bf FROM site WHERE r = 4 AND bf < file UNION ALL SELECT file, name, min(bf) FROM site WHERE r = 5 AND bf <> file GROUP BY file, name)"""


@query(f"""WITH RECURSIVE {_SITES}, rc AS (SELECT *, CASE r WHEN 3 THEN 'm' || bf WHEN 4 THEN 'p.' || bf || '.x' WHEN 5 THEN 'obj' END AS receiver FROM site),
loc AS (SELECT file, name, min(id) AS id FROM symbols WHERE symbol_type IN ('function', 'class') GROUP BY 1, 2), own AS (SELECT m.id, arg_max(c.id, c.line_start) AS cls FROM symbols m JOIN symbols c ON c.symbol_type = 'class' AND c.file = m.file AND c.line_start < m.line_start AND m.line_start <= c.line_end WHERE m.symbol_type = 'method' GROUP BY m.id),
meth AS (SELECT o.cls, s.name, min(s.id) AS id FROM own o JOIN symbols s ON s.id = o.id GROUP BY 1, 2), up AS (SELECT DISTINCT cls AS c0, cls AS c, 0 AS d FROM own UNION ALL SELECT c0, e.target, d + 1 FROM up JOIN class_edges e ON e.source = up.c AND e.edge_type = 'inherits' WHERE d < 60),
selfhit AS (SELECT rc.site, arg_min(m.id, up.d) AS target FROM rc JOIN own ON own.id = rc.caller JOIN up ON up.c0 = own.cls JOIN meth m ON m.cls = up.c AND m.name = rc.name WHERE r = 1 GROUP BY rc.site),
k AS (SELECT rc.site, rc.name, l.id AS t3, i4.mf AS m4, i5.mf AS m5, i6.mf AS m6 FROM rc LEFT JOIN loc l ON l.file = rc.file AND l.name = rc.name LEFT JOIN imp i4 ON i4.file = rc.file AND i4.local = rc.receiver LEFT JOIN imp i5 ON i5.file = rc.file AND rc.r = 4 AND i5.local = 'p.' || rc.bf LEFT JOIN imp i6 ON i6.file = rc.file AND i6.local = rc.name WHERE r NOT IN (1, 2)),
x AS (SELECT *, CASE WHEN t3 IS NOT NULL THEN 3 WHEN m4 IS NOT NULL THEN 4 WHEN m5 IS NOT NULL THEN 5 WHEN m6 IS NOT NULL THEN 6 END AS step, coalesce(m4, m5, m6) AS mf FROM k), f AS (SELECT file, name, min(id) AS id FROM symbols GROUP BY 1, 2),
y AS (SELECT x.site, coalesce(t3, f.id) AS target, step FROM x LEFT JOIN f ON t3 IS NULL AND f.file = x.mf AND f.name = x.name)
SELECT s.site, s.file, s.name, coalesce(h.target, y.target) AS target, CASE WHEN h.target IS NOT NULL THEN 2 WHEN y.target IS NOT NULL THEN y.step END AS step FROM site s LEFT JOIN selfhit h ON h.site = s.site LEFT JOIN y ON y.site = s.site""")
def resolve_calls_ranked(v):
    sites, imports = _sites(v)
    inherits = v.class_edges.where("edge_type = 'inherits'").select(F.col("source").alias("cls"), F.col("target").alias("base"), "line")
    return R.resolve_calls(sites, v.symbols, imports, inherits)


@query(f"""WITH {_SITES}, cs AS (SELECT DISTINCT site, file, name, CASE r WHEN 4 THEN 'p.' || bf END AS prefix FROM site), loc AS (SELECT file, name, min(id) AS id FROM symbols WHERE symbol_type = 'class' GROUP BY 1, 2)
SELECT cs.site, coalesce(l.id, n.id, w.id) AS target, CASE WHEN l.id IS NOT NULL THEN 3 WHEN n.id IS NOT NULL THEN 4 ELSE 5 END AS step FROM cs LEFT JOIN loc l ON l.file = cs.file AND l.name = cs.name LEFT JOIN imp i ON i.file = cs.file AND i.local = cs.name LEFT JOIN loc n ON n.file = i.mf AND n.name = cs.name
LEFT JOIN imp p ON p.file = cs.file AND p.local = cs.prefix LEFT JOIN loc w ON w.file = p.mf AND w.name = cs.name WHERE coalesce(l.id, n.id, w.id) IS NOT NULL""")
def resolve_class_names(v):
    sites, imports = _sites(v)
    full = F.when(F.col("receiver").startswith("p."), F.concat(F.regexp_replace("receiver", r"\.x$", "."), "name")).otherwise(F.col("name"))
    return R.resolve_classes(sites.select("site", "file", full.alias("name")), v.symbols, imports)


@query(f"""WITH {_SITES} SELECT site.site, o.target FROM site LEFT JOIN (SELECT file, name, min(id) AS target FROM symbols WHERE symbol_type IN ('function', 'method', 'class') GROUP BY 1, 2 HAVING count(*) = 1) o ON o.file = site.file AND o.name = site.name""")
def resolve_same_file_only(v):
    return R.same_file_only(_sites(v)[0], v.symbols)


@query("""WITH n AS (SELECT lower(r_name) AS name FROM region UNION ALL SELECT printf('cn-%03d', CAST(r_regionkey AS INT)) FROM region UNION ALL SELECT 'Nowhere') SELECT n.name, coalesce(a.path, '.kb/concepts/' || n.name || '.md') AS path, a.path IS NULL AS is_stub FROM n LEFT JOIN artifacts a ON a.kind = 'concept' AND (lower(a.title) = lower(n.name) OR lower(a.code) = lower(n.name))""")
def concept_ref_resolution(v):
    r = v.table("region")
    names = r.select(F.lower("r_name").alias("name")).union(r.select(F.format_string("cn-%03d", F.col("r_regionkey").cast("int")))).union(v.spark.createDataFrame([("Nowhere",)], "name string"))
    return R.concept_refs(names, "name", v.artifacts.where("kind = 'concept'").select("path", "title", "code"), v.aliases.where("false").select("path", "alias"))


@query("""WITH n AS (SELECT 'Playbook: ' || upper(s_name) AS name FROM supplier UNION ALL SELECT s_name FROM supplier UNION ALL SELECT 'playbook:none') SELECT n.name, p.path FROM n LEFT JOIN (SELECT lower(title) AS k, min(path) AS path FROM artifacts WHERE kind = 'playbook' GROUP BY 1) p ON p.k = lower(trim(substr(n.name, 10))) WHERE lower(n.name) LIKE 'playbook:%'""")
def playbook_prefix_names(v):
    t = v.table("supplier")
    names = t.select(F.concat(F.lit("Playbook: "), F.upper("s_name")).alias("name")).union(t.select("s_name")).union(v.spark.createDataFrame([("playbook:none",)], "name string"))
    return R.playbook_names(names, "name", v.artifacts.where("kind = 'playbook'").select("path", "title"))


# graph build


def _parsed(v):
    s, i = "array<string>", lambda c: F.col(c).cast("string")
    none, no = F.lit(None).cast("string"), F.array().cast(s)
    at = lambda a, c: F.concat(F.lit(a), c if not isinstance(c, str) else i(c))
    row = lambda d, **k: d.select(*[k.get(c.split()[0], no if c.endswith(">") else none).cast(c.split()[1]).alias(c.split()[0]) for c in B.PARSED.split(", ")])
    link = lambda *x: F.concat_ws(" ", *[F.concat(F.lit("[["), y, F.lit(" ]]")) for y in x])
    code = lambda p, c: F.format_string(f"{p}-%03d", c.cast("int"))
    text = lambda c: c.cast("string")
    n, c, o, p = F.col("n_nationkey"), F.col("c_custkey"), F.col("o_orderkey"), F.col("s_suppkey")
    concept = row(v.table("nation"), path=at("c/", "n_nationkey"), kind=F.lit("concept"), title=F.col("n_name"), status=F.lit("active"), code=code("CN", n), body=link(at("Ghost ", text(n % 3))), tags=F.array(at("t", text(n % 4))), aliases=F.array(at("Alias ", text(n % 20))), files=F.array(at("src/", "n_nationkey"), at("src/", text(n + 100000000))), ok=n % 6 != 5)
    design = row(v.table("customer"), path=at("d/", "c_custkey"), kind=F.lit("design"), title=F.col("c_name"), body=link(at("alias-", text(F.col("c_nationkey") % 20)), code("CV", c % 10), at("PLAY ", text(c % 7))), tags=F.array(at("t", text(c % 4))), source=at("src/", "c_custkey"), imports=F.array(at("src/", text(c + 1)), at("src/", text(c + 2))), stack=F.array(at("s/", text(c % 50))), ok=c % 9 != 0, sections=F.array("c_name", "c_mktsegment"))
    post = row(v.table("orders"), path=at("s/", "o_orderkey"), kind=F.lit("stack"), title=at("Order ", "o_orderkey"), status=F.lit("open"), concepts=F.array(code("CN", o % 30), at("alias ", text(o % 40))), files=F.array(at("src/", text(o % 100))), ok=F.lit(True), sections=F.array(i("o_orderstatus"), i("o_orderpriority")))
    rule = row(v.table("supplier"), path=at("v/", "s_suppkey"), kind=F.lit("convention"), title=F.col("s_name"), status=F.lit("active"), code=code("CV", p), body=link(code("CN", p % 30), at("Alias ", text(p % 25))), aliases=F.array(at("alias ", text(p % 400 + 18))), directory=at("src/", text(p % 5)), priority=(p % 3), ok=F.lit(True))
    play = row(v.table("region"), path=at("p/", "r_regionkey"), kind=F.lit("playbook"), title=F.col("r_name"), aliases=F.array(at("Play ", "r_regionkey")), tags=F.array(F.lit("play")), ok=F.lit(True))
    return concept.union(design).union(post).union(rule).union(play), v.table("part").select(at("src/", "p_partkey").alias("path"))


def _build_sql(des="true", alias="'alias' || (n % 20)", play="true", present="true"):
    return f"""con AS (SELECT n_nationkey AS n, 'c/' || n_nationkey AS path, n_name AS title, printf('CN-%03d', CAST(n_nationkey AS INT)) AS code FROM nation WHERE n_nationkey % 6 <> 5),
des AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_custkey % 9 <> 0 AND {des}),
ccand AS (SELECT replace(replace(replace(lower(title), '-', ''), '_', ''), ' ', '') AS k, path FROM con UNION ALL SELECT {alias}, path FROM con),
cand AS (SELECT 'a:' || lower(s_name) AS k, 'v/' || s_suppkey AS path, 1 AS p FROM supplier UNION ALL SELECT 'a:alias ' || (s_suppkey % 400 + 18), 'v/' || s_suppkey, 2 FROM supplier UNION ALL SELECT 'c:' || k, path, 3 FROM ccand
UNION ALL SELECT 'a:' || lower(r_name), 'p/' || r_regionkey, 4 FROM region UNION ALL SELECT 'a:play ' || r_regionkey, 'p/' || r_regionkey, 4 FROM region WHERE {play}),
named AS (SELECT 'd/' || c AS source, 'alias-' || (n % 20) AS name, 'wikilink' AS link_type FROM des UNION ALL SELECT 'd/' || c, printf('CV-%03d', CAST(c % 10 AS INT)), 'wikilink' FROM des UNION ALL SELECT 'd/' || c, 'PLAY ' || (c % 7), 'wikilink' FROM des UNION ALL SELECT path, 'Ghost ' || (n % 3), 'wikilink' FROM con
UNION ALL SELECT 'v/' || s_suppkey, printf('CN-%03d', CAST(s_suppkey % 30 AS INT)), 'convention_concept_ref' FROM supplier UNION ALL SELECT 'v/' || s_suppkey, 'Alias ' || (s_suppkey % 25), 'convention_concept_ref' FROM supplier),
dn AS (SELECT name, unnest(['a:' || lower(name), 'c:' || replace(replace(replace(lower(name), '-', ''), '_', ''), ' ', '')]) AS k FROM (SELECT DISTINCT name FROM named)),
best AS (SELECT name, arg_min(path, (p, path)) AS path FROM dn JOIN cand USING (k) GROUP BY name),
cref AS (SELECT o_orderkey AS o, 'alias ' || (o_orderkey % 40) AS name, (SELECT min(path) FROM ccand WHERE k = 'alias' || (o_orderkey % 40)) AS path FROM orders UNION ALL SELECT o_orderkey, printf('CN-%03d', CAST(o_orderkey % 30 AS INT)), (SELECT path FROM con WHERE n = o_orderkey % 30) FROM orders),
built AS (SELECT DISTINCT * FROM (SELECT 'd/' || c AS source, 'src/' || c AS target, 'design_source' AS link_type FROM des UNION ALL SELECT 'src/' || c, 'src/' || (c + 1), 'ast_import' FROM des UNION ALL SELECT 'src/' || c, 'src/' || (c + 2), 'ast_import' FROM des
UNION ALL SELECT 'd/' || c, 's/' || (c % 50), 'design_stack_ref' FROM des UNION ALL SELECT path, 'src/' || n, 'concept_file_ref' FROM con WHERE n IN (SELECT p_partkey FROM part WHERE {present}) UNION ALL SELECT 's/' || o_orderkey, 'src/' || (o_orderkey % 100), 'stack_file_ref' FROM orders
UNION ALL SELECT source, coalesce(b.path, '.kb/concepts/' || name || '.md'), link_type FROM named LEFT JOIN best b USING (name) UNION ALL SELECT 's/' || o, coalesce(path, '.kb/concepts/' || name || '.md'), 'stack_concept_ref' FROM cref))"""


_BUILD = _build_sql()


@query(f"WITH {_BUILD} SELECT source, target, link_type FROM built")
def link_graph_links(v):
    return B.full_build(*_parsed(v))["links"]


_OWN = """own AS (SELECT path, 'concept' AS kind FROM con UNION ALL SELECT 'd/' || c, 'design' FROM des UNION ALL SELECT 's/' || o_orderkey, 'stack' FROM orders UNION ALL SELECT 'v/' || s_suppkey, 'convention' FROM supplier UNION ALL SELECT 'p/' || r_regionkey, 'playbook' FROM region),
made AS (SELECT 'src/' || c AS path FROM des), tg AS (SELECT target AS path, min(CASE WHEN link_type IN ('wikilink', 'convention_concept_ref', 'stack_concept_ref') THEN 'concept' WHEN link_type = 'design_stack_ref' THEN 'stack' ELSE 'source' END) AS kind FROM built GROUP BY 1)"""


@query(f"WITH {_BUILD}, {_OWN} SELECT path, kind, false AS is_stub FROM own UNION ALL SELECT path, 'source', false FROM made UNION ALL SELECT path, kind, true FROM tg WHERE path NOT IN (SELECT path FROM own) AND path NOT IN (SELECT path FROM made)")
def link_graph_artifacts(v):
    return B.full_build(*_parsed(v))["artifacts"].select("path", "kind", "is_stub")


@query("SELECT kind, action, count(*) AS n FROM (SELECT 'concept' AS kind, CASE WHEN n_nationkey % 6 <> 5 THEN 'created' ELSE 'failed' END AS action FROM nation UNION ALL SELECT 'design', CASE WHEN c_custkey % 9 <> 0 THEN 'created' ELSE 'failed' END FROM customer UNION ALL SELECT 'stack', 'created' FROM orders UNION ALL SELECT 'convention', 'created' FROM supplier UNION ALL SELECT 'playbook', 'created' FROM region) GROUP BY 1, 2")
def link_graph_log(v):
    return B.full_build(*_parsed(v))["log"].groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"))


_CHANGED = _build_sql(des="c_custkey % 10 <> 1", alias="CASE WHEN n % 5 = 0 THEN 'moved' || n ELSE 'alias' || (n % 20) END", play="r_regionkey <> 2", present="p_partkey % 7 <> 0")


def _updated_store(v):
    """A stored graph after a tenth of the designs went, a fifth of the concepts took other aliases, a playbook lost its own and source files went."""
    parsed, present = _parsed(v)
    store = D.LinkStore(v.spark, f"{V.shared_folder(v.spark)}/links-{uuid.uuid4().hex}", buckets=16)
    store.build(parsed, present)
    gone = v.table("customer").where("c_custkey % 10 = 1").select(F.concat(F.lit("d/"), F.col("c_custkey").cast("string")).alias("path"))
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("int")
    other = parsed.where((F.col("kind") == "concept") & (number % 5 == 0)).withColumn("aliases", F.array(F.concat(F.lit("Moved "), number.cast("string"))))
    play = parsed.where("path = 'p/2'").withColumn("aliases", F.array().cast("array<string>"))
    store.update(other.unionByName(play), gone, vanished=present.where(number % 7 == 0))
    return store.tables()


@query(f"WITH {_CHANGED} SELECT source, target, link_type FROM built")
def link_graph_updated(v):
    return _updated_store(v)["links"]


@query(f"WITH {_CHANGED}, {_OWN} SELECT path, kind, false AS is_stub FROM own UNION ALL SELECT path, 'source', false FROM made UNION ALL SELECT path, kind, true FROM tg WHERE path NOT IN (SELECT path FROM own) AND path NOT IN (SELECT path FROM made)")
def link_graph_updated_artifacts(v):
    return _updated_store(v)["artifacts"].select("path", "kind", "is_stub")


@query("""SELECT 'd/' || c_custkey AS path, c_name || chr(10) || c_mktsegment || chr(10) || 't' || (c_custkey % 4) AS body FROM customer WHERE c_custkey % 9 <> 0
UNION ALL SELECT 's/' || o_orderkey, o_orderstatus || chr(10) || o_orderpriority FROM orders
UNION ALL SELECT 'c/' || n_nationkey, '[[Ghost ' || (n_nationkey % 3) || ' ]]' || chr(10) || '[[Ghost ' || (n_nationkey % 3) || ' ]]' || chr(10) || 'Alias ' || (n_nationkey % 20) || chr(10) || 't' || (n_nationkey % 4) FROM nation WHERE n_nationkey % 6 <> 5
UNION ALL SELECT 'v/' || s_suppkey, b || chr(10) || b || chr(10) || 'alias ' || (s_suppkey % 400 + 18) FROM (SELECT s_suppkey, printf('[[CN-%03d ]] [[Alias %d ]]', CAST(s_suppkey % 30 AS INT), CAST(s_suppkey % 25 AS INT)) AS b FROM supplier)
UNION ALL SELECT 'p/' || r_regionkey, 'Play ' || r_regionkey || chr(10) || 'play' FROM region""")
def link_graph_texts(v):
    return B.full_build(*_parsed(v))["texts"].select("path", "body")


# the symbol graph from source files


def _python_files(v, tail=""):
    """A Python file a supplier: class and function import those of half its number; tail: what every fifth file has at its end."""
    t = v.table("supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    n = {"s": F.col("s"), "k": F.floor(F.col("s") / 2), "j": F.floor(F.col("s") / 3)}
    base = F.when(F.col("s") % 10 == 1, "    def base(self):\n        return 0\n").otherwise("\n\n")
    text = """from pkg.m{k} import C{k}, f{k} as g
import pkg.m{j} as mj


class C{s}(C{k}):
    part: list[C{k}]
    size: int

    def __init__(self) -> None:
        self.other: mj.X = None
        self.own: C{s} | None = None

    def run(self):
        self.run{s}()
        self.base()

    def run{s}(self):
        g()
        mj.f{j}()
        unknown.call()

{base}

def f{s}(flag):
    if flag:
        C{k}()
    Cx()
    return f{s}(flag)
"""
    parts = [base if x == "{base}" else n[x[1]].cast("string") if x[0] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", text) if x]
    end = F.when(F.col("s") % 5 == 0, tail).otherwise("")
    return t.select(F.concat(F.lit("src/pkg/m"), F.col("s").cast("string"), F.lit(".py")).alias("path"), F.concat(*parts, end).alias("text"))


def _symbol_graph(v):
    files = _python_files(v)
    return Z.symbol_graph(P.python_facts(files), files.select(F.col("path").alias("file")))


def _named_ends(v, table, a, b):
    s = _symbol_graph(v)
    q = s["symbols"].select("id", "qualified_name")
    d = s[table].join(q.withColumnsRenamed({"id": a, "qualified_name": "from"}), a)
    return d if b is None else d.join(q.withColumnsRenamed({"id": b, "qualified_name": "to"}), b)


_FILES = """s AS (SELECT CAST(s_suppkey AS BIGINT) AS s, CAST(s_suppkey AS BIGINT) // 2 AS k, CAST(s_suppkey AS BIGINT) // 3 AS j FROM supplier WHERE true),
up AS (SELECT s, s AS owner, 0 AS d FROM s UNION SELECT up.s, owner // 2, d + 1 FROM up JOIN s ON s.s = up.owner // 2 WHERE owner % 10 <> 1 AND d < 40),
b AS (SELECT s, arg_min(owner, d) AS owner FROM up WHERE owner % 10 = 1 GROUP BY s)"""


_CALLS = """SELECT printf('pkg.m%d.C%d.run', s, s) AS "from", printf('pkg.m%d.C%d.run%d', s, s, s) AS "to", 14::BIGINT AS line FROM s UNION ALL SELECT printf('pkg.m%d.C%d.run', s, s), printf('pkg.m%d.C%d.base', owner, owner), 15 FROM b
UNION ALL SELECT printf('pkg.m%d.C%d.run%d', s, s, s), printf('pkg.m%d.f%d', k, k), 18 FROM s WHERE k IN (SELECT s FROM s) UNION ALL SELECT printf('pkg.m%d.C%d.run%d', s, s, s), printf('pkg.m%d.f%d', j, j), 19 FROM s WHERE j IN (SELECT s FROM s)
UNION ALL SELECT printf('pkg.m%d.f%d', s, s), printf('pkg.m%d.C%d', k, k), 28 FROM s WHERE k IN (SELECT s FROM s) UNION ALL SELECT printf('pkg.m%d.f%d', s, s), printf('pkg.m%d.f%d', s, s), 30 FROM s"""


@query(f"WITH RECURSIVE {_FILES} {_CALLS}")
def symbol_build_calls(v):
    return _named_ends(v, "calls", "caller", "callee").select("from", "to", "line")


@query(f"""WITH RECURSIVE {_FILES}, e AS (SELECT s, 'call' AS n, 20 AS line FROM s) SELECT printf('pkg.m%d.C%d.run%d', s, s, s) AS "from", 'unknown.call' AS callee_name, 20::BIGINT AS line FROM s UNION ALL SELECT printf('pkg.m%d.C%d.run', s, s), 'self.base', 15 FROM s WHERE s NOT IN (SELECT s FROM b)
UNION ALL SELECT printf('pkg.m%d.f%d', s, s), 'Cx', 29 FROM s UNION ALL SELECT printf('pkg.m%d.C%d.run%d', s, s, s), 'g', 18 FROM s WHERE k NOT IN (SELECT s FROM s) UNION ALL SELECT printf('pkg.m%d.C%d.run%d', s, s, s), 'mj.f' || j, 19 FROM s WHERE j NOT IN (SELECT s FROM s)
UNION ALL SELECT printf('pkg.m%d.f%d', s, s), 'C' || k, 28 FROM s WHERE k NOT IN (SELECT s FROM s)""")
def symbol_build_unresolved(v):
    return _named_ends(v, "unresolved_calls", "caller", None).select("from", "callee_name", "line")


@query(f"""WITH {_FILES}, x AS (SELECT * FROM s WHERE k IN (SELECT s FROM s))
SELECT printf('pkg.m%d.C%d', s, s) AS "from", printf('pkg.m%d.C%d', k, k) AS "to", 'inherits' AS edge_type, 5::BIGINT AS line FROM x UNION ALL SELECT printf('pkg.m%d.C%d', s, s), printf('pkg.m%d.C%d', k, k), 'composes', 6 FROM x
UNION ALL SELECT printf('pkg.m%d.C%d', s, s), printf('pkg.m%d.C%d', s, s), 'composes', 11 FROM s UNION ALL SELECT printf('pkg.m%d.f%d', s, s), printf('pkg.m%d.C%d', k, k), 'instantiates', 28 FROM x""")
def symbol_build_class_edges(v):
    return _named_ends(v, "class_edges", "source", "target").select("from", "to", "edge_type", "line")


@query(f"""WITH RECURSIVE {_FILES.replace('WHERE true', 'WHERE s_suppkey % 11 <> 5')} {_CALLS} UNION ALL SELECT printf('pkg.m%d.extra', s, s), printf('pkg.m%d.f%d', k, k), 32 FROM s WHERE s % 5 = 0 AND k IN (SELECT s FROM s)""")
def symbol_refresh_calls(v):
    """A stored graph after a seventh of the files came, a fifth got one more function and an eleventh went."""
    number = F.regexp_extract("path", r"m(\d+)\.py", 1).try_cast("int")
    files, later = _python_files(v), _python_files(v, "def extra():\n    g()\n")
    first = files.where(number % 7 != 3)
    store = SymbolStore(v.spark, f"{V.shared_folder(v.spark)}/symbols-{uuid.uuid4().hex}", buckets=16)
    store.build(P.python_facts(first), first.select(F.col("path").alias("file")))
    new = later.where(((number % 7 == 3) | (number % 5 == 0)) & (number % 11 != 5))
    gone = first.where(number % 11 == 5).select(F.col("path").alias("file"))
    store.refresh(P.python_facts(new), new.select(F.col("path").alias("file")), gone)
    t = store.tables()
    q = t["symbols"].select("id", "qualified_name")
    d = t["calls"].join(q.withColumnsRenamed({"id": "caller", "qualified_name": "from"}), "caller").join(q.withColumnsRenamed({"id": "callee", "qualified_name": "to"}), "callee")
    return d.select("from", "to", "line")


@query(f"""WITH RECURSIVE {_FILES}, oldest AS (SELECT s, s AS owner, 0 AS d FROM s WHERE s % 7 <> 3 UNION SELECT o.s, owner // 2, d + 1 FROM oldest o JOIN s ON s.s = o.owner // 2 WHERE owner % 10 <> 1 AND d < 40 AND s.s % 7 <> 3)
SELECT printf('pkg.m%d.C%d.run%d', s, s, s) AS "from", printf('pkg.m%d.f%d', j, j) AS "to", 19::BIGINT AS line FROM s WHERE s % 7 <> 3 AND j % 7 = 3 AND j IN (SELECT s FROM s)
UNION ALL SELECT printf('pkg.m%d.f%d', s, s), printf('pkg.m%d.C%d', k, k), 28 FROM s WHERE s % 7 <> 3 AND k % 7 = 3 AND k IN (SELECT s FROM s)
UNION ALL SELECT printf('pkg.m%d.C%d.run', s, s), printf('pkg.m%d.C%d.base', owner, owner), 15 FROM b WHERE s % 7 <> 3 AND s NOT IN (SELECT s FROM oldest WHERE owner % 10 = 1) AND EXISTS (SELECT 1 FROM s x WHERE x.s % 7 = 3 AND x.s % 10 = 1)""")
def promoted_calls(v):
    """What the symbols of a seventh of the files answer of the calls that the others' graph leaves open."""
    number = F.regexp_extract("path", r"m(\d+)\.py", 1).try_cast("int")
    files = _python_files(v)
    first, names = files.where(number % 7 != 3), files.select(F.col("path").alias("file"))
    before = Z.symbol_graph(P.python_facts(first), first.select(F.col("path").alias("file")))
    facts = V.cut(P.python_facts(files))
    symbols = V.cut(Z.symbols_of(facts))
    imports = V.cut(Z.bindings(facts, names))
    sites = V.cut(Z.sites_of(facts, symbols))
    inherits = Z.inherits_of(sites, Z.class_targets(sites, symbols, imports))
    new = symbols.where(F.regexp_extract("file", r"m(\d+)\.py", 1).try_cast("int") % 7 == 3)
    d = R.promoted(V.cut(before["unresolved_calls"]), new, symbols, imports, V.cut(inherits))
    q = symbols.select("id", "qualified_name")
    d = d.join(q.withColumnsRenamed({"id": "caller", "qualified_name": "from"}), "caller").join(q.withColumnsRenamed({"id": "callee", "qualified_name": "to"}), "callee")
    return d.select("from", "to", "line")


@query("""WITH RECURSIVE s AS (SELECT CAST(s_suppkey AS BIGINT) AS s FROM supplier), up AS (SELECT s, s AS owner FROM s UNION SELECT up.s, owner // 2 FROM up JOIN s ON s.s = up.owner // 2 WHERE owner % 4 <> 0)
SELECT printf('pkg.e%d.E%d', s, s) AS qualified_name, 'A' AS member FROM s UNION ALL SELECT DISTINCT printf('pkg.e%d.L%d', s, s), 'B' FROM up WHERE owner % 4 = 0""")
def symbol_build_enums(v):
    """Enums and their members: by their own base, and by a chain of bases through other files."""
    s = F.col("s_suppkey").cast("long")
    k, n = F.floor(s / 2).cast("string"), s.cast("string")
    base = F.when(s % 4 == 0, F.concat(F.lit("E"), n)).otherwise(F.concat(F.lit("L"), k))
    text = F.concat(F.lit("from enum import Enum\nfrom pkg.e"), k, F.lit(" import L"), k, F.lit("\nclass E"), n, F.lit("(Enum):\n    A = "), n, F.lit("\nclass L"), n, F.lit("("), base, F.lit("):\n    B = 1\n"))
    files = v.table("supplier").select(F.concat(F.lit("src/pkg/e"), n, F.lit(".py")).alias("path"), text.alias("text"))
    g = Z.symbol_graph(P.python_facts(files), files.select(F.col("path").alias("file")))
    enums = g["symbols"].where("symbol_type = 'enum'").select(F.col("id").alias("symbol"), "qualified_name")
    return enums.join(g["members"], "symbol", "left").select("qualified_name", F.col("name").alias("member"))


_DESIGN = "SELECT CAST(c_custkey AS BIGINT) AS c, c_name, c_mktsegment FROM customer"


@query(f"""SELECT '.kb/designs/src/m' || c || '.py.md' AS path, CASE WHEN c % 7 = 0 THEN 'no id' WHEN c % 9 = 0 THEN 'no footer' END AS error, CASE WHEN c % 7 <> 0 AND c % 9 <> 0 THEN 'src/m' || c || '.py' END AS source,
CASE WHEN c % 7 <> 0 AND c % 9 <> 0 THEN 'def f' || c || '(): ...' END AS contract, CASE WHEN c % 7 <> 0 AND c % 9 <> 0 THEN c_mktsegment || '|t' || (c % 3) END AS tags, CASE WHEN c % 7 <> 0 AND c % 9 <> 0 THEN 'h' || (c % 50) END AS source_hash FROM ({_DESIGN})""")
def design_files_parsed(v):
    """Design files written from a table, read back: some without an id, some without a footer, footers of both forms."""
    c = F.col("c_custkey").cast("long")
    n = c.cast("string")
    h = F.concat(F.lit("h"), (c % 50).cast("string"))
    pairs = lambda cut: F.concat_ws(cut, F.concat(F.lit("source: src/m"), n), F.concat(F.lit("source_hash: "), h), F.lit("design_hash: d"), F.lit("generated: 2024-05-01T00:00:00"), F.lit("generator: tool"))
    foot = F.when(c % 9 == 0, "").when(c % 2 == 0, F.concat(F.lit("<!-- kb:meta {"), pairs(", "), F.lit("} -->\n"))).otherwise(F.concat(F.lit("<!-- kb:meta\n"), pairs("\n"), F.lit("\n-->\n")))
    head = F.concat(F.lit("---\ndescription: "), F.col("c_name"), F.when(c % 7 == 0, "").otherwise(F.concat(F.lit("\nid: DS-"), n)), F.lit("\n---\n\n# src/m"), n, F.lit(".py\n\n"))
    body = F.concat(F.lit("## Interface Contract\n\n```python\ndef f"), n, F.lit("(): ...\n```\n\n## Tags\n\n- "), F.col("c_mktsegment"), F.lit("\n- t"), (c % 3).cast("string"), F.lit("\n\n"))
    # a small file makes one task, and parsing a text costs far more than dealing out its row
    files = v.table("customer").select("c_custkey", "c_name", "c_mktsegment").repartition("c_custkey").select(F.concat(F.lit(".kb/designs/src/m"), n, F.lit(".py.md")).alias("path"), F.concat(head, body, foot).alias("text"))
    return A.typed(files).select("path", "error", "design.source", "design.contract", F.array_join("design.tags", "|").alias("tags"), "design.footer.source_hash")


_LOOKUP = """l AS (SELECT target AS path, source, link_type FROM links WHERE target LIKE 'part/%' OR target LIKE 'nation/%'), f AS (SELECT DISTINCT path FROM l),
i AS (SELECT l.path, 2 AS section, string_agg('- [' || status || '] ' || title, chr(10) ORDER BY n) AS content FROM (SELECT l.path, a.status, a.title, row_number() OVER (PARTITION BY l.path ORDER BY CASE a.status WHEN 'open' THEN 1 ELSE 2 END, o_custkey DESC, l.source) AS n
  FROM l JOIN artifacts a ON a.path = l.source JOIN orders ON 'orders/' || o_orderkey = l.source WHERE l.link_type = 'stack_file_ref' AND a.status <> 'stale') l WHERE n <= 3 GROUP BY 1),
k AS (SELECT path, 4 AS section, string_agg('- [[' || source || ']] (' || CASE link_type WHEN 'stack_file_ref' THEN 'stack post' WHEN 'wikilink' THEN 'concept wikilink' ELSE link_type END || ')', chr(10) ORDER BY source, link_type) AS content FROM l GROUP BY 1),
b AS (SELECT *, length(content) // 4 AS t, coalesce(sum(length(content) // 4) OVER (PARTITION BY path ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM i UNION ALL SELECT * FROM k))"""


@query(f"""WITH {_LOOKUP} SELECT path, section, CASE WHEN before + t <= 120 THEN content ELSE substr(content, 1, CAST(120 - before AS INT) * 4) || chr(10) || '... truncated due to token budget' || chr(10) END AS content, before + t > 120 AS truncated
FROM b WHERE before <= 120 AND (before + t <= 120 OR 120 - before > 50)""")
def file_lookups(v):
    """Issues and links of all parts and nations, within 120 tokens each."""
    links = v.links.where("target LIKE 'part/%' OR target LIKE 'nation/%'")
    files = links.select(F.col("target").alias("path"))
    votes = v.table("orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("post"), F.col("o_custkey").alias("votes"))
    posts = links.where("link_type = 'stack_file_ref'").select(F.col("target").alias("file"), F.col("source").alias("post")).join(votes, "post").join(v.artifacts.select(F.col("path").alias("post"), "title", "status"), "post")
    found = Q.sections(files, 120, posts=posts, links=links)
    return Q.within(found.where(F.col("section") != Q.SIBLINGS), 120)


def _js_files(v):
    """A TypeScript or JavaScript file a supplier, some as a folder's index; it imports those of half and a third of its number. And the path mappings."""
    t = v.table("supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    s, k, j = (F.floor(F.col("s") / n).cast("string") for n in (1, 2, 3))
    kind = F.col("s") % 3
    path = F.when(kind == 0, F.concat(F.lit("src/m"), s, F.lit(".ts"))).when(kind == 1, F.concat(F.lit("src/m"), s, F.lit("/index.tsx"))).otherwise(F.concat(F.lit("src/m"), s, F.lit(".js")))
    text = F.concat(F.lit("import { C"), k, F.lit(", f as g } from '"), F.when(kind == 1, "../m").otherwise("./m"), k, F.lit("'\nimport * as ns from \"@/m"), j, F.lit("\"\nimport x from 'vendor'\n"))
    config = v.spark.createDataFrame([('{"compilerOptions": {"baseUrl": "./src", /* two */ "paths": {"#/*": ["none/*"], "@/*": ["lib/*", "*"]}}}',)], "text string")
    return t.select("s", path.alias("path"), text.alias("text")), J.ts_paths(config)


_JS = "s AS (SELECT CAST(s_suppkey AS BIGINT) AS s, 'src/m' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.tsx' ELSE '.js' END AS path FROM supplier)"


@query(f"""WITH {_JS} SELECT a.path AS file, CASE a.s % 3 WHEN 1 THEN '../m' ELSE './m' END || b.s AS specifier, b.path AS module_file FROM s a JOIN s b ON b.s = a.s // 2 UNION ALL SELECT a.path, '@/m' || b.s, b.path FROM s a JOIN s b ON b.s = a.s // 3""")
def js_module_files(v):
    files, paths = _js_files(v)
    return J.js_modules(J.js_imports(files), files, paths)


@query(f"""WITH {_JS} SELECT a.s * 10 + 1 AS site, CASE WHEN b.s IS NOT NULL THEN b.s * 2 + 1 END AS target FROM s a LEFT JOIN s b ON b.s = a.s // 2 UNION ALL SELECT a.s * 10 + 2, CASE WHEN b.s IS NOT NULL THEN b.s * 2 END FROM s a LEFT JOIN s b ON b.s = a.s // 3
UNION ALL SELECT s * 10 + 3, NULL FROM s UNION ALL SELECT s * 10 + 4, s * 2 FROM s""")
def js_call_targets(v):
    files, paths = _js_files(v)
    imports = J.js_imports(files)
    b = J.js_bindings(imports, J.js_modules(imports, files, paths))
    n = lambda c, x: F.concat(F.lit(c), x.cast("string"))
    s, at = F.col("s"), lambda k, r, x: F.struct((F.col("s") * 10 + k).alias("site"), F.lit(r).cast("string").alias("receiver"), x.alias("name"))
    calls = F.array(at(1, None, n("C", F.floor(s / 2))), at(2, "ns", n("ns.f", F.floor(s / 3))), at(3, None, F.lit("g")), at(4, "this", n("this.f", s)))
    sites = files.select(F.col("path").alias("file"), F.inline(calls))
    own = F.array(F.struct((s * 2).alias("id"), n("f", s).alias("name"), F.lit("function").alias("symbol_type"), F.lit(1).alias("line_start")), F.struct((s * 2 + 1).alias("id"), n("C", s).alias("name"), F.lit("class").alias("symbol_type"), F.lit(9).alias("line_start")))
    return J.js_calls(sites, files.select(F.col("path").alias("file"), F.inline(own)), b)


# more of the symbol graph and the indexes


@query("SELECT e.target, e.edge_type, e.source, s.file AS source_file, e.line FROM class_edges e JOIN symbols s ON s.id = e.source")
def class_edges_in(v):
    return Y.class_edges_to(v.symbols, v.class_edges)


@query("SELECT c.caller, s.name AS caller_name, s.file AS caller_file, 'ext.' || c.callee AS callee_name, c.line FROM calls c JOIN symbols s ON s.id = c.caller")
def unresolved_callees(v):
    u = v.calls.select("caller", F.concat(F.lit("ext."), F.col("callee").cast("string")).alias("callee_name"), "line")
    return Y.unresolved_callees(v.symbols, u)


def _parameters(v):
    return v.members.where("ordinal IS NOT NULL").select("symbol", F.concat(F.lit("flag"), F.col("ordinal").cast("string")).alias("name"))


@query("SELECT 'flag' || ordinal AS name FROM members WHERE symbol = 7 AND ordinal IS NOT NULL")
def branch_parameters(v):
    return Y.branch_parameters(_parameters(v), 7)


@query("SELECT DISTINCT file FROM symbols WHERE id IN (SELECT symbol FROM members WHERE ordinal IS NOT NULL)")
def branching_files(v):
    return Y.branching_files(v.symbols, _parameters(v))


@query("SELECT file, count(*) AS n FROM symbols WHERE symbol_type = 'class' GROUP BY file")
def symbols_query_raw(v):
    return Y.query_raw(v.spark, "SELECT file, count(*) AS n FROM symbols_raw WHERE symbol_type = :kind GROUP BY file", {"kind": "class"}, symbols_raw=v.symbols)


@query("SELECT 'symbols' AS name, count(*) AS rows FROM symbols UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'class_edges', count(*) FROM class_edges UNION ALL SELECT 'members', count(*) FROM members")
def symbol_graph_health(v):
    return Y.graph_health(symbols=v.symbols, calls=v.calls, class_edges=v.class_edges, members=v.members)


@query("SELECT CAST(p_partkey AS BIGINT) AS symbol, CASE k WHEN 0 THEN 'A' ELSE 'B' END AS name, CASE k WHEN 0 THEN p_brand ELSE p_type END AS value, k AS ordinal FROM part, (VALUES (0), (1)) x(k) WHERE p_size % 2 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), 'C', p_name, 0 FROM part WHERE p_size % 2 = 1 AND p_size % 3 <> 0")
def members_from_definitions(v):
    p = v.table("part").withColumn("symbol", F.col("p_partkey").cast("long"))
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("value"))
    enums = p.where("p_size % 2 = 0").select("symbol", F.array(pair("A", "p_brand"), pair("B", "p_type")).alias("variants"))
    return Y.members_from(enums, p.where("p_size % 2 = 1").select("symbol", F.lit("C").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("value")))


@query("""WITH d AS (SELECT DISTINCT directory AS path FROM rules), t AS (SELECT min(path) AS a, split_part(max(path), '/', 1) AS b FROM d),
p AS (SELECT path, CASE WHEN path = a OR starts_with(path, a || '/') THEN a WHEN path = b OR starts_with(path, b || '/') THEN b ELSE '.' END AS root FROM d, t),
r AS (SELECT page_id AS rule, directory AS dir FROM rules UNION SELECT page_id, '.' FROM rules WHERE priority = 6 UNION SELECT page_id, split_part(directory, '/', 1) FROM rules WHERE priority > 2)
SELECT DISTINCT p.path, p.root, r.rule FROM p JOIN r ON r.dir = '.' OR (p.path = r.dir OR starts_with(p.path, r.dir || '/')) AND (p.root = '.' OR r.dir = p.root OR starts_with(r.dir, p.root || '/'))""")
def rules_by_any_scope(v):
    """Below a directory, a host and all: a rule of a whole host holds where the host is the root or lies below it."""
    host = F.split("directory", "/")[0]
    scopes = F.when(F.col("priority") == 6, F.array("directory", F.lit("."), host)).when(F.col("priority") > 2, F.array("directory", F.concat(F.lit("/"), host, F.lit("/")))).otherwise(F.array("directory"))
    ends = v.rules.agg(F.min("directory").alias("a"), F.max("directory").alias("b")).first()
    last = ends["b"].split("/")[0]
    found = X.by_any_scope(v.rules.select(F.col("directory").alias("path")), v.rules.select(F.col("page_id").alias("rule"), scopes.alias("scopes")), [ends["a"], f"{last}/", "."])
    return found.withColumn("root", F.when(F.col("root") == f"{last}/", last).otherwise(F.col("root")))  # an expression on each pair would take longer than pairing


_TREE = "SELECT 'src/d' || (p_size % 7) || '/' || p_brand || '/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.py' ELSE '/build/out.o' END AS path, p_size % 7 AS d, p_partkey AS k, p_size % 3 AS e, p_brand FROM part"


@query(f"SELECT path FROM ({_TREE}) WHERE NOT (e = 0 AND k::VARCHAR NOT LIKE '1%' OR e = 1 AND d = 3 OR e = 2 OR d = 5 AND p_brand LIKE 'Brand#1%')")
def tree_without_ignored(v):
    """Files that a walk finds: without what a list, the ignore file of a directory and a second list leave out."""
    k = F.col("p_partkey").cast("string")
    end = F.when(F.col("p_size") % 3 == 0, ".log").when(F.col("p_size") % 3 == 1, ".py").otherwise("/build/out.o")
    files = v.table("part").select(F.concat(F.lit("src/d"), (F.col("p_size") % 7).cast("string"), F.lit("/"), "p_brand", F.lit("/"), k, end).alias("path"))
    text = v.spark.createDataFrame([("src/d3/.gitignore", "# local\n*.py\n!none.py\n")], "path string, text string")
    lists = v.spark.createDataFrame([("a", 0, "*.log"), ("a", 1, "!1*.log"), ("b", 0, "**/build/"), ("b", 1, "/src/d5/Brand#1*/")], "layer string, pos int, pattern string")
    lines = G.ignore_lines(text).union(lists.select("layer", F.lit(".").alias("directory"), "pos", "pattern"))
    return G.reachable(files, lines)


@query("SELECT DISTINCT file AS directory, 'any' AS title, 2 AS specificity FROM symbols WHERE file LIKE 'Brand#1%'")
def playbook_trigger_dir(v):
    p = v.spark.createDataFrame([("any", ["Brand#1*/*"])], "title string, globs array<string>")
    return X.by_trigger_dir(v.symbols.select(F.col("file").alias("directory")).distinct(), p)


@query("SELECT o_orderkey AS post, CAST(o_custkey AS BIGINT) AS votes FROM orders WHERE o_orderstatus = 'O' AND starts_with('src/' || o_custkey, 'src/1')")
def posts_by_status_and_scope(v):
    o = v.table("orders")
    none = F.lit(None).cast("string")
    posts = o.select(F.col("o_orderkey").alias("post"), F.col("o_custkey").cast("long").alias("votes"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"), F.array(F.concat(F.lit("src/"), F.col("o_custkey").cast("string"))).alias("files"), F.array(none).alias("tags"), F.array(none).alias("concepts"), none.alias("resolution_type"))
    return X.posts_by(posts, status="open", scope="src/1").select("post", "votes")


@query("SELECT page_id FROM rules WHERE starts_with('site1.example/a/b', directory) OR priority = 0")
def conventions_in_scope(v):
    r = v.rules.select("page_id", F.when(F.col("priority") == 0, "project").otherwise(F.col("directory")).alias("scope"))
    return X.in_scope(r, "site1.example/a/b").select("page_id")


@query("SELECT path, title FROM artifacts WHERE kind = 'convention' AND path IN (SELECT target FROM links WHERE link_type = 'wikilink')")
def convention_details(v):
    ids = v.links.where("link_type = 'wikilink'").select(F.col("target").alias("path"))
    return X.details(v.artifacts.where("kind = 'convention'"), ids).select("path", "title")


@query("""WITH c AS (SELECT p_brand AS directory, '.' || lower(split_part(p_type, ' ', 1)) AS extension, count(*) AS n FROM part GROUP BY 1, 2) SELECT directory, arg_min(extension, (-n, extension)) AS extension, CAST(sum(n) AS BIGINT) AS files FROM c GROUP BY directory""")
def directory_topology(v):
    ext = F.lower(F.split("p_type", " ")[0])
    return I.topology(v.table("part").select(F.col("p_brand").alias("directory"), F.concat(F.lit("x."), ext).alias("name")))


@query()
def billboard_synthesis(v):
    return I.billboards(v.table("part").select(F.col("p_brand").alias("directory"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("description")))


@query("SELECT 'warning' AS severity, 'orphan_concepts' AS check_name, CAST(id AS VARCHAR) AS artifact, 'no link names it' AS message FROM symbols WHERE symbol_type = 'class' AND id NOT IN (SELECT target FROM class_edges)")
def orphan_concepts(v):
    c = v.symbols.where("symbol_type = 'class'").select(F.col("id").cast("string").alias("path"), F.lit("no such name").alias("title"))
    links = v.class_edges.select(F.col("target").cast("string").alias("target"))
    return K.orphans(c, links, v.aliases.where("false"))
