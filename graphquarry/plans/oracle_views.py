"""The engine tables in DuckDB SQL, for the oracle queries."""

from __future__ import annotations

import re

VIEWS = {
    "artifacts": """
SELECT 'region/' || r_regionkey AS path, 'concept' AS kind, r_name AS title, 'active' AS status, printf('CN-%03d', CAST(r_regionkey AS INT)) AS code FROM region
UNION ALL SELECT 'nation/' || n_nationkey, 'convention', n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'deprecated' ELSE 'active' END, printf('CV-%03d', CAST(n_nationkey AS INT)) FROM nation
UNION ALL SELECT 'supplier/' || s_suppkey, 'playbook', s_name, 'active', printf('PB-%03d', CAST(s_suppkey AS INT)) FROM supplier
UNION ALL SELECT 'customer/' || c_custkey, 'design', c_name, 'active', printf('DS-%03d', CAST(c_custkey AS INT)) FROM customer
UNION ALL SELECT 'orders/' || o_orderkey, 'stack', 'Order ' || o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'stale' END, printf('ST-%03d', CAST(o_orderkey AS INT)) FROM orders
UNION ALL SELECT 'part/' || p_partkey, 'source', p_name, NULL, NULL FROM part""",
    "links": """
SELECT 'nation/' || n_nationkey AS source, 'region/' || n_regionkey AS target, 'convention_concept_ref' AS link_type FROM nation
UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'wikilink' FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'wikilink' FROM supplier
UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey, 'stack_concept_ref' FROM orders
UNION ALL SELECT DISTINCT 'orders/' || l_orderkey, 'part/' || l_partkey, 'stack_file_ref' FROM lineitem
UNION ALL SELECT DISTINCT 'orders/' || l_orderkey, 'supplier/' || l_suppkey, 'design_stack_ref' FROM lineitem""",
    "cyclic": """
SELECT DISTINCT source, target, 'ast_import' AS link_type FROM (SELECT doc_id AS source, (doc_id * 3 + 1) % n AS target FROM documents, (SELECT count(*) AS n FROM documents)
UNION ALL SELECT doc_id, (doc_id * 7 + 2) % n FROM documents, (SELECT count(*) AS n FROM documents))""",
    "doc_tags": """
SELECT doc_id, tag FROM (SELECT doc_id, unnest([lang, source, 'quality-' || quality, 'toxic-' || toxic]) AS tag FROM documents LEFT JOIN labels USING (doc_id)) WHERE tag IS NOT NULL""",
    "alias_rows": """
SELECT 'part/' || p_partkey AS path, upper(p_name) AS alias, CAST(p_partkey AS BIGINT) AS pos FROM part UNION ALL SELECT 'nation/' || n_nationkey, lower(n_name), CAST(n_nationkey AS BIGINT) FROM nation""",
    "symbols": """
SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS file, p_name AS name, p_brand || '.' || p_name || '.' || p_partkey AS qualified_name, ['function', 'method', 'class', 'enum', 'constant'][p_size % 5 + 1] AS symbol_type,
CAST(p_partkey AS BIGINT) AS line_start, CAST(p_partkey + p_size AS BIGINT) AS line_end, CASE WHEN p_size % 3 = 0 THEN 'private' ELSE 'public' END AS visibility FROM part""",
    "calls": """
SELECT DISTINCT * FROM (SELECT CAST(l_partkey AS BIGINT) AS caller, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS BIGINT) AS callee, CAST(l_linenumber AS BIGINT) AS line FROM lineitem) WHERE callee IS NOT NULL""",
    "members": """
SELECT CAST(p_partkey AS BIGINT) AS symbol, p_name AS name, p_type AS value, CASE WHEN p_size % 4 <> 0 THEN p_size END AS ordinal FROM part""",
    "class_edges": """
SELECT id AS source, id // 2 AS target, CASE WHEN id % 3 = 0 THEN 'instantiates' ELSE 'inherits' END AS edge_type, id AS line FROM symbols WHERE id > 0""",
    "posts": """
SELECT conv_id AS post, count(*) AS votes, arg_min(text, turn) AS problem, arg_max(text, turn) AS last, ['open', 'resolved', 'outdated', 'duplicate', 'stale'][conv_id % 5 + 1] AS status FROM conversations GROUP BY conv_id""",
    "rules": """
SELECT page_id, directory, CAST(page_id % 7 AS INT) AS priority, CASE page_id % 6 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'draft' ELSE 'active' END AS status, CAST(row_number() OVER (PARTITION BY directory ORDER BY page_id) - 1 AS INT) AS ordinal
FROM (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)/[^/?#]*', 1) AS directory FROM pages)""",
    "log": """
SELECT event_id, CAST(ts AS DATE) AS build_started, CASE event_type WHEN 'view' THEN 'unchanged' WHEN 'click' THEN 'updated' WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'failed' ELSE 'deleted' END AS action, CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM events""",
    "texts": """
SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, text, lang, source FROM documents""",
    "words": """
SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(translate(lower(title || ' ' || body), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+') AS ws FROM texts)""",
    "sizes": """
SELECT doc_id, count(term) AS len FROM documents LEFT JOIN words USING (doc_id) GROUP BY doc_id""",
}


def complete(sql: str) -> str:
    """sql after the views that it names, directly or through others."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                visit(VIEWS[v])
                need.append(v)

    visit(sql)
    own = sql.strip()
    more = own.startswith("WITH ")
    ctes = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in need)
    if not need:
        return own
    own = own.removeprefix("WITH ").removeprefix("RECURSIVE ") if more else own
    return f"WITH RECURSIVE {ctes}" + (", " if more else " ") + own
