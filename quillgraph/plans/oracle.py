"""DuckDB counterparts of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

SQL: dict[str, str] = {}

_VIEWS = {
    "nodes": """nodes AS (SELECT *, split_part(graph_node_no, ':', 1) AS class FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, graph_node_no ORDER BY update_time DESC NULLS LAST, id DESC) AS rn FROM kg_graph_node) WHERE rn = 1),
    alive AS (SELECT * FROM nodes WHERE NOT coalesce(deleted, false)),
    domains AS (SELECT graph_no, graph_version, graph_node_no, class AS type, CASE WHEN class = 'Asset' THEN split_part(graph_node_no, ':', 2) END AS entity_spec
      FROM nodes WHERE class IN ('Asset', 'Relation', 'Event', 'Behavior'))""",
    "pairs": """pairs AS (SELECT DISTINCT graph_no, graph_version, winner_node_no AS a, loser_node_no AS b FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, merge_id ORDER BY update_time DESC NULLS LAST, id DESC) AS rn FROM kg_merge_log)
      WHERE rn = 1 AND status = 'MERGED' AND trim(winner_node_no) <> '' AND trim(loser_node_no) <> '')""",
    "edges": """edges AS (SELECT p.graph_no, p.graph_version, left(sha256(a || '|same_as|' || b), 32) AS graph_edge_no, a AS source_node_no, b AS target_node_no, 'same_as' AS name, n.ref
      FROM pairs p LEFT JOIN nodes n ON n.graph_no = p.graph_no AND n.graph_version = p.graph_version AND n.graph_node_no = p.b)""",
    "near": """near AS (SELECT graph_no, graph_version, left(sha256(a || '|cites|' || b), 32) AS graph_edge_no, a AS source_node_no, b AS target_node_no, 'cites' AS name, 'from ' || a AS description, docs FROM (
      SELECT graph_no, graph_version, graph_node_no AS a, nxt AS b, list(DISTINCT doc_no) AS docs FROM (
        SELECT *, lead(graph_node_no) OVER (PARTITION BY graph_no, graph_version, doc_no ORDER BY graph_node_no) AS nxt FROM (SELECT graph_no, graph_version, graph_node_no, unnest(map_keys(ref)) AS doc_no FROM alive WHERE ref IS NOT NULL))
      WHERE nxt IS NOT NULL AND nxt <> graph_node_no GROUP BY ALL))""",
    "idx": """idx AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, object_type, object_no ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn FROM kg_search_index) WHERE rn = 1),
    questions AS (SELECT graph_no, graph_version, graph_no || '@' || graph_version AS query_no, variant_no, split_part(searchable_text, chr(10), 1) AS text, embedding FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version ORDER BY id) AS variant_no FROM idx WHERE object_type = 'NODE' AND len(embedding) = 64) WHERE variant_no <= 3)""",
    "docs": """docs AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, doc_no ORDER BY update_time DESC NULLS LAST, id DESC) AS rn FROM kg_doc) WHERE rn = 1)""",
    "vector": """scored AS (SELECT q.query_no, q.variant_no, i.object_type, i.object_no,
        round(CASE WHEN len(i.embedding) = len(q.embedding) AND list_dot_product(i.embedding, i.embedding) > 0 AND list_dot_product(q.embedding, q.embedding) > 0
          THEN list_cosine_similarity(i.embedding, q.embedding) ELSE 0 END, 6) AS score
      FROM idx i JOIN questions q USING (graph_no, graph_version) WHERE len(i.embedding) = 64),
    vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no, variant_no, object_type ORDER BY score DESC, object_no) AS rank FROM scored WHERE score > 0) WHERE rank <= 20)""",
    "text": """grams AS (SELECT graph_no, graph_version, object_type, object_no, term, count(*) AS tf FROM (
      SELECT graph_no, graph_version, object_type, object_no, unnest([substr(lower(searchable_text), i, 2) FOR i IN range(1, greatest(length(searchable_text) - 1, 1) + 1)]) AS term
      FROM idx WHERE length(searchable_text) > 0) GROUP BY ALL),
    terms AS (SELECT DISTINCT graph_no, graph_version, query_no, unnest([substr(lower(text), i, 2) FOR i IN range(1, greatest(length(text) - 1, 1) + 1)]) AS term FROM questions WHERE variant_no = 1 AND length(text) > 0),
    sizes AS (SELECT graph_no, graph_version, object_type, count(DISTINCT object_no) AS n FROM idx GROUP BY ALL),
    dfs AS (SELECT graph_no, graph_version, object_type, term, count(DISTINCT object_no) AS df FROM grams GROUP BY ALL),
    tscored AS (SELECT query_no, object_type, object_no, round(sum((1 + ln(tf)) * ln(1 + n / df)), 6) AS score
      FROM grams JOIN terms USING (graph_no, graph_version, term) JOIN dfs USING (graph_no, graph_version, object_type, term) JOIN sizes USING (graph_no, graph_version, object_type) GROUP BY ALL),
    textual AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no, object_type ORDER BY score DESC, object_no) AS rank FROM tscored WHERE score > 0) WHERE rank <= 20)""",
    "hybrid": """lists AS (SELECT query_no, object_type, object_no, rank, 0 AS list_no FROM textual UNION ALL SELECT query_no, object_type, object_no, rank, 1 FROM vector WHERE variant_no = 1),
    fused AS (SELECT query_no, object_type, object_no, sum(1.0::double / (60 + rank)) AS score, min(list_no * 1000 + rank) AS first FROM lists GROUP BY ALL),
    hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no, object_type ORDER BY round(score, 12) DESC, first, object_no) AS rank FROM fused) WHERE rank <= 20)""",
    "pool": """ends AS (SELECT graph_no || '@' || graph_version AS query_no, unnest([source_node_no, target_node_no]) AS object_no, unnest([2 * r, 2 * r + 1]) AS "at" FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version ORDER BY graph_edge_no) AS r FROM edges) WHERE r <= 20),
    members AS (SELECT query_no, object_no, min("at") AS "at" FROM (
      SELECT query_no, object_no, rank AS "at" FROM hybrid WHERE object_type = 'NODE' UNION ALL SELECT query_no, object_no, 1000 + "at" FROM ends) GROUP BY ALL),
    pool AS (SELECT query_no, object_no, row_number() OVER (PARTITION BY query_no ORDER BY "at", object_no) AS rank FROM members)""",
    "changes": """places AS (SELECT graph_no, graph_version, row_number() OVER (PARTITION BY graph_no ORDER BY graph_version DESC) AS place FROM (SELECT DISTINCT graph_no, graph_version FROM docs)),
    snaps AS (SELECT d.graph_no, doc_no, lower(sha256) AS sha, place FROM docs d JOIN places USING (graph_no, graph_version)),
    changes AS (SELECT coalesce(n.graph_no, o.graph_no) AS graph_no, coalesce(n.doc_no, o.doc_no) AS doc_no,
        CASE WHEN o.doc_no IS NULL THEN 'new' WHEN n.doc_no IS NULL THEN 'removed' WHEN n.sha IS NOT DISTINCT FROM o.sha THEN 'unchanged' ELSE 'changed' END AS change
      FROM (SELECT * FROM snaps WHERE place = 1) n FULL JOIN (SELECT * FROM snaps WHERE place = 2) o ON n.graph_no = o.graph_no AND n.doc_no = o.doc_no)""",
    "trade": """trade AS (
      SELECT 'nation:' || n_nationkey AS source, 'located_in' AS name, 'region:' || n_regionkey AS target FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'based_in', 'nation:' || c_nationkey FROM customer
      UNION ALL SELECT 'supplier:' || s_suppkey, 'based_in', 'nation:' || s_nationkey FROM supplier
      UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
      UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
      UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey FROM lineitem)""",
    "tasks": """kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
    tasks AS (SELECT event_id::varchar AS task_no, user_id::varchar AS graph_no, user_id, event_id, ts AS "at",
        ['QUEUED', 'RUNNING', 'FAILED', 'SUCCEEDED', 'QUEUED'][(k - 1) % 5 + 1] AS status, (event_id % 4)::int AS attempts,
        CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 900 SECOND END AS lease FROM events JOIN kinds USING (event_type))""",
    "state": """state AS (SELECT 'g:1:' || user_id AS state_key, json_extract_string(props, '$.k') AS node_no, ts AS "at" FROM events),
    touched AS (SELECT state_key, node_no, max("at") AS last_access FROM state GROUP BY ALL),
    seen AS (SELECT state_key, max(last_access) AS seen FROM touched GROUP BY ALL)""",
    "lines": r"""raw_lines AS (SELECT doc_id, graph_no, doc_no, text, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, graph_no, doc_no, text, CASE WHEN text = '' THEN [] WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM raw_lines)""",
    "groups": """reach AS (SELECT graph_no, graph_version, x, y FROM arcs UNION SELECT r.graph_no, r.graph_version, r.x, e.y FROM reach r JOIN arcs e ON e.graph_no = r.graph_no AND e.graph_version = r.graph_version AND e.x = r.y),
    groups AS (SELECT graph_no, graph_version, x AS graph_node_no, least(x, min(y)) AS winner_node_no FROM reach GROUP BY graph_no, graph_version, x)""",
    "arcs": """arcs AS (SELECT graph_no, graph_version, a AS x, b AS y FROM pairs UNION SELECT graph_no, graph_version, b, a FROM pairs)""",
    "hop": """ranking AS (SELECT query_no, object_no, rank AS r FROM vector WHERE variant_no = 1 AND object_type = 'NODE'),
    start AS (SELECT graph_no || '@' || graph_version AS query_no, graph_no, graph_version, min(source_node_no) AS node_no FROM edges GROUP BY graph_no, graph_version),
    walked1 AS (SELECT DISTINCT s.query_no, e.graph_no, e.graph_version, e.graph_edge_no, e.source_node_no, e.target_node_no FROM start s JOIN edges e
      ON e.graph_no = s.graph_no AND e.graph_version = s.graph_version AND (e.source_node_no = s.node_no OR e.target_node_no = s.node_no)),
    ends1 AS (SELECT query_no, graph_no, graph_version, graph_edge_no, source_node_no AS node_no, 0 AS side FROM walked1 UNION ALL SELECT query_no, graph_no, graph_version, graph_edge_no, target_node_no, 1 FROM walked1),
    found1 AS (SELECT e.query_no, e.graph_no, e.graph_version, e.node_no, min(e.graph_edge_no || e.side) AS "at" FROM ends1 e
      WHERE NOT EXISTS (SELECT 1 FROM start s WHERE s.query_no = e.query_no AND s.node_no = e.node_no) GROUP BY ALL),
    hop1 AS (SELECT f.*, 0 AS hop, row_number() OVER (PARTITION BY f.query_no ORDER BY r NULLS LAST, "at", f.node_no) AS place FROM found1 f LEFT JOIN ranking k ON k.query_no = f.query_no AND k.object_no = f.node_no)""",
    "hop2": """front AS (SELECT * FROM hop1 WHERE query_no NOT IN (SELECT query_no FROM hop1 GROUP BY query_no HAVING count(*) >= 5)),
    walked2 AS (SELECT DISTINCT f.query_no, e.graph_no, e.graph_version, e.graph_edge_no, e.source_node_no, e.target_node_no FROM front f JOIN edges e
      ON e.graph_no = f.graph_no AND e.graph_version = f.graph_version AND (e.source_node_no = f.node_no OR e.target_node_no = f.node_no)),
    ends2 AS (SELECT query_no, graph_edge_no, source_node_no AS node_no, 0 AS side FROM walked2 UNION ALL SELECT query_no, graph_edge_no, target_node_no, 1 FROM walked2),
    found2 AS (SELECT e.query_no, e.node_no, min(e.graph_edge_no || e.side) AS "at" FROM ends2 e
      WHERE NOT EXISTS (SELECT 1 FROM start s WHERE s.query_no = e.query_no AND s.node_no = e.node_no)
        AND NOT EXISTS (SELECT 1 FROM hop1 h WHERE h.query_no = e.query_no AND h.node_no = e.node_no) GROUP BY ALL),
    hop2 AS (SELECT f.query_no, f.node_no, 1 AS hop, row_number() OVER (PARTITION BY f.query_no ORDER BY r NULLS LAST, "at", f.node_no) AS place FROM found2 f LEFT JOIN ranking k ON k.query_no = f.query_no AND k.object_no = f.node_no)""",
    "refs": r"""tokens AS (SELECT graph_no, graph_version, graph_node_no, doc_no, trim(token) AS token, token AS raw FROM (
      SELECT graph_no, graph_version, graph_node_no, doc_no, unnest(ts) AS token FROM (SELECT graph_no, graph_version, graph_node_no, unnest(map_keys(ref)) AS doc_no, unnest(map_values(ref)) AS ts FROM alive WHERE ref IS NOT NULL))),
    spans AS (SELECT *, CASE WHEN regexp_full_match(token, '[+]?\d+') THEN token::int WHEN regexp_full_match(token, '\d+\s*-\s*\d+') THEN least(trim(split_part(token, '-', 1))::int, trim(split_part(token, '-', 2))::int) END AS lo,
      CASE WHEN regexp_full_match(token, '[+]?\d+') THEN token::int WHEN regexp_full_match(token, '\d+\s*-\s*\d+') THEN greatest(trim(split_part(token, '-', 1))::int, trim(split_part(token, '-', 2))::int) END AS hi FROM tokens),
    named_lines AS (SELECT DISTINCT graph_no, graph_version, graph_node_no, doc_no, raw AS token, unnest(range(lo, hi + 1)) AS n FROM spans WHERE lo IS NOT NULL)""",
}


def _with(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(_VIEWS[n] for n in names) + "\n"


def _filled(window: int) -> str:
    return f"""wide AS (SELECT DISTINCT graph_no, graph_version, graph_node_no, doc_no, m FROM (SELECT graph_no, graph_version, graph_node_no, doc_no, unnest(range(n - {window}, n + {window} + 1)) AS m FROM named_lines) WHERE m >= 1),
    lagged AS (SELECT *, lag(m) OVER (PARTITION BY graph_no, graph_version, graph_node_no, doc_no ORDER BY m) AS prev FROM wide),
    filled AS (SELECT graph_no, graph_version, graph_node_no, doc_no, unnest(range(CASE WHEN m - prev BETWEEN 2 AND 3 THEN prev + 1 ELSE m END, m + 1))::int AS line_no FROM lagged)"""


SQL["p6_found"] = """
WITH latest AS (
  SELECT graph_no, graph_version, doc_no, lower(sha256) AS sha FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, doc_no ORDER BY update_time DESC NULLS LAST, id DESC) AS rn
    FROM kg_doc WHERE graph_no IS NOT NULL AND graph_version IS NOT NULL AND doc_no IS NOT NULL) WHERE rn = 1),
versions AS (
  SELECT graph_no, graph_version, lag(graph_version) OVER (PARTITION BY graph_no ORDER BY graph_version) AS prev
  FROM (SELECT DISTINCT graph_no, graph_version FROM latest)),
steps AS (SELECT * FROM versions WHERE prev IS NOT NULL),
new_side AS (SELECT l.graph_no, l.graph_version, l.doc_no, l.sha FROM latest l JOIN steps s USING (graph_no, graph_version)),
old_side AS (SELECT l.graph_no, s.graph_version, l.doc_no, l.sha FROM latest l JOIN steps s ON l.graph_no = s.graph_no AND l.graph_version = s.prev)
SELECT coalesce(n.graph_no, o.graph_no) AS graph_no, coalesce(n.graph_version, o.graph_version) AS graph_version,
       coalesce(n.doc_no, o.doc_no) AS doc_no,
       CASE WHEN o.doc_no IS NULL THEN 'added' WHEN n.doc_no IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new_side n FULL JOIN old_side o ON n.graph_no = o.graph_no AND n.graph_version = o.graph_version AND n.doc_no = o.doc_no
WHERE o.doc_no IS NULL OR n.doc_no IS NULL OR n.sha IS DISTINCT FROM o.sha
"""

SQL["scan_scope_filter"] = _with("nodes") + "SELECT graph_no, graph_version, class, count(*) AS nodes FROM alive GROUP BY ALL"
SQL["find_entities_like"] = _with("nodes") + """SELECT h.graph_no, h.graph_version, h.graph_node_no, name, coalesce(d.type, h.type) AS class, d.entity_spec FROM (
  SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version ORDER BY graph_node_no) AS n FROM alive WHERE contains(strip_accents(lower(name)), 'ledger')) h
  LEFT JOIN domains d USING (graph_no, graph_version, graph_node_no) WHERE n <= 20"""
SQL["node_domain_join"] = _with("nodes") + "SELECT n.graph_no, n.graph_version, graph_node_no, coalesce(d.type, n.type) AS class, d.entity_spec, n.deleted FROM nodes n LEFT JOIN domains d USING (graph_no, graph_version, graph_node_no)"
SQL["typed_nodes"] = _with("nodes") + "SELECT graph_no, graph_version, graph_node_no, entity_spec, d.type FROM alive JOIN domains d USING (graph_no, graph_version, graph_node_no)"
SQL["relations_one_hop"] = _with("nodes", "pairs", "edges") + """, both_ways AS (
  SELECT graph_no, graph_version, source_node_no AS node_no, 'out' AS direction, name AS label, target_node_no AS other_no FROM edges
  UNION ALL SELECT graph_no, graph_version, target_node_no, 'in', name, source_node_no FROM edges WHERE source_node_no <> target_node_no)
SELECT b.graph_no, b.graph_version, node_no, direction, label, other_no, coalesce(o.name, '(missing)') AS other_name, coalesce(o.type, '?') AS other_type
FROM both_ways b JOIN nodes w ON w.graph_no = b.graph_no AND w.graph_version = b.graph_version AND w.graph_node_no = b.node_no
LEFT JOIN alive o ON o.graph_no = b.graph_no AND o.graph_version = b.graph_version AND o.graph_node_no = b.other_no"""
SQL["graph_snapshot_closed"] = _with("nodes", "pairs", "edges") + """, snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version ORDER BY graph_node_no) AS n FROM alive) WHERE n <= 200)
SELECT e.graph_no, e.graph_version, graph_edge_no, source_node_no, target_node_no, e.name FROM edges e
WHERE EXISTS (SELECT 1 FROM snap s WHERE s.graph_no = e.graph_no AND s.graph_version = e.graph_version AND s.graph_node_no = source_node_no)
  AND EXISTS (SELECT 1 FROM snap s WHERE s.graph_no = e.graph_no AND s.graph_version = e.graph_version AND s.graph_node_no = target_node_no)"""
_UNREFERENCED = """ FROM alive n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_no = n.graph_no AND e.graph_version = n.graph_version AND (e.source_node_no = n.graph_node_no OR e.target_node_no = n.graph_node_no))"""
SQL["unreferenced_nodes"] = _with("nodes", "pairs", "edges") + "SELECT graph_no, graph_version, graph_node_no" + _UNREFERENCED
SQL["low_support_prune"] = _with("nodes", "pairs", "edges") + "SELECT graph_no, graph_version, graph_node_no, coalesce(cardinality(ref), 0)::int AS support" + _UNREFERENCED + " AND coalesce(cardinality(ref), 0) < 2"

SQL["vector_topk"] = _with("idx", "vector") + "SELECT query_no, object_type, object_no, score, rank FROM vector WHERE variant_no = 1"
SQL["text_bigram_topk"] = _with("idx", "text") + "SELECT query_no, object_type, object_no, score, rank FROM textual"
SQL["hybrid_search"] = _with("idx", "vector", "text", "hybrid") + "SELECT query_no, object_type, object_no, round(score, 6) AS score, rank FROM hybrid"
_LISTS = """WITH e AS (SELECT label, vec_id::varchar AS object_no, embedding::double[] AS v, vec_id FROM embeddings),
q AS (SELECT label, arg_min(v, vec_id) AS q FROM e GROUP BY label),
s AS (SELECT label, object_no, 0 AS list_no, round(list_cosine_similarity(v, q), 6) AS score FROM e JOIN q USING (label) UNION ALL SELECT label, object_no, 1, round(list_dot_product(v, q), 6) FROM e JOIN q USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label, list_no ORDER BY score DESC, object_no) AS rank FROM s),
f AS (SELECT label, object_no, sum(1.0::double / (60 + rank)) AS score, min(list_no * 1000000 + rank) AS first, max(score) AS value FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 12) DESC, first, object_no) AS rank FROM f) """
SQL["rrf_two_lists"] = _LISTS + "SELECT label, object_no, round(score, 6) AS score, rank FROM o WHERE rank <= 10"
SQL["rrf_representative"] = _LISTS + "SELECT label, object_no, value, rank FROM o WHERE rank <= 10"
SQL["candidate_pool"] = _with("nodes", "pairs", "edges", "idx", "vector", "text", "hybrid", "pool") + "SELECT * FROM pool"
SQL["restricted_rerank"] = _with("nodes", "pairs", "edges", "idx", "vector", "text", "hybrid", "pool") + """, again AS (SELECT * FROM (SELECT query_no, object_no, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) AS r
  FROM scored WHERE variant_no = 1 AND object_type = 'NODE' AND score > 0 AND (query_no, object_no) IN (SELECT query_no, object_no FROM pool)) WHERE r <= 20)
SELECT p.query_no, p.object_no, row_number() OVER (PARTITION BY p.query_no ORDER BY coalesce(r, 1000000 + rank), p.object_no) AS rank FROM pool p LEFT JOIN again a ON a.query_no = p.query_no AND a.object_no = p.object_no"""
SQL["multi_query_fusion"] = _with("idx", "vector") + """, fused AS (SELECT query_no AS question_no, object_no, sum(1.0::double / (60 + rank)) AS score, min(variant_no * 1000 + rank) AS first FROM vector WHERE object_type = 'NODE' GROUP BY ALL)
SELECT question_no, object_no, round(score, 6) AS score, row_number() OVER (PARTITION BY question_no ORDER BY round(score, 12) DESC, first, object_no) AS rank FROM fused"""
SQL["retry_ladder"] = _with("idx", "vector") + """, hits AS (SELECT * FROM vector WHERE variant_no = 1 AND object_type = 'NODE'),
tiers AS (SELECT query_no, object_no, rank, tier FROM hits, (VALUES (0, 0.8), (1, 0.4), (2, 0.0)) t(tier, least) WHERE score > least),
chosen AS (SELECT query_no, coalesce(min(tier) FILTER (n >= 5), 2) AS tier FROM (SELECT query_no, tier, count(*) AS n FROM tiers GROUP BY ALL) GROUP BY ALL)
SELECT query_no, tier, object_no, rank FROM tiers JOIN chosen USING (query_no, tier)"""
SQL["expand_one_hop"] = _with("nodes", "pairs", "edges", "idx", "vector", "hop") + "SELECT query_no, node_no AS object_no, place AS rank FROM hop1 WHERE place <= 3"
SQL["expand_two_hops"] = _with("nodes", "pairs", "edges", "idx", "vector", "hop", "hop2") + """SELECT * FROM (SELECT query_no, node_no AS object_no, row_number() OVER (PARTITION BY query_no ORDER BY hop, place) AS rank
  FROM (SELECT query_no, node_no, hop, place FROM hop1 UNION ALL SELECT query_no, node_no, hop, place FROM hop2)) WHERE rank <= 5"""
SQL["connecting_edges"] = _with("nodes", "pairs", "edges", "idx", "vector", "hop") + """, inside AS (SELECT query_no, node_no FROM start UNION SELECT query_no, node_no FROM hop1 WHERE place <= 3)
SELECT query_no, graph_edge_no, source_node_no, target_node_no FROM walked1 WHERE (query_no, source_node_no) IN (SELECT query_no, node_no FROM inside) AND (query_no, target_node_no) IN (SELECT query_no, node_no FROM inside)"""
SQL["explored_exclusion"] = _with("nodes", "pairs", "edges", "idx", "vector", "text", "hybrid", "pool") + """SELECT p.query_no, p.object_no, p.rank - 3 AS rank FROM pool p
WHERE p.rank BETWEEN 4 AND 8 AND p.query_no IN (SELECT query_no FROM questions) AND EXISTS (SELECT 1 FROM alive a WHERE a.graph_no || '@' || a.graph_version = p.query_no AND a.graph_node_no = p.object_no)"""
SQL["ref_expand"] = _with("nodes", "refs") + "SELECT graph_no, graph_version, graph_node_no, doc_no, token, n::int AS line_no FROM named_lines"
SQL["ref_gap_merge"] = _with("nodes", "refs") + ", " + _filled(1) + " SELECT * FROM filled"
SQL["evidence_lines"] = _with("nodes", "refs", "lines") + ", " + _filled(0) + """, vs AS (SELECT graph_no, max(graph_version) AS graph_version FROM alive GROUP BY graph_no),
numbered AS (SELECT l.graph_no, vs.graph_version, l.doc_no, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS content FROM lines l JOIN vs USING (graph_no) WHERE len(parts) > 0)
SELECT f.graph_no, f.graph_version, graph_node_no, f.doc_no, f.line_no, sha256(content) AS line_hash FROM filled f JOIN numbered n ON n.graph_no = f.graph_no AND n.graph_version = f.graph_version AND n.doc_no = f.doc_no AND n.line_no = f.line_no"""
SQL["chunk_channel"] = _with("idx", "vector", "text", "hybrid") + """, hits AS (SELECT query_no, object_no, score FROM hybrid WHERE object_type = 'DOC_CHUNK'),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) AS rank FROM hits) WHERE rank <= 10),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY graph_version DESC, graph_no DESC, id DESC) AS rn FROM kg_doc_chunk) WHERE rn = 1)
SELECT query_no, chunk_no, graph_version, doc_no, line_start, line_end, rank FROM cut JOIN newest ON object_no = chunk_no"""

SQL["doc_lines"] = _with("lines") + """SELECT doc_id, line_no::int AS line_no, length(line)::int AS n_chars, sha256(line) AS line_hash FROM (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM lines WHERE len(parts) > 0)"""
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"
SQL["doc_titles"] = _with("lines") + f"""SELECT doc_id, left(coalesce(list_filter([regexp_replace(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'), '^#+{_WS}*', '') FOR x IN parts], lambda y: y <> '')[1], doc_no), 512) AS title FROM lines"""
SQL["numbered_text"] = _with("lines") + "SELECT doc_id, sha256(array_to_string(list_transform(parts, lambda x, i: '[' || i || '] ' || x), chr(10))) AS numbered_hash FROM lines"
SQL["chunk_docs"] = """WITH RECURSIVE t AS (SELECT graph_no, doc_no, text, length(text) AS n, string_split(text, '') AS ch FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]')),
feeds AS (SELECT graph_no, doc_no, unnest(list_filter(range(0, len(ch)), lambda i: ch[i + 1] = chr(10))) AS p FROM t),
cuts AS (
  SELECT graph_no, doc_no, n, 0::bigint AS s, least(800, n)::bigint AS hard FROM t
  UNION ALL
  SELECT c.graph_no, c.doc_no, c.n, c.nxt, least(c.nxt + 800, c.n) FROM (
    SELECT x.graph_no, x.doc_no, x.n, CASE WHEN x.e - 200 > x.s THEN x.e - 200 ELSE x.e END AS nxt, x.e FROM (
      SELECT k.graph_no, k.doc_no, k.n, k.s, CASE WHEN k.hard < k.n AND max(f.p) - k.s > 400 THEN max(f.p) ELSE k.hard END AS e
      FROM cuts k LEFT JOIN feeds f ON f.graph_no = k.graph_no AND f.doc_no = k.doc_no AND f.p >= k.s AND f.p < k.hard GROUP BY k.graph_no, k.doc_no, k.n, k.s, k.hard) x) c WHERE c.e < c.n),
ended AS (SELECT k.graph_no, k.doc_no, k.s, CASE WHEN k.hard < k.n AND max(f.p) - k.s > 400 THEN max(f.p) ELSE k.hard END AS e
  FROM cuts k LEFT JOIN feeds f ON f.graph_no = k.graph_no AND f.doc_no = k.doc_no AND f.p >= k.s AND f.p < k.hard GROUP BY k.graph_no, k.doc_no, k.n, k.s, k.hard),
pieces AS (SELECT e.graph_no, e.doc_no, e.s, e.e, substr(t.text, e.s::int + 1, (e.e - e.s)::int) AS piece, t.text FROM ended e JOIN t USING (graph_no, doc_no)),
solid AS (SELECT *, row_number() OVER (PARTITION BY graph_no, doc_no ORDER BY s) - 1 AS chunk_index FROM pieces WHERE regexp_matches(piece, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]'))
SELECT graph_no, doc_no, left(sha256(doc_no || '#' || chunk_index), 32) AS chunk_no, chunk_index::int AS chunk_index,
  (1 + (SELECT count(*) FROM feeds f WHERE f.graph_no = p.graph_no AND f.doc_no = p.doc_no AND f.p < p.s))::int AS line_start,
  (1 + (SELECT count(*) FROM feeds f WHERE f.graph_no = p.graph_no AND f.doc_no = p.doc_no AND f.p < greatest(p.s, p.e - 1)))::int AS line_end,
  sha256(trim(piece, chr(10))) AS content_hash FROM solid p"""
_PLAN = "|".join(["plan", "roadmap", "prd", "design", "spec", "proposal", "milestone", "schedule", "计划", "规划", "路线图", "方案", "设计", "需求", "里程碑"])
SQL["source_classes"] = _with("docs") + f"""SELECT graph_no, graph_version, doc_no, CASE
  WHEN regexp_extract(lower(doc_no), '\\.[^./]+$') IN ('.py','.go','.ts','.tsx','.js','.jsx','.java','.rs','.c','.h','.cpp','.hpp','.cc','.cs','.rb','.php','.kt','.swift','.scala','.m','.mm') THEN 'CODE'
  WHEN regexp_matches(lower(doc_no), '{_PLAN}') OR regexp_matches(lower(coalesce(title, '')), '{_PLAN}') THEN 'PLAN' ELSE 'DOC' END AS source_class FROM docs"""
SQL["content_hashes"] = _with("docs") + """, newest AS (SELECT graph_no, doc_no, arg_max(lower(sha256), graph_version) AS stored FROM docs WHERE sha256 IS NOT NULL GROUP BY ALL)
SELECT d.graph_no, d.doc_no, sha256(d.text) AS sha256, coalesce(sha256(d.text) = stored, false) AS agrees FROM documents d JOIN newest USING (graph_no, doc_no)"""
SQL["url_keys"] = _with("docs") + r"""SELECT graph_no, graph_version, doc_no, left('url:' || regexp_replace(regexp_replace(regexp_replace(origin_url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '[?#].*$', ''), '/+$', ''), 512) AS url_no FROM docs WHERE trim(origin_url) <> ''"""
SQL["edge_keys"] = _with("trade") + "SELECT source, name, target, left(sha256(source || '|' || name || '|' || target), 32) AS edge_no FROM trade"

SQL["validate_nodes"] = """WITH x AS (SELECT id AS seq, name, split_part(graph_node_no, ':', 1) AS type, CASE WHEN len(string_split(graph_node_no, ':')) > 2 THEN split_part(graph_node_no, ':', 2) END AS spec FROM kg_graph_node),
y AS (SELECT *, CASE WHEN name IS NULL OR trim(name) = '' THEN 'node: empty name' WHEN type NOT IN ('Asset', 'Relation', 'Event', 'Behavior') THEN 'node: unknown type'
  WHEN type = 'Asset' AND coalesce(spec, '') NOT IN ('Solution', 'Mission', 'Implementation', 'ServiceInstance', 'Artifact') THEN 'node: unknown archetype' ELSE '' END AS reason FROM x)
SELECT seq, CASE WHEN reason = '' AND type = 'Asset' THEN spec END AS entity_spec, reason FROM y"""
SQL["validate_edges"] = """WITH names AS (SELECT DISTINCT graph_no, string_split(graph_node_no, ':')[-1] AS name FROM kg_graph_node
  WHERE trim(name) <> '' AND (split_part(graph_node_no, ':', 1) IN ('Relation', 'Event', 'Behavior') OR (split_part(graph_node_no, ':', 1) = 'Asset' AND len(string_split(graph_node_no, ':')) > 2 AND split_part(graph_node_no, ':', 2) IN ('Solution', 'Mission', 'Implementation', 'ServiceInstance', 'Artifact')))),
e AS (SELECT id AS seq, graph_no, string_split(winner_node_no, ':')[-1] AS source, string_split(loser_node_no, ':')[-1] AS target, CASE status WHEN 'MERGED' THEN 'EXTRACTED' WHEN 'PRUNED' THEN 'MAYBE' ELSE 'INFERRED' END AS confidence FROM kg_merge_log)
SELECT seq, confidence, CASE WHEN confidence = 'MAYBE' THEN 'edge: unknown confidence'
  WHEN NOT EXISTS (SELECT 1 FROM names n WHERE n.graph_no = e.graph_no AND n.name = source) THEN 'edge: unknown source'
  WHEN NOT EXISTS (SELECT 1 FROM names n WHERE n.graph_no = e.graph_no AND n.name = target) THEN 'edge: unknown target' ELSE '' END AS reason FROM e"""
SQL["node_upsert"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, graph_node_no ORDER BY id) AS n FROM kg_graph_node),
old AS (SELECT * FROM r WHERE n = 1),
said AS (SELECT graph_no, graph_version, graph_node_no, arg_max(description, n) AS d FROM r WHERE n > 1 AND coalesce(description, '') <> '' GROUP BY ALL),
toks AS (SELECT graph_no, graph_version, graph_node_no, n, unnest(map_keys(ref)) AS doc, unnest(map_values(ref)) AS ts FROM r WHERE ref IS NOT NULL),
kept AS (SELECT t.* FROM toks t JOIN old o USING (graph_no, graph_version, graph_node_no) WHERE t.n = 1 OR NOT coalesce(o.deleted, false)),
sup AS (SELECT graph_no, graph_version, graph_node_no, count(DISTINCT doc) AS support FROM kept GROUP BY ALL),
tok AS (SELECT graph_no, graph_version, graph_node_no, count(DISTINCT t) AS tokens, bool_or(t IS NULL) AS hole FROM (SELECT graph_no, graph_version, graph_node_no, n, unnest(ts) AS t FROM kept) GROUP BY ALL)
SELECT o.graph_no, o.graph_version, o.graph_node_no, o.name, CASE WHEN coalesce(o.deleted, false) THEN o.description ELSE coalesce(s.d, o.description) END AS description,
  coalesce(sup.support, 0)::int AS support, CASE WHEN o.ref IS NULL AND sup.support IS NULL THEN NULL ELSE coalesce(tok.tokens, 0) END::int AS tokens, coalesce(o.deleted, false) AS deleted
FROM old o LEFT JOIN said s USING (graph_no, graph_version, graph_node_no) LEFT JOIN sup USING (graph_no, graph_version, graph_node_no) LEFT JOIN tok USING (graph_no, graph_version, graph_node_no)"""
SQL["edge_upsert"] = _with("nodes", "pairs", "edges") + """SELECT graph_no, graph_version, graph_edge_no, source_node_no, target_node_no, name, '{"confidence":"EXTRACTED"}' AS properties, coalesce(cardinality(ref), 0)::int AS support FROM edges"""
SQL["index_copy_version"] = _with("idx") + """SELECT graph_no, graph_version + 1 AS graph_version, object_type, object_no, len(embedding)::int AS dim FROM idx WHERE graph_version = (SELECT max(graph_version) FROM idx)"""
SQL["reindex_counts"] = _with("nodes", "pairs", "edges") + """, all_rows AS (SELECT graph_no, graph_version, 'NODE' AS t FROM alive UNION ALL SELECT graph_no, graph_version, 'EDGE' FROM edges
  UNION ALL SELECT graph_no, graph_version, 'DOC_CHUNK' FROM (SELECT DISTINCT graph_no, graph_version, chunk_no FROM kg_doc_chunk))
SELECT graph_no, graph_version, count(*) FILTER (t = 'NODE') AS nodes, count(*) FILTER (t = 'EDGE') AS edges, count(*) FILTER (t = 'DOC_CHUNK') AS doc_chunks FROM all_rows GROUP BY ALL"""

SQL["fusion_candidates"] = _with("nodes") + rf""", g AS (SELECT graph_no, graph_version, graph_node_no, class, list_distinct([substr(lower(bare), i, 2) FOR i IN range(1, greatest(length(bare) - 1, 1) + 1)]) AS grams FROM (SELECT *, regexp_replace(name, '^{_WS}+|{_WS}+$', '', 'g') AS bare FROM alive) WHERE length(bare) > 0),
posted AS (SELECT graph_no, graph_version, graph_node_no, class, unnest(grams) AS gram FROM g),
rare AS (SELECT graph_no, graph_version, class, gram FROM posted GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT a.graph_no, a.graph_version, a.graph_node_no, b.graph_node_no AS candidate_no FROM posted a JOIN rare r USING (graph_no, graph_version, class, gram) JOIN posted b USING (graph_no, graph_version, class, gram)
  WHERE a.graph_node_no <> b.graph_node_no GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT p.*, round(len(list_intersect(x.grams, y.grams)) / len(list_distinct(list_concat(x.grams, y.grams))), 6) AS score FROM p
  JOIN g x USING (graph_no, graph_version, graph_node_no) JOIN g y ON y.graph_no = p.graph_no AND y.graph_version = p.graph_version AND y.graph_node_no = p.candidate_no)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, graph_node_no ORDER BY score DESC, candidate_no) AS rank FROM s) WHERE rank <= 10"""
SQL["fusion_clusters"] = SQL["fusion_candidates"].replace("SELECT * FROM (SELECT *, row_number()", ", cand AS (SELECT * FROM (SELECT *, row_number()", 1) + rf"""),
member AS (SELECT c.graph_no, c.graph_version, c.graph_node_no AS seed, 0 AS rank, c.graph_node_no AS no FROM (SELECT DISTINCT graph_no, graph_version, graph_node_no FROM cand) c UNION ALL SELECT graph_no, graph_version, graph_node_no, rank, candidate_no FROM cand),
said AS (SELECT m.*, n.name, lower(regexp_extract(n.name, '{_WS}*(.*)', 1)) AS low FROM member m JOIN nodes n ON n.graph_no = m.graph_no AND n.graph_version = m.graph_version AND n.graph_node_no = m.no),
worded AS (SELECT *, regexp_split_to_array(low, '{_WS}+')[1] AS word FROM said),
firsts AS (SELECT graph_no, graph_version, seed, word, arg_min(no, rank) AS lead FROM worded GROUP BY ALL HAVING count(DISTINCT name) > 1)
SELECT DISTINCT w.graph_no, w.graph_version, least(no, lead) AS a, greatest(no, lead) AS b FROM worded w JOIN firsts USING (graph_no, graph_version, seed, word) WHERE no <> lead"""
SQL["slug_plain"] = _with("nodes") + rf"""SELECT graph_no, graph_version, graph_node_no, slug, class || ':' || slug AS node_no FROM (SELECT *, CASE WHEN kept = '' THEN 'unnamed' ELSE kept END AS slug FROM (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(name, '^{_WS}+|{_WS}+$', '', 'g')), '{_WS}+', '-', 'g'), '[^0-9a-z一-鿿\-]', '', 'g') AS kept FROM nodes WHERE name IS NOT NULL))"""
SQL["tag_escape"] = _with("nodes") + r"""SELECT graph_no, graph_version, graph_node_no, regexp_replace(name, '([,.<>{}\[\]"'':;!@#$%^&*()\-+=~/ \\])', '\\\1', 'g') AS tag FROM nodes WHERE name IS NOT NULL"""
SQL["source_types"] = r"""SELECT doc_id, ltrim(lower(regexp_extract(doc_no, '(\.[^./]+)$', 1)), '.') AS source_type FROM documents"""
SQL["task_enqueue"] = _with("tasks") + """SELECT graph_no, coalesce(min(event_id) FILTER (status IN ('QUEUED', 'RUNNING'))::varchar, 'new-' || graph_no) AS task_no, count(*) FILTER (status IN ('QUEUED', 'RUNNING')) = 0 AS created FROM tasks GROUP BY graph_no"""
SQL["task_finish"] = _with("tasks") + """SELECT task_no, CASE WHEN status <> 'RUNNING' THEN status WHEN lease IS NOT NULL THEN 'SUCCEEDED' WHEN attempts < 3 THEN 'QUEUED' ELSE 'FAILED' END AS status, CASE WHEN status = 'RUNNING' AND lease IS NULL THEN 'boom' END AS error,
  status = 'QUEUED' OR (status = 'RUNNING' AND lease IS NULL AND attempts < 3) AS active, status <> 'RUNNING' AND lease IS NOT NULL AS leased FROM tasks"""
SQL["step_plan"] = _with("tasks") + """SELECT graph_no AS run_no, task_no AS step_key, CASE WHEN status IN ('QUEUED', 'FAILED') THEN 'SKIPPED' ELSE status END AS status, attempts FROM tasks UNION ALL SELECT DISTINCT graph_no, 'new', 'PENDING', 0 FROM tasks"""
SQL["step_checkpoint"] = _with("tasks") + """SELECT graph_no AS run_no, task_no AS step_key, CASE status WHEN 'QUEUED' THEN 'RUNNING' WHEN 'RUNNING' THEN 'SUCCEEDED' ELSE status END AS status, attempts + (status = 'QUEUED')::int AS attempts,
  CASE WHEN status = 'FAILED' THEN 'again' END AS error, status <> 'QUEUED' AS finished FROM tasks"""
SQL["fusion_components"] = _with("pairs", "arcs", "groups", recursive=True) + "SELECT * FROM groups"
_GROUPED = """, g AS (SELECT graph_no, graph_version, graph_node_no, min(graph_node_no) OVER (PARTITION BY graph_no, graph_version, winner_node_no) AS winner_node_no FROM groups
  WHERE (graph_no, graph_version, graph_node_no) IN (SELECT graph_no, graph_version, graph_node_no FROM alive)) """
SQL["merge_nodes"] = _with("nodes", "pairs", "arcs", "groups", recursive=True) + _GROUPED + """,
members AS (SELECT g.winner_node_no, n.* FROM g JOIN alive n USING (graph_no, graph_version, graph_node_no)),
long AS (SELECT graph_no, graph_version, winner_node_no AS graph_node_no, max(length(description)) FILTER (graph_node_no <> winner_node_no) AS n FROM members GROUP BY ALL HAVING count(*) FILTER (graph_node_no <> winner_node_no) > 0),
sup AS (SELECT graph_no, graph_version, winner_node_no AS graph_node_no, count(DISTINCT doc) AS support FROM (SELECT graph_no, graph_version, winner_node_no, unnest(map_keys(ref)) AS doc FROM members) GROUP BY ALL)
SELECT n.graph_no, n.graph_version, n.graph_node_no, n.name,
  CASE WHEN l.graph_node_no IS NOT NULL AND coalesce(l.n, 0) > coalesce(length(n.description), 0) THEN l.n ELSE length(n.description) END::int AS description_length,
  CASE WHEN l.graph_node_no IS NOT NULL AND s.support IS NOT NULL THEN s.support ELSE coalesce(cardinality(n.ref), 0) END::int AS support,
  coalesce(n.deleted, false) OR (g.winner_node_no IS NOT NULL AND g.winner_node_no <> n.graph_node_no) AS deleted
FROM nodes n LEFT JOIN long l USING (graph_no, graph_version, graph_node_no) LEFT JOIN sup s USING (graph_no, graph_version, graph_node_no) LEFT JOIN g USING (graph_no, graph_version, graph_node_no)"""
_REMAPPED = """, m AS (SELECT e.*, e.graph_edge_no AS old_no, e.source_node_no AS s0, e.target_node_no AS t0, coalesce(a.winner_node_no, e.source_node_no) AS s1, coalesce(b.winner_node_no, e.target_node_no) AS t1 FROM near e
  LEFT JOIN g a ON a.graph_no = e.graph_no AND a.graph_version = e.graph_version AND a.graph_node_no = e.source_node_no LEFT JOIN g b ON b.graph_no = e.graph_no AND b.graph_version = e.graph_version AND b.graph_node_no = e.target_node_no),
k AS (SELECT *, CASE WHEN s0 <> s1 OR t0 <> t1 THEN left(sha256(s1 || '|cites|' || t1), 32) ELSE old_no END AS new_no, (s0 <> s1 OR t0 <> t1) AND s1 = t1 AS loop FROM m),
placed AS (SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, new_no ORDER BY old_no <> new_no, old_no) AS place, count(*) OVER (PARTITION BY graph_no, graph_version, new_no) AS size FROM k WHERE NOT loop) """
_MERGED = _with("nodes", "pairs", "arcs", "groups", "near", recursive=True) + _GROUPED + _REMAPPED
SQL["merge_edges_remap"] = _MERGED + """, d AS (SELECT graph_no, graph_version, new_no, count(DISTINCT doc) AS support FROM (SELECT graph_no, graph_version, new_no, unnest(docs) AS doc FROM placed) GROUP BY ALL)
SELECT p.graph_no, p.graph_version, p.new_no AS graph_edge_no, s1 AS source_node_no, t1 AS target_node_no, support::int AS support, (size - 1)::int AS folded FROM placed p JOIN d USING (graph_no, graph_version, new_no) WHERE place = 1"""
SQL["merge_edges_dropped"] = _MERGED + """, gone AS (SELECT graph_no, graph_version, old_no, s0, t0, description FROM placed WHERE place > 1 UNION ALL SELECT graph_no, graph_version, old_no, s0, t0, description FROM k WHERE loop)
SELECT graph_no, graph_version, old_no AS graph_edge_no, s0 AS source_node_no, t0 AS target_node_no, description FROM gone
WHERE (graph_no, graph_version, old_no) NOT IN (SELECT graph_no, graph_version, new_no FROM placed WHERE place = 1)"""
SQL["rollback_nodes"] = _with("nodes") + """SELECT graph_no, graph_version, graph_node_no, name, description, properties,
  array_to_string(list_sort(list_transform(map_entries(ref), lambda e: e.key || '=' || array_to_string(list_sort(e.value), ','))), ';') AS refs, coalesce(deleted, false) AS deleted FROM nodes"""
SQL["rollback_edges"] = _with("nodes", "near") + """SELECT graph_no, graph_version, graph_edge_no, source_node_no, target_node_no, name, description, '{"confidence":"INFERRED"}' AS properties,
  array_to_string(list_sort(list_transform(docs, lambda d: d || '=1')), ';') AS refs, false AS deleted FROM near"""
SQL["rollback_aliases"] = _with("nodes") + """SELECT graph_no, graph_version, min(graph_node_no) AS canonical_node_no, '~' || name AS alias, 'import' AS source FROM alive WHERE name IS NOT NULL GROUP BY graph_no, graph_version, name"""
SQL["rollback_domain"] = _with("nodes", "pairs", "arcs", "groups", recursive=True) + _GROUPED + """,
lost AS (SELECT graph_no, graph_version, count(*) AS lost FROM g JOIN domains d USING (graph_no, graph_version, graph_node_no) WHERE winner_node_no <> graph_node_no GROUP BY ALL)
SELECT graph_no, graph_version, type, count(*) AS n_rows, 0::bigint AS deleted, coalesce(any_value(lost), 0)::bigint AS lost FROM domains LEFT JOIN lost USING (graph_no, graph_version) GROUP BY graph_no, graph_version, type"""
_ALIASES = """, wanted AS (SELECT DISTINCT p.graph_no, p.graph_version, a AS canonical_node_no, n.name AS alias FROM pairs p JOIN nodes n ON n.graph_no = p.graph_no AND n.graph_version = p.graph_version AND n.graph_node_no = p.b WHERE n.name IS NOT NULL AND trim(n.name) <> ''),
aliases AS (SELECT graph_no, graph_version, min(canonical_node_no) AS canonical_node_no, alias, 'merge' AS source FROM wanted GROUP BY graph_no, graph_version, alias) """
SQL["alias_owner"] = _with("nodes", "pairs") + _ALIASES + "SELECT * FROM aliases"
SQL["alias_lookup"] = _with("nodes", "pairs") + _ALIASES + """SELECT n.graph_node_no AS wanted, n.graph_no, n.graph_version, n.graph_node_no, coalesce(string_agg(DISTINCT alias, '|' ORDER BY alias), '') AS aliases
FROM alive n LEFT JOIN aliases a ON a.graph_no = n.graph_no AND a.graph_version = n.graph_version AND a.canonical_node_no = n.graph_node_no GROUP BY n.graph_no, n.graph_version, n.graph_node_no"""

_RECALLED = _with("nodes", "near", "idx", "vector", "text", "hybrid") + """,
pool AS (SELECT query_no, object_no, rank FROM hybrid WHERE object_type = 'NODE'),
first_lists AS (SELECT query_no, object_no, 0 AS l, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) AS rank FROM tscored t WHERE object_type = 'NODE' AND score > 0 AND EXISTS (SELECT 1 FROM pool p WHERE p.query_no = t.query_no AND p.object_no = t.object_no)
  UNION ALL SELECT query_no, object_no, 1, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) FROM scored s WHERE object_type = 'NODE' AND variant_no = 1 AND score > 0 AND EXISTS (SELECT 1 FROM pool p WHERE p.query_no = s.query_no AND p.object_no = s.object_no)),
first_fused AS (SELECT query_no, object_no, sum(1.0::double / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM first_lists WHERE rank <= 20 GROUP BY ALL),
again AS (SELECT query_no, object_no, row_number() OVER (PARTITION BY query_no ORDER BY round(score, 12) DESC, first, object_no) AS rank FROM first_fused),
ordered AS (SELECT p.query_no, p.object_no, row_number() OVER (PARTITION BY p.query_no ORDER BY coalesce(a.rank, 1000 + p.rank), p.object_no) AS rank FROM pool p LEFT JOIN again a USING (query_no, object_no)),
scopes AS (SELECT DISTINCT query_no, graph_no, graph_version FROM questions),
seed AS (SELECT o.query_no, graph_no, graph_version, object_no, rank FROM ordered o JOIN scopes USING (query_no) JOIN alive n USING (graph_no, graph_version) WHERE rank <= 5 AND n.graph_node_no = o.object_no),
walked AS (SELECT DISTINCT s.query_no, e.* FROM seed s JOIN near e ON e.graph_no = s.graph_no AND e.graph_version = s.graph_version AND (e.source_node_no = s.object_no OR e.target_node_no = s.object_no)),
ends AS (SELECT query_no, graph_no, graph_version, graph_edge_no || '0' AS pos, source_node_no AS object_no FROM walked UNION ALL SELECT query_no, graph_no, graph_version, graph_edge_no || '1', target_node_no FROM walked),
cand AS (SELECT query_no, graph_no, graph_version, object_no, min(pos) AS pos FROM ends e WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.query_no = e.query_no AND s.object_no = e.object_no) GROUP BY ALL),
hop_lists AS (SELECT query_no, object_no, 0 AS l, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) AS rank FROM tscored t WHERE object_type = 'NODE' AND score > 0 AND EXISTS (SELECT 1 FROM cand p WHERE p.query_no = t.query_no AND p.object_no = t.object_no)
  UNION ALL SELECT query_no, object_no, 1, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) FROM scored s WHERE object_type = 'NODE' AND variant_no = 1 AND score > 0 AND EXISTS (SELECT 1 FROM cand p WHERE p.query_no = s.query_no AND p.object_no = s.object_no)),
hop_fused AS (SELECT query_no, object_no, sum(1.0::double / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM hop_lists WHERE rank <= 12 GROUP BY ALL),
hop AS (SELECT * FROM (SELECT query_no, object_no, row_number() OVER (PARTITION BY query_no ORDER BY round(score, 12) DESC, first, object_no) AS r FROM hop_fused) WHERE r <= 12),
neighbour AS (SELECT c.* FROM (SELECT c.query_no, graph_no, graph_version, c.object_no, row_number() OVER (PARTITION BY c.query_no ORDER BY r NULLS LAST, pos, c.object_no) AS rank FROM cand c LEFT JOIN hop h ON h.query_no = c.query_no AND h.object_no = c.object_no) c
  JOIN alive n ON n.graph_no = c.graph_no AND n.graph_version = c.graph_version AND n.graph_node_no = c.object_no WHERE rank <= 3),
member AS (SELECT query_no, graph_no, graph_version, object_no FROM seed UNION SELECT query_no, graph_no, graph_version, object_no FROM neighbour),
link AS (SELECT w.* FROM walked w WHERE EXISTS (SELECT 1 FROM member m WHERE m.query_no = w.query_no AND m.object_no = w.source_node_no) AND EXISTS (SELECT 1 FROM member m WHERE m.query_no = w.query_no AND m.object_no = w.target_node_no)) """
SQL["recall_full"] = _RECALLED + """,
cdf AS (SELECT term, count(DISTINCT object_no) AS df FROM grams WHERE object_type = 'DOC_CHUNK' GROUP BY term),
ct AS (SELECT query_no, object_no, max(score) AS score FROM (SELECT query_no, g.graph_no, g.graph_version, object_no, round(sum((1 + ln(tf)) * ln(1 + (SELECT count(DISTINCT object_no) FROM idx WHERE object_type = 'DOC_CHUNK') / df)), 6) AS score
  FROM grams g JOIN (SELECT DISTINCT query_no, term FROM terms) t USING (term) JOIN cdf USING (term) WHERE object_type = 'DOC_CHUNK' GROUP BY ALL) GROUP BY ALL),
cv AS (SELECT q.query_no, i.object_no, max(round(CASE WHEN list_dot_product(i.embedding, i.embedding) > 0 AND list_dot_product(q.embedding, q.embedding) > 0 THEN list_cosine_similarity(i.embedding, q.embedding) ELSE 0 END, 6)) AS score
  FROM (SELECT * FROM idx WHERE object_type = 'DOC_CHUNK' AND len(embedding) = 64) i, (SELECT * FROM questions WHERE variant_no = 1) q GROUP BY ALL),
cl AS (SELECT query_no, object_no, 0 AS l, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) AS rank FROM ct WHERE score > 0 UNION ALL SELECT query_no, object_no, 1, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) FROM cv WHERE score > 0),
cf AS (SELECT query_no, object_no, sum(1.0::double / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM cl WHERE rank <= 10 GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY round(score, 12) DESC, first, object_no) AS r FROM cf),
chunk AS (SELECT query_no, object_no, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, object_no) AS rank FROM cr WHERE r <= 10)
SELECT query_no, 'seed' AS part, object_no, rank::int AS rank FROM seed UNION ALL SELECT query_no, 'neighbour', object_no, rank::int FROM neighbour UNION ALL SELECT query_no, 'edge', graph_edge_no, 0 FROM link
UNION ALL SELECT query_no, 'chunk', object_no, rank::int FROM chunk WHERE object_no IN (SELECT chunk_no FROM kg_doc_chunk)"""
SQL["recall_evidence"] = _RECALLED + ", " + _VIEWS["refs"] + ", " + _VIEWS["lines"] + """,
said AS (SELECT DISTINCT m.query_no, m.graph_no, m.graph_version, t.doc_no, t.n FROM member m JOIN named_lines t ON t.graph_no = m.graph_no AND t.graph_version = m.graph_version AND t.graph_node_no = m.object_no WHERE n >= 1
  UNION SELECT query_no, graph_no, graph_version, unnest(docs), 1 FROM link),
gaps AS (SELECT *, lag(n) OVER (PARTITION BY query_no, graph_no, graph_version, doc_no ORDER BY n) AS prev FROM said),
full_lines AS (SELECT query_no, graph_no, graph_version, doc_no, unnest(range(CASE WHEN n - prev BETWEEN 2 AND 3 THEN prev + 1 ELSE n END, n + 1))::int AS line_no FROM gaps),
vs AS (SELECT graph_no, max(graph_version) AS graph_version FROM nodes GROUP BY graph_no),
numbered AS (SELECT l.graph_no, vs.graph_version, l.doc_no, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS content FROM lines l JOIN vs USING (graph_no) WHERE len(parts) > 0)
SELECT f.query_no, f.doc_no, f.line_no, sha256(content) AS line_hash FROM full_lines f JOIN numbered n ON n.graph_no = f.graph_no AND n.graph_version = f.graph_version AND n.doc_no = f.doc_no AND n.line_no = f.line_no"""
SQL["searchable_text"] = _with("nodes", "pairs", "edges") + _ALIASES + rf""", said AS (SELECT graph_no, graph_version, canonical_node_no AS graph_node_no, list(DISTINCT regexp_replace(alias, '^{_WS}+|{_WS}+$', '', 'g')) AS aliases, list(alias ORDER BY alias) AS raw FROM aliases GROUP BY ALL),
keyed AS (SELECT graph_no, graph_version, graph_node_no, k, json_extract(properties, '$."' || k || '"') AS v FROM (SELECT graph_no, graph_version, graph_node_no, properties, unnest(json_keys(properties)) AS k FROM alive WHERE json_valid(properties) AND json_type(properties) = 'OBJECT')),
props AS (SELECT graph_no, graph_version, graph_node_no, list(k || ': ' || regexp_replace(v ->> '$', '^{_WS}+|{_WS}+$', '', 'g') ORDER BY k) AS parts FROM keyed WHERE json_type(v) = 'VARCHAR' AND regexp_replace(v ->> '$', '^{_WS}+|{_WS}+$', '', 'g') <> '' GROUP BY ALL),
joined AS (SELECT n.*, [regexp_replace(name, '^{_WS}+|{_WS}+$', '', 'g'), regexp_replace(description, '^{_WS}+|{_WS}+$', '', 'g')] || coalesce(parts, []) || coalesce(list_transform(raw, lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), []) AS all_parts
  FROM alive n LEFT JOIN props USING (graph_no, graph_version, graph_node_no) LEFT JOIN said USING (graph_no, graph_version, graph_node_no))
SELECT graph_no, graph_version, 'NODE' AS object_type, graph_node_no AS object_no, sha256(array_to_string(list_filter(all_parts, lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS text_hash FROM joined
UNION ALL SELECT graph_no, graph_version, 'EDGE', graph_edge_no, sha256('same_as' || chr(10) || 'confidence: INFERRED') FROM edges
UNION ALL SELECT graph_no, graph_version, 'DOC_CHUNK', chunk_no, sha256(content) FROM (SELECT DISTINCT graph_no, graph_version, chunk_no, content FROM kg_doc_chunk)"""
SQL["classify_versions"] = _with("docs", "changes") + "SELECT * FROM changes"
_KEPT = """, entries AS (SELECT graph_no, graph_node_no, unnest(map_keys(ref)) AS doc_no FROM alive WHERE ref IS NOT NULL),
kept AS (SELECT e.graph_no, graph_node_no, string_agg(DISTINCT e.doc_no, '|' ORDER BY e.doc_no) AS docs FROM entries e JOIN changes c ON c.graph_no = e.graph_no AND c.doc_no = e.doc_no AND c.change = 'unchanged' GROUP BY e.graph_no, graph_node_no) """
SQL["project_nodes"] = _with("nodes", "docs", "changes") + _KEPT + "SELECT * FROM kept"
SQL["project_edges"] = _with("nodes", "pairs", "edges", "docs", "changes") + _KEPT + """, inside AS (SELECT * FROM edges e WHERE (graph_no, source_node_no) IN (SELECT graph_no, graph_node_no FROM kept) AND (graph_no, target_node_no) IN (SELECT graph_no, graph_node_no FROM kept)),
ed AS (SELECT graph_no, graph_edge_no, unnest(map_keys(ref)) AS doc_no FROM inside WHERE ref IS NOT NULL)
SELECT e.graph_no, graph_edge_no, count(*)::int AS support FROM ed e JOIN changes c ON c.graph_no = e.graph_no AND c.doc_no = e.doc_no AND c.change = 'unchanged' GROUP BY ALL"""
SQL["project_index"] = _with("idx", "docs", "changes") + """SELECT i.graph_no, graph_version + 1 AS graph_version, object_no, len(embedding)::int AS dim FROM idx i WHERE object_type = 'DOC_CHUNK' AND EXISTS (
  SELECT 1 FROM kg_doc_chunk k JOIN changes c ON c.graph_no = k.graph_no AND c.doc_no = k.doc_no AND c.change = 'unchanged' WHERE k.graph_no = i.graph_no AND k.chunk_no = i.object_no)"""
_REGISTRY = """WITH v AS (SELECT graph_no, graph_version, max(graph_version) OVER (PARTITION BY graph_no) AS last FROM (SELECT DISTINCT graph_no, graph_version FROM kg_doc)),
registry AS (SELECT graph_no, graph_version, 'graph at ' || graph_version AS name, CASE WHEN graph_version = last THEN CASE WHEN graph_version % 2 = 0 THEN 'BUILDING' ELSE 'ACTIVE' END WHEN graph_version = last - 1 THEN 'ACTIVE' ELSE 'FROZEN' END AS status FROM v) """
SQL["latest_active"] = _REGISTRY + "SELECT graph_no, max(graph_version) AS graph_version FROM registry WHERE status = 'ACTIVE' GROUP BY graph_no"
SQL["list_graphs"] = _REGISTRY + "SELECT graph_no, max(graph_version) AS graph_version, arg_min(name, graph_version) AS name, arg_max(status, graph_version) AS status FROM registry GROUP BY graph_no"

SQL["task_progress"] = _with("tasks") + "SELECT graph_no AS run_no, count(*) AS total, count(*) FILTER (status IN ('SUCCEEDED', 'QUEUED')) AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM tasks GROUP BY graph_no"
SQL["task_claim"] = _with("tasks") + """SELECT task_no, 'RUNNING' AS status, (attempts + 1)::int AS attempts, TIMESTAMP '2024-01-20 00:15:00' AS lease_expires_at FROM tasks
WHERE status = 'QUEUED' AND "at" <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY "at", task_no LIMIT 25"""
SQL["lease_recovery"] = _with("tasks") + """, r AS (SELECT graph_no, status = 'RUNNING' AND (lease IS NULL OR lease < TIMESTAMP '2024-01-20 00:00:00') AS lost, attempts >= 3 AS spent, status FROM tasks)
SELECT graph_no, CASE WHEN lost AND spent THEN 'FAILED' WHEN lost THEN 'QUEUED' ELSE status END AS status, count(*) AS tasks,
  count(*) FILTER (CASE WHEN lost THEN NOT spent ELSE status IN ('QUEUED', 'RUNNING') END) AS active, count(*) FILTER (lost) AS errors FROM r GROUP BY ALL"""
SQL["task_queue_order"] = _with("tasks") + """SELECT graph_no, task_no, row_number() OVER (PARTITION BY graph_no ORDER BY "at", task_no) AS place FROM tasks WHERE status = 'QUEUED'"""
SQL["task_retry"] = _with("tasks") + """, b AS (SELECT DISTINCT graph_no FROM tasks WHERE user_id % 2 = 0 AND status IN ('QUEUED', 'RUNNING'))
SELECT graph_no, CASE WHEN status = 'FAILED' AND graph_no NOT IN (SELECT graph_no FROM b) THEN 'QUEUED' ELSE status END AS status, count(*) AS tasks FROM tasks GROUP BY ALL"""
_TOTALS = "SELECT state_key, count(DISTINCT node_no) AS nodes, max(last_access) AS last_access FROM touched WHERE state_key IN (SELECT state_key FROM {}) GROUP BY state_key"
SQL["state_ttl"] = _with("state") + ", kept AS (SELECT state_key FROM seen WHERE TIMESTAMP '2024-01-30 00:00:00' - seen <= INTERVAL 4 HOUR) " + _TOTALS.format("kept")
SQL["state_lru"] = _with("state") + ", kept AS (SELECT state_key FROM seen ORDER BY seen DESC, state_key LIMIT 20) " + _TOTALS.format("kept")
SQL["state_running"] = _with("state") + """, f AS (SELECT state_key, node_no, min("at") AS "at" FROM state WHERE coalesce(node_no, '') <> '' GROUP BY ALL), c AS (SELECT state_key, "at", count(*) AS n FROM f GROUP BY ALL)
SELECT state_key, "at", (sum(n) OVER (PARTITION BY state_key ORDER BY "at"))::bigint AS total FROM c"""
SQL["stream_windows"] = "SELECT time_bucket(INTERVAL 1 DAY, ts)::timestamp AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SQL["stream_sessions"] = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts)::timestamp AS session_start, count(*) AS events FROM s GROUP BY user_id, k"""

_PACKAGES = r"""packages AS (SELECT DISTINCT CASE WHEN contains(doc_no, '/') THEN regexp_extract(doc_no, '^(.*)/[^/]+$', 1) ELSE '.' END AS package FROM documents WHERE doc_no NOT LIKE 'url:%'),
up AS (SELECT package, CASE WHEN package <> '.' AND contains(package, '/') THEN regexp_extract(package, '^(.*)/[^/]*$', 1) END AS parent FROM packages),
missing AS (SELECT DISTINCT parent AS package FROM up WHERE parent IS NOT NULL AND parent NOT IN (SELECT package FROM packages)),
hier AS (SELECT coalesce(parent, 'repo') AS source, 'SUBPACKAGE' AS kind, package AS target FROM up UNION SELECT 'repo', unnest(['CONTAINS', 'SUBPACKAGE']), package FROM missing)"""
SQL["code_hierarchy"] = "WITH " + _PACKAGES + " SELECT * FROM hier"
SQL["code_topo_levels"] = "WITH RECURSIVE " + _PACKAGES + """, everything AS (SELECT package FROM packages UNION SELECT package FROM missing), deps AS (SELECT source, target FROM hier WHERE source <> 'repo'),
lv AS (SELECT package, 0 AS level FROM everything UNION SELECT d.source, lv.level + 1 FROM lv JOIN deps d ON d.target = lv.package)
SELECT package, max(level)::int AS level FROM lv GROUP BY package"""
SQL["code_degree"] = _with("trade") + """, ends AS (SELECT source AS id, 0 AS i, 1 AS o FROM trade UNION ALL SELECT target, 1, 0 FROM trade) SELECT id, sum(i)::bigint AS in_degree, sum(o)::bigint AS out_degree FROM ends GROUP BY id"""
SQL["trade_two_hops"] = _with("trade") + """SELECT b.target AS nation, count(*) AS links, count(DISTINCT s.target) AS parts FROM trade s JOIN trade b ON b.source = s.source AND b.name = 'based_in' WHERE s.name = 'supplies' GROUP BY b.target"""

# Ranks are 32-bit integers in the plans.
for _name in ("vector_topk", "text_bigram_topk", "hybrid_search", "rrf_two_lists", "rrf_representative", "candidate_pool", "restricted_rerank", "multi_query_fusion", "retry_ladder", "expand_one_hop", "expand_two_hops", "explored_exclusion", "chunk_channel", "fusion_candidates"):
    SQL[_name] = f"SELECT * REPLACE (rank::int AS rank) FROM ({SQL[_name]}) AS ranked"
SQL["task_queue_order"] = f"SELECT * REPLACE (place::int AS place) FROM ({SQL['task_queue_order']}) AS placed"
