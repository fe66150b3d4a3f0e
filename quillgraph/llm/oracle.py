"""DuckDB counterparts of the training-data queries, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["p1_found"] = """
WITH RECURSIVE latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, coalesce('m' || merge_id, 'r' || id)
    ORDER BY update_time DESC NULLS LAST, id DESC) AS rn FROM kg_merge_log) WHERE rn = 1 AND status = 'MERGED'),
named AS (SELECT graph_no, graph_version,
    CASE WHEN trim(winner_node_no) <> '' THEN winner_node_no END AS x, CASE WHEN trim(loser_node_no) <> '' THEN loser_node_no END AS y FROM latest),
arcs AS (
  SELECT graph_no, graph_version, coalesce(x, y) AS a, coalesce(y, x) AS b FROM named WHERE coalesce(x, y) IS NOT NULL
  UNION SELECT graph_no, graph_version, coalesce(y, x), coalesce(x, y) FROM named WHERE coalesce(x, y) IS NOT NULL),
reach AS (
  SELECT graph_no, graph_version, a AS node_no, a AS seen FROM arcs
  UNION SELECT r.graph_no, r.graph_version, r.node_no, e.b FROM reach r JOIN arcs e
    ON e.graph_no IS NOT DISTINCT FROM r.graph_no AND e.graph_version IS NOT DISTINCT FROM r.graph_version AND e.a = r.seen)
SELECT graph_no, graph_version, node_no, min(seen) AS group_no FROM reach GROUP BY ALL
"""

_SOLID = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"

SQL["p4_found"] = f"""
WITH RECURSIVE d AS (SELECT chunk_overlap FROM kg_settings WHERE settings_no = 'default'),
t AS (SELECT c.id, c.content, c.line_start AS l0, s.chunk_size AS size, least(greatest(coalesce(s.chunk_overlap, (SELECT max(chunk_overlap) FROM d), 0), 0), s.chunk_size - 1) AS overlap, length(c.content) AS n
  FROM kg_doc_chunk c JOIN kg_settings s USING (settings_no) WHERE length(c.content) > s.chunk_size AND regexp_matches(c.content, '{_SOLID}')),
feeds AS (SELECT id, unnest(list_filter(range(0, n), lambda i: ch[i + 1] = chr(10))) AS p FROM (SELECT id, n, string_split(content, '') AS ch FROM t)),
cuts AS (
  SELECT id, 0::bigint AS s FROM t
  UNION ALL
  SELECT id, CASE WHEN e - overlap > s THEN e - overlap ELSE e END FROM (
    SELECT k.id, k.s, t.overlap, t.n, CASE WHEN k.s + t.size < t.n AND max(f.p) - k.s > t.size // 2 THEN max(f.p) ELSE least(k.s + t.size, t.n) END AS e
    FROM cuts k JOIN t USING (id) LEFT JOIN feeds f ON f.id = k.id AND f.p >= k.s AND f.p < least(k.s + t.size, t.n) GROUP BY k.id, k.s, t.overlap, t.n, t.size) WHERE e < n),
ended AS (SELECT k.id, k.s, CASE WHEN k.s + t.size < t.n AND max(f.p) - k.s > t.size // 2 THEN max(f.p) ELSE least(k.s + t.size, t.n) END AS e
  FROM cuts k JOIN t USING (id) LEFT JOIN feeds f ON f.id = k.id AND f.p >= k.s AND f.p < least(k.s + t.size, t.n) GROUP BY k.id, k.s, t.n, t.size),
solid AS (SELECT ended.*, t.l0 FROM ended JOIN t USING (id) WHERE regexp_matches(substr(t.content, s::int + 1, (e - s)::int), '{_SOLID}'))
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::int AS piece_no, s::int AS char_start, e::int AS char_end,
  (l0 + (SELECT count(*) FROM feeds f WHERE f.id = p.id AND f.p < p.s))::int AS line_start, (l0 + (SELECT count(*) FROM feeds f WHERE f.id = p.id AND f.p < p.e - 1))::int AS line_end
FROM solid p
"""

SQL["p7_found"] = """
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_no, graph_version, object_type, object_no ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn FROM kg_search_index) WHERE rn = 1),
usable AS (SELECT id, embedding FROM latest WHERE len(embedding) = 64 AND list_dot_product(embedding, embedding) > 0),
scored AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS score FROM usable a JOIN usable b ON a.id <> b.id),
near AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM scored WHERE score >= 0.85) WHERE r <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM near
"""
