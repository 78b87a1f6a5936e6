"""The fixture mapping in plain SQL, as named common table expressions an oracle query can lean on.

`with_tables(sql, *names)` puts the named tables and what they depend on in front of a query.
"""

from __future__ import annotations

NEEDS: dict[str, tuple[str, ...]] = {
    "lines": (), "regions": ("lines",), "hregions": ("regions",), "pgs": ("regions",), "page_text": ("regions",),
    "words": ("regions",), "spans": ("words",), "marks": ("regions", "page_text"), "nodes": (), "edges": (),
    "activity": (), "chat": (),
}

TABLES: dict[str, str] = {
    "lines": """
  SELECT doc_id AS paper_id, CAST(i - 1 AS BIGINT) AS line_no, l AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
           generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> ''""",
    "regions": """
  SELECT paper_id, line_no AS ord, CAST(line_no // 20 AS INTEGER) AS page,
         CASE WHEN line_no % 20 < 10 THEN 50.0::DOUBLE ELSE 320.0::DOUBLE END AS x0, (72 + 24 * (line_no % 10))::DOUBLE AS y0,
         CASE WHEN line_no % 20 < 10 THEN 50.0::DOUBLE ELSE 320.0::DOUBLE END + least(240, 2 * length(text))::DOUBLE AS x1,
         (92 + 24 * (line_no % 10))::DOUBLE AS y1,
         CASE WHEN line_no = 0 THEN 'title' WHEN (paper_id + line_no) % 7 = 0 THEN 'section-header'
              WHEN (paper_id + line_no) % 11 = 0 THEN 'caption' WHEN (paper_id + line_no) % 13 = 0 THEN 'page-footer'
              WHEN (paper_id + line_no) % 17 = 0 THEN 'picture' ELSE 'text' END AS label, text FROM lines""",
    "hregions": r"""
  SELECT paper_id, ord, page, x0, y0, x1, y1, label, header_level,
         CASE WHEN label = 'section-header' THEN h || ' ' || short
              WHEN label = 'caption' THEN CASE WHEN c % 2 = 1 THEN 'Figure ' || c || '. ' ELSE 'Table ' || c || ': ' END || text
              WHEN label = 'title' THEN short ELSE text END AS text
  FROM (SELECT *, CAST(ord % 3 + 1 AS INTEGER) AS header_level, regexp_replace(substring(text, 1, 60), '[ .,;:]+$', '') AS short,
               (paper_id + ord) // 7 - paper_id // 7 AS h, (paper_id + ord) // 11 - paper_id // 11 AS c FROM regions)""",
    "pgs": "SELECT DISTINCT paper_id, page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM regions",
    "page_text": "SELECT paper_id, page, string_agg(text, chr(10) ORDER BY ord) AS text FROM regions GROUP BY 1, 2",
    "words": """
  SELECT paper_id, page, block, 0 AS line, CAST(i - 1 AS BIGINT) AS word_no,
         rx0 + rw * (i - 1) / n AS x0, ry0 + 4 AS y0, rx0 + rw * (i - 1) / n + 0.8::DOUBLE * rw / n AS x1, ry1 - 4 AS y1,
         text, block * 100000 + i - 1 AS word_ord
  FROM (SELECT paper_id, page, ord AS block, x0 AS rx0, x1 - x0 AS rw, y0 AS ry0, y1 AS ry1, CAST(len(ws) AS DOUBLE) AS n,
               unnest(ws) AS text, generate_subscripts(ws, 1) AS i
        FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM regions))""",
    "spans": """
  SELECT *, (block = 0 OR (paper_id + block) % 7 = 0) AS bold,
         CASE WHEN block = 0 OR (paper_id + block) % 7 = 0 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM words""",
    "marks": """
  SELECT paper_id, 'h-' || paper_id AS h_id, page, x0, y0, x1, y1, tag, exact,
         substring(ptext, greatest(page_at - 32, 0) + 1, least(page_at, 32)) AS prefix,
         substring(ptext, page_at + length(exact) + 1, 32) AS suffix, page_at AS page_offset
  FROM (SELECT r.*, trim(substring(r.text, 1, 60)) AS exact, p.text AS ptext,
               strpos(p.text, trim(substring(r.text, 1, 60))) - 1 AS page_at,
               CASE WHEN l.quality = 1 THEN 't-supports' WHEN l.toxic = 1 THEN 't-question' END AS tag
        FROM regions r JOIN documents d ON d.doc_id = r.paper_id
        JOIN page_text p ON p.paper_id = r.paper_id AND p.page = r.page
        LEFT JOIN labels l ON l.doc_id = r.paper_id
        WHERE r.ord = r.paper_id % len(string_split(d.text, chr(10)))) WHERE exact <> ''""",
    "nodes": """
  SELECT r_regionkey::BIGINT AS paper_id, 'n-r' || r_regionkey AS node_id, r_regionkey::BIGINT AS ord, 'group' AS type,
         NULL::VARCHAR AS parent_id, NULL::VARCHAR AS tag, r_name AS name, NULL::VARCHAR AS prompt, false AS tray,
         NULL::VARCHAR AS origin, '' AS text, (r_regionkey % 100 * 10)::DOUBLE AS x, (r_regionkey % 50 * 10)::DOUBLE AS y FROM region
  UNION ALL SELECT n_regionkey, 'n-n' || n_nationkey, n_nationkey + 1000, 'group', 'n-r' || n_regionkey, NULL, n_name,
         CASE WHEN n_nationkey % 5 = 0 THEN 'What about ' || n_name END, n_nationkey % 7 = 0, NULL, '',
         n_nationkey % 100 * 10, n_nationkey % 50 * 10 FROM nation
  UNION ALL SELECT n_regionkey, 'n-c' || c_custkey, c_custkey + 1000000, 'chunk', 'n-n' || c_nationkey,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 't-supports' WHEN c_mktsegment = 'MACHINERY' THEN 't-question' END,
         c_name, NULL, false, NULL, c_name, c_custkey % 100 * 10, c_custkey % 50 * 10
         FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'n-s' || s_suppkey, s_suppkey + 1000000000, 'note', 'n-n' || s_nationkey, NULL, s_name, NULL, false,
         CASE WHEN s_suppkey % 4 = 0 THEN 'ai' ELSE 'reader' END, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END,
         s_suppkey % 100 * 10, s_suppkey % 50 * 10 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "edges": """
  SELECT cn.n_regionkey::BIGINT AS paper_id, 'e-' || o_custkey || '-' || l_suppkey AS edge_id, o_custkey * 1000000 + l_suppkey AS ord,
         'n-c' || o_custkey AS from_id, 'n-s' || l_suppkey AS to_id
  FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  WHERE cn.n_regionkey = sn.n_regionkey""",
    "activity": """
  SELECT user_id AS paper_id, event_id, ts AS t, event_type, value,
         CASE WHEN event_id % 50 = 0 THEN 'other' WHEN event_type = 'view' THEN 'read'
              WHEN event_type IN ('click', 'purchase') THEN 'build' WHEN event_type = 'signup' THEN 'session' ELSE 'ai' END AS kind,
         CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'highlight' WHEN 'purchase' THEN 'cut'
              WHEN 'signup' THEN 'open' ELSE 'define' END AS action,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS page, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "chat": """
  SELECT conv_id AS paper_id, turn * 2 AS line_no, false AS new_chat, text AS question, a AS answer FROM (
    SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND r = 'assistant'
  UNION ALL SELECT conv_id, turn * 2, true, NULL, NULL FROM conversations WHERE role = 'system'
  UNION ALL SELECT conv_id, 5, true, NULL, NULL FROM conversations WHERE turn = 3 AND conv_id % 2 = 0""",
}


def add_table(name: str, sql: str, *needs: str) -> None:
    TABLES[name], NEEDS[name] = sql, needs


def with_tables(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{name} AS ({TABLES[name]})" for name in order)
    rest = sql.strip()
    if body and rest.upper().startswith("WITH "):
        return f"WITH RECURSIVE {body},\n{rest[5:]}"
    return f"WITH RECURSIVE {body}\n{rest}" if body else rest

TITLE = r"regexp_replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '^[^\p{L}\p{N}\p{M}_(\[]+', '')"
HEADING_NUMBER = r"'^\s*(\d+(?:\.\d+)*[.)]?|[A-Z][.)])\s+\S'"

add_table("hbody", rf"""
  SELECT *, (label IN ('section-header', 'title') AND NOT (label = 'title' AND page > 0) AND length(t) BETWEEN 2 AND 120
    AND NOT regexp_matches(t, '^\d+$') AND NOT regexp_matches(t, '^\p{{Ll}}')
    AND (NOT ends_with(t, '.') OR (regexp_matches(t, {HEADING_NUMBER}) AND length(t) <= 80 AND contains(t, ' ')
         AND regexp_matches(list_extract(string_split(t, ' '), -1), '^\p{{Lu}}')))) AS is_heading
  FROM (SELECT *, {TITLE} AS t FROM hregions) WHERE label NOT IN ('page-header', 'page-footer', 'footnote', 'caption')""", "hregions")
add_table("srows", """
  SELECT *, row_number() OVER (PARTITION BY paper_id, section_ord ORDER BY ord) AS seq FROM (
    SELECT *, CAST(sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ord) - 1 AS BIGINT) AS section_ord FROM hbody)
  WHERE section_ord >= 0""", "hbody")
add_table("sections", rf"""
  SELECT h.paper_id, 'sec-' || h.section_ord AS section_id, h.section_ord AS ord, nullif(h.n, '') AS number, h.t AS title, h.page, h.x0, h.y0, h.x1, h.y1,
         coalesce(b.text, '') AS text,
         CASE WHEN h.n <> '' THEN length(h.n) - length(replace(h.n, '.', '')) + 1
              WHEN max(CASE WHEN h.n <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY h.paper_id ORDER BY h.section_ord) = 0 THEN 1
              ELSE greatest(1, h.header_level - 1) END AS depth
  FROM (SELECT *, rtrim(regexp_extract(t, {HEADING_NUMBER}, 1), '.)') AS n FROM srows WHERE is_heading) h
  LEFT JOIN (SELECT paper_id, section_ord, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM srows WHERE NOT is_heading AND text <> ''
             GROUP BY 1, 2) b ON b.paper_id = h.paper_id AND b.section_ord = h.section_ord""", "srows")
add_table("section_fold", """
  SELECT paper_id, section_ord, seq, page, x0, y0, x1, y1, y0 AS last_y0, 0 AS run_ord FROM srows WHERE seq = 1
  UNION ALL
  SELECT i.paper_id, i.section_ord, i.seq, i.page, CASE WHEN j THEN least(rx0, i.x0) ELSE i.x0 END, CASE WHEN j THEN least(ry0, i.y0) ELSE i.y0 END,
         CASE WHEN j THEN greatest(rx1, i.x1) ELSE i.x1 END, CASE WHEN j THEN greatest(ry1, i.y1) ELSE i.y1 END, i.y0, run_ord + CASE WHEN j THEN 0 ELSE 1 END
  FROM (SELECT i.*, r.x0 AS rx0, r.y0 AS ry0, r.x1 AS rx1, r.y1 AS ry1, r.run_ord,
               i.page = r.page AND i.y0 >= r.last_y0 AND abs((r.x0 + r.x1) / 2 - (i.x0 + i.x1) / 2) <= 0.15::DOUBLE * 612 AS j
        FROM section_fold r JOIN srows i ON i.paper_id = r.paper_id AND i.section_ord = r.section_ord AND i.seq = r.seq + 1) i""", "srows")
add_table("section_rects", """
  SELECT paper_id, 'sec-' || section_ord AS section_id, section_ord AS ord, CAST(run_ord AS BIGINT) AS run_ord, page,
         arg_max(x0, seq) AS x0, arg_max(y0, seq) AS y0, arg_max(x1, seq) AS x1, arg_max(y1, seq) AS y1
  FROM section_fold GROUP BY paper_id, section_ord, run_ord, page""", "section_fold")
add_table("figures", r"""
  SELECT paper_id, figure_id, kind, label, caption, page, cap_x0, cap_y0, cap_x1, cap_y1, a_x0 - 4 AS x0, a_y0 - 4 AS y0, a_x1 + 4 AS x1, a_y1 + 4 AS y1,
         'region' AS confidence, row_number() OVER (PARTITION BY paper_id ORDER BY page, a_y0 - 4, cap_ord) - 1 AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, figure_id ORDER BY cap_ord) AS keep FROM (
    SELECT c.paper_id, CASE c.kind WHEN 'table' THEN 'tab-' ELSE 'fig-' END || c.number AS figure_id, c.kind,
           CASE c.kind WHEN 'table' THEN 'Table ' ELSE 'Figure ' END || c.number AS label, c.text AS caption, c.page, c.ord AS cap_ord,
           c.x0 AS cap_x0, c.y0 AS cap_y0, c.x1 AS cap_x1, c.y1 AS cap_y1, a.x0 AS a_x0, a.y0 AS a_y0, a.x1 AS a_x1, a.y1 AS a_y1,
           row_number() OVER (PARTITION BY c.paper_id, c.ord ORDER BY CASE WHEN a.y1 <= c.y0 + 1 THEN 0 ELSE 1 END,
                              CASE WHEN a.y1 <= c.y0 + 1 THEN -a.y1 ELSE a.y0 END, a.ord) AS pick
    FROM (SELECT *, regexp_extract(text, '(?i)^\s*(Figure|Fig\.?|Table)\s*(\d+)\s*[.:]', 2) AS number,
                 CASE WHEN starts_with(lower(regexp_extract(text, '(?i)^\s*(Figure|Fig\.?|Table)\s*(\d+)\s*[.:]', 1)), 'table') THEN 'table' ELSE 'figure' END AS kind
          FROM hregions WHERE label IN ('caption', 'text') AND regexp_matches(text, '(?i)^\s*(Figure|Fig\.?|Table)\s*(\d+)\s*[.:]')) c
    JOIN hregions a ON a.paper_id = c.paper_id AND a.page = c.page AND a.label = CASE c.kind WHEN 'table' THEN 'table' ELSE 'picture' END
      AND (a.x1 - a.x0) * (a.y1 - a.y0) >= 2500
      AND (least(a.x1, c.x1) - greatest(a.x0, c.x0)) / least(a.x1 - a.x0, c.x1 - c.x0) >= 0.3) WHERE pick = 1) WHERE keep = 1""", "hregions")
# One drag per page, and the words under it.
add_table("drags", """
  SELECT paper_id, page, 'd' || page AS sel_id, 40.0::DOUBLE AS x0, (90 + paper_id % 60)::DOUBLE AS y0, (150 + paper_id % 250)::DOUBLE AS x1,
         (180 + paper_id % 140)::DOUBLE AS y1 FROM pgs""", "pgs")
add_table("drag_words", """
  SELECT d.sel_id, w.* FROM words w JOIN drags d ON d.paper_id = w.paper_id AND d.page = w.page
  JOIN (SELECT paper_id, page, block, min(y0) AS ly0, max(y1) AS ly1 FROM words GROUP BY 1, 2, 3) l
    ON l.paper_id = w.paper_id AND l.page = w.page AND l.block = w.block
  WHERE greatest(0, least(ly1, d.y1) - greatest(ly0, d.y0)) / (ly1 - ly0) >= 0.5
    AND greatest(0, least(w.x1, d.x1) - greatest(w.x0, d.x0)) / (w.x1 - w.x0) >= 0.5""", "words", "drags")
add_table("drags2", """
  SELECT paper_id, page, 'd' || page AS sel_id, 45.0::DOUBLE AS x0, (95 + paper_id % 3 * 24)::DOUBLE AS y0, (60 + paper_id % 250)::DOUBLE AS x1,
         (118 + paper_id % 3 * 24)::DOUBLE AS y1 FROM pgs""", "pgs")
