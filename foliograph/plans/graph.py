"""Queries for the annotation graph (GR, JN-11..16, JN-26, JN-30, FL-03..07, AG-21, WN-04/06/08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import graph as G
from foliograph.plans.prelude import add_table
from foliograph.plans.registry import query


add_table("anc", """
  SELECT paper_id, node_id, parent_id AS ancestor_id, 1 AS depth FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.paper_id, a.node_id, n.parent_id, a.depth + 1 FROM anc a JOIN nodes n ON n.paper_id = a.paper_id AND n.node_id = a.ancestor_id
  WHERE n.parent_id IS NOT NULL""", "nodes")
add_table("both_ends", "SELECT paper_id, edge_id, ord, from_id AS end_id, to_id AS other_id FROM edges UNION ALL SELECT paper_id, edge_id, ord, to_id, from_id FROM edges", "edges")
add_table("pnodes", """
  SELECT paper_id, 'n-g' AS node_id, 0::BIGINT AS ord, 'group' AS type, NULL AS parent_id, NULL AS tag, CASE WHEN paper_id % 5 = 0 THEN 'Paper' ELSE 'Mine' END AS name,
         paper_id % 5 = 0 AS tray, NULL AS origin, '' AS text, NULL AS source_id FROM marks
  UNION ALL SELECT paper_id, 'n-c' || ord, ord + 1, 'chunk', CASE WHEN ord % 2 = 0 THEN 'n-g' END, CASE WHEN ord % 4 = 1 THEN 't-question' END, title, false, NULL, substring(title, 1, 64), section_id
         FROM sections WHERE ord % 3 <> 2
  UNION ALL SELECT paper_id, 'n-t', 1000000, 'note', NULL, CASE WHEN paper_id % 2 = 0 THEN 't-term' END, NULL, false, CASE WHEN paper_id % 4 = 0 THEN 'ai' ELSE 'reader' END,
         CASE WHEN paper_id % 6 = 0 THEN '' ELSE 'Note on ' || paper_id END, NULL FROM marks""", "marks", "sections")
add_table("pedges", """
  SELECT paper_id, 'e-1' AS edge_id, 1 AS ord, CASE WHEN paper_id % 2 = 0 THEN h_id ELSE 'n-t' END AS from_id, CASE WHEN paper_id % 2 = 0 THEN 'n-t' ELSE h_id END AS to_id FROM marks WHERE paper_id % 7 <> 0
  UNION ALL SELECT paper_id, 'e-2', 2, 'n-c0', h_id FROM marks WHERE paper_id % 3 = 0""", "marks")
add_table("pheld", """
  SELECT DISTINCT m.paper_id, m.h_id, s.section_id, s.ord FROM marks m JOIN section_rects s ON s.paper_id = m.paper_id AND s.page = m.page
  WHERE (m.x0 + m.x1) / 2 BETWEEN s.x0 AND s.x1 AND (m.y0 + m.y1) / 2 BETWEEN s.y0 AND s.y1""", "marks", "section_rects")
add_table("holders", """
  SELECT paper_id, h_id, node_id FROM (
    SELECT h.paper_id, h.h_id, n.node_id, row_number() OVER (PARTITION BY h.paper_id, h.h_id ORDER BY CASE WHEN n.parent_id = 'n-g' AND n.paper_id % 5 = 0 THEN 1 ELSE 0 END, z.area, n.ord) AS k
    FROM pheld h JOIN pnodes n ON n.paper_id = h.paper_id AND n.source_id = h.section_id
    JOIN (SELECT paper_id, section_id, sum((x1 - x0) * (y1 - y0)) AS area FROM section_rects GROUP BY 1, 2) z ON z.paper_id = h.paper_id AND z.section_id = h.section_id) WHERE k = 1""",
          "pheld", "pnodes", "section_rects")


def no_tags():
    return F.array().cast("array<string>")


def big(lib):
    return lib.nodes().withColumn("tags", F.when(F.col("tag").isNotNull(), F.array("tag")).otherwise(no_tags()))


def tagged_marks(lib):
    return lib.highlights().withColumn("tags", F.when(F.col("tag").isNotNull(), F.array("tag")).otherwise(no_tags()))


def board(lib):
    return lib.shared("paper_board", lib.paper_board)


def closure(lib):
    """One closure of the groups for every query that walks them."""
    return lib.shared("closure", lambda: G.ancestors(lib.nodes()))


@query("gr01_slot_of", """
SELECT paper_id, node_id, slot_id FROM (SELECT a.paper_id, a.node_id, a.ancestor_id AS slot_id, row_number() OVER (PARTITION BY a.paper_id, a.node_id ORDER BY a.depth) AS k
FROM anc a JOIN nodes g ON g.node_id = a.ancestor_id AND g.paper_id = a.paper_id AND g.prompt <> '') WHERE k = 1""", ("anc",))
def _(lib):
    return G.slot_of(lib.nodes(), closure(lib))


@query("gr02_ancestors", "SELECT paper_id, node_id, ancestor_id, depth FROM anc", ("anc",))
def _(lib):
    return closure(lib)


@query("gr02_in_tray", "SELECT DISTINCT a.paper_id, a.node_id FROM anc a JOIN nodes g ON g.node_id = a.ancestor_id AND g.paper_id = a.paper_id AND g.tray", ("anc",))
def _(lib):
    return G.in_tray(lib.nodes(), closure(lib))


@query("gr03_absolute_positions", """
SELECT n.paper_id, n.node_id, n.x + coalesce(sum(g.x), 0) AS abs_x, n.y + coalesce(sum(g.y), 0) AS abs_y FROM nodes n
LEFT JOIN anc a ON a.paper_id = n.paper_id AND a.node_id = n.node_id LEFT JOIN nodes g ON g.paper_id = a.paper_id AND g.node_id = a.ancestor_id GROUP BY n.paper_id, n.node_id, n.x, n.y""", ("anc",))
def _(lib):
    return G.absolute_positions(lib.nodes(), closure(lib))


@query("gr04_hidden_nodes", """
SELECT paper_id, node_id FROM nodes n WHERE coalesce(tag, '') <> 't-question' AND NOT EXISTS (
  SELECT 1 FROM anc a JOIN nodes c ON c.paper_id = a.paper_id AND c.node_id = a.node_id AND c.tag = 't-question' WHERE a.paper_id = n.paper_id AND a.ancestor_id = n.node_id)""", ("anc",))
def _(lib):
    return G.hidden_nodes(big(lib), F.array(F.lit("t-question")))


@query("gr05_parents_first", """
SELECT n.paper_id, n.node_id, least(n.ord, coalesce(b.o, n.ord)) AS first_ord, coalesce(d.d, 0) AS depth, n.ord FROM nodes n
LEFT JOIN (SELECT a.paper_id, a.ancestor_id, min(c.ord) AS o FROM anc a JOIN nodes c ON c.paper_id = a.paper_id AND c.node_id = a.node_id GROUP BY 1, 2) b ON b.paper_id = n.paper_id AND b.ancestor_id = n.node_id
LEFT JOIN (SELECT paper_id, node_id, max(depth) AS d FROM anc GROUP BY 1, 2) d ON d.paper_id = n.paper_id AND d.node_id = n.node_id""", ("anc",))
def _(lib):
    return G.parents_first(lib.nodes(), closure(lib))


@query("gr06_new_connections", """
SELECT paper_id, edge_id, from_id, to_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, least(from_id, to_id), greatest(from_id, to_id) ORDER BY ord, edge_id) AS k FROM (
  SELECT paper_id, 'x' || edge_id AS edge_id, to_id AS from_id, from_id AS to_id, ord FROM edges UNION ALL SELECT paper_id, 'y' || edge_id, from_id, from_id, ord FROM edges) c
  WHERE from_id <> to_id AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.ord % 3 = 0 AND e.paper_id = c.paper_id AND least(e.from_id, e.to_id) = least(c.from_id, c.to_id) AND greatest(e.from_id, e.to_id) = greatest(c.from_id, c.to_id))) WHERE k = 1""", ("edges",))
def _(lib):
    e = lib.edges()
    turned = e.select("paper_id", F.concat(F.lit("x"), "edge_id").alias("edge_id"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "ord")
    selfs = e.select("paper_id", F.concat(F.lit("y"), "edge_id").alias("edge_id"), "from_id", F.col("from_id").alias("to_id"), "ord")
    return G.new_connections(e.where("ord % 3 = 0"), turned.unionByName(selfs))


REMOVED = "node_id LIKE 'n-n%' AND CAST(substring(node_id, 4) AS INTEGER) % 3 = 0 OR node_id LIKE 'n-s%' AND CAST(substring(node_id, 4) AS INTEGER) % 5 = 0"


@query("gr07_remove_items_nodes", f"""
SELECT n.paper_id, n.node_id, CASE WHEN g.node_id IS NOT NULL THEN g.parent_id ELSE n.parent_id END AS parent_id, n.x + coalesce(g.x, 0) AS x, n.y + coalesce(g.y, 0) AS y
FROM nodes n LEFT JOIN (SELECT * FROM nodes WHERE {REMOVED}) g ON g.paper_id = n.paper_id AND g.node_id = n.parent_id WHERE NOT (n.{REMOVED.replace(' OR node_id', ' OR n.node_id').replace('substring(node_id', 'substring(n.node_id')})""", ("nodes",))
def _(lib):
    n = lib.nodes()
    return G.remove_items(n, lib.edges(), n.where(REMOVED).select("paper_id", F.col("node_id").alias("id")))[0].select("paper_id", "node_id", "parent_id", "x", "y")


@query("gr07_remove_items_edges", "SELECT paper_id, edge_id FROM edges WHERE CAST(substring(to_id, 4) AS INTEGER) % 5 <> 0", ("edges",))
def _(lib):
    n = lib.nodes()
    return G.remove_items(n, lib.edges(), n.where(REMOVED).select("paper_id", F.col("node_id").alias("id")))[1].select("paper_id", "edge_id")


@query("gr08_reshape", """
SELECT paper_id, edge_id, from_id, to_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, least(from_id, to_id), greatest(from_id, to_id) ORDER BY ord, edge_id) AS k FROM (
  SELECT e.paper_id, edge_id, CASE WHEN k.c IS NOT NULL THEN 'n-c' || k.keep ELSE from_id END AS from_id, to_id, ord FROM edges e
  LEFT JOIN (SELECT n_regionkey AS paper_id, 'n-c' || c_custkey AS c, min(c_custkey) OVER (PARTITION BY c_nationkey) AS keep FROM customer JOIN nation ON c_nationkey = n_nationkey) k ON k.paper_id = e.paper_id AND k.c = e.from_id)) WHERE k = 1""", ("edges",))
def _(lib):
    chunks = lib.nodes().where("type = 'chunk'")
    keep = chunks.groupBy("paper_id", "parent_id").agg(F.min_by("node_id", "ord").alias("keep_id"))
    mapping = chunks.join(keep, ["paper_id", "parent_id"]).where("node_id <> keep_id").select("paper_id", F.col("node_id").alias("old_id"), "keep_id")
    return G.reshape(lib.edges(), mapping)


@query("gr11_apply_tags", """
SELECT paper_id, node_id AS id, array_to_string(list_filter(list_distinct_ordered, lambda t: t IN ('t-supports', 't-question', 't-term')), ',') AS tags FROM (
  SELECT paper_id, node_id, CASE WHEN ord % 3 = 0 THEN ['t-term'] || CASE WHEN ord % 2 = 0 THEN ['t-question'] ELSE [] END
     WHEN tag IS NULL THEN CASE WHEN ord % 2 = 0 THEN ['t-question'] ELSE [] END
     ELSE [tag] || CASE WHEN ord % 2 = 0 AND tag <> 't-question' THEN ['t-question'] ELSE [] END END AS list_distinct_ordered FROM nodes)""", ("nodes",))
def _(lib):
    items = big(lib).select("paper_id", F.col("node_id").alias("id"), "tags")
    changes = lib.nodes().select("paper_id", F.col("node_id").alias("id"), F.when(F.col("ord") % 3 == 0, "t-term").alias("main"),
                                 F.when(F.col("ord") % 2 == 0, F.array(F.lit("t-question"), F.lit("t-deleted"))).otherwise(no_tags()).alias("add"))
    tags = lib.spark.createDataFrame([("t-supports",), ("t-question",), ("t-term",)], "tag_id string")
    return G.apply_tags(items, changes, tags).select("paper_id", "id", F.array_join("tags", ",").alias("tags"))


@query("gr12_piece_of_quote", r"""
SELECT s.paper_id, s.section_id AS chunk_id, coalesce(min(CASE WHEN contains(trim(regexp_replace(p.text, '[\s\p{Z}]+', ' ', 'g')), substring(trim(regexp_replace(s.title, '[\s\p{Z}]+', ' ', 'g')), 1, 40)) THEN p.seq - 1 END),
       CASE WHEN count(*) = 3 THEN 1 ELSE 0 END) AS piece_ord FROM sections s JOIN srows p ON p.paper_id = s.paper_id AND p.section_ord = s.ord GROUP BY 1, 2""", ("sections", "srows"))
def _(lib):
    from pyspark.sql import Window

    from foliograph.operators.layout import sectioned
    w = Window.partitionBy("paper_id", "section_ord").orderBy("ord")
    rows = sectioned(lib.headed_body()).select("paper_id", F.concat(F.lit("sec-"), "section_ord").alias("chunk_id"), (F.row_number().over(w) - 1).alias("piece_ord"), "text")
    quotes = lib.sections()[0].select("paper_id", F.col("section_id").alias("chunk_id"), F.col("title").alias("exact"))
    return G.piece_of_quote(rows, quotes)


@query("jn11_chunk_holder", "SELECT paper_id, h_id, node_id FROM holders", ("holders",))
def _(lib):
    nodes, _e, rects = board(lib)
    return G.chunk_holder(lib.highlights(), nodes, rects)


@query("jn12_resolve_edges", """
SELECT e.paper_id, e.edge_id, CASE WHEN starts_with(from_id, 'h-') THEN h.node_id WHEN starts_with(to_id, 'h-') THEN h.node_id END AS source,
       CASE WHEN starts_with(from_id, 'h-') THEN from_id ELSE to_id END AS source_handle, CASE WHEN starts_with(from_id, 'h-') THEN to_id ELSE from_id END AS target
FROM pedges e JOIN holders h ON h.paper_id = e.paper_id WHERE (e.edge_id = 'e-1' OR EXISTS (SELECT 1 FROM pnodes n WHERE n.paper_id = e.paper_id AND n.node_id = 'n-c0'))""", ("pedges", "holders", "pnodes"))
def _(lib):
    nodes, edges, rects = board(lib)
    return G.resolve_edges(edges, nodes, G.chunk_holder(lib.highlights(), nodes, rects)).select("paper_id", "edge_id", "source", "source_handle", "target")


@query("jn13_connected_notes", """
SELECT b.paper_id, b.end_id AS item_id, b.other_id AS note_id, min(b.ord) AS edge_ord, n.ord AS note_ord, n.origin FROM both_ends b
JOIN nodes n ON n.paper_id = b.paper_id AND n.node_id = b.other_id AND n.type = 'note' GROUP BY 1, 2, 3, 5, 6""", ("both_ends", "nodes"))
def _(lib):
    return G.connected_notes(lib.edges(), lib.nodes())


@query("jn14_connection_labels", r"""
SELECT e.paper_id, m.h_id, e.edge_id, n.type AS kind, CASE WHEN n.type = 'chunk' THEN '→ ' || coalesce(CASE WHEN s.number IS NOT NULL THEN '§' || s.number ELSE s.title END || ' ', '') ||
       array_to_string(list_slice(string_split(trim(regexp_replace(n.text, '[\s\p{Z}]+', ' ', 'g')), ' '), 1, 3), ' ') END AS label
FROM pedges e JOIN marks m ON m.paper_id = e.paper_id JOIN pnodes n ON n.paper_id = e.paper_id AND n.node_id = CASE WHEN e.from_id = m.h_id THEN e.to_id ELSE e.from_id END
LEFT JOIN (SELECT f.paper_id, f.section_id AS own, s.number, s.title, row_number() OVER (PARTITION BY f.paper_id, f.section_id ORDER BY s.ord) AS k FROM (
    SELECT paper_id, section_id, arg_min(page, run_ord) AS page, (arg_min(x0, run_ord) + arg_min(x1, run_ord)) / 2 AS mx, (arg_min(y0, run_ord) + arg_min(y1, run_ord)) / 2 AS my FROM section_rects GROUP BY 1, 2) f
  JOIN section_rects r ON r.paper_id = f.paper_id AND r.page = f.page AND f.mx BETWEEN r.x0 AND r.x1 AND f.my BETWEEN r.y0 AND r.y1 JOIN sections s ON s.paper_id = r.paper_id AND s.section_id = r.section_id) s
  ON s.paper_id = n.paper_id AND s.own = n.source_id AND s.k = 1""", ("pedges", "marks", "pnodes", "sections", "section_rects"))
def _(lib):
    nodes, edges, rects = board(lib)
    secs, ext = lib.sections()
    return G.connection_labels(edges, lib.highlights(), nodes, rects, secs, ext).select("paper_id", "h_id", "edge_id", "kind", "label")


@query("jn15_unanswered_questions", """
SELECT paper_id, node_id AS id, type AS kind, text FROM nodes n WHERE tag = 't-question' AND NOT EXISTS (
  SELECT 1 FROM both_ends b JOIN nodes a ON a.paper_id = b.paper_id AND a.node_id = b.other_id AND a.type = 'note' AND a.origin = 'reader' AND a.text <> '' WHERE b.paper_id = n.paper_id AND b.end_id = n.node_id)""", ("both_ends", "nodes"))
def _(lib):
    return G.unanswered_questions(tagged_marks(lib).where("false"), big(lib), lib.edges())


add_table("piece_rows", """
  SELECT paper_id, source_id, type, row_number() OVER (PARTITION BY paper_id ORDER BY page, o NULLS LAST, y0, x0, source_id) - 1 AS row FROM (
    SELECT i.*, coalesce((SELECT min(r.ord) FROM hregions r WHERE r.paper_id = i.paper_id AND r.page = i.page AND (i.x0 + i.x1) / 2 BETWEEN r.x0 AND r.x1 AND i.y0 + 1 BETWEEN r.y0 AND r.y1),
                         (SELECT min(r.ord) FROM hregions r WHERE r.paper_id = i.paper_id AND r.page = i.page AND (r.x0 + r.x1) / 2 BETWEEN i.x0 AND i.x1 AND (r.y0 + r.y1) / 2 BETWEEN i.y0 AND i.y1)) AS o
    FROM (SELECT paper_id, section_id AS source_id, 'chunk' AS type, arg_min(page, run_ord) AS page, arg_min(x0, run_ord) AS x0, arg_min(y0, run_ord) AS y0, arg_min(x1, run_ord) AS x1, arg_min(y1, run_ord) AS y1 FROM section_rects GROUP BY 1, 2
          UNION ALL SELECT paper_id, figure_id, 'figure', page, x0, y0, x1, y1 FROM figures) i)""", "section_rects", "figures", "hregions")


@query("jn16_missing_pieces", """
SELECT p.paper_id, p.source_id, p.type, p.row, 20 AS x, 48 + p.row * 44 AS y FROM piece_rows p WHERE NOT EXISTS (SELECT 1 FROM pnodes n WHERE n.paper_id = p.paper_id AND n.source_id = p.source_id)""", ("piece_rows", "pnodes"))
def _(lib):
    secs, ext = lib.sections()
    return G.missing_pieces(secs, ext, lib.figures(), lib.headed_regions(), board(lib)[0])


@query("wn04_paper_order", "SELECT paper_id, source_id, row FROM piece_rows", ("piece_rows",))
def _(lib):
    secs, ext = lib.sections()
    return G.missing_pieces(secs, ext, lib.figures(), lib.headed_regions(), board(lib)[0].where("false")).select("paper_id", "source_id", "row")


@query("jn26_agent_targets", r"""
SELECT paper_id, 'a' || k AS file, CASE k WHEN 0 THEN 'highlight' WHEN 1 THEN 'node' END AS target_kind,
       CASE k WHEN 0 THEN CASE WHEN length(f) <= 44 THEN f ELSE substring(f, 1, 43) || '…' END WHEN 1 THEN CASE WHEN paper_id % 5 = 0 THEN 'Paper' ELSE 'Mine' END END AS label
FROM (SELECT paper_id, unnest([0, 1, 2]) AS k, trim(regexp_replace(exact, '^\s*#+\s*', '')) AS f FROM marks)""", ("marks",))
def _(lib):
    return G.agent_targets(agent_notes(lib), lib.highlights(), board(lib)[0]).select("paper_id", "file", "target_kind", "label")


def agent_notes(lib):
    k = F.posexplode(F.array(F.col("h_id"), F.lit("n-g"), F.lit("h-gone"))).alias("k", "on")
    return lib.highlights().select("paper_id", k).select("paper_id", F.concat(F.lit("a"), "k").alias("file"), "on", F.lit("Read me").alias("title"), F.lit(" body \n").alias("text"))


@query("jn26_placed_agent_notes", "SELECT paper_id, count(*) AS notes, 2 AS linked, '# Read me' || chr(10) || chr(10) || 'body' || chr(10) AS text FROM (SELECT paper_id, unnest([0, 1, 2]) FROM marks) GROUP BY 1", ("marks",))
def _(lib):
    n, e = G.place_agent_notes(G.agent_targets(agent_notes(lib), lib.highlights(), board(lib)[0]))
    return n.join(e.select("paper_id", F.col("to_id").alias("node_id"), F.lit(1).alias("l")), ["paper_id", "node_id"], "left").groupBy("paper_id").agg(
        F.count("*").alias("notes"), F.sum("l").alias("linked"), F.max("text").alias("text"))


@query("jn30_ghost_rows", """
SELECT s.paper_id, s.section_id, 48 + p.row * 44 AS y, n.node_id, CASE WHEN s.number IS NOT NULL THEN '§' || s.number || ' ' ELSE '' END || s.title || ' ' ||
       CASE WHEN n.node_id IS NULL THEN 'not on the board' WHEN n.parent_id IS NOT NULL THEN '→ in ' || CASE WHEN s.paper_id % 5 = 0 THEN 'Paper' ELSE 'Mine' END ELSE '→ on the board' END ||
       ' · ' || m || CASE WHEN m = 1 THEN ' mark' ELSE ' marks' END || ' · ' || nn || CASE WHEN nn = 1 THEN ' note' ELSE ' notes' END AS text
FROM (SELECT s.*, (SELECT count(*) FROM pheld h WHERE h.paper_id = s.paper_id AND h.section_id = s.section_id) AS m,
             (SELECT count(*) FROM pheld h WHERE h.paper_id = s.paper_id AND h.section_id = s.section_id AND h.paper_id % 7 <> 0) AS nn FROM sections s) s
JOIN piece_rows p ON p.paper_id = s.paper_id AND p.source_id = s.section_id LEFT JOIN pnodes n ON n.paper_id = s.paper_id AND n.source_id = s.section_id
WHERE NOT (s.paper_id % 5 = 0 AND n.parent_id IS NOT NULL)""", ("sections", "piece_rows", "pnodes", "pheld"))
def _(lib):
    nodes, edges, _r = board(lib)
    secs, ext = lib.sections()
    return G.ghost_rows(secs, ext, lib.figures(), lib.headed_regions(), nodes, lib.highlights(), edges)


@query("fl03_tag_filter", "SELECT paper_id, node_id FROM nodes WHERE tag IN ('t-supports', 't-term')", ("nodes",))
def _(lib):
    return big(lib).where(G.carries(F.col("tags"), F.array(F.lit("t-supports"), F.lit("t-term")))).select("paper_id", "node_id")


@query("fl05_validate_board", """
SELECT paper_id, node_id AS id, 'listed before its parent' AS problem FROM nodes WHERE parent_id IS NOT NULL AND ord % 11 = 0
UNION ALL SELECT paper_id, node_id, 'unknown parent' FROM nodes WHERE parent_id IS NOT NULL AND ord % 13 = 0 AND ord % 11 <> 0
UNION ALL SELECT paper_id, edge_id, 'unknown end' FROM edges WHERE ord % 17 = 0
UNION ALL SELECT paper_id, node_id, 'duplicate id' FROM nodes WHERE type = 'note'
UNION ALL SELECT paper_id, node_id, 'wrong prefix' FROM nodes WHERE type = 'note'""", ("nodes", "edges"))
def _(lib):
    n, e = big(lib), lib.edges()
    o, kid = F.col("ord"), F.col("parent_id").isNotNull()
    bad = n.withColumn("parent_id", F.when(kid & (o % 13 == 0) & (o % 11 != 0), "n-none").otherwise(F.col("parent_id"))).withColumn("ord", F.when(kid & (o % 11 == 0), F.lit(-1).cast("long")).otherwise(o))
    marks = n.where("type = 'note'").select("paper_id", F.col("node_id").alias("h_id"))
    edges = e.withColumn("to_id", F.when(o % 17 == 0, "h-none").otherwise(F.col("to_id")))
    return G.validate_board(bad, edges, marks)


@query("fl06_reader_layer_nodes", "SELECT paper_id, node_id FROM nodes WHERE NOT (type = 'note' AND origin IS NOT DISTINCT FROM 'ai')", ("nodes",))
def _(lib):
    return G.reader_layer_only(lib.nodes(), lib.edges())[0].select("paper_id", "node_id")


@query("fl06_reader_layer_edges", "SELECT e.paper_id, edge_id FROM edges e WHERE CAST(substring(to_id, 4) AS INTEGER) % 4 <> 0", ("edges",))
def _(lib):
    return G.reader_layer_only(lib.nodes(), lib.edges())[1].select("paper_id", "edge_id")


@query("fl07_validate_ids", r"""
SELECT doc_id, regexp_matches(f, '^[a-z0-9][a-z0-9.-]*$') AND NOT contains(f, '..') AS paper_ok, regexp_matches(n, '^n-[0-9A-HJKMNP-TV-Z]{26}$') AS node_ok FROM (
  SELECT doc_id, lower(replace(source, 'src', CASE doc_id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'a..b' ELSE '-x' END)) || doc_id AS f, 'n-' || upper(substring(sha256(doc_id::VARCHAR), 1, 26)) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'U' END AS n FROM documents)""")
def _(lib):
    d = F.col("doc_id")
    folder = F.concat(F.lower(F.replace("source", F.lit("src"), F.when(d % 3 == 0, "src").when(d % 3 == 1, "a..b").otherwise("-x"))), d)
    node = F.concat(F.lit("n-"), F.upper(F.substring(F.sha2(d.cast("string").cast("binary"), 256), 1, 26)), F.when(d % 2 == 0, "").otherwise("U"))
    return lib.table("documents").select("doc_id", G.valid_paper_id(folder).alias("paper_ok"), G.valid_node_id(node).alias("node_ok"))


@query("ag21_any_tagged", "SELECT paper_id, bool_or(tag IS NOT NULL) AS any_tagged FROM nodes GROUP BY 1", ("nodes",))
def _(lib):
    e = lib.edges().withColumn("tags", no_tags())
    return G.any_tagged(big(lib), big(lib).where("false"), e)


def snapshot(lib, later: bool, edges=None):
    n = big(lib).select("paper_id", F.col("node_id").alias("id"), F.lit("node").alias("kind"), "type", "parent_id", "tags", "text", "ord")
    e = (lib.edges() if edges is None else edges).select("paper_id", F.col("edge_id").alias("id"), F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("parent_id"), no_tags().alias("tags"), F.lit("").alias("text"), "ord")
    every, o = n.unionByName(e), F.col("ord")
    if later:
        every = every.where("ord % 7 <> 0").withColumn("tags", F.when(o % 5 == 0, F.array(F.lit("t-new"))).otherwise(F.col("tags"))).withColumn(
            "parent_id", F.when((F.col("type") == "note") & (o % 10 == 1), F.lit("n-r0")).otherwise(F.col("parent_id")))
    else:
        every = every.where("ord % 3 <> 0")
    return every.drop("ord")


@query("wn08_board_diff", """
WITH things AS (SELECT paper_id, node_id AS id, 'node' AS kind, type, parent_id, tag, ord FROM nodes UNION ALL SELECT paper_id, edge_id, 'edge', NULL, NULL, NULL, ord FROM edges)
SELECT paper_id, 'remove' AS action, id FROM things WHERE ord % 3 <> 0 AND ord % 7 = 0
UNION ALL SELECT paper_id, CASE WHEN kind = 'edge' THEN 'connect' ELSE 'cut' END, id FROM things WHERE ord % 3 = 0 AND ord % 7 <> 0 AND (kind = 'edge' OR type = 'chunk')
UNION ALL SELECT paper_id, 'tag', id FROM things WHERE ord % 3 <> 0 AND ord % 7 <> 0 AND ord % 5 = 0
UNION ALL SELECT DISTINCT paper_id, 'group', id FROM things WHERE ord % 7 <> 0 AND type = 'group' AND (ord % 3 = 0 OR (id = 'n-r0' AND paper_id IN (SELECT paper_id FROM things WHERE type = 'note' AND ord % 10 = 1 AND ord % 3 <> 0 AND ord % 7 <> 0)))""", ("nodes", "edges"))
def _(lib):
    return G.board_diff(snapshot(lib, False), snapshot(lib, True))


@query("wn06_cache_edges", """
SELECT paper_id, 'e-' || paper_id AS edge_id, h_id AS from_id, 'n-t' AS to_id FROM marks WHERE paper_id % 3 <> 1 AND paper_id % 7 = 0""", ("marks",))
def _(lib):
    nodes, edges, _r = board(lib)
    p = F.col("paper_id")
    h = lib.highlights().select("paper_id", "h_id", F.when(p % 3 != 1, "n-t").otherwise("n-x").alias("note"))
    return G.cache_edges(h, nodes, edges)
