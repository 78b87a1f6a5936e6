"""Queries for documents out (AG-11..16), selections and re-cut chunks (AN-16/17, GR-09/10, JN-23/27/28), migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import anchoring as A
from foliograph.operators import chunks as C
from foliograph.operators import documents as D
from foliograph.operators import grounding as GD
from foliograph.operators import history as H
from foliograph.operators import pieces as P
from foliograph.operators import search as S
from foliograph.operators.spread import materialise
from foliograph.operators.words import CORNERS
from foliograph.plans.answers import requests, slots, spans
from foliograph.plans.graph import board, no_tags
from foliograph.plans.prelude import add_table
from foliograph.plans.registry import query
from foliograph.sources import library

TAGS = [("t-supports", "supports"), ("t-question", "question"), ("t-term", "term")]


def parts(lib):
    nodes, edges, rects = board(lib)
    none = F.lit(None).cast("string")
    nodes = nodes.withColumn("caption", none).withColumn("clip", none).withColumn("has_sketch", F.col("paper_id") % 11 == 0)
    nodes = nodes.withColumn("prompt", F.when(F.col("type") == "group", "What is shown?").otherwise(F.col("prompt")))
    first = lib.sections()[0].where("ord = 0").select("paper_id", "title")
    base = lib.pages().select("paper_id").distinct().join(first, "paper_id", "left")
    papers = base.select("paper_id", F.coalesce("title", F.col("paper_id").cast("string")).alias("title"), F.when(F.col("paper_id") % 3 == 0, "Learn").alias("goal"))
    marks = lib.highlights().withColumn("rect_ord", F.lit(0)).withColumn("tags", F.when(F.col("tag").isNotNull(), F.array("tag")).otherwise(no_tags()))
    return papers, nodes, rects, marks, edges, lib.headed_regions(), lib.spark.createDataFrame(TAGS, "tag_id string, name string")


def rows_of(paragraphs):
    """A document as its ordered paragraphs: what the Markdown sink writes, nothing gathered."""
    return paragraphs.select("paper_id", F.to_json("pos").alias("pos"), "text")


PAPER_MARKDOWN = r"""
SELECT paper_id, string_agg(t, chr(10) || chr(10) ORDER BY ord, k) || chr(10) AS text FROM (
  SELECT s.paper_id, s.ord, 0 AS k, CASE WHEN s.ord = 0 THEN '# ' || title ELSE repeat('#', CAST(depth + 1 AS BIGINT)) || ' ' || title || ' (' || CASE WHEN a = b THEN 'p. ' || (a + 1) ELSE 'pp. ' || (a + 1) || '–' || (b + 1) END || ')' END AS t
  FROM sections s JOIN (SELECT paper_id, section_id, min(page) AS a, max(page) AS b FROM section_rects GROUP BY 1, 2) r ON r.paper_id = s.paper_id AND r.section_id = s.section_id
  UNION ALL SELECT paper_id, ord, 1, regexp_replace(regexp_replace(text, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') FROM sections WHERE regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''
  UNION ALL SELECT doc_id, 0, 0, '# ' || doc_id FROM documents WHERE doc_id NOT IN (SELECT paper_id FROM sections)) GROUP BY 1"""


@query("ag11_paper_markdown", PAPER_MARKDOWN, ("sections", "section_rects"))
def _(lib):
    secs, ext = lib.sections()
    papers = lib.table("documents").select(F.col("doc_id").alias("paper_id"))
    return D.as_text(D.paper_markdown(papers, secs, ext))


@query("ag12_export_markdown")
def _(lib):
    papers, nodes, rects, marks, edges, regions, tags = parts(lib)
    return rows_of(D.export_paragraphs(papers, nodes, rects, marks, edges, regions, tags, no_tags()))


@query("ag12_export_tagged")
def _(lib):
    papers, nodes, rects, marks, edges, regions, tags = parts(lib)
    return rows_of(D.export_paragraphs(papers, nodes, rects, marks, edges, regions, tags, F.array(F.lit("t-question"), F.lit("t-term"))))


@query("ag13_export_by_template")
def _(lib):
    papers, nodes, rects, marks, edges, regions, tags = parts(lib)
    return rows_of(D.export_paragraphs(papers, nodes, rects, marks, edges, regions, tags, no_tags(), order="template"))


@query("ag14_board_markdown")
def _(lib):
    return rows_of(D.board_paragraphs(*parts(lib)))


@query("ag15_reader_layer", r"""
SELECT paper_id, string_agg(t, chr(10) ORDER BY a, o) AS text FROM (
  SELECT paper_id, -1 AS a, 0 AS o, '<reader>' AS t FROM marks UNION ALL SELECT paper_id, 0, 0, '<goal>' || CASE WHEN paper_id % 3 = 0 THEN 'Learn' ELSE '' END || '</goal>' FROM marks
  UNION ALL SELECT paper_id, 1, 0, '<highlight id="' || h_id || '" tags="' || CASE tag WHEN 't-supports' THEN 'supports' WHEN 't-question' THEN 'question' ELSE '' END || '">' || replace(replace(replace(exact, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</highlight>' FROM marks
  UNION ALL SELECT paper_id, 2, 0, '<note id="n-t" connected="' || CASE WHEN paper_id % 7 <> 0 THEN h_id ELSE '' END || '">' || CASE WHEN paper_id % 6 = 0 THEN '' ELSE 'Note on ' || paper_id END || '</note>' FROM marks WHERE paper_id % 4 <> 0
  UNION ALL SELECT paper_id, 3, ord, '<connection from="' || from_id || '" to="' || to_id || '" tags=""/>' FROM pedges WHERE NOT (edge_id = 'e-1' AND paper_id % 4 = 0)
  UNION ALL SELECT paper_id, 4, 0, '<group id="n-g" name="' || CASE WHEN paper_id % 5 = 0 THEN 'Paper' ELSE 'Mine' END || '" members="' || string_agg(node_id, ', ' ORDER BY ord) || '"/>' FROM pnodes WHERE parent_id = 'n-g' GROUP BY paper_id
  UNION ALL SELECT paper_id, 5, 0, '</reader>' FROM marks) GROUP BY 1""", ("pedges", "pnodes"))
def _(lib):
    return D.as_text(layer(lib), "\n", "")


def layer(lib):
    papers, nodes, _rects, marks, edges, _regions, tags = parts(lib)
    boards = papers.join(marks.select("paper_id").distinct(), "paper_id", "left_semi")
    return D.reader_layer(boards, nodes, edges, marks.withColumn("ord", F.lit(0)), tags)


@query("ag16_pass_prompts", r"""
SELECT paper_id, string_agg('<span id="' || span_id || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>', chr(10) ORDER BY ord) || chr(10) || chr(10) || 'Slots: Background, Problem' AS prompt FROM pspans GROUP BY 1""", ("pspans",))
def _(lib):
    return D.pass_prompts(spans(lib), slots(lib))


@query("ag16_define_prompts")
def _(lib):
    r = requests(lib)
    near = GD.define_context(r, spans(lib), lib.sections()[1], lib.word_lines())
    none = lib.spark.createDataFrame([], "paper_id long, request_id string, sentence string")
    return D.define_prompts(r, near, spans(lib), none)


@query("ag16_ask_prompts")
def _(lib):
    turns = H.history_within_budget(H.current_chat(lib.chat()), 2000)
    questions = lib.chat().where("NOT new_chat").groupBy("paper_id").agg(F.max_by("question", "line_no").alias("question"), F.max_by("answer", "line_no").alias("selection"))
    return D.ask_prompts(questions, spans(lib), layer(lib), turns)


# -- selections and chunks -----------------------------------------------------------


def selections(lib):
    return lib.drags().withColumn("rect_ord", F.lit(0))


@query("an16_make_highlights", r"""
SELECT paper_id, sel_id, regexp_replace(regexp_replace(string_agg(t, chr(10) ORDER BY f), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS exact FROM (
  SELECT paper_id, sel_id, block, string_agg(text, ' ' ORDER BY word_ord) AS t, min(word_ord) AS f FROM drag_words GROUP BY 1, 2, 3) GROUP BY 1, 2""", ("drag_words",))
def _(lib):
    anchors, _lines = C.make_highlights(selections(lib), lib.page_text(), lib.word_lines())
    return anchors.where("exact <> ''").select("paper_id", "sel_id", "exact")


@query("an16_make_chunk_anchors", r"""
SELECT paper_id, sel_id, which, CASE which WHEN 'start' THEN substring(e, 1, 64) ELSE right(e, 64) END AS exact FROM (SELECT *, unnest(['start', 'end']) AS which FROM (
  SELECT paper_id, sel_id, regexp_replace(regexp_replace(string_agg(t, chr(10) ORDER BY f), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS e FROM (
  SELECT paper_id, sel_id, block, string_agg(text, ' ' ORDER BY word_ord) AS t, min(word_ord) AS f FROM drag_words GROUP BY 1, 2, 3) GROUP BY 1, 2))""", ("drag_words",))
def _(lib):
    return C.make_chunk_anchors(selections(lib), lib.page_text(), lib.word_lines()).where("exact <> ''").select("paper_id", "sel_id", "which", "exact")


@query("an16_area_quotes")
def _(lib):
    return C.area_quotes(lib.drags(), lib.page_text(), lib.word_lines()).select("paper_id", "sel_id", "exact", "prefix", "suffix", "position")


def region_quotes(lib):
    """Each highlight asked for inside the section that holds it, with the context and the position of the words under it: a repeated line
    is told apart by nothing else."""
    held = P.highlights_in(lib.highlights(), lib.sections()[1].withColumnRenamed("section_id", "node_id"))
    under = lib.highlights().select("paper_id", "page", "h_id", "exact", *[F.col(c).alias(f"q_{c}") for c in CORNERS])
    own = A.global_position(A.quote_under(under, lib.page_text(), lib.word_lines(), ["h_id"]), lib.page_text())
    q = materialise(held.join(own, ["paper_id", "h_id"]).select(
        "paper_id", F.concat_ws("|", "h_id", "node_id").alias("q_id"), "node_id", "exact", "prefix", "suffix", F.col("position").cast("long").alias("position"), F.col("page").alias("page_hint")))
    ext = lib.sections()[1].select("paper_id", F.col("section_id").alias("node_id"), F.col("run_ord").alias("rect_ord"), "page", *CORNERS)
    return q.drop("node_id"), q.select("paper_id", "q_id", "node_id").join(ext, ["paper_id", "node_id"]).drop("node_id")


def in_region(lib):
    quotes, rects = lib.shared("region_quotes", lambda: region_quotes(lib))
    return lib.shared("in_region", lambda: C.quotes_in_region(quotes, rects, lib.page_text(), lib.word_lines())), rects


@query("an17_quotes_in_region", """
SELECT m.paper_id, m.h_id || '|' || h.section_id AS q_id, m.page FROM pheld h JOIN marks m ON m.paper_id = h.paper_id AND m.h_id = h.h_id""", ("pheld",))
def _(lib):
    """Repeated lines share their words and context, so only the page is told apart here."""
    return in_region(lib)[0][0].select("paper_id", "q_id", "page")


@query("gr09_recut_split", """
SELECT h.paper_id, m.h_id || '|' || h.section_id AS q_id, sum((r.x1 - r.x0) * (r.y1 - r.y0)) AS area FROM pheld h JOIN marks m ON m.paper_id = h.paper_id
JOIN section_rects r ON r.paper_id = h.paper_id AND r.section_id = h.section_id GROUP BY 1, 2""", ("pheld", "section_rects"))
def _(lib):
    (lines, _missing), rects = in_region(lib)
    cut = C.recut(rects, lines)
    return cut.groupBy("paper_id", "q_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@query("gr09_recut_cut")
def _(lib):
    (lines, _missing), rects = in_region(lib)
    return C.recut(rects, lines, "cut")


def neighbours(lib):
    """Every two sections in a row, to be joined."""
    ext = lib.sections()[1].select("paper_id", "ord", F.col("run_ord").alias("rect_ord"), "page", *CORNERS)
    return ext.withColumn("join_id", F.floor(F.col("ord") / 2)).withColumn("node_id", F.concat(F.lit("n-c"), "ord"))


@query("gr10_join_chunks")
def _(lib):
    sizes = lib.pages()
    return C.join_chunks(neighbours(lib), lib.word_lines(), lib.headed_regions(), sizes)[0]


@query("jn23_chunk_blocks", """
SELECT d.paper_id, d.sel_id, r.ord AS region_ord, 'text' AS kind, string_agg(w.text, ' ' ORDER BY w.word_ord) || chr(10) AS text FROM drags d
JOIN regions r ON r.paper_id = d.paper_id AND r.page = d.page AND r.label IN ('text', 'section-header', 'title', 'caption') AND greatest(r.x0, d.x0) < least(r.x1, d.x1) AND greatest(r.y0, d.y0) < least(r.y1, d.y1)
JOIN words w ON w.paper_id = r.paper_id AND w.block = r.ord AND greatest(0, least(w.y1, least(r.y1, d.y1)) - greatest(w.y0, greatest(r.y0, d.y0))) / (w.y1 - w.y0) >= 0.5
  AND greatest(0, least(w.x1, least(r.x1, d.x1)) - greatest(w.x0, greatest(r.x0, d.x0))) / (w.x1 - w.x0) >= 0.5 GROUP BY 1, 2, 3
UNION ALL SELECT d.paper_id, d.sel_id, r.ord, 'clip', NULL FROM drags d JOIN regions r ON r.paper_id = d.paper_id AND r.page = d.page AND r.label = 'picture'
  AND (r.x0 + r.x1) / 2 BETWEEN d.x0 AND d.x1 AND (r.y0 + r.y1) / 2 BETWEEN d.y0 AND d.y1""", ("drags", "words"))
def _(lib):
    blocks = P.chunk_blocks(selections(lib), lib.regions(), lib.word_lines(), ["sel_id"])
    return S.join_hyphens(blocks, S.paper_words(lib.page_text()), ["sel_id", "region_ord"]).select("paper_id", "sel_id", "region_ord", "kind", "text")


add_table("peek_near", """
  SELECT paper_id, section_id, side, b_top, b_bottom, b_left, arg_min(gx0, (away, g)) AS gx0, arg_min(gx1, (away, g)) AS gx1 FROM (
    SELECT b.*, r.x0 AS gx0, r.x1 AS gx1, r.ord AS g, greatest(r.x0 - b_left, b_left - r.x1, 0) AS away FROM (
      SELECT paper_id, section_id, 'before' AS side, arg_min(page, run_ord) AS page, arg_min(x0, run_ord) AS b_left, greatest(arg_min(y0, run_ord) - 36, 0) AS b_top, arg_min(y0, run_ord) AS b_bottom FROM section_rects GROUP BY 1, 2
      UNION ALL SELECT paper_id, section_id, 'after', arg_max(page, run_ord), arg_max(x0, run_ord), arg_max(y1, run_ord), least(arg_max(y1, run_ord) + 36, 792) FROM section_rects GROUP BY 1, 2) b
    LEFT JOIN regions r ON r.paper_id = b.paper_id AND r.page = b.page AND r.y0 < b_bottom AND r.y1 > b_top AND greatest(r.x0 - b_left, b_left - r.x1, 0) <= 24)
  WHERE b_bottom - b_top >= 1 GROUP BY ALL""", "section_rects", "regions")


@query("jn28_peek_bands", """
SELECT paper_id, section_id AS node_id, side, b_top, b_bottom, CASE WHEN gx0 IS NOT NULL THEN least(gx0, b_left) WHEN b_left < 306 THEN 0 ELSE 306 END AS b_x0,
       CASE WHEN gx0 IS NOT NULL THEN gx1 WHEN b_left < 306 THEN 306 ELSE 612 END AS b_x1 FROM (
  SELECT paper_id, section_id, side, b_top, b_bottom, b_left, gx0, gx1 FROM peek_near)""", ("peek_near",))
def _(lib):
    ext = lib.sections()[1].select("paper_id", F.col("section_id").alias("node_id"), F.col("run_ord").alias("rect_ord"), "page", *CORNERS)
    return P.peek_bands(ext, lib.pages(), lib.regions()).select("paper_id", "node_id", "side", "b_top", "b_bottom", "b_x0", "b_x1")


@query("jn27_destination_cards")
def _(lib):
    links = lib.drags().select("paper_id", F.col("sel_id").alias("link_id"), "page", F.when(F.col("paper_id") % 9 != 0, F.col("y0") - 20).alias("top"), F.when(F.col("paper_id") % 4 != 0, F.lit(52.0)).alias("left_x"))
    return P.destination_cards(links, lib.pages(), lib.headed_regions(), lib.figures(), lib.word_lines()).select("paper_id", "link_id", "kind", "text")


@query("src05_agent_notes", r"""
SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'A "b" ' || doc_id END AS title, CASE WHEN doc_id % 4 = 0 THEN 'h-' || doc_id END AS "on", doc_id % 4 <> 3 AS has_front FROM documents""")
def _(lib):
    d = F.col("doc_id")
    head = F.concat(F.lit("---\ntitle: 'A \"b\" "), d, F.lit("'\n"), F.when(d % 4 == 0, F.concat(F.lit("on: h-"), d, F.lit(" # the mark\n"))).when(d % 4 == 3, "not a field\n").otherwise(""), F.lit("---\n"))
    raw = lib.table("documents").select("doc_id", F.concat(head, "text").alias("value"), F.col("text").alias("body"))
    return library.parse_agent_notes(raw).select("doc_id", "title", "on", (F.col("text") == F.col("body")).alias("has_front"))


@query("wn07_migrate_boards", """
SELECT paper_id, 2 AS schema, CASE WHEN paper_id % 3 = 0 THEN 1 ELSE 2 END AS edges, h_id AS from_id, CASE WHEN paper_id % 3 = 0 THEN page ELSE page END AS page, CASE WHEN paper_id % 3 = 0 THEN 'ai' ELSE 'reader' END AS origin FROM marks""", ("marks",))
def _(lib):
    """Two boards in three are of schema 1, naming their note on the highlight and their ends by handles."""
    p = F.col("paper_id")
    new = p % 3 == 0
    rect = F.array("x0", "y0", "x1", "y1")
    lines = F.when(new, F.array(F.struct("page", rect.alias("rect"))))
    none = F.lit(None).cast("string")
    mark = F.struct(F.col("h_id").alias("id"), F.when(~new, "n-t").alias("note"), F.struct(lines.alias("rects"), F.when(~new, F.col("page")).alias("page"), F.when(~new, rect).alias("rect")).alias("anchor"))
    note = F.struct(F.lit("n-t").alias("id"), F.lit("note").alias("type"), F.struct(F.when(new, "ai").alias("origin")).alias("data"))
    edge = F.struct(F.lit("e-x").alias("id"), F.when(new, F.col("h_id")).alias("from"), F.when(new, F.lit("n-c")).alias("to"), F.when(~new, "n-c").alias("source"), F.when(~new, "n-c").alias("target"),
                    F.when(~new, F.col("h_id")).alias("sourceHandle"), F.when(~new, "n-c-in").alias("targetHandle"))
    text = F.to_json(F.struct(F.when(new, 2).alias("schema"), F.array(mark).alias("highlights"), F.array(note).alias("nodes"), F.array(edge).alias("edges")))
    raw = lib.highlights().select("paper_id", F.from_json(text, library.BOARD_SCHEMA.replace("paper_id string, ", "")).alias("b")).select("paper_id", "b.*")
    done = library.migrate_boards(raw)
    return done.select("paper_id", "schema", F.size("edges").alias("edges"), F.col("edges")[0]["from"].alias("from_id"), F.col("highlights")[0]["anchor"]["rects"][0]["page"].alias("page"),
                       F.col("nodes")[0]["data"]["origin"].alias("origin"))
