"""Queries for layout structure, words under rectangles and geometry joins (JN-01..10, AG-01..10, GD-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions.rects import midpoint, rect
from foliograph.operators import layout as L
from foliograph.operators import pieces as P
from foliograph.operators import words as W
from foliograph.plans.registry import query

CORNERS = W.CORNERS


def as_query_rects(df):
    return df.select("*", *[F.col(c).alias(f"q_{c}") for c in CORNERS]).drop(*CORNERS)


@query("jn01_lines_under", "SELECT paper_id, sel_id, page, block, word_ord, text FROM drag_words", ("drag_words",))
def _(lib):
    return W.words_under(lib.word_lines(), as_query_rects(lib.drags()), ["sel_id"]).select("paper_id", "sel_id", "page", "block", "word_ord", "text")


@query("jn02_text_under", """
SELECT paper_id, sel_id, string_agg(t, chr(10) ORDER BY f) || chr(10) AS text FROM (
  SELECT paper_id, sel_id, block, string_agg(text, ' ' ORDER BY word_ord) AS t, min(word_ord) AS f FROM drag_words GROUP BY 1, 2, 3) GROUP BY 1, 2""", ("drag_words",))
def _(lib):
    return W.text_under(lib.word_lines(), as_query_rects(lib.drags()), ["sel_id"])


@query("jn03_highlights_in", """
SELECT DISTINCT m.paper_id, s.section_id AS node_id, m.h_id FROM marks m JOIN section_rects s ON s.paper_id = m.paper_id AND s.page = m.page
WHERE (m.x0 + m.x1) / 2 BETWEEN s.x0 AND s.x1 AND (m.y0 + m.y1) / 2 BETWEEN s.y0 AND s.y1""", ("marks", "section_rects"))
def _(lib):
    nodes = lib.sections()[1].withColumnRenamed("section_id", "node_id")
    return P.highlights_in(lib.highlights(), nodes).select("paper_id", "node_id", "h_id")


@query("jn04_section_at", """
SELECT paper_id, h_id, section_id FROM (
  SELECT m.paper_id, m.h_id, s.section_id, row_number() OVER (PARTITION BY m.paper_id, m.h_id ORDER BY s.ord, s.run_ord) AS k
  FROM marks m JOIN section_rects s ON s.paper_id = m.paper_id AND s.page = m.page
  WHERE (m.x0 + m.x1) / 2 BETWEEN s.x0 AND s.x1 AND (m.y0 + m.y1) / 2 BETWEEN s.y0 AND s.y1) WHERE k = 1""", ("marks", "section_rects"))
def _(lib):
    return L.section_at(lib.highlights(), lib.sections()[1], ["h_id"])


@query("jn05_reading_key", """
SELECT d.paper_id, d.sel_id, coalesce(a.o, b.o) AS region_ord FROM drags d
LEFT JOIN (SELECT d.paper_id, d.sel_id, min(r.ord) AS o FROM drags d JOIN regions r ON r.paper_id = d.paper_id AND r.page = d.page
  AND (d.x0 + d.x1) / 2 BETWEEN r.x0 AND r.x1 AND d.y0 + 1 BETWEEN r.y0 AND r.y1 GROUP BY 1, 2) a ON a.paper_id = d.paper_id AND a.sel_id = d.sel_id
LEFT JOIN (SELECT d.paper_id, d.sel_id, min(r.ord) AS o FROM drags d JOIN regions r ON r.paper_id = d.paper_id AND r.page = d.page
  AND (r.x0 + r.x1) / 2 BETWEEN d.x0 AND d.x1 AND (r.y0 + r.y1) / 2 BETWEEN d.y0 AND d.y1 GROUP BY 1, 2) b ON b.paper_id = d.paper_id AND b.sel_id = d.sel_id""",
       ("drags",))
def _(lib):
    return L.reading_position(lib.drags(), lib.regions(), ["sel_id"]).select("paper_id", "sel_id", "region_ord")


@query("jn06_smallest_region_at", """
SELECT paper_id, sel_id, region_ord, label FROM (
  SELECT d.paper_id, d.sel_id, r.ord AS region_ord, r.label, row_number() OVER (PARTITION BY d.paper_id, d.sel_id ORDER BY (r.x1 - r.x0) * (r.y1 - r.y0), r.ord) AS k
  FROM drags d JOIN regions r ON r.paper_id = d.paper_id AND r.page = d.page
  AND (d.x0 + d.x1) / 2 BETWEEN r.x0 AND r.x1 AND (d.y0 + d.y1) / 2 BETWEEN r.y0 AND r.y1) WHERE k = 1""", ("drags",))
def _(lib):
    px, py = midpoint(rect())
    pts = lib.drags().select("paper_id", "sel_id", "page", px.alias("px"), py.alias("py"))
    return L.smallest_region_at(pts, lib.regions(), ["sel_id"]).select("paper_id", "sel_id", "region_ord", "label")


@query("jn07_snap_text", r"""
WITH small AS (SELECT * FROM (
  SELECT d.*, r.ord AS g, r.x0 AS gx0, r.y0 AS gy0, r.x1 AS gx1, r.y1 AS gy1,
         row_number() OVER (PARTITION BY d.paper_id, d.sel_id ORDER BY (r.x1 - r.x0) * (r.y1 - r.y0), r.ord) AS k
  FROM drags2 d JOIN regions r ON r.paper_id = d.paper_id AND r.page = d.page
   AND (d.x0 + d.x1) / 2 BETWEEN r.x0 AND r.x1 AND (d.y0 + d.y1) / 2 BETWEEN r.y0 AND r.y1) WHERE k = 1),
boxes AS (SELECT paper_id, page, sel_id, 'in' AS kind, greatest(x0, gx0) AS x0, greatest(y0, gy0) AS y0, least(x1, gx1) AS x1, least(y1, gy1) AS y1 FROM small
  UNION ALL SELECT paper_id, page, sel_id, 'all', gx0, gy0, gx1, gy1 FROM small),
chars AS (SELECT d.paper_id, d.sel_id, sum(CASE WHEN kind = 'in' THEN length(regexp_replace(w.text, '\s+', '', 'g')) ELSE 0 END) AS inside,
    sum(CASE WHEN kind = 'all' THEN length(regexp_replace(w.text, '\s+', '', 'g')) ELSE 0 END) AS whole
  FROM boxes d JOIN words w ON d.paper_id = w.paper_id AND d.page = w.page
  WHERE d.x0 < d.x1 AND d.y0 < d.y1 AND greatest(0, least(w.y1, d.y1) - greatest(w.y0, d.y0)) / (w.y1 - w.y0) >= 0.5
    AND greatest(0, least(w.x1, d.x1) - greatest(w.x0, d.x0)) / (w.x1 - w.x0) >= 0.5 GROUP BY 1, 2)
SELECT d.paper_id, d.sel_id, coalesce(c.whole > 0 AND c.inside / c.whole >= 0.6, false) AS took,
  CASE WHEN coalesce(c.whole > 0 AND c.inside / c.whole >= 0.6, false) THEN least(d.x0, s.gx0) ELSE d.x0 END AS x0,
  CASE WHEN coalesce(c.whole > 0 AND c.inside / c.whole >= 0.6, false) THEN greatest(d.y1, s.gy1) ELSE d.y1 END AS y1
FROM drags2 d LEFT JOIN small s ON s.paper_id = d.paper_id AND s.sel_id = d.sel_id LEFT JOIN chars c ON c.paper_id = d.paper_id AND c.sel_id = d.sel_id""",
       ("drags2", "words"))
def _(lib):
    return P.snap_text(rough(lib), lib.regions(), lib.word_lines()).select("paper_id", "sel_id", "took", "x0", "y1")


def rough(lib):
    """A drag over one line of text per page, sometimes wide enough to take it."""
    p = F.col("paper_id")
    return lib.pages().select("paper_id", "page", F.concat(F.lit("d"), "page").alias("sel_id"), F.lit(45.0).alias("x0"),
                              (95.0 + p % 3 * 24).alias("y0"), (60.0 + p % 250).alias("x1"), (118.0 + p % 3 * 24).alias("y1"))


@query("jn08_snap_area", """
SELECT d.paper_id, d.sel_id, s.label, coalesce(s.x0, d.x0) AS x0, coalesce(s.y0, d.y0) AS y0, coalesce(s.x1, d.x1) AS x1, coalesce(s.y1, d.y1) AS y1
FROM drags d LEFT JOIN (
  SELECT r.paper_id, r.sel_id, r.label, least(r.x0, coalesce(f.cap_x0, r.x0)) AS x0, least(r.y0, coalesce(f.cap_y0, r.y0)) AS y0,
         greatest(r.x1, coalesce(f.cap_x1, r.x1)) AS x1, greatest(r.y1, coalesce(f.cap_y1, r.y1)) AS y1
  FROM (SELECT d.sel_id, r.*, row_number() OVER (PARTITION BY d.paper_id, d.sel_id ORDER BY (r.x1 - r.x0) * (r.y1 - r.y0), r.ord) AS k
        FROM drags d JOIN hregions r ON r.paper_id = d.paper_id AND r.page = d.page AND r.label IN ('formula', 'picture', 'table')
         AND greatest(0, least(r.x1, d.x1) - greatest(r.x0, d.x0)) * greatest(0, least(r.y1, d.y1) - greatest(r.y0, d.y0)) / ((r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.6) r
  LEFT JOIN (SELECT r.paper_id, r.ord AS ro, f.*, row_number() OVER (PARTITION BY r.paper_id, r.ord ORDER BY f.ord) AS fk FROM hregions r JOIN figures f
        ON f.paper_id = r.paper_id AND f.page = r.page AND (r.x0 + r.x1) / 2 BETWEEN f.x0 AND f.x1 AND (r.y0 + r.y1) / 2 BETWEEN f.y0 AND f.y1) f
    ON f.paper_id = r.paper_id AND f.ro = r.ord AND f.fk = 1
  WHERE r.k = 1) s ON s.paper_id = d.paper_id AND s.sel_id = d.sel_id""", ("drags", "figures"))
def _(lib):
    return P.snap_area(lib.drags(), lib.headed_regions(), lib.figures()).select("paper_id", "sel_id", "label", *CORNERS)


@query("jn09_find_artwork", """
SELECT paper_id, figure_id, x0 + 4 AS a_x0, y0 + 4 AS a_y0, confidence FROM figures""", ("figures",))
def _(lib):
    r = lib.headed_regions()
    found = L.find_artwork(L.captions_of(r), r)
    fid = F.concat(F.when(F.col("kind") == "table", "tab-").otherwise("fig-"), "number")
    return found.select("paper_id", fid.alias("figure_id"), "a_x0", "a_y0", "confidence")


@query("jn10_paired_figure", """
SELECT paper_id, sel_id, figure_id FROM (
  SELECT d.paper_id, d.sel_id, f.figure_id, row_number() OVER (PARTITION BY d.paper_id, d.sel_id ORDER BY f.ord) AS k
  FROM (SELECT paper_id, page, 'd' || page AS sel_id, 40.0 AS x0, 60.0 AS y0, 300 + paper_id % 300 AS x1, 200 + paper_id % 300 AS y1 FROM pgs) d JOIN figures f
  ON f.paper_id = d.paper_id AND f.page = d.page AND (f.x0 + f.x1) / 2 BETWEEN d.x0 AND d.x1 AND (f.y0 + f.y1) / 2 BETWEEN d.y0 AND d.y1
   AND (f.cap_x0 + f.cap_x1) / 2 BETWEEN d.x0 AND d.x1 AND (f.cap_y0 + f.cap_y1) / 2 BETWEEN d.y0 AND d.y1) WHERE k = 1""", ("figures", "pgs"))
def _(lib):
    p = F.col("paper_id")
    wide = lib.pages().select("paper_id", "page", F.concat(F.lit("d"), "page").alias("sel_id"), F.lit(40.0).alias("x0"), F.lit(60.0).alias("y0"),
                              (300.0 + p % 300).alias("x1"), (200.0 + p % 300).alias("y1"))
    return L.paired_figure(wide, lib.figures(), ["sel_id"])


@query("jn31_mark_and_heading_at", """
SELECT q.paper_id, q.sel_id, m.h_id, s.section_id FROM (SELECT paper_id, page, sel_id, 60.0 AS px, 82 + paper_id % 9 * 24 AS py FROM drags) q
LEFT JOIN (SELECT paper_id, page, x0, y0, x1, y1, h_id FROM marks) m ON m.paper_id = q.paper_id AND m.page = q.page AND px BETWEEN m.x0 AND m.x1 AND py BETWEEN m.y0 AND m.y1
LEFT JOIN sections s ON s.paper_id = q.paper_id AND s.page = q.page AND px BETWEEN s.x0 AND s.x1 AND py BETWEEN s.y0 AND s.y1""", ("drags", "marks", "sections"))
def _(lib):
    pts = lib.drags().select("paper_id", "page", "sel_id", F.lit(60.0).alias("px"), (82.0 + F.col("paper_id") % 9 * 24).alias("py"))
    marks = P.mark_at(pts, lib.highlights().withColumn("ord", F.lit(0)), ["sel_id"])
    heads = P.heading_at(pts, lib.sections()[0], ["sel_id"])
    return pts.select("paper_id", "sel_id").join(marks, ["paper_id", "sel_id"], "left").join(heads, ["paper_id", "sel_id"], "left")


@query("ag01_line_hulls", """
SELECT paper_id, sel_id, page, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM drag_words GROUP BY 1, 2, 3, 4""", ("drag_words",))
def _(lib):
    under = W.words_under(lib.word_lines(), as_query_rects(lib.drags()), ["sel_id"])
    return W.printed_lines(under, ["sel_id"]).select("paper_id", "sel_id", "page", "block", *CORNERS)


@query("ag02_column_runs", "SELECT paper_id, section_id, run_ord, page, x0, y0, x1, y1 FROM section_rects", ("section_rects",))
def _(lib):
    rows = L.section_rows(lib.headed_regions())
    return L.column_runs(rows, lib.pages(), ["paper_id", "section_ord"]).select(
        "paper_id", F.concat(F.lit("sec-"), "section_ord").alias("section_id"), "run_ord", "page", *CORNERS)


@query("ag05_body_size", """
SELECT paper_id, page, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY c DESC, f) AS k FROM (
  SELECT paper_id, page, size, sum(length(trim(text))) AS c, min(word_ord) AS f FROM spans GROUP BY 1, 2, 3)) WHERE k = 1""", ("spans",))
def _(lib):
    return L.body_size(lib.text_spans())


@query("ag06_merge_rows", """
SELECT paper_id, page, block, min(x0) AS x0, max(x1) AS x1, md5(string_agg(text, ' ' ORDER BY word_ord)) AS text_md5, bool_or(bold) AS bold, max(size) AS size
FROM (SELECT *, sum(brk) OVER (PARTITION BY paper_id, page, block ORDER BY word_ord) AS run FROM (
  SELECT *, CASE WHEN coalesce(x0 - lag(x1) OVER w, 0) > 2 * size THEN 1 ELSE 0 END AS brk FROM spans WINDOW w AS (PARTITION BY paper_id, page, block ORDER BY word_ord)))
GROUP BY paper_id, page, block, run""", ("spans",))
def _(lib):
    return L.merge_rows(lib.text_spans()).select("paper_id", "page", "block", "x0", "x1", F.md5("text").alias("text_md5"), "bold", "size")


@query("ag07_inline_headings")
def _(lib):
    return buried(lib)[1].select("paper_id", "ord", "line_idx", "number", "text")


def printed_runs(lib):
    """The spans of `buried`, those of a region in its row."""
    k = F.col("paper_id") + F.col("block")
    own = (F.col("block") == 0) | (k % 7 == 0)

    def run(word, i):
        row = F.floor(i / 6)
        marked = (k % 3 == 1) & (row % 4 == 0)
        numbered = F.concat(((F.col("block") + row) % 9).cast("string"), F.lit(" X"), word)
        x0, y0 = 50.0 + i % 6 * 20, F.col("y0") + 4 + 14.0 * row
        return F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 16.0).alias("x1"), (y0 + 12.0).alias("y1"), F.when((i % 6 == 0) & marked, numbered).otherwise(word).alias("text"),
                        (own | marked).alias("bold"), F.when(own, 12.0).otherwise(10.0).alias("size"))

    words = F.filter(F.split("text", " "), lambda w: w != "")
    spread = lib.regions().repartition("paper_id", "ord")  # the text alone, before its runs are made
    return spread.withColumnRenamed("ord", "block").select("paper_id", "page", "block", F.transform(words, run).alias("runs"))


def buried(lib):
    """Styled lines inside regions, and the headings accepted among them. Words wrap into printed lines of six; in every
    third region each fourth line starts like a heading that may or may not continue the paper's numbering."""
    k, row = F.col("paper_id") + F.col("block"), F.floor(F.col("word_no") / 6)
    marked = (k % 3 == 1) & (row % 4 == 0)
    spans = lib.text_spans().withColumn("_row", row).withColumn("x0", 50.0 + F.col("word_no") % 6 * 20).withColumn("x1", F.col("x0") + 16.0)
    spans = spans.withColumn("y0", F.col("y0") + 14.0 * F.col("_row")).withColumn("y1", F.col("y0") + 12.0)
    numbered = F.concat(((F.col("block") + row) % 9).cast("string"), F.lit(" X"), "text")
    spans = spans.withColumn("text", F.when((F.col("word_no") % 6 == 0) & marked, numbered).otherwise(F.col("text"))).withColumn("bold", F.col("bold") | marked)
    lines = lib.shared("buried_lines", lambda: L.merge_runs(printed_runs(lib)))
    found = L.inline_headings(lines, L.body_size(spans), lib.regions().withColumn("header_level", F.lit(None).cast("int")))
    return lines, lib.shared("buried_headings", lambda: found)


@query("ag08_split_regions")
def _(lib):
    lines, found = buried(lib)
    return L.split_regions(lib.regions(), lines, found).select("paper_id", "ord", "piece", "page", *CORNERS, "label")


@query("ag09_build_sections", """
SELECT paper_id, section_id, ord, number, depth, title, page, md5(text) AS text_md5 FROM sections""", ("sections",))
def _(lib):
    return lib.sections()[0].select("paper_id", "section_id", "ord", "number", "depth", "title", "page", F.md5("text").alias("text_md5"))


@query("ag10_build_figures", """
SELECT paper_id, figure_id, kind, label, caption, page, x0, y0, x1, y1, confidence, ord FROM figures""", ("figures",))
def _(lib):
    return lib.figures().select("paper_id", "figure_id", "kind", "label", "caption", "page", *CORNERS, "confidence", "ord")
