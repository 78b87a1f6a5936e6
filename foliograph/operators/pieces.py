"""Marks and pieces by geometry: what lies where, what a rough selection takes, what a piece shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.rects import Rect, area, intersection, midpoint, overlap_ratio, overlaps, rect, union
from foliograph.operators.geomjoin import overlapping_rects, points_in_rects
from foliograph.operators.layout import smallest_region_at
from foliograph.operators.words import CORNERS, chars_under, text_under

SNAP_THRESHOLD = 0.6
CLIP_LABELS = ("formula", "picture", "table")
TEXT_LABELS = ("text", "list-item", "section-header", "title", "caption", "footnote")


def boxed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in CORNERS])


def midpoints(df: DataFrame, *keep: str) -> DataFrame:
    px, py = midpoint(rect())
    return df.select(*keep, px.alias("px"), py.alias("py"))


def highlights_in(highlight_rects: DataFrame, node_rects: DataFrame) -> DataFrame:
    """(paper_id, node_id, h_id) once for each mark with a line midpoint inside one of the node's rects."""
    pts = midpoints(highlight_rects, "paper_id", "h_id", "page")
    held = boxed(node_rects, "n_", "paper_id", "page", "node_id")
    return points_in_rects(pts, held, "px", "py", "n_").select("paper_id", "node_id", "h_id").distinct()


def snap_text(selections: DataFrame, regions: DataFrame, words: DataFrame) -> DataFrame:
    """A text selection holding at least 60 % of the characters of the region under its midpoint grows to hold it all."""
    at = smallest_region_at(midpoints(selections, "paper_id", "sel_id", "page"), regions, ["sel_id"])
    both = selections.join(at, ["paper_id", "sel_id", "page"])
    shared = intersection(rect(), rect("g_"))
    asked = both.select("paper_id", "page", "sel_id", F.explode(F.array(
        F.struct(F.lit("inside").alias("part"), *[v.alias(f"q_{c}") for v, c in zip(shared, CORNERS, strict=True)]),
        F.struct(F.lit("whole").alias("part"), *[F.col(f"g_{c}").alias(f"q_{c}") for c in CORNERS]))).alias("q")).select(
        "paper_id", "page", "sel_id", "q.*").where("q_x0 IS NOT NULL")
    chars = chars_under(words, asked, ["sel_id", "part"]).groupBy("paper_id", "sel_id").agg(
        F.sum(F.when(F.col("part") == "inside", F.col("chars")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("part") == "whole", F.col("chars")).otherwise(0)).alias("whole"))
    joined = (selections.join(at.drop("page"), ["paper_id", "sel_id"], "left").join(chars, ["paper_id", "sel_id"], "left")
              .withColumn("took", F.coalesce((F.col("whole") > 0) & (F.col("inside") / F.col("whole") >= SNAP_THRESHOLD), F.lit(False))))
    grown = union(rect(), rect("g_"))
    return joined.select("paper_id", "sel_id", "page", "took", "label", "region_ord",
                         *[F.when(F.col("took"), g).otherwise(F.col(c)).alias(c) for g, c in zip(grown, CORNERS, strict=True)])


def snap_area(drags: DataFrame, regions: DataFrame, figures: DataFrame) -> DataFrame:
    """A rectangle drag covering at least 60 % of a picture, table or formula takes the smallest such, with its caption.

    Sharing 60 % of the area means sharing over half of each side, so the region's midpoint lies in the drag."""
    clips = regions.where(F.col("label").isin(*CLIP_LABELS))
    pts = midpoints(clips, "paper_id", "page", F.col("ord").alias("region_ord"), "label", *[F.col(c).alias(f"g_{c}") for c in CORNERS])
    near = points_in_rects(pts, boxed(drags, "d_", "paper_id", "page", "sel_id"), "px", "py", "d_")
    covered = near.where(overlap_ratio(rect("g_"), rect("d_")) >= SNAP_THRESHOLD)
    pick = covered.groupBy("paper_id", "sel_id", "page").agg(F.min_by(
        F.struct("region_ord", "label", "px", "py", *[f"g_{c}" for c in CORNERS]), F.struct(area(rect("g_")), F.col("region_ord"))).alias("g")).select(
        "paper_id", "sel_id", "page", "g.*")
    figs = figures.select("paper_id", "page", F.col("ord").alias("f_ord"), *[F.col(c).alias(f"f_{c}") for c in CORNERS], *[f"cap_{c}" for c in CORNERS])
    caps = points_in_rects(pick.select("paper_id", "sel_id", "page", "px", "py"), figs, "px", "py", "f_").groupBy("paper_id", "sel_id").agg(
        F.min_by(F.struct(*[f"cap_{c}" for c in CORNERS]), "f_ord").alias("c")).select("paper_id", "sel_id", "c.*")
    taken = pick.join(caps, ["paper_id", "sel_id"], "left")
    whole = union(rect("g_"), rect("cap_"))
    target = taken.select("paper_id", "sel_id", "label", *[F.when(F.col("cap_x0").isNotNull(), u).otherwise(F.col(f"g_{c}")).alias(f"t_{c}")
                                                          for u, c in zip(whole, CORNERS, strict=True)])
    return drags.join(target, ["paper_id", "sel_id"], "left").select(
        "paper_id", "sel_id", "page", "label", *[F.coalesce(f"t_{c}", c).alias(c) for c in CORNERS])


def mark_at(points: DataFrame, highlight_rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last highlight in board order holding each point."""
    held = boxed(highlight_rects, "m_", "paper_id", "page", "h_id", F.col("ord").alias("m_ord"))
    return points_in_rects(points, held, "px", "py", "m_").groupBy("paper_id", *keys).agg(F.max_by("h_id", F.struct("m_ord", "h_id")).alias("h_id"))


def heading_at(points: DataFrame, sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first section whose heading holds each point."""
    held = boxed(sections, "s_", "paper_id", "page", "section_id", F.col("ord").alias("s_ord"))
    return points_in_rects(points, held, "px", "py", "s_").groupBy("paper_id", *keys).agg(F.min_by("section_id", "s_ord").alias("section_id"))


def chunk_blocks(rects: DataFrame, regions: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each chunk rect shows, in (rect_ord, region_ord) order: the words under a text region's overlap, or a whole
    picture, table or formula whose midpoint it holds. Line-end hyphens are joined by `search.join_hyphens`."""
    keys = list(keys)
    mine = boxed(rects, "c_", "paper_id", "page", *keys, "rect_ord")
    txt = boxed(regions.where(F.col("label").isin(*TEXT_LABELS)), "g_", "paper_id", "page", F.col("ord").alias("region_ord"))
    over = overlapping_rects(txt, mine, "g_", "c_")
    shared = intersection(rect("c_"), rect("g_"))
    asked = over.select("paper_id", "page", *keys, "rect_ord", "region_ord", *[v.alias(f"q_{c}") for v, c in zip(shared, CORNERS, strict=True)])
    said = text_under(words, asked, [*keys, "rect_ord", "region_ord"])
    texts = asked.join(said, ["paper_id", *keys, "rect_ord", "region_ord"]).select(
        "paper_id", *keys, "rect_ord", "region_ord", F.lit("text").alias("kind"), "page", *[F.col(f"q_{c}").alias(c) for c in CORNERS],
        "text", F.lit(None).cast("string").alias("label"))
    clips = midpoints(regions.where(F.col("label").isin(*CLIP_LABELS)), "paper_id", "page", F.col("ord").alias("region_ord"), "label", *CORNERS)
    shown = points_in_rects(clips, mine, "px", "py", "c_").select(
        "paper_id", *keys, "rect_ord", "region_ord", F.lit("clip").alias("kind"), "page", *CORNERS, F.lit(None).cast("string").alias("text"), "label")
    return texts.unionByName(shown)


def not_overlapping(items: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items none of whose area is shared with any of the other rectangles on their page. A page's others are gathered, so the items,
    which may be many more, are joined once."""
    held = others.groupBy("paper_id", "page").agg(F.collect_list(F.struct(*CORNERS)).alias("_others"))
    hit = F.exists("_others", lambda o: overlaps(rect(), Rect(*(o[c] for c in CORNERS))))
    return items.join(held, ["paper_id", "page"], "left").where(~F.coalesce(hit, F.lit(False))).drop("_others")


def kept_sentences(lines: DataFrame, highlight_rects: DataFrame) -> DataFrame:
    """Sentences whose first line some highlight starts on and whose last line it ends on.

    `lines`: paper_id, sentence_id, line_ord, page, box. `highlight_rects`: paper_id, h_id, rect_ord, page, box."""
    def ends(df: DataFrame, key: str, order: str) -> DataFrame:
        box = F.struct("page", *CORNERS)
        return df.groupBy("paper_id", key).agg(F.min_by(box, order).alias("head"), F.max_by(box, order).alias("tail"))

    s, h = ends(lines, "sentence_id", "line_ord"), ends(highlight_rects, "h_id", "rect_ord")

    def side(df: DataFrame, which: str, key: str, prefix: str) -> DataFrame:
        return df.select("paper_id", key, F.col(f"{which}.page").alias("page"), *[F.col(f"{which}.{c}").alias(f"{prefix}{c}") for c in CORNERS])

    first = overlapping_rects(side(s, "head", "sentence_id", "s_"), side(h, "head", "h_id", "h_"), "s_", "h_").select("paper_id", "sentence_id", "h_id")
    last = overlapping_rects(side(s, "tail", "sentence_id", "s_"), side(h, "tail", "h_id", "h_"), "s_", "h_").select("paper_id", "sentence_id", "h_id")
    return first.join(last, ["paper_id", "sentence_id", "h_id"], "left_semi").select("paper_id", "sentence_id").distinct()


def column_at(bands: DataFrame, regions: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The column each band (b_left, b_top, b_bottom) starts in: the nearest crossing region within 24 points of its left,
    widened to it, else the half of the page holding it. Adds b_x0, b_x1."""
    reach = 24.0
    wide = bands.select("paper_id", "page", *keys, "b_left", (F.col("b_left") - reach).alias("z_x0"), F.col("b_top").alias("z_y0"),
                        (F.col("b_left") + reach).alias("z_x1"), F.col("b_bottom").alias("z_y1"))
    g = boxed(regions, "g_", "paper_id", "page", F.col("ord").alias("g_ord"))
    # Open overlap plus the closed sideways reach: grow the zone a little, then test the exact distances.
    zone = wide.withColumn("z_x0", F.col("z_x0") - 1e-3).withColumn("z_x1", F.col("z_x1") + 1e-3)
    away = F.greatest(F.col("g_x0") - F.col("b_left"), F.col("b_left") - F.col("g_x1"), F.lit(0.0))
    near = (overlapping_rects(g, zone, "g_", "z_").where(away <= reach).groupBy("paper_id", *keys)
            .agg(F.min_by(F.struct("g_x0", "g_x1"), F.struct(away, F.col("g_ord"))).alias("g")))
    half = F.col("width") / 2
    left = F.col("b_left")
    return (bands.join(pages.select("paper_id", "page", "width"), ["paper_id", "page"]).join(near, ["paper_id", *keys], "left")
            .withColumn("b_x0", F.when(F.col("g").isNotNull(), F.least(F.col("g.g_x0"), left)).when(left < half, F.lit(0.0)).otherwise(half))
            .withColumn("b_x1", F.when(F.col("g").isNotNull(), F.col("g.g_x1")).when(left < half, half).otherwise(F.col("width"))).drop("g", "width"))


def peek_bands(rects: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Three lines' depth before a piece's first rect and after its last, inside its column and page. `rects`: paper_id,
    node_id, rect_ord, page, box."""
    depth, least = 36.0, 1.0
    box = F.struct("page", *CORNERS)
    ends = rects.groupBy("paper_id", "node_id").agg(F.min_by(box, "rect_ord").alias("a"), F.max_by(box, "rect_ord").alias("z"))
    sides = ends.select("paper_id", "node_id", F.explode(F.array(
        F.struct(F.lit("before").alias("side"), F.col("a.page").alias("page"), F.col("a.x0").alias("b_left"), (F.col("a.y0") - depth).alias("top"), F.col("a.y0").alias("bottom")),
        F.struct(F.lit("after").alias("side"), F.col("z.page").alias("page"), F.col("z.x0").alias("b_left"), F.col("z.y1").alias("top"), (F.col("z.y1") + depth).alias("bottom")))).alias("s")
    ).select("paper_id", "node_id", "s.*")
    inside = (sides.join(pages.select("paper_id", "page", "height"), ["paper_id", "page"])
              .withColumn("b_top", F.greatest(F.col("top"), F.lit(0.0))).withColumn("b_bottom", F.least(F.col("bottom"), F.col("height")))
              .where(F.col("b_bottom") - F.col("b_top") >= least).drop("top", "bottom", "height"))
    return column_at(inside, regions, pages, ["node_id", "side"])


def destination_cards(links: DataFrame, pages: DataFrame, regions: DataFrame, figures: DataFrame, words: DataFrame) -> DataFrame:
    """What a link's target shows: a figure or formula crossing its first 24 points, else the words of a 60-point band in
    its column. `links`: paper_id, link_id, page, top, left_x (both may be null)."""
    depth, clip_reach, reach = 60.0, 24.0, 24.0
    from foliograph.functions.text import first_entry

    at = (links.join(pages.select("paper_id", "page", "height"), ["paper_id", "page"])
          .withColumn("b_top", F.coalesce("top", F.lit(0.0))).withColumn("b_left", F.coalesce("left_x", F.lit(0.0)))
          .withColumn("b_bottom", F.least(F.col("b_top") + depth, F.col("height"))))
    zone = at.select("paper_id", "page", "link_id", "b_left", (F.col("b_left") - reach - 1e-3).alias("z_x0"), F.col("b_top").alias("z_y0"),
                     (F.col("b_left") + reach + 1e-3).alias("z_x1"), (F.col("b_top") + clip_reach).alias("z_y1"))
    formula = regions.where("label = 'formula'").select("paper_id", "page", F.lit(1).alias("rank"), F.col("ord").alias("t_ord"),
                                                        F.lit("").alias("t_text"), *CORNERS, *[F.col(c).alias(f"k_{c}") for c in CORNERS])
    own = figures.select("paper_id", "page", F.lit(0).alias("rank"), F.col("ord").alias("t_ord"), F.col("caption").alias("t_text"), *CORNERS,
                         *[F.col(c).alias(f"k_{c}") for c in CORNERS])
    cap = figures.select("paper_id", "page", F.lit(0).alias("rank"), F.col("ord").alias("t_ord"), F.col("caption").alias("t_text"),
                         *[F.col(f"cap_{c}").alias(c) for c in CORNERS], *[F.col(c).alias(f"k_{c}") for c in CORNERS]).where("x0 IS NOT NULL")
    targets = own.unionByName(cap).unionByName(formula)
    t = targets.select("paper_id", "page", "rank", "t_ord", "t_text", *[F.col(c).alias(f"t_{c}") for c in CORNERS], *[f"k_{c}" for c in CORNERS])
    away = F.greatest(F.col("t_x0") - F.col("b_left"), F.col("b_left") - F.col("t_x1"), F.lit(0.0))
    clip = overlapping_rects(t, zone, "t_", "z_").where(away <= reach).groupBy("paper_id", "link_id").agg(
        F.min_by(F.struct(F.col("t_text").alias("text"), *[F.col(f"k_{c}").alias(c) for c in CORNERS]), F.struct("rank", "t_ord")).alias("clip"))
    banded = column_at(at.join(clip, ["paper_id", "link_id"], "left_anti"), regions, pages, ["link_id"])
    asked = banded.select("paper_id", "page", "link_id", F.col("b_x0").alias("q_x0"), F.col("b_top").alias("q_y0"), F.col("b_x1").alias("q_x1"), F.col("b_bottom").alias("q_y1"))
    said = text_under(words, asked, ["link_id"]).select("paper_id", "link_id", first_entry(F.col("text")).alias("w_text"))
    return (at.select("paper_id", "link_id", "page").join(clip, ["paper_id", "link_id"], "left").join(said, ["paper_id", "link_id"], "left")
            .select("paper_id", "link_id", "page", F.when(F.col("clip").isNotNull(), "clip").otherwise("words").alias("kind"),
                    F.coalesce("clip.text", "w_text", F.lit("")).alias("text"), *[F.col(f"clip.{c}").alias(c) for c in CORNERS]))
