"""Selections, chunks and their re-cutting (AN-16, AN-17, GR-09, GR-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import anchoring as A
from foliograph.operators.geomjoin import points_in_rects
from foliograph.operators.grounding import find_quote_inside
from foliograph.operators.layout import column_runs
from foliograph.operators.pieces import boxed, midpoints
from foliograph.operators.search import HYPHENATED, join_hyphens, paper_words
from foliograph.operators.spread import materialise
from foliograph.operators.words import CORNERS, Lines, printed_lines, text_under, words_under

GLUE = "\ue001\n"   # a joined line-end hyphen keeps its two places, so offsets still count in the page's own text
HIDDEN = r"(?U)[\s\x1c-\x1f\ue001]+"


def selection_texts(rects: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The text under each rect of a selection. `rects`: paper_id, keys, rect_ord, page, box."""
    keys = list(keys)
    return rects.join(text_under(words, boxed(rects, "q_", "paper_id", "page", *keys, "rect_ord"), [*keys, "rect_ord"]), ["paper_id", *keys, "rect_ord"], "left").withColumn(
        "text", F.coalesce("text", F.lit("")))


def _quoted_ends(said: DataFrame, pages: DataFrame, words: DataFrame, keys: list[str], first, last) -> DataFrame:
    box = F.struct("page", *CORNERS, "text")
    ends = said.groupBy("paper_id", *keys).agg(F.min_by(box, "rect_ord").alias("a"), F.max_by(box, "rect_ord").alias("z"))
    asked = ends.select("paper_id", *keys, F.explode(F.array(
        F.struct(F.lit("start").alias("which"), F.col("a").alias("b"), first(F.col("a.text")).alias("exact")),
        F.struct(F.lit("end").alias("which"), F.col("z").alias("b"), last(F.col("z.text")).alias("exact")))).alias("e")).select(
        "paper_id", *keys, "e.which", "e.exact", "e.b.page", *[F.col(f"e.b.{c}").alias(f"q_{c}") for c in CORNERS])
    return A.quote_under(materialise(asked), pages, words, [*keys, "which"])


def make_highlights(rects: DataFrame, pages: DataFrame, words: DataFrame, keys: Sequence[str] = ("sel_id",)) -> tuple[DataFrame, DataFrame]:
    """(anchors, lines): a selection's quote, its prefix and position from its first rect, its suffix from its last, and one
    box per printed line."""
    keys = list(keys)
    said = materialise(selection_texts(rects, words, keys))
    ends = _quoted_ends(said, pages, words, keys, X.ends_trimmed, X.ends_trimmed)
    exact = said.groupBy("paper_id", *keys).agg(X.ends_trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rect_ord", "text"))), lambda s: s["text"]), "\n")).alias("exact"))
    head = A.global_position(ends.where("which = 'start'"), pages).select("paper_id", *keys, "prefix", "position")
    tail = ends.where("which = 'end'").select("paper_id", *keys, "suffix")
    under = words_under(words, boxed(rects, "q_", "paper_id", "page", *keys, "rect_ord"), [*keys, "rect_ord"])
    return exact.join(head, ["paper_id", *keys]).join(tail, ["paper_id", *keys]), printed_lines(under, [*keys, "rect_ord"])


def make_chunk_anchors(rects: DataFrame, pages: DataFrame, words: DataFrame, keys: Sequence[str] = ("sel_id",)) -> DataFrame:
    """A chunk's two ends: 64 characters quoted under its first and its last rect. One row per end."""
    keys = list(keys)
    said = materialise(selection_texts(rects, words, keys))
    n = A.END_CHARS
    ends = _quoted_ends(said, pages, words, keys, lambda t: F.substring(X.ends_trimmed(t), 1, n), lambda t: F.right(X.ends_trimmed(t), F.lit(n)))
    return A.global_position(ends, pages).select("paper_id", *keys, "which", "exact", "prefix", "suffix", "position")


def area_quotes(rects: DataFrame, pages: DataFrame, words: DataFrame, keys: Sequence[str] = ("sel_id",)) -> DataFrame:
    """An area selection's quote: at most 256 characters of the text inside."""
    keys = list(keys)
    said = selection_texts(rects.withColumn("rect_ord", F.lit(0)), words, keys)
    asked = said.select("paper_id", "page", *keys, *[F.col(c).alias(f"q_{c}") for c in CORNERS], F.substring(X.ends_trimmed("text"), 1, A.QUOTE_CHARS).alias("exact"))
    return A.global_position(A.quote_under(materialise(asked), pages, words, keys), pages)


def card_texts(pages: DataFrame) -> DataFrame:
    """Pages as a card reads them, with their places: hyphens of words the paper knows are marked at line ends. Only papers with a
    hyphen at a line end need their words."""
    broken = pages.where(F.col("text").rlike(HYPHENATED)).select("paper_id").distinct()
    vocab = paper_words(pages.join(broken, "paper_id", "left_semi"))
    joined = join_hyphens(pages.select("paper_id", "page", "text"), vocab, ["page"], glue=GLUE)
    return joined.join(A.page_places(pages), ["paper_id", "page"])


def card_index(pages: DataFrame, span: int = 1, texts: DataFrame | None = None) -> DataFrame:
    """The page index as a card reads it: line-end hyphens of words the paper knows are left out of the matched text, while
    offsets still point into the pages' own text. `texts` are the `card_texts` of the pages, where they are known."""
    texts = card_texts(pages) if texts is None else texts
    if span > 1:
        texts = A.page_windows(texts, span).join(texts.drop("text"), ["paper_id", "page"])
    return materialise(texts.withColumn("stripped", F.regexp_replace("text", HIDDEN, "")))


def card_offsets(text: str) -> Column:
    """For every character that a card matches its offset in the page's own text."""
    return F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(~c.isin("", *X.WS_CHARS, GLUE[0]), i)), lambda i: i.isNotNull())


def quotes_in_region(quotes: DataFrame, rects: DataFrame, pages: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, missing): printed lines of words chosen in a chunk, found on one page or across two, taken only when their
    first and last line lie inside the chunk; only the inside lines come back. `quotes`: paper_id, q_id, exact, prefix,
    suffix, position, page_hint; `rects`: paper_id, q_id, rect_ord, page, box."""
    index = card_index(pages)
    one, one_lines = find_quote_inside(quotes, rects, index, pages, words, offsets=card_offsets)
    one = materialise(one)
    # No place over two pages beats the full score of 1: only the other quotes are looked for there, in their own papers.
    rest = materialise(quotes.join(one.where("score >= 1").select("paper_id", "q_id"), ["paper_id", "q_id"], "left_anti"))
    near = rest.select("paper_id").distinct()
    two, two_lines = find_quote_inside(rest, rects.join(rest.select("paper_id", "q_id"), ["paper_id", "q_id"], "left_semi"),
                                       card_index(pages, 2, index.drop("stripped").join(near, "paper_id", "left_semi")), pages, words, span=2, offsets=card_offsets)
    a = one.select("paper_id", "q_id", F.col("score").alias("s1"))
    b = two.select("paper_id", "q_id", F.col("score").alias("s2"))
    pick = materialise(a.join(b, ["paper_id", "q_id"], "full").withColumn("span", F.when(F.col("s2") > F.coalesce("s1", F.lit(-1.0)), 2).otherwise(1)))
    lines = one_lines.join(pick.where("span = 1"), ["paper_id", "q_id"], "left_semi").unionByName(two_lines.join(pick.where("span = 2"), ["paper_id", "q_id"], "left_semi"))
    pts = midpoints(lines, "paper_id", "q_id", "page", "line_first", *CORNERS)
    inside = points_in_rects(pts, boxed(rects, "r_", "paper_id", "page", "q_id", "rect_ord"), "px", "py", "r_", keys=["paper_id", "page", "q_id"])
    kept = inside.groupBy("paper_id", "q_id", "page", "line_first", *CORNERS).agg(F.min("rect_ord").alias("rect_ord"))
    return kept, quotes.select("paper_id", "q_id").join(pick, ["paper_id", "q_id"], "left_anti")


def recut(rects: DataFrame, lines: DataFrame, mode: str = "split") -> DataFrame:
    """A chunk's rects divided at the top of the quote's first line and, for "cut", at the bottom of its last. Rows: paper_id,
    q_id, piece, rect_ord, page, box, for the parts with any height. `lines` come from `quotes_in_region`."""
    first = F.min_by(F.struct("rect_ord", F.col("y0").alias("y")), F.struct("page", "line_first"))
    last = F.max_by(F.struct("rect_ord", F.col("y1").alias("y")), F.struct("page", "line_first"))
    b = lines.groupBy("paper_id", "q_id").agg(first.alias("b1"), last.alias("b2"))
    j = rects.join(b, ["paper_id", "q_id"])
    cut_at = lambda bound, low: F.when(F.col("rect_ord") == F.col(f"{bound}.rect_ord"), F.least(F.greatest(F.col(f"{bound}.y"), low), F.col("y1")))
    j = j.withColumn("c1", cut_at("b1", F.col("y0")))
    j = j.withColumn("c2", cut_at("b2", F.coalesce("c1", "y0")) if mode == "cut" else F.lit(None).cast("double"))
    before = F.when(F.col("rect_ord") > F.col("b1.rect_ord"), 1).otherwise(0) + (F.when(F.col("rect_ord") > F.col("b2.rect_ord"), 1).otherwise(0) if mode == "cut" else F.lit(0))
    part = lambda n, a, z: F.struct(n.cast("int").alias("piece"), a.alias("a"), z.alias("z"))
    e1, e2 = F.coalesce("c1", "y0"), F.coalesce("c2", F.coalesce("c1", "y0"))
    n1, n2 = F.when(F.col("c1").isNotNull(), 1).otherwise(0), F.when(F.col("c2").isNotNull(), 1).otherwise(0)
    parts = F.array(part(before, F.col("y0"), e1), part(before + n1, e1, e2), part(before + n1 + n2, e2, F.col("y1")))
    return j.select("paper_id", "q_id", "rect_ord", "page", "x0", "x1", F.explode(parts).alias("p")).where("p.z > p.a").select(
        "paper_id", "q_id", "p.piece", "rect_ord", "page", "x0", F.col("p.a").alias("y0"), "x1", F.col("p.z").alias("y1"))


def join_chunks(rects: DataFrame, words: DataFrame, regions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, refused): chunks asked to become one (`join_id`) merged in paper order, their rects collapsed into column
    runs; refused when one has no words or body words lie between two. `rects`: paper_id, join_id, node_id, rect_ord, page,
    box; `pages` carry widths."""
    under = words_under(words, boxed(rects, "q_", "paper_id", "page", "join_id", "node_id"), ["join_id", "node_id"])
    key = F.struct("page", "word_ord")
    spans = under.groupBy("paper_id", "join_id", "node_id").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    asked = rects.select("paper_id", "join_id", "node_id").distinct()
    wordless = asked.join(spans, ["paper_id", "join_id", "node_id"], "left_anti").select("paper_id", "join_id")
    w = Window.partitionBy("paper_id", "join_id").orderBy("first", "last", "node_id")   # the chunks of one request
    ordered = materialise(spans.withColumn("place", F.row_number().over(w) - 1).withColumn("next", F.lead("first").over(w)))
    gaps = ordered.where("next IS NOT NULL AND next > last").select("paper_id", "join_id", "place", "last", "next")
    spread = gaps.withColumn("page", F.explode(F.sequence(F.col("last.page"), F.col("next.page"))))
    if isinstance(words, Lines):
        far = lambda w: (F.struct("page", w["word_ord"].alias("word_ord")) > F.col("last")) & (F.struct("page", w["word_ord"].alias("word_ord")) < F.col("next"))
        words = words.rows.join(spread, ["paper_id", "page"]).select("paper_id", "page", "join_id", "place", F.explode(F.filter(words.laid(F.col), far)).alias("_w"))
        between = words.select("paper_id", "page", "join_id", "place", "_w.*")
    else:
        between = words.join(spread, ["paper_id", "page"]).where((F.struct("page", "word_ord") > F.col("last")) & (F.struct("page", "word_ord") < F.col("next")))
    pts = midpoints(between, "paper_id", "page", "join_id", "place", "word_ord")
    furniture = boxed(regions.where(F.col("label").isin(*X.FURNITURE)), "g_", "paper_id", "page")
    excused = points_in_rects(pts, furniture, "px", "py", "g_").select("paper_id", "page", "join_id", "place", "word_ord").distinct()
    apart = pts.join(excused, ["paper_id", "page", "join_id", "place", "word_ord"], "left_anti").select("paper_id", "join_id")
    refused = wordless.unionByName(apart).distinct()
    rows = (rects.join(ordered.select("paper_id", "join_id", "node_id", "place"), ["paper_id", "join_id", "node_id"]).join(refused, ["paper_id", "join_id"], "left_anti")
            .withColumn("seq", (F.col("place") * 1_000_000 + F.col("rect_ord")).cast("long")))
    return column_runs(rows, pages, ["paper_id", "join_id"], "seq"), refused
