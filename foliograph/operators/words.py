"""Words and rectangles: the words a rectangle covers, as rows, text or printed-line boxes.

`words`: paper_id, page, word_ord, x0..y1, text, block, line, or the same as `Lines`. `rects`: paper_id, page, q_x0..q_y1 and the caller's
keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.functions.rects import Rect, interval_share
from foliograph.operators.geomjoin import points_in_rects

LINE_INSIDE = 0.5
WORD_INSIDE = 0.5
CORNERS = ("x0", "y0", "x1", "y1")


class Lines(NamedTuple):
    """Text lines whose words are laid out where they are used. Words with their boxes are some twenty times as large as their text, so
    lines are joined and shuffled as they are stored, and a line's words are an array made after that."""

    #: paper_id, page, block, line, line_first, l_y0, l_y1 and what `laid` reads.
    rows: DataFrame
    #: A line's words in order, an array of (word_ord, x0, y0, x1, y1, text), given a way to name the columns of `rows`.
    laid: Callable[[Callable[[str], Column]], Column]
    #: The same way and without laying it out, the line's words as text, one space between them, where columns tell it.
    said: Callable[[Callable[[str], Column]], Column] | None = None
    #: The same way, two places between which all words of the line lie, each word being wider than nothing.
    reach: Callable[[Callable[[str], Column]], tuple[Column, Column]] | None = None

    def where(self, rows: Callable[[DataFrame], DataFrame]) -> Lines:
        return self._replace(rows=rows(self.rows))

    def chars(self) -> Column:
        """How many characters a line of `rows` has without whitespace."""
        text = F.array_join(F.transform(self.laid(F.col), lambda w: w["text"]), "") if self.said is None else self.said(F.col)
        return F.length(X.strip_ws(text))


def of_rows(words: DataFrame | Lines, change: Callable[[DataFrame], DataFrame]) -> DataFrame | Lines:
    """The same change to either form of words, for filters by paper or page."""
    return words.where(change) if isinstance(words, Lines) else change(words)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_words(words: DataFrame | Lines) -> DataFrame:
    """(paper_id, page, _held): what a page's words are made of, one row a page; `page_array` makes them."""
    rows, order = (words.rows, "line_first") if isinstance(words, Lines) else (words.select("paper_id", "page", "word_ord", *CORNERS, "text"), "word_ord")
    rest = [c for c in rows.columns if c not in ("paper_id", "page", order)]
    return rows.groupBy("paper_id", "page").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_held"))


def page_array(words: DataFrame | Lines) -> Column:
    """The words of a row of `page_words` in order, an array of structs; those of `Lines` with block and line."""
    if not isinstance(words, Lines):
        return F.col("_held")
    whole = lambda w, held: F.struct(*[w[c].alias(c) for c in ("word_ord", *CORNERS, "text")], held["block"].alias("block"), held["line"].alias("line"))
    return F.flatten(F.transform("_held", lambda held: F.transform(words.laid(lambda name: held[name]), lambda w: whole(w, held))))


def hull_columns(prefix: str = "") -> list[Column]:
    return [F.min("x0").alias(f"{prefix}x0"), F.min("y0").alias(f"{prefix}y0"),
            F.max("x1").alias(f"{prefix}x1"), F.max("y1").alias(f"{prefix}y1")]


def text_lines(words: DataFrame) -> DataFrame:
    """One box per text line."""
    return words.groupBy("paper_id", "page", "block", "line").agg(*hull_columns("l_"), F.min("word_ord").alias("line_first"))


def _lines_at(words: Lines, rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines half inside a rectangle vertically, with its keys, `q_x0` and `q_x1`; not those known to lie beside it."""
    wanted = rects.select("paper_id", "page", *keys, *[f"q_{c}" for c in CORNERS])
    inside = interval_share(F.col("l_y0"), F.col("l_y1"), F.col("q_y0"), F.col("q_y1")) >= LINE_INSIDE
    if words.reach is not None:
        left, right = words.reach(F.col)
        inside = inside & (F.col("q_x0") < right) & (left < F.col("q_x1"))
    return points_in_rects(words.rows.withColumn("l_mid", (F.col("l_y0") + F.col("l_y1")) / 2), wanted, "l_mid", "l_mid", "q_", residual=inside)


def _within(words: Lines) -> Column:
    """The words of a row of `_lines_at` that are half inside horizontally."""
    return F.filter(words.laid(F.col), lambda w: interval_share(w["x0"], w["x1"], F.col("q_x0"), F.col("q_x1")) >= WORD_INSIDE)


def _lines_under(words: Lines, rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(paper_id, page, block, line, keys, _in): lines half inside a rectangle vertically, with their words half inside horizontally."""
    return _lines_at(words, rects, keys).select("paper_id", "page", "block", "line", *keys, _within(words).alias("_in"))


def _said_under(words: Lines, rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(paper_id, keys, _first, _line): each line's words under a rectangle as text, with the place of the first. Words are laid out only
    where the rectangle might cut their line."""
    cut = F.transform(F.filter(F.array(_within(words)), lambda ws: F.size(ws) > 0), lambda ws: F.struct(
        ws[0]["word_ord"].alias("_first"), F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("_line")))
    if words.said is not None and words.reach is not None:
        left, right = words.reach(F.col)
        whole = F.struct(F.col("line_first").alias("_first"), words.said(F.col).alias("_line"))
        cut = F.when((F.col("q_x0") <= left) & (left < right) & (right <= F.col("q_x1")), F.filter(F.array(whole), lambda s: s["_line"] != "")).otherwise(cut)
    return _lines_at(words, rects, keys).select("paper_id", *keys, F.explode(cut).alias("_s")).select("paper_id", *keys, "_s.*")


def words_under(words: DataFrame | Lines, rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words of the lines lying at least half inside a rectangle vertically, themselves half inside horizontally.

    An interval at least half inside another has its midpoint there, so line midpoints are banded like any point."""
    if isinstance(words, Lines):
        return _lines_under(words, rects, keys).select("paper_id", "page", "block", "line", *keys, F.explode("_in").alias("_w")).select(
            "paper_id", "page", "block", "line", *keys, "_w.*")
    wanted = rects.select("paper_id", "page", *keys, *[f"q_{c}" for c in CORNERS])
    lines = text_lines(words).withColumn("l_mid", (F.col("l_y0") + F.col("l_y1")) / 2)
    inside = interval_share(F.col("l_y0"), F.col("l_y1"), F.col("q_y0"), F.col("q_y1")) >= LINE_INSIDE
    hit = points_in_rects(lines, wanted, "l_mid", "l_mid", "q_", residual=inside)
    near = hit.select("paper_id", "page", "block", "line", *keys, "q_x0", "q_x1")
    return (words.join(near, ["paper_id", "page", "block", "line"])
            .where(interval_share(F.col("x0"), F.col("x1"), F.col("q_x0"), F.col("q_x1")) >= WORD_INSIDE)
            .drop("q_x0", "q_x1"))


def ordered_text(df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str, out: str, *extra: Column) -> DataFrame:
    """The text of each key's rows in order. The gathered list is the value that is returned, no more."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["t"]), sep).alias(out), *extra)


def text_under(words: DataFrame | Lines, rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The words under each rectangle as text, one line per text line, ending in a line break. No words, no row. The keys tell the
    rectangles apart."""
    if isinstance(words, Lines):
        lines = _said_under(words, rects, keys)
    else:
        under = words_under(words, rects, keys)
        lines = ordered_text(under, ["paper_id", *keys, "block", "line"], "word_ord", "text", " ", "_line",
                             F.min("word_ord").alias("_first"))
    whole = ordered_text(lines, ["paper_id", *keys], "_first", "_line", "\n", "text")
    return whole.withColumn("text", F.concat("text", F.lit("\n")))


def chars_under(words: DataFrame | Lines, rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many non-whitespace characters lie under each rectangle."""
    return words_under(words, rects, keys).groupBy("paper_id", *keys).agg(F.sum(F.length(X.strip_ws("text"))).alias("chars"))


def merge_hulls(items: Column, joins: Callable[[Rect, Column], Column]) -> Column:
    """Fold an ordered array of boxes (first, x0, y0, x1, y1) into the hulls of its runs.

    `joins(hull, box)` says whether a box continues the running hull. The arrays are one page column or one text block."""
    head = F.element_at(items, 1)
    start = F.struct(F.filter(items, lambda _: F.lit(False)).alias("done"), head.alias("cur"))

    def step(acc: Column, it: Column) -> Column:
        cur = acc["cur"]
        hull = Rect(cur["x0"], cur["y0"], cur["x1"], cur["y1"])
        grown = F.struct(cur["first"].alias("first"), F.least(cur["x0"], it["x0"]).alias("x0"), F.least(cur["y0"], it["y0"]).alias("y0"),
                         F.greatest(cur["x1"], it["x1"]).alias("x1"), F.greatest(cur["y1"], it["y1"]).alias("y1"))
        go_on = joins(hull, it)
        return F.struct(F.when(go_on, acc["done"]).otherwise(F.array_append(acc["done"], cur)).alias("done"),
                        F.when(go_on, grown).otherwise(it).alias("cur"))

    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step, lambda a: F.array_append(a["done"], a["cur"]))


def boxes(first: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(first).alias("first"), *[F.col(c) for c in CORNERS])))


def printed_lines(words: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One box per printed line of the given words: text lines of one block sharing at least half their height merge."""
    lines = words.groupBy("paper_id", *keys, "page", "block", "line").agg(*hull_columns(), F.min("word_ord").alias("first"))

    def same_row(hull: Rect, it: Column) -> Column:
        shared = F.least(hull.y1, it["y1"]) - F.greatest(hull.y0, it["y0"])
        return shared >= LINE_INSIDE * F.least(hull.y1 - hull.y0, it["y1"] - it["y0"])

    runs = lines.groupBy("paper_id", *keys, "page", "block").agg(merge_hulls(boxes("first"), same_row).alias("_runs"))
    return (runs.select("paper_id", *keys, "page", "block", F.explode("_runs").alias("r"))
            .select("paper_id", *keys, "page", "block", F.col("r.first").alias("line_first"), *[F.col(f"r.{c}") for c in CORNERS]))
