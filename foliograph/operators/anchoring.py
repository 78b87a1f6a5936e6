"""Find quoted passages again after the text under them has changed.

Every page is matched with its whitespace stripped. Exact places come from a substring join. The best place known so far says how
alike a changed copy must be to score as high, and so how many characters it may have gained or lost; cut into one piece more than
that, a quote shares a whole piece with any such copy. Pieces meet pages in the same substring join, a bit-parallel common
subsequence around each shared piece drops most of them, and only what is left is scored in full. Quotes whose pieces would be
too short to tell anything (nothing like them is in the paper) are the only ones that meet every page of their own paper.
The best place is one grouped maximum.

`quotes`: paper_id, q_id, exact, prefix, suffix, position, page_hint. `pages`: paper_id, page, text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.functions.rects import contains_point, midpoint, rect
from foliograph.functions.similarity import fuzzy_window, indel_similarity, lcs
from foliograph.operators.contains import substring_join
from foliograph.operators.geomjoin import points_in_rects
from foliograph.operators.layout import column_runs
from foliograph.operators.spread import materialise, running
from foliograph.operators.words import CORNERS, Lines, let, of_rows, printed_lines

# Fixed values of the scoring rule.
MIN_SCORE = 0.5
FUZZY_MIN_CHARS = 8
W_QUOTE, W_PREFIX, W_SUFFIX, W_POSITION = 50.0, 20.0, 20.0, 2.0
TOTAL = W_QUOTE + W_PREFIX + W_SUFFIX + W_POSITION
CONTEXT_CHARS = 32
END_CHARS = 64
QUOTE_CHARS = 256
POSITION_BUCKET = 256
#: Least quote similarity of a fuzzy place, a fixed value of the scoring rule too.
MIN_QUOTE = 0.6
#: Pieces of fewer characters are in too many texts to prune anything.
PIECE_CHARS = 7


def page_places(pages: DataFrame) -> DataFrame:
    """(paper_id, page, page_start, total_len): where each page starts in its paper, and the paper's length."""
    sized = pages.select("paper_id", "page", F.length("text").alias("_len"))  # lengths are shifted and added up without the text
    starts = running(sized, ["paper_id"], "page", F.col("_len"), "page_start", inclusive=False).drop("_len")
    totals = sized.groupBy("paper_id").agg(F.greatest(F.sum("_len"), F.lit(1)).alias("total_len"))
    return starts.join(totals, "paper_id")


def page_index(pages: DataFrame) -> DataFrame:
    """Pages with their stripped text, where they start in the paper, and the paper's length."""
    return materialise(pages.join(page_places(pages), ["paper_id", "page"]).withColumn("stripped", X.strip_ws("text")))


def laid_out(pages: DataFrame, wanted: DataFrame, offsets: Callable[[str], Column] = X.kept_offsets) -> DataFrame:
    """Pages of `wanted` with `_off`, the offsets of their kept characters, and `stripped`, what those make up, instead of the text. The offsets
    are many times as large as the text, so they are made where they are used, after the shuffle; so is the stripped text, which comes along
    only where it does not follow from the text."""
    if offsets is X.kept_offsets:
        pages = pages.drop("stripped")
    near = pages.join(wanted.select("paper_id", "page").distinct(), ["paper_id", "page"], "left_semi").repartition("paper_id", "page")
    if offsets is X.kept_offsets:
        near = near.withColumn("stripped", X.strip_ws("text"))
    return near.withColumn("_off", offsets("text")).drop("text")


def stripped_quotes(quotes: DataFrame) -> DataFrame:
    return (quotes.withColumn("needle", X.strip_ws("exact")).withColumn("pre", X.strip_ws(F.coalesce("prefix", F.lit(""))))
            .withColumn("suf", X.strip_ws(F.coalesce("suffix", F.lit("")))).where("needle <> ''"))


def exact_candidates(quotes: DataFrame, index: DataFrame, within: Sequence[str] = ("paper_id",)) -> DataFrame:
    """Every place a stripped quote occurs on a page: quote columns, page keys, s, e (stripped) and quote_score 1."""
    found = substring_join(quotes, index, "needle", "stripped", ["paper_id", "page"], within)
    return (found.withColumn("s", F.col("at").cast("int")).withColumn("e", (F.col("at") + F.length("needle")).cast("int"))
            .withColumn("quote_score", F.lit(1.0)).drop("at"))


def fuzzy_candidates(quotes: DataFrame, index: DataFrame, exact: DataFrame, min_chars: int = FUZZY_MIN_CHARS) -> DataFrame:
    """Best window of every page of a quote's own paper, for quotes of at least `min_chars` characters, on pages without an exact
    hit."""
    long = quotes.where(F.length("needle") >= min_chars)
    held = index.select("paper_id", "page", F.col("stripped").alias("_text"))
    pairs = long.join(held, "paper_id").join(exact.select("paper_id", "q_id", "page").distinct(), ["paper_id", "q_id", "page"], "left_anti")
    return _best_windows(pairs, MIN_QUOTE)


def _best_windows(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of a quote and a page (`_text`) with the page's best window, where that is alike enough."""
    hit = pairs.withColumn("_f", fuzzy_window("needle", "_text")).where(F.col("_f.score") >= least)
    return (hit.withColumn("s", F.col("_f.s")).withColumn("e", F.col("_f.e")).withColumn("quote_score", F.col("_f.score"))
            .drop("_f", "_text"))


def allowed_changes(alike: Column, length: Column) -> Column:
    """Characters that a copy of a text may have lost and gained together to be at least `alike`: of two texts with 2 LCS / (a + b)
    >= t, no longer than `length` each, a + b - 2 LCS are at most 2 (1 - t) length."""
    return F.floor(2 * (1 - alike) * length + 1e-9).cast("int")


def cut_pieces(df: DataFrame, text: str, pieces: Column, out: str = "piece") -> DataFrame:
    """`text` cut into so many pieces of about one length: `out`, with its place `_off`. A change breaks one piece, so of one more
    piece than changes one is whole."""
    edge = lambda i: F.floor(i * F.length(text) / F.col("_n")).cast("int")
    numbered = df.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return (numbered.withColumn("_off", edge(F.col("_i"))).withColumn(out, F.substring(text, F.col("_off") + 1, edge(F.col("_i") + 1) - F.col("_off")))
            .where(F.length(out) > 0).drop("_i", "_n"))


def piece_candidates(quotes: DataFrame, index: DataFrame, exact: DataFrame, least: float = MIN_QUOTE, within: Sequence[str] = ("paper_id",)) -> DataFrame:
    """Best window of every page that shares a piece with a quote, on pages without an exact hit. `quotes` carry `alike`: every page
    with a window at least so similar is among them.

    A window with such a piece lies no more changes away from the piece's diagonal than are allowed, so its common
    subsequence is in that stretch of the page. A page shorter than the quote is cut into pieces itself."""
    within = list(within)
    quote = [c for c in ("paper_id", "q_id") if c in quotes.columns]
    place = list(dict.fromkeys([*quote, "paper_id", "page"]))
    sized = quotes.withColumn("_e", allowed_changes(F.col("alike"), F.length("needle")))
    cut = cut_pieces(sized.select(*quote, "needle", "alike", "_e"), "needle", F.col("_e") + 1)
    shared = substring_join(cut, index, "piece", "stripped", ["paper_id", "page"], within)
    near = shared.join(index.select("paper_id", "page", F.col("stripped").alias("_text")), ["paper_id", "page"])
    first = F.col("at") - F.col("_off") - F.col("_e")
    around = F.substring("_text", (F.greatest(first, F.lit(0)) + 1).cast("int"), (F.length("needle") + 2 * F.col("_e") + F.least(first, F.lit(0))).cast("int"))
    bound = F.col("alike") * F.length("needle") / (2 - F.col("alike"))  # a window cut by the page's edge is the least that can do
    long = near.where(F.length("_text") >= F.length("needle")).withColumn("_around", around).where(lcs("needle", "_around") >= bound - 1e-9)
    floors = (F.min("alike").alias("_least"), F.max(F.length("needle")).alias("_longest"))  # a page does not know which quote it will meet
    held = index.select("paper_id", "page", F.col("stripped").alias("_page")).where("_page <> ''")
    if within:
        small = held.join(quotes.groupBy(*within).agg(*floors), within)
    else:
        small = held.withColumns({name: quotes.agg(floor).scalar() for name, floor in zip(("_least", "_longest"), floors, strict=True)})
    small = small.where(F.length("_page") < F.col("_longest"))
    parts = cut_pieces(small.select("paper_id", "page", "_page", "_least"), "_page", F.least(allowed_changes(F.col("_least"), F.length("_page")) + 1, F.length("_page")), "_part")
    back = substring_join(parts.select("paper_id", "page", F.col("_page"), "_part").distinct(), quotes.select(*quote, "needle"), "_part", "needle", quote if within else ["q_id"], within, places=False).distinct()
    back = back.join(quotes.select(*quote, "needle"), quote if within else ["q_id"]).where(F.length("_page") < F.length("needle"))
    found = long.select(*place).unionByName(back.select(*place)).distinct()
    if exact is not None:
        found = found.join(exact.select(*place).distinct(), place, "left_anti")
    pairs = found.join(quotes.drop("alike"), quote).join(index.select("paper_id", "page", F.col("stripped").alias("_text")), ["paper_id", "page"])
    return _best_windows(pairs, least)


def similar(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(indel_similarity(a, b))


def weighted(quote: Column, prefix: Column, suffix: Column, position: Column) -> Column:
    return (W_QUOTE * quote + W_PREFIX * prefix + W_SUFFIX * suffix + W_POSITION * position) / TOTAL


def score_candidates(candidates: DataFrame, index: DataFrame, offsets: Callable[[str], Column] = X.kept_offsets) -> DataFrame:
    """Adds start, end (page offsets), global_start and score. Offsets are laid out once for each page with a hit."""
    held = laid_out(index.select("paper_id", "page", "text", "stripped", "page_start", "total_len"), candidates, offsets)
    near = candidates.join(held, ["paper_id", "page"])
    pre_len, s = F.length("pre"), F.col("s")
    before = F.when(F.col("pre") == "", F.lit("")).otherwise(F.substring("stripped", F.greatest(s - pre_len, F.lit(0)) + 1, F.least(s, pre_len)))
    after = F.when(F.col("suf") == "", F.lit("")).otherwise(F.substring("stripped", F.col("e") + 1, F.length("suf")))
    cut = (near.withColumn("start", F.get("_off", s)).withColumn("end", F.get("_off", F.col("e") - 1) + 1)
           .withColumn("_before", before).withColumn("_after", after).withColumn("global_start", F.col("page_start") + F.col("start"))
           .drop("_off", "stripped"))
    position = 1.0 - F.least(F.lit(1.0), F.abs(F.col("global_start") - F.col("position")) / F.col("total_len"))
    score = weighted(F.col("quote_score"), similar(F.col("pre"), F.col("_before")), similar(F.col("suf"), F.col("_after")), position)
    return cut.withColumn("score", score).drop("_before", "_after", "page_start", "total_len")


def best_place(scored: DataFrame, keys: Sequence[str] = ("paper_id", "q_id")) -> DataFrame:
    """Highest score of at least 0.5; ties to the page nearest the hint, then the lower page, then the earlier start."""
    keys = list(keys)
    rest = [c for c in scored.columns if c not in keys]
    rank = F.struct("score", -F.abs(F.col("page") - F.col("page_hint")), -F.col("page"), -F.col("start"))
    return (scored.where(F.col("score") >= MIN_SCORE).groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("b")).select(*keys, "b.*"))


def needed_similarity(score: Column) -> Column:
    """How alike a quote's place must be at least to reach `score`, everything else being equal in it."""
    return F.greatest(F.lit(MIN_QUOTE), (TOTAL * score - (W_PREFIX + W_SUFFIX + W_POSITION)) / W_QUOTE - 1e-9)


def _best_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("paper_id", "q_id").agg(F.max("score").alias("_best"))


def candidates(quotes: DataFrame, index: DataFrame, settle: bool = True, min_chars: int = FUZZY_MIN_CHARS) -> DataFrame:
    """Scored exact places, and every fuzzy one that could be a quote's best place: the best of these rows is the best of all pages.

    A place may score up to 1, so an exact one that scores 1 is final, as is one that a single changed character could not reach. The others say how alike a better place must be; where
    none is known the pieces are made as short as is useful, and what they find must then be alike enough to prove that
    nothing else can be better. Without `settle` all pages of the paper are scored."""
    stripped = stripped_quotes(quotes)
    exact = materialise(score_candidates(exact_candidates(stripped, index), index))
    if not settle:
        return exact.unionByName(score_candidates(fuzzy_candidates(stripped, index, exact, min_chars), index))
    size = F.length("needle")
    longest = F.greatest(F.floor(size / PIECE_CHARS), F.lit(1)) - 1  # changes that pieces of useful length can stand
    known = stripped.where(size >= min_chars).join(_best_score(exact), ["paper_id", "q_id"], "left").where("_best IS NULL OR _best < 1")
    asked = known.withColumn("alike", F.least(F.greatest(needed_similarity(F.coalesce("_best", F.lit(0.0))), 1 - longest / (2 * size)), F.lit(1.0)))
    changeable = allowed_changes(F.col("alike"), size) > 0  # what may not change is nowhere but in the exact places
    asked = materialise(asked.where(changeable | F.col("_best").isNull()).drop("_best"))
    near = materialise(score_candidates(piece_candidates(asked.where(changeable), index, exact), index))
    best = _best_score(exact.select("paper_id", "q_id", "score").unionByName(near.select("paper_id", "q_id", "score")))
    proven = asked.join(best, ["paper_id", "q_id"]).where(needed_similarity(F.col("_best")) >= F.col("alike") - 2e-9)
    rest = asked.drop("alike").join(proven.select("paper_id", "q_id"), ["paper_id", "q_id"], "left_anti")
    tried = exact.select("paper_id", "q_id", "page").unionByName(near.select("paper_id", "q_id", "page"))
    far = score_candidates(fuzzy_candidates(rest, index, tried, min_chars), index)
    return exact.unionByName(near).unionByName(far)


def find_everywhere(quotes: DataFrame, index: DataFrame, min_quote: float = 0.97, min_chars: int = FUZZY_MIN_CHARS) -> DataFrame:
    """The best place of each quote in each paper that has it, exactly or as a copy of at least `min_quote` similarity. `quotes` have no
    paper of their own. Complete for that similarity: no quote meets a page without a shared piece."""
    stripped = stripped_quotes(quotes)
    exact = score_candidates(exact_candidates(stripped, index, within=[]), index)
    if min_quote >= 1:  # nothing but the quote itself is so much alike
        return best_place(exact, ["q_id", "paper_id"])
    exact = materialise(exact)
    asked = stripped.where(F.length("needle") >= min_chars).withColumn("alike", F.lit(min_quote))
    near = score_candidates(piece_candidates(asked, index, exact, min_quote, within=[]), index)
    return best_place(exact.unionByName(near), ["q_id", "paper_id"])


def find_quote(quotes: DataFrame, index: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """The best place of each quote in its paper; `accepted` (paper_id, q_id, page, start) limits which places may win."""
    scored = candidates(quotes, index, settle=accepted is None)
    if accepted is not None:
        scored = scored.join(accepted, ["paper_id", "q_id", "page", "start"], "left_semi")
    return best_place(scored)


def page_windows(pages: DataFrame, n: int) -> DataFrame:
    """Every run of n consecutive pages as one text, keyed by its first page; offsets run on."""
    spread = pages.select("paper_id", "page", "text").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "first", F.col("page") - F.col("_k"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "")
    return (spread.groupBy("paper_id", "first").agg(F.count("*").alias("_n"), joined.alias("text")).where(F.col("_n") == n)
            .select("paper_id", F.col("first").alias("page"), "text"))


def window_index(pages: DataFrame, n: int) -> DataFrame:
    """`page_index` over windows of n pages: starts and the paper's length are those of the single pages."""
    return page_windows(pages, n).withColumn("stripped", X.strip_ws("text")).join(page_places(pages), ["paper_id", "page"])


def page_spans(matches: DataFrame, pages: DataFrame, keys: Sequence[str], span: int = 2) -> DataFrame:
    """A match whose offsets run on across page breaks, cut into one row per page."""
    start = running(pages.select("paper_id", "page", F.length("text").alias("len")), ["paper_id"], "page", F.col("len"), "at", inclusive=False)
    base = start.select("paper_id", F.col("page").alias("first"), F.col("at").alias("first_at"))
    over = (matches.withColumnRenamed("page", "first").join(base, ["paper_id", "first"])
            .withColumn("page", F.explode(F.sequence(F.col("first"), F.col("first") + span - 1))).join(start, ["paper_id", "page"]))
    lo = F.greatest(F.col("first_at") + F.col("start") - F.col("at"), F.lit(0))
    hi = F.least(F.col("first_at") + F.col("end") - F.col("at"), F.col("len"))
    return over.withColumn("p_start", lo.cast("int")).withColumn("p_end", hi.cast("int")).where("p_start < p_end").select(
        "paper_id", *keys, "page", F.col("p_start").alias("start"), F.col("p_end").alias("end"))


def longest_head(needle: Column, text: Column) -> Column:
    """Length of the longest start of `needle` occurring in `text`: a shorter start always occurs too, so the bits of the
    answer are settled from the highest down."""
    top = F.floor(F.log2(F.greatest(F.length(needle), F.lit(1)) + F.lit(1e-9))).cast("int")
    bits = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    return F.aggregate(bits, F.lit(0), lambda k, b: F.when(
        (k + b <= F.length(needle)) & F.contains(text, F.substring(needle, F.lit(1), k + b)), k + b).otherwise(k))


def split_match(quotes: DataFrame, index: DataFrame, span: int = 2) -> DataFrame:
    """Quotes over `span` pages as exact pieces, one per page: every page but the last takes the longest start of what is
    left, the last must hold the rest. Returns the best run of pages: one row per piece with page, start, end, score.

    Some piece is at least 1/span of the quote, so it holds one of the quote's 2·span aligned blocks: the substring join
    on those blocks keeps only runs of pages that can match."""
    q = stripped_quotes(quotes).where(F.length("needle") >= span)
    size = F.greatest(F.ceil(F.length("needle") / (2 * span)), F.lit(1)).cast("int")
    parts = q.select("paper_id", "q_id", size.alias("_g"), "needle").select(
        "paper_id", "q_id", F.explode(F.expr("regexp_extract_all(needle, concat('(?s).{', _g, '}'), 0)")).alias("part")).distinct()
    near = substring_join(parts, index, "part", "stripped", ["paper_id", "page"], places=False).select("paper_id", "q_id", "page").distinct()
    firsts = near.withColumn("first", F.explode(F.sequence(F.col("page") - (span - 1), F.col("page")))).select("paper_id", "q_id", "first").distinct()
    texts = index.select("paper_id", "page", "stripped")
    runs = firsts.join(q.select("paper_id", "q_id", "needle", "pre", "suf", "position", "page_hint"), ["paper_id", "q_id"])
    cut = runs.withColumn("_rest", F.col("needle")).withColumn("_ok", F.lit(True))
    pieces = []
    for i in range(span):
        held = texts.select("paper_id", (F.col("page") - i).alias("first"), F.col("stripped").alias("_t"))
        last = i == span - 1
        cut = cut.join(held, ["paper_id", "first"])
        size_i = F.length("_rest") if last else longest_head(F.col("_rest"), F.col("_t"))
        cut = cut.withColumn("_k", size_i)
        good = F.contains("_t", "_rest") if last else F.col("_k") < F.length("_rest")
        cut = (cut.where((F.col("_k") > 0) & good).withColumn(f"_p{i}", F.substring("_rest", F.lit(1), F.col("_k")))
               .withColumn("_rest", F.substring("_rest", F.col("_k") + 1, F.length("_rest"))).drop("_t", "_k"))
        pieces.append(F.struct(F.lit(i).alias("i"), F.col(f"_p{i}").alias("piece"), F.when(F.lit(i == 0), F.col("pre")).when(
            F.lit(last), F.col("suf")).otherwise(F.lit("")).alias("context")))
    want = cut.select("paper_id", "q_id", "first", "position", F.explode(F.array(*pieces)).alias("p")).select(
        "paper_id", "q_id", "first", "position", "p.*").withColumn("page", F.col("first") + F.col("i"))
    at = substring_join(want, index, "piece", "stripped", ["paper_id", "page"], ["paper_id", "page"])
    held = laid_out(index.select("paper_id", "page", "text", "page_start", "total_len"), want).withColumnRenamed("stripped", "_t")
    near = at.withColumn("at", F.col("at").cast("int")).join(held, ["paper_id", "page"])
    c = F.length("context")
    side = F.when(F.col("i") == 0, F.substring("_t", F.greatest(F.col("at") - c, F.lit(0)) + 1, F.least(F.col("at"), c))).otherwise(
        F.substring("_t", F.col("at") + F.length("piece") + 1, c))
    like = near.withColumn("_side", side).withColumn("like", F.when(F.col("context") == "", F.lit(1.0)).otherwise(similar(F.col("context"), F.col("_side"))))
    placed = like.withColumn("start", F.get("_off", F.col("at"))).withColumn("end", F.get("_off", F.col("at") + F.length("piece") - 1) + 1)
    chosen = placed.groupBy("paper_id", "q_id", "first", "i").agg(
        F.max_by(F.struct("page", "start", "end", "like", "position", "page_start", "total_len"), F.struct("like", -F.col("at"))).alias("b"))
    whole = chosen.groupBy("paper_id", "q_id", "first").agg(
        F.array_sort(F.collect_list(F.struct("i", "b"))).alias("ps"), F.count("*").alias("n")).where(F.col("n") == span)
    head, tail = F.col("ps")[0]["b"], F.element_at("ps", -1)["b"]
    position = 1.0 - F.least(F.lit(1.0), F.abs(head["page_start"] + head["start"] - head["position"]) / head["total_len"])
    scored = whole.withColumn("score", weighted(F.lit(1.0), head["like"], tail["like"], position)).where(F.col("score") >= MIN_SCORE)
    best = scored.groupBy("paper_id", "q_id").agg(F.max_by(F.struct("score", "ps"), F.struct("score", -F.col("first"))).alias("b"))
    return best.select("paper_id", "q_id", F.col("b.score").alias("score"), F.explode("b.ps").alias("p")).select(
        "paper_id", "q_id", "p.b.page", "p.b.start", "p.b.end", "score")


def global_position(rows: DataFrame, pages: DataFrame, offset: str = "start", out: str = "position") -> DataFrame:
    """Offset in the concatenation of all pages."""
    starts = running(pages.select("paper_id", "page", F.length("text").alias("_l")), ["paper_id"], "page", F.col("_l"), "_at", inclusive=False)
    return rows.join(starts.select("paper_id", "page", "_at"), ["paper_id", "page"]).withColumn(out, F.col("_at") + F.col(offset)).drop("_at")


# -- printed lines ---------------------------------------------------------------


def aligned_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words with the stretch [ws, we) of their page's stripped text they hold; pages whose words do not add up to their
    text are left out."""
    w = Window.partitionBy("paper_id", "page").orderBy("word_ord")
    sized = words.withColumn("_l", F.length(X.strip_ws("text")))
    ends = sized.withColumn("we", F.sum("_l").over(w)).withColumn("ws", F.col("we") - F.col("_l")).drop("_l")
    said = sized.groupBy("paper_id", "page").agg(F.sum("_l").alias("_said"))
    full = pages.select("paper_id", "page", F.length(X.strip_ws("text")).alias("_full")).join(said, ["paper_id", "page"]).where("_said = _full")
    return ends.join(full.select("paper_id", "page"), ["paper_id", "page"], "left_semi")


def _matched_on_page(spans: DataFrame, words: Lines, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`matched_words` for words that are still lines: a page's lines follow one another by their numbers of characters, and meet the page's
    spans as one list. Only lines that a span touches are laid out, each of them once."""
    size = lambda text: F.length(X.strip_ws(text))
    if "ms" not in spans.columns:
        spans = spans.join(pages.select("paper_id", "page", "text"), ["paper_id", "page"]).withColumn("ms", size(F.substring("text", F.lit(1), F.col("start")))).withColumn(
            "me", size(F.substring("text", F.lit(1), F.col("end"))))
    asked = spans.where("ms < me").groupBy("paper_id", "page").agg(F.collect_list(F.struct(*keys, "ms", "me")).alias("_spans"))
    near = asked.select("paper_id", "page")
    page = Window.partitionBy("paper_id", "page")
    lines = (words.rows.join(near, ["paper_id", "page"], "left_semi").withColumn("_size", words.chars())
             .withColumn("_we", F.sum("_size").over(page.orderBy("line_first").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_said", F.sum("_size").over(page)))
    full = pages.select("paper_id", "page", "text").join(near, ["paper_id", "page"], "left_semi").select("paper_id", "page", size("text").cast("long").alias("_said"))
    touches = lambda ws, we: lambda x: (x["ms"] < we) & (ws < x["me"]) & (ws < we)
    met = (lines.join(full, ["paper_id", "page", "_said"], "left_semi").join(asked, ["paper_id", "page"]).withColumn("_ws", F.col("_we") - F.col("_size"))
           .withColumn("_mine", F.filter("_spans", touches(F.col("_ws"), F.col("_we")))).where(F.size("_mine") > 0).drop("_spans"))

    def taken(ws: Column) -> Column:
        """The words that share a character with a span, each with the place where it starts."""
        sized = F.transform(ws, lambda w: F.struct(w.alias("word"), size(w["text"]).alias("n")))

        def step(a: Column, it: Column) -> Column:
            mine = F.exists("_mine", touches(a["at"], a["at"] + it["n"]))
            return F.struct((a["at"] + it["n"]).alias("at"), F.when(mine, F.array_append(a["out"], F.struct(a["at"].alias("at"), it.alias("it")))).otherwise(a["out"]).alias("out"))

        none = F.transform(F.filter(sized, lambda _: F.lit(False)), lambda it: F.struct(F.col("_ws").alias("at"), it.alias("it")))
        return F.aggregate(sized, F.struct(F.col("_ws").alias("at"), none.alias("out")), step, lambda a: a["out"])

    said = met.select("paper_id", "page", "block", "line", "_mine", F.explode(let(words.laid(F.col), taken)).alias("_w"))
    found = F.filter("_mine", touches(F.col("_w.at"), F.col("_w.at") + F.col("_w.it.n")))
    return said.select("paper_id", "page", "block", "line", F.explode(found).alias("_s"), "_w").select(
        "paper_id", "page", *[f"_s.{k}" for k in keys], *[f"_w.it.word.{c}" for c in ("word_ord", *CORNERS, "text")], "block", "line")


def matched_words(spans: DataFrame, words: DataFrame | Lines, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole words the characters [start, end) of a page belong to. Positions are bucketed, so a page's matches and words
    only meet where they can overlap. `spans` may say instead which characters of the stripped text those are: [ms, me)."""
    keys = list(keys)
    if isinstance(words, Lines):
        return _matched_on_page(spans, words, pages, keys)
    strip = lambda to: F.length(X.strip_ws(F.substring("text", F.lit(1), to)))
    if "ms" not in spans.columns:
        spans = spans.join(pages.select("paper_id", "page", "text"), ["paper_id", "page"]).withColumn("ms", strip(F.col("start"))).withColumn("me", strip(F.col("end")))
    s = (spans.select("paper_id", "page", *keys, "ms", "me").where("ms < me")
         .withColumn("_b", F.explode(F.sequence(F.floor(F.col("ms") / POSITION_BUCKET), F.floor((F.col("me") - 1) / POSITION_BUCKET)))))
    w = aligned_words(words, pages).where("ws < we").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("ws") / POSITION_BUCKET), F.floor((F.col("we") - 1) / POSITION_BUCKET))))
    return (w.join(s, ["paper_id", "page", "_b"])
            .where((F.col("ws") < F.col("me")) & (F.col("ms") < F.col("we")) & (F.col("_b") == F.floor(F.greatest("ws", "ms") / POSITION_BUCKET)))
            .drop("_b", "ms", "me", "ws", "we"))


def matched_lines(spans: DataFrame, words: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Printed-line boxes of matched characters, one row per line."""
    return printed_lines(matched_words(spans, words, pages, keys), keys)


def ends_of(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    box = F.struct("page", *CORNERS)
    order = F.struct("page", "line_first")
    return lines.groupBy("paper_id", *keys).agg(F.min_by(box, order).alias("head"), F.max_by(box, order).alias("tail"))


def both_ends_inside(lines: DataFrame, rects: DataFrame, keys: Sequence[str], rect_keys: Sequence[str]) -> DataFrame:
    """Keys whose first and last line both have their midpoint in one of the rects carrying the same `rect_keys`."""
    keys, rect_keys = list(keys), list(rect_keys)
    ends = ends_of(lines, keys)
    pts = ends.select("paper_id", *keys, F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("head").alias("b")), F.struct(F.lit(1).alias("w"), F.col("tail").alias("b")))).alias("x")).select(
        "paper_id", *keys, F.col("x.w").alias("w"), F.col("x.b.page").alias("page"), ((F.col("x.b.x0") + F.col("x.b.x1")) / 2).alias("px"), ((F.col("x.b.y0") + F.col("x.b.y1")) / 2).alias("py"))
    held = rects.select("paper_id", "page", *rect_keys, *[F.col(c).alias(f"h_{c}") for c in CORNERS])
    hit = points_in_rects(pts, held, "px", "py", "h_", keys=["paper_id", "page", *rect_keys])
    return hit.groupBy("paper_id", *keys).agg(F.count_distinct("w").alias("n")).where("n = 2").drop("n")


def over_pages(quotes: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """Where quotes over n pages lie, one row per page: in the pages' joined text, or as exact pieces if those score as high."""
    pages = index.select("paper_id", "page", "text")
    joined = find_quote(quotes, window_index(pages, n)).select("paper_id", "q_id", "page", "start", "end", "score")
    cut = materialise(split_match(quotes, index, n))
    best_cut = cut.groupBy("paper_id", "q_id").agg(F.max("score").alias("cut_score"))
    split_wins = joined.join(best_cut, ["paper_id", "q_id"], "full").where(F.col("cut_score") >= F.coalesce("score", F.lit(-1.0))).select("paper_id", "q_id")
    from_joined = page_spans(joined.join(split_wins, ["paper_id", "q_id"], "left_anti"), pages, ["q_id"], n)
    return from_joined.unionByName(cut.join(split_wins, ["paper_id", "q_id"], "left_semi").select("paper_id", "q_id", "page", "start", "end"))


# -- resolving marks and pieces -------------------------------------------------


def resolve_highlights(quotes: DataFrame, rects: DataFrame, pages: DataFrame, words: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, lines): anchored when the quote's first and last lines still lie in the stored rects (or cannot be rebuilt
    on the same page), relocated with new line boxes when they moved, orphaned when the quote is gone.

    `quotes` also carry `span`, the pages the mark runs over; `rects`: paper_id, q_id, page, box. `index` is the `page_index` of the pages, where
    it is known."""
    index = page_index(pages) if index is None else index
    quotes, pages = materialise(quotes), index.select("paper_id", "page", "text")
    spans = find_quote(quotes.where("span = 1"), index).select("paper_id", "q_id", "page", "start", "end")
    for n in sorted(r.span for r in quotes.where("span > 1").select("span").distinct().collect()):
        spans = spans.unionByName(over_pages(quotes.where(F.col("span") == n), index, n))
    spans = materialise(spans)
    first = spans.groupBy("paper_id", "q_id").agg(F.min_by(F.struct("page", "start"), "page").alias("f")).select("paper_id", "q_id", "f.page", "f.start")
    where = global_position(first, pages).select("paper_id", "q_id", F.col("page").alias("found_page"), F.col("position").alias("found_at"))
    lines = materialise(matched_lines(spans, words, pages, ["q_id"]))
    have = lines.select("paper_id", "q_id").distinct().withColumn("has_lines", F.lit(True))
    held = both_ends_inside(lines, rects, ["q_id"], ["q_id"]).withColumn("held", F.lit(True))
    state = (F.when(F.col("found_page").isNull(), "orphaned").when(F.col("held"), "anchored")
             .when(F.col("has_lines"), "relocated").when(F.col("found_page") == F.col("page_hint"), "anchored").otherwise("orphaned"))
    states = (quotes.select("paper_id", "q_id", "page_hint", F.col("position").alias("old_position")).join(where, ["paper_id", "q_id"], "left")
              .join(have, ["paper_id", "q_id"], "left").join(held, ["paper_id", "q_id"], "left").withColumn("state", state)
              .withColumn("position", F.when(F.col("state") == "orphaned", F.col("old_position")).otherwise(F.col("found_at")))
              .select("paper_id", "q_id", "state", "position", F.when(F.col("state") == "orphaned", F.col("page_hint")).otherwise(F.col("found_page")).alias("page")))
    moved = lines.join(states.where("state = 'relocated'"), ["paper_id", "q_id"], "left_semi")
    return states, moved


def resolve_chunks(ends: DataFrame, rects: DataFrame, pages: DataFrame, words: DataFrame, regions: DataFrame, layout: DataFrame,
                   index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, rects): both ends of a chunk are found on their own; an empty quote is no evidence. A chunk that moved is
    rebuilt from the regions between its ends.

    `ends`: paper_id, node_id, which (start/end), exact, prefix, suffix, position. `rects`: paper_id, node_id, rect_ord, page,
    box. `layout`: page sizes. `index` is the `page_index` of the pages, where it is known."""
    index = page_index(pages) if index is None else index
    box = F.struct("page", *CORNERS)
    stored = rects.groupBy("paper_id", "node_id").agg(F.min_by(box, "rect_ord").alias("a"), F.max_by(box, "rect_ord").alias("z"))
    e = ends.join(stored, ["paper_id", "node_id"]).withColumn("fallback", F.when(F.col("which") == "start", F.col("a")).otherwise(F.col("z"))).withColumn(
        "page_hint", F.col("fallback.page")).withColumn("q_id", F.concat_ws("|", "node_id", "which"))
    e, pages = materialise(e), index.select("paper_id", "page", "text")
    quoted = e.where(X.strip_ws("exact") != "")
    found = find_quote(quoted.select("paper_id", "q_id", "exact", "prefix", "suffix", "position", "page_hint"), index).select(
        "paper_id", "q_id", "page", "start", "end", "global_start")
    found = materialise(found)
    lines = matched_lines(found, words, pages, ["q_id"])
    hull = lines.groupBy("paper_id", "q_id").agg(F.struct(F.min("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
                                                          F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("hull"))
    at = (e.join(found.select("paper_id", "q_id", F.col("global_start")), ["paper_id", "q_id"], "left").join(hull, ["paper_id", "q_id"], "left")
          .withColumn("loc", F.coalesce("hull", "fallback")).withColumn("is_quoted", X.strip_ws("exact") != ""))
    pts = at.where("global_start IS NOT NULL").select("paper_id", "node_id", "which", F.col("loc.page").alias("page"),
                                                      ((F.col("loc.x0") + F.col("loc.x1")) / 2).alias("px"), ((F.col("loc.y0") + F.col("loc.y1")) / 2).alias("py"))
    held_rects = rects.select("paper_id", "node_id", "page", *[F.col(c).alias(f"h_{c}") for c in CORNERS])
    inside = points_in_rects(pts, held_rects, "px", "py", "h_", keys=["paper_id", "page", "node_id"]).select("paper_id", "node_id", "which").distinct().withColumn("in", F.lit(True))
    judged = at.join(inside, ["paper_id", "node_id", "which"], "left").withColumn(
        "holds", F.when(F.col("global_start").isNotNull(), F.coalesce("in", F.lit(False))).otherwise(~F.col("is_quoted")))
    one = judged.groupBy("paper_id", "node_id").agg(
        F.bool_or("is_quoted").alias("any_quote"), F.bool_or(F.col("global_start").isNotNull()).alias("any_found"), F.bool_and("holds").alias("all_hold"),
        F.max(F.when(F.col("which") == "start", F.col("global_start"))).alias("start_at"), F.max("position").alias("old_position"),
        F.max_by("loc", F.col("which") == "start").alias("from"), F.max_by("loc", F.col("which") == "end").alias("to"))
    state = (F.when(~F.col("any_quote"), "anchored").when(~F.col("any_found"), "orphaned").when(F.col("all_hold"), "anchored").otherwise("relocated"))
    states = materialise(one.withColumn("state", state))
    moved = states.where("state = 'relocated'")
    body = regions.where(~F.col("label").isin(*X.FURNITURE))
    ends_at = moved.select("paper_id", "node_id", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("from").alias("b")), F.struct(F.lit(1).alias("w"), F.col("to").alias("b")))).alias("x")).select(
        "paper_id", "node_id", "x.w", F.col("x.b.page").alias("page"), ((F.col("x.b.x0") + F.col("x.b.x1")) / 2).alias("px"), ((F.col("x.b.y0") + F.col("x.b.y1")) / 2).alias("py"))
    g = body.select("paper_id", "page", "ord", *[F.col(c).alias(f"g_{c}") for c in CORNERS])
    holding = points_in_rects(ends_at, g, "px", "py", "g_").groupBy("paper_id", "node_id").pivot("w", [0, 1]).agg(F.min("ord"))
    spans = holding.where("`0` IS NOT NULL AND `1` IS NOT NULL AND `1` >= `0`").select("paper_id", "node_id", F.col("0").alias("lo"), F.col("1").alias("hi"))
    chosen = (spans.withColumn("ord", F.explode(F.sequence("lo", "hi"))).join(body.select("paper_id", "ord", "page", *CORNERS), ["paper_id", "ord"])
              .select("paper_id", "node_id", F.col("ord").cast("long").alias("ord"), "page", *CORNERS))
    alone = moved.join(spans, ["paper_id", "node_id"], "left_anti").select("paper_id", "node_id", F.explode(F.array_distinct(F.array("from", "to"))).alias("b"), F.col("from").alias("f")).select(
        "paper_id", "node_id", F.when(F.col("b") == F.col("f"), 0).otherwise(1).cast("long").alias("ord"), "b.page", *[F.col(f"b.{c}").alias(c) for c in CORNERS])
    rebuilt = column_runs(chosen.unionByName(alone), layout, ["paper_id", "node_id"])
    out = states.select("paper_id", "node_id", "state", F.when(F.col("state") == "orphaned", F.col("old_position")).otherwise(F.coalesce("start_at", "old_position")).alias("position"))
    return out, rebuilt


def page_fingerprints(page_text: DataFrame, regions: DataFrame) -> DataFrame:
    """(paper_id, page, words, boxes): hashes of each page's text and of its regions."""
    boxes = regions.groupBy("paper_id", "page").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "ord", F.concat_ws(",", *[F.col(c).cast("double").cast("string") for c in CORNERS], "label").alias("b")))), lambda s: s["b"]), ";"), 256).alias("boxes"))
    texts = page_text.select("paper_id", "page", F.sha2(F.col("text").cast("binary"), 256).alias("words"))
    return texts.join(boxes, ["paper_id", "page"], "full")


def anchor_basis(page_text: DataFrame, regions: DataFrame) -> DataFrame:
    """Fingerprint of a paper's text and regions. Pages are hashed first, so a paper's row gathers hashes, not text."""
    both = page_fingerprints(page_text, regions)
    line = F.concat_ws(":", F.col("page").cast("string"), F.coalesce("words", F.lit("")), F.coalesce("boxes", F.lit("")))
    return both.groupBy("paper_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("l")))), lambda s: s["l"]), "\n"), 256).alias("basis"))


def item_basis(items: DataFrame, page_text: DataFrame, regions: DataFrame) -> DataFrame:
    """(paper_id, kind, id, basis): fingerprint of the pages that a mark or chunk runs over, from its first to its last, with the place
    of each in the paper's text. `items`: a row for each of an item's rects, with paper_id, kind, id, page."""
    starts = running(page_text.select("paper_id", "page", F.length("text").alias("_l")), ["paper_id"], "page", F.col("_l"), "_at", inclusive=False)
    marks = page_fingerprints(page_text, regions).join(starts.select("paper_id", "page", "_at"), ["paper_id", "page"], "left")
    line = F.concat_ws(":", F.col("page").cast("string"), F.coalesce("words", F.lit("")), F.coalesce("boxes", F.lit("")), F.coalesce(F.col("_at").cast("string"), F.lit("")))
    over = items.groupBy("paper_id", "kind", "id").agg(F.min("page").alias("a"), F.max("page").alias("z")).withColumn("page", F.explode(F.sequence("a", "z")))
    held = over.join(marks.select("paper_id", "page", line.alias("l")), ["paper_id", "page"], "left")
    return held.groupBy("paper_id", "kind", "id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "page", F.coalesce("l", F.lit("none")).alias("l")))), lambda s: s["l"]), "\n"), 256).alias("basis"))


class Reanchored(NamedTuple):
    """Where the marks and chunks of a library stand in its present text."""

    #: paper_id, kind, id, state, position, looked_for
    states: DataFrame
    #: paper_id, kind, id, rect_ord, page, box
    rects: DataFrame
    #: What `pieces.chunk_blocks` gives, with node_id, of the chunks whose rects changed.
    blocks: DataFrame


def reanchor(stored: DataFrame, quotes: DataFrame, mark_rects: DataFrame, ends: DataFrame, chunk_rects: DataFrame, pages: DataFrame, regions: DataFrame,
             words: DataFrame, layout: DataFrame) -> Reanchored:
    """Marks and chunks found again in a new extraction, item by item.

    An item is looked for when the pages under it, or their place in the paper, are no longer what they were, or when it had no place
    and anything in its paper changed; every other one keeps its anchor. A chunk gets new blocks only when its rects did change.

    `stored`: paper_id, kind (highlight or chunk), id, basis (`item_basis` at the time), paper_basis (`anchor_basis` at the time), state,
    position. `quotes` and `mark_rects` as for `resolve_highlights`, `ends` and `chunk_rects` as for `resolve_chunks`."""
    from foliograph.operators.pieces import chunk_blocks

    marks = mark_rects.select("paper_id", F.lit("highlight").alias("kind"), F.col("q_id").alias("id"), F.lit(0).cast("long").alias("rect_ord"), "page", *CORNERS)
    chunks = chunk_rects.select("paper_id", F.lit("chunk").alias("kind"), F.col("node_id").alias("id"), F.col("rect_ord").cast("long").alias("rect_ord"), "page", *CORNERS)
    held = marks.unionByName(chunks)
    now = item_basis(held.select("paper_id", "kind", "id", "page"), pages, regions).withColumnRenamed("basis", "_now")
    papers = anchor_basis(pages, regions).select("paper_id", F.col("basis").alias("_paper"))
    lost = (F.col("state") == "orphaned") & ~F.col("paper_basis").eqNullSafe(F.col("_paper"))
    judged = stored.join(now, ["paper_id", "kind", "id"], "left").join(papers, "paper_id", "left")
    judged = materialise(judged.withColumn("looked_for", ~F.col("basis").eqNullSafe(F.col("_now")) | lost).select("paper_id", "kind", "id", "state", "position", "looked_for"))
    asked = judged.where("looked_for")
    near = asked.select("paper_id").distinct()

    def of(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.join(asked.where(F.col("kind") == kind).select("paper_id", F.col("id").alias(key)), ["paper_id", key], "left_semi")

    def there(df: DataFrame) -> DataFrame:
        return df.join(near, "paper_id", "left_semi")

    index, seen = page_index(there(pages)), of_rows(words, there)
    text = index.select("paper_id", "page", "text")
    mark_states, mark_lines = resolve_highlights(of(quotes, "highlight", "q_id"), of(mark_rects, "highlight", "q_id"), text, seen, index)
    chunk_states, rebuilt = resolve_chunks(of(ends, "chunk", "node_id"), of(chunk_rects, "chunk", "node_id"), text, seen, there(regions), there(layout), index)
    found = mark_states.select("paper_id", F.lit("highlight").alias("kind"), F.col("q_id").alias("id"), "state", F.col("position").cast("long").alias("position")).unionByName(
        chunk_states.select("paper_id", F.lit("chunk").alias("kind"), F.col("node_id").alias("id"), "state", F.col("position").cast("long").alias("position")))
    kept = judged.where("NOT looked_for").select("paper_id", "kind", "id", "state", F.col("position").cast("long").alias("position"), "looked_for")
    states = found.withColumn("looked_for", F.lit(True)).unionByName(kept)
    moved = mark_lines.select("paper_id", F.lit("highlight").alias("kind"), F.col("q_id").alias("id"), F.col("line_first").cast("long").alias("rect_ord"), "page", *CORNERS).unionByName(
        rebuilt.select("paper_id", F.lit("chunk").alias("kind"), F.col("node_id").alias("id"), F.col("run_ord").cast("long").alias("rect_ord"), "page", *CORNERS))
    moved = materialise(moved)
    rects = held.join(moved.select("paper_id", "kind", "id").distinct(), ["paper_id", "kind", "id"], "left_anti").unionByName(moved)
    shape = lambda df: df.groupBy("paper_id", "id").agg(F.array_sort(F.collect_list(F.struct("rect_ord", F.struct("page", *CORNERS).alias("r")))).alias("s")).select(
        "paper_id", "id", F.transform("s", lambda x: x["r"]).alias("shape"))
    other = shape(moved.where("kind = 'chunk'")).join(shape(chunks).withColumnRenamed("shape", "was"), ["paper_id", "id"], "left").where("NOT shape <=> was").select("paper_id", "id")
    anew = moved.where("kind = 'chunk'").join(other, ["paper_id", "id"], "left_semi").select("paper_id", F.col("id").alias("node_id"), "rect_ord", "page", *CORNERS)
    blocks = chunk_blocks(anew, there(regions), seen, ["node_id"])
    return Reanchored(states, rects, blocks)


def anchor_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every anchor after, with whether its state or geometry differs from before. Both: paper_id, id, state, geometry."""
    old = before.select("paper_id", "id", F.struct("state", "geometry").alias("_old"))
    new = after.withColumn("_new", F.struct("state", "geometry"))
    return new.join(old, ["paper_id", "id"], "left").select("paper_id", "id", "state", (~F.col("_new").eqNullSafe(F.col("_old"))).alias("changed"))


# -- making quotes ----------------------------------------------------------------


def quote_under(asked: DataFrame, pages: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A quote with 32 characters either side, from the occurrence whose words lie under the rect, else the first; no
    context when the words are not on the page. `asked`: paper_id, page, keys, exact, q_x0..q_y1. Quotes that occur once need no words."""
    keys = list(keys)
    q = asked.withColumn("needle", X.strip_ws("exact"))
    texts = pages.withColumn("stripped", X.strip_ws("text"))
    at = substring_join(q.select("paper_id", "page", *keys, "needle", *[f"q_{c}" for c in CORNERS]), texts, "needle", "stripped", ["paper_id", "page"], ["paper_id", "page"])
    held = laid_out(pages.select("paper_id", "page", "text"), asked).drop("stripped")
    ends = at.withColumn("ms", F.col("at").cast("int")).withColumn("me", (F.col("at") + F.length("needle")).cast("int")).drop("at", "needle")
    placed = materialise(ends.join(held, ["paper_id", "page"]).withColumn("start", F.get("_off", F.col("ms"))).withColumn("end", F.get("_off", F.col("me") - 1) + 1).drop("_off")
                         .withColumn("_n", F.count("*").over(Window.partitionBy("paper_id", "page", *keys))))
    spans = placed.where("_n > 1").select("paper_id", "page", *keys, "ms", "me", F.col("start").alias("at_start"))
    hulls = matched_words(spans, words, pages, [*keys, "at_start"]).groupBy("paper_id", "page", *keys, "at_start").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    under = placed.join(hulls.withColumnRenamed("at_start", "start"), ["paper_id", "page", *keys, "start"], "left").withColumn(
        "under", F.coalesce(contains_point(rect("q_"), *midpoint(rect())), F.lit(False)))
    best = under.groupBy("paper_id", "page", *keys).agg(F.max_by(F.struct("start", "end"), F.struct("under", -F.col("start"))).alias("b"))
    cut = best.join(pages.select("paper_id", "page", "text"), ["paper_id", "page"]).select(
        "paper_id", "page", *keys, F.col("b.start").alias("start"),
        X.context_before(F.col("text"), F.col("b.start"), CONTEXT_CHARS).alias("prefix"), F.substring("text", F.col("b.end") + 1, F.lit(CONTEXT_CHARS)).alias("suffix"))
    return asked.join(cut, ["paper_id", "page", *keys], "left").select(
        "paper_id", "page", *keys, "exact", F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("suffix", F.lit("")).alias("suffix"),
        F.coalesce("start", F.lit(0)).alias("start"))
