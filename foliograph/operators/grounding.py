"""Claims checked against the text they cite: a claim stays only if its span exists and prints its quote.

`spans`: paper_id, span_id, page, ord, x0..y1, text. `claims`: paper_id, span_id, quote and the caller's keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import anchoring as A
from foliograph.operators.geomjoin import overlapping_rects
from foliograph.operators.pieces import boxed
from foliograph.operators.spread import materialise
from foliograph.operators.words import CORNERS, text_under

MIN_QUOTE_WORDS = 3
MAX_SLOT_SPANS = 3
GROUND = "struct<span:string,quote:string>"
PASS_SCHEMA = (f"terms array<struct<term:string,defined_in:array<{GROUND}>,explanation:string,grounds:array<{GROUND}>>>, "
               f"where_to_look array<struct<slot:string,spans:array<{GROUND}>>>, _corrupt_record string")
ASK_SCHEMA = f"answer string, grounds array<{GROUND}>, notes array<string>, _corrupt_record string"


def paper_spans(regions: DataFrame, words: DataFrame) -> DataFrame:
    """Non-furniture regions in reading order as spans "p{page}-r{n}" with their text; wordless ones go, ids stay."""
    w = Window.partitionBy("paper_id", "page").orderBy("ord")
    ids = regions.where(~F.col("label").isin(*X.FURNITURE)).withColumn(
        "span_id", F.concat(F.lit("p"), F.col("page") + 1, F.lit("-r"), F.row_number().over(w))).select("paper_id", "page", "ord", "span_id", *CORNERS)
    asked = boxed(ids, "q_", "paper_id", "page", "span_id")
    said = text_under(words, asked, ["span_id"]).withColumn("text", X.ends_trimmed("text")).where("text <> ''")
    return ids.join(said, ["paper_id", "span_id"])


def quotes_words(quote: Column, text: Column) -> Column:
    """At least three words sitting in the text at word boundaries; both already normalised."""
    literal = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return (F.size(F.split(quote, " ")) >= MIN_QUOTE_WORDS) & F.rlike(text, literal)


def ground(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """Claims that hold, with their span's page and box. Each text is normalised once; cited spans only."""
    cited = spans.join(claims.select("paper_id", "span_id").distinct(), ["paper_id", "span_id"], "left_semi")
    held = cited.select("paper_id", "span_id", "page", *CORNERS, X.grounding_form("text").alias("_t"))
    asked = claims.withColumn("_q", X.grounding_form("quote"))
    return asked.join(held, ["paper_id", "span_id"]).where(quotes_words(F.col("_q"), F.col("_t"))).drop("_q", "_t")


def split_objects(raw: Column) -> Column:
    """The top-level {...} parts of a text as an array, or null when anything but whitespace lies outside them or one is
    left open. A character fold: it knows strings and escapes."""
    chars = F.regexp_extract_all(raw, F.lit("(?s)."), F.lit(0))
    init = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("str"), F.lit(False).alias("esc"), F.lit(True).alias("ok"), F.lit(1).alias("from"),
                    F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        i = a["i"] + 1
        live = ~a["str"]
        opens, closes = live & (c == "{"), live & (c == "}")
        depth = a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        stray = (a["depth"] == 0) & ~opens & ~c.isin(*X.WS_CHARS)
        done = closes & (depth == 0)
        return F.struct(depth.alias("depth"),
                        F.when(a["str"], a["esc"] | (c != '"')).otherwise((a["depth"] > 0) & (c == '"')).alias("str"),
                        (a["str"] & ~a["esc"] & (c == "\\")).alias("esc"), (a["ok"] & ~stray & (depth >= 0)).alias("ok"),
                        F.when(opens & (a["depth"] == 0), i).otherwise(a["from"]).alias("from"),
                        F.when(done, F.array_append(a["out"], F.substring(raw, a["from"], i - a["from"] + 1))).otherwise(a["out"]).alias("out"), i.alias("i"))

    return F.aggregate(chars, init, step, lambda a: F.when(a["ok"] & (a["depth"] == 0) & (F.size(a["out"]) > 0), a["out"]))


def parse_answers(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, invalid): the last of a text's concatenated JSON objects; a broken or foreign part, or a wrong shape, makes
    the whole answer invalid."""
    parts = raw.withColumn("_parts", split_objects(F.col("raw")))
    sound = F.col("_parts").isNotNull() & F.forall("_parts", lambda p: F.try_parse_json(p).isNotNull())
    read = materialise(parts.withColumn("_sound", F.coalesce(sound, F.lit(False))).withColumn(
        "a", F.from_json(F.element_at("_parts", -1), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))
    good = F.col("_sound") & F.col("a").isNotNull() & F.col("a._corrupt_record").isNull()
    keep = [c for c in raw.columns]
    return read.where(good).select(*keep, "a"), read.where(~good).select(*keep)


def term_claims(parsed: DataFrame) -> DataFrame:
    t = parsed.select("paper_id", F.posexplode("a.terms").alias("i", "t"))
    part = lambda name: t.select("paper_id", "i", F.lit(name).alias("part"), F.posexplode(f"t.{name}").alias("j", "g"))
    return part("defined_in").unionByName(part("grounds")).select("paper_id", "i", "part", "j", F.col("g.span").alias("span_id"), F.col("g.quote").alias("quote"))


def ground_terms(parsed: DataFrame, spans: DataFrame) -> DataFrame:
    """Terms with any ground left; an explanation only with grounds of its own and text."""
    kept = ground(term_claims(parsed), spans)
    g = F.struct("j", "span_id", "quote", "page", *CORNERS)
    pick = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, g))).alias(name)
    per = kept.groupBy("paper_id", "i").agg(pick("defined_in"), pick("grounds"))
    t = parsed.select("paper_id", F.posexplode("a.terms").alias("i", "t"))
    said = X.ends_trimmed("t.explanation")
    return t.join(per, ["paper_id", "i"]).select("paper_id", "i", X.ends_trimmed("t.term").alias("term"), F.when((F.size("grounds") > 0) & (said != ""), said).alias("explanation"), "defined_in", "grounds")


def ground_slots(parsed: DataFrame, spans: DataFrame, slots: DataFrame) -> DataFrame:
    """Per known slot the first ground of each span, at most three. An answer's slot list is its own row's, so these
    windows are small."""
    s = parsed.select("paper_id", F.posexplode("a.where_to_look").alias("i", "s"))
    claims = s.select("paper_id", "i", F.col("s.slot").alias("slot"), F.posexplode("s.spans").alias("j", "g")).select("paper_id", "i", "slot", "j", F.col("g.span").alias("span_id"), F.col("g.quote").alias("quote"))
    kept = ground(claims.join(slots.select(F.col("name").alias("slot")), "slot", "left_semi"), spans)
    once = kept.groupBy("paper_id", "i", "slot", "span_id").agg(F.min_by(F.struct("j", "quote", "page", *CORNERS), "j").alias("g")).select("paper_id", "i", "slot", "span_id", "g.*")
    w = Window.partitionBy("paper_id", "i", "slot").orderBy("j")
    return once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= MAX_SLOT_SPANS)


def find_quote_inside(quotes: DataFrame, rects: DataFrame, index: DataFrame, pages: DataFrame, words: DataFrame, span: int = 1,
                      offsets: Callable[[str], Column] = X.kept_offsets) -> tuple[DataFrame, DataFrame]:
    """(places, lines): the best place of each quote whose first and last printed line lie inside the quote's own rects
    (paper_id, q_id, page, box). Only the pages those rects are on can hold one, so a quote meets those pages alone."""
    stripped = A.stripped_quotes(quotes)
    near = rects.select("paper_id", "q_id", "page").distinct()
    if span > 1:
        near = near.withColumn("page", F.explode(F.sequence(F.col("page") - (span - 1), F.col("page")))).distinct()
    asked = stripped.join(near, ["paper_id", "q_id"])
    from foliograph.functions.similarity import fuzzy_window
    from foliograph.operators.contains import substring_join

    exact = (substring_join(asked, index, "needle", "stripped", ["paper_id", "page"], ["paper_id", "page"])
             .withColumn("s", F.col("at").cast("int")).withColumn("e", (F.col("at") + F.length("needle")).cast("int")).withColumn("quote_score", F.lit(1.0)).drop("at"))
    exact = materialise(exact)
    open_pairs = asked.where(F.length("needle") >= A.FUZZY_MIN_CHARS).join(exact.select("paper_id", "q_id", "page").distinct(), ["paper_id", "q_id", "page"], "left_anti")
    fuzzy = (open_pairs.join(index.select("paper_id", "page", F.col("stripped").alias("_t")), ["paper_id", "page"]).withColumn("_f", fuzzy_window("needle", "_t"))
             .where("_f.score IS NOT NULL").withColumn("s", F.col("_f.s")).withColumn("e", F.col("_f.e")).withColumn("quote_score", F.col("_f.score")).drop("_f", "_t"))
    scored = materialise(A.score_candidates(exact.unionByName(fuzzy), index, offsets).where(F.col("score") >= A.MIN_SCORE).withColumn("m_first", F.col("page")))
    spans = A.page_spans(scored.select("paper_id", "q_id", "m_first", "page", "start", "end", F.col("start").alias("at_start")), pages, ["q_id", "m_first", "at_start"], span) if span > 1 else scored.select(
        "paper_id", "q_id", "page", "start", "end", F.col("page").alias("m_first"), F.col("start").alias("at_start"))
    lines = materialise(A.matched_lines(spans, words, pages, ["q_id", "m_first", "at_start"]))
    ok = A.both_ends_inside(lines, rects, ["q_id", "m_first", "at_start"], ["q_id"])
    best = A.best_place(scored.join(ok.select("paper_id", "q_id", F.col("m_first").alias("page"), F.col("at_start").alias("start")), ["paper_id", "q_id", "page", "start"], "left_semi"))
    mine = lines.join(best.select("paper_id", "q_id", F.col("page").alias("m_first"), F.col("start").alias("at_start")), ["paper_id", "q_id", "m_first", "at_start"], "left_semi").drop("m_first", "at_start")
    return best, mine


def ground_lines(grounds: DataFrame, index: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """Printed lines of each ground's quote inside its span, for the grounds that lack them. `grounds`: paper_id, q_id, quote,
    page, box, has_lines."""
    need = grounds.where("NOT has_lines")
    quotes = need.join(index.select("paper_id", "page", "page_start"), ["paper_id", "page"]).select(
        "paper_id", "q_id", F.col("quote").alias("exact"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.col("page_start").alias("position"), F.col("page").alias("page_hint"))
    return find_quote_inside(quotes, need.select("paper_id", "q_id", "page", *CORNERS), index, pages, words)[1]


def ask_results(parsed: DataFrame, spans: DataFrame, notes: DataFrame) -> DataFrame:
    """Answers with the grounds that hold (perhaps none) and the notes that exist, once each, in their order."""
    said = parsed.withColumn("answer", X.ends_trimmed("a.answer")).where("answer <> ''")
    claims = said.select("paper_id", "call_id", F.posexplode("a.grounds").alias("j", "g")).select("paper_id", "call_id", "j", F.col("g.span").alias("span_id"), F.col("g.quote").alias("quote"))
    kept = ground(claims, spans).groupBy("paper_id", "call_id").agg(F.array_sort(F.collect_list(F.struct("j", "span_id", "quote"))).alias("grounds"))
    named = said.select("paper_id", "call_id", F.posexplode(F.array_distinct("a.notes")).alias("j", "node_id")).join(notes.select("paper_id", "node_id"), ["paper_id", "node_id"], "left_semi")
    ids = named.groupBy("paper_id", "call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "node_id"))), lambda s: s["node_id"]).alias("notes"))
    return said.select("paper_id", "call_id", "answer").join(kept, ["paper_id", "call_id"], "left").join(ids, ["paper_id", "call_id"], "left")


def likely_sentence(requests: DataFrame, page_text: DataFrame) -> DataFrame:
    """The sentence around [start, end) when the text there is the word asked about. `requests`: paper_id, request_id, word,
    page, start, end."""
    j = requests.join(page_text, ["paper_id", "page"])
    s, e = F.col("start"), F.col("end")
    here = F.substring("text", s + 1, e - s)
    tail = F.substring("text", e + 1, F.lit(X.SENTENCE_WINDOW))
    stop = F.regexp_extract(tail, r"(?s)^(.*?[.!?])[\"”’)]?\s+(?=[A-Z\"“‘(\[])", 1)
    whole = F.concat(X.sentence_before(F.col("text"), s), here, F.when(stop != "", stop).otherwise(tail))
    same = F.lower(X.grounding_form(here)) == F.lower(X.grounding_form("word"))
    return j.withColumn("_same", same).withColumn("sentence", X.grounding_form(whole)).where("_same").select("paper_id", "request_id", "sentence")


def stale_answers(answers: DataFrame, papers: DataFrame) -> DataFrame:
    """Answers made from an older extraction than the paper's current one."""
    return answers.join(papers.select("paper_id", F.col("extracted_at").alias("_now")), "paper_id").where("_now > extracted_at").drop("_now")


def merge_answers(current: DataFrame, passes: DataFrame, definitions: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, kind, key, body, extracted_at): a new whole-paper pass replaces the old; definitions stay only from the
    paper's present extraction; a new definition replaces its key's."""
    now = papers.select("paper_id", F.col("extracted_at").alias("_now"))
    reader = current.where("kind = 'pass'").join(passes.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(passes)
    kept = current.where("kind = 'definition'").join(now, "paper_id").where("extracted_at = _now").drop("_now")
    defined = kept.join(definitions.select("paper_id", "key").distinct(), ["paper_id", "key"], "left_anti").unionByName(definitions)
    return reader.unionByName(defined)


def define_context(requests: DataFrame, spans: DataFrame, section_rects: DataFrame, words: DataFrame) -> DataFrame:
    """Spans to send for a word: those overlapping its rect or the extent of the first section that does. Requests whose word
    is not under their rect get none. `requests`: paper_id, request_id, word, page, box."""
    said = text_under(words, boxed(requests, "q_", "paper_id", "page", "request_id"), ["request_id"])
    ok = requests.join(said, ["paper_id", "request_id"]).where(F.contains(X.word_key("text"), X.word_key("word"))).drop("text")
    mine = boxed(ok, "m_", "paper_id", "page", "request_id")
    direct = overlapping_rects(boxed(spans, "s_", "paper_id", "page", "span_id"), mine, "s_", "m_").select("paper_id", "request_id", "span_id")
    home = overlapping_rects(boxed(section_rects, "s_", "paper_id", "page", "section_id", "ord"), mine, "s_", "m_").groupBy("paper_id", "request_id").agg(F.min_by("section_id", "ord").alias("section_id"))
    ext = home.join(section_rects.select("paper_id", "section_id", "page", *CORNERS), ["paper_id", "section_id"])
    far = overlapping_rects(boxed(spans, "s_", "paper_id", "page", "span_id"), boxed(ext, "m_", "paper_id", "page", "request_id"), "s_", "m_").select("paper_id", "request_id", "span_id")
    return direct.unionByName(far).distinct()


def term_entry(lookups: DataFrame, terms: DataFrame, definitions: DataFrame) -> DataFrame:
    """What is known of a word: the pass's term first, else a saved definition. `lookups`: paper_id, word."""
    t = terms.groupBy("paper_id", X.word_key("term").alias("_k")).agg(F.min_by(F.struct("term", "explanation"), "i").alias("t"))
    d = definitions.select("paper_id", F.col("key").alias("_k"), F.struct(F.col("explanation")).alias("d"))
    j = lookups.withColumn("_k", X.word_key("word")).join(t, ["paper_id", "_k"], "left").join(d, ["paper_id", "_k"], "left")
    return j.where("t IS NOT NULL OR d IS NOT NULL").select("paper_id", "word", F.coalesce("t.term", "word").alias("term"),
                                                          F.when(F.col("t").isNotNull(), F.col("t.explanation")).otherwise(F.col("d.explanation")).alias("explanation"))
