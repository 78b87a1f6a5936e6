"""Search inside papers: find, definition ranking, term occurrences, in-text references, text cut at links and marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators.anchoring import laid_out
from foliograph.operators.contains import long_keys, starts, substring_join
from foliograph.operators.spread import materialise, page_numbering
from foliograph.operators.words import CORNERS, Lines, let, page_array, page_words, text_under

FIND_CONTEXT_WORDS = 4
MIN_PARTIAL_CHARS = 12
WORD = r"[\p{L}\p{N}]+"
HYPHENATED = r"([\p{L}\p{N}]+)-\n([\p{L}\p{N}]+)"
MARKER = "\ue000"      # a private character standing for a hyphenated line end


def paper_words(page_text: DataFrame) -> DataFrame:
    """Distinct lower-case vocabulary of each paper; repeats fold away before the shuffle."""
    words = page_text.select("paper_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    return words.distinct()


def broken_words(page_text: DataFrame) -> DataFrame:
    """`paper_words` of the papers that have a hyphen at a line end, which are all that `reflow` asks for."""
    broken = page_text.where(F.regexp_replace("text", r"\r\n?", "\n").rlike(HYPHENATED)).select("paper_id").distinct()
    return paper_words(page_text.join(broken, "paper_id", "left_semi"))


def join_hyphens(docs: DataFrame, vocabulary: DataFrame, keys: Sequence[str], text: str = "text", glue: str = "", unknown: str = "-\n") -> DataFrame:
    """Line-end hyphens joined where the joined word is in the paper. Texts without one pass through untouched and are not shuffled. `glue`
    stands where a joined hyphen and break were, `unknown` where they were not joined."""
    keys = list(keys)
    open_ = F.coalesce(F.contains(text, F.lit("-\n")) | F.contains(text, F.lit(MARKER)), F.lit(False))
    whole, docs = docs.where(~open_), docs.where(open_)
    marked = docs.withColumn("_parts", F.split(F.regexp_replace(text, HYPHENATED, f"$1{MARKER}$2"), MARKER))
    breaks = (marked.where(F.size("_parts") > 1).select("paper_id", *keys, "_parts", F.explode(F.sequence(F.lit(1), F.size("_parts") - 1)).alias("i"))
              .select("paper_id", *keys, "i", F.lower(F.concat(F.regexp_extract(F.element_at("_parts", F.col("i")), f"({WORD})$", 1),
                                                              F.regexp_extract(F.element_at("_parts", F.col("i") + 1), f"^({WORD})", 1))).alias("word")))
    known = breaks.join(vocabulary, ["paper_id", "word"], "left_semi").groupBy("paper_id", *keys).agg(F.collect_set("i").alias("_join"))
    glued = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.when(i == F.size("_parts") - 1, "").when(
        F.array_contains("_join", i + 1), glue).otherwise(unknown))), "")
    joined = marked.join(known, ["paper_id", *keys], "left").withColumn("_join", F.coalesce("_join", F.array().cast("array<int>"))).withColumn(
        text, F.when(F.size("_parts") == 1, F.col(text)).otherwise(glued)).drop("_parts", "_join")
    return whole.unionByName(joined)


def prose(text: Column) -> Column:
    """Single line breaks to spaces, blank lines to paragraph breaks."""
    paras = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]*\n[ \t]*\n[ \t\n]*")
    flat = F.transform(paras, lambda p: X.ends_trimmed(F.regexp_replace(F.regexp_replace(p, r"[ \t]*\n[ \t]*", " "), r"[ \t]{2,}", " ")))
    return F.array_join(F.filter(flat, lambda p: p != ""), "\n\n")


def reflow(docs: DataFrame, vocabulary: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Extracted text as prose; a hyphen whose joined word is unknown stays, without its break."""
    clean = docs.withColumn(text, F.regexp_replace(text, r"\r\n?", "\n"))
    return join_hyphens(clean, vocabulary, keys, text, unknown="-").withColumn(text, prose(F.col(text)))


def find_in_papers(queries: DataFrame, page_text: DataFrame, sections: DataFrame) -> DataFrame:
    """Case-free, whitespace-free, non-overlapping hits in paper order, with four words either side,
    the section they fall in and their place on the page. `queries`: paper_id, query_id, query, one row each.

    Pages and sections of a paper of at most `contains.WHOLE` characters meet where the paper is, each shuffled once; those of longer papers
    meet in substring joins."""
    q = queries.select("paper_id", "query_id", X.squeeze("query").alias("needle")).where("needle <> ''").distinct()
    texts = page_text.select("paper_id", "text").unionByName(sections.select("paper_id", "text"))
    large = long_keys(texts, "text", ["paper_id"])
    if large is None:
        return _find_in_short(q, page_text, sections)
    of = lambda df, how: df.join(large, ["paper_id"], how)
    parts = [find(*(of(df, how) for df in (q, page_text, sections))) for find, how in ((_find_in_short, "left_anti"), (_find_in_long, "left_semi"))]
    return parts[0].unionByName(parts[1])


def _quoted(needle: str) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(F.col(needle), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _context(start: Column, end: Column) -> list[Column]:
    """`before`, `match` and `after` of a hit in `text`."""
    near = rf"(?U)^\s*(?:\S+\s+){{0,{FIND_CONTEXT_WORDS - 1}}}\S+"   # anchored, so only the words next to the hit are scanned
    head, tail = F.substring("text", F.lit(1), start), F.substring("text", end + 1, F.length("text"))
    return [X.flat(F.reverse(F.regexp_extract(F.reverse(head), near, 0))).alias("before"),
            X.single_spaced(F.substring("text", start + 1, end - start)).alias("match"), X.flat(F.regexp_extract(tail, near, 0)).alias("after")]


def _find_in_short(q: DataFrame, page_text: DataFrame, sections: DataFrame) -> DataFrame:
    """Everything by paper: a page's hits are one array until they are numbered and know their section."""
    near = q.join(page_text.select("paper_id", "page", "text"), "paper_id").where(F.contains(X.squeeze("text"), F.col("needle")))
    spans = let(X.kept_offsets("text"), lambda off: F.transform(X.match_spans(X.squeeze("text"), _quoted("needle")), lambda m: F.struct(
        F.get(off, m["start"]).alias("start"), (F.get(off, m["end"] - 1) + 1).alias("end"))))
    held = F.transform(spans, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), i.alias("nth"), *_context(m["start"], m["end"])))
    paged = near.select("paper_id", "query_id", "page", held.alias("_hits")).withColumn("_size", F.size("_hits"))
    before = Window.partitionBy("paper_id", "query_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    numbered = paged.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    body = sections.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), "section_id", X.squeeze("text").alias("flat")))).alias("_secs"))
    hits = numbered.join(body, "paper_id", "left").select(
        "paper_id", "query_id", "page", "_shift", "_secs", F.explode("_hits").alias("h")).select("paper_id", "query_id", "page", "_shift", "_secs", "h.*")

    def held_by(*said: str) -> Column:
        return let(X.squeeze(F.concat(*said)), lambda way: F.get(F.filter("_secs", lambda s: (way != "") & F.contains(s["flat"], way)), F.lit(0))["section_id"])

    return hits.select("paper_id", "query_id", (F.col("_shift") + F.col("nth")).cast("long").alias("hit"), "page", "start", "end", "nth", "before", "match", "after",
                       F.coalesce(held_by("before", "match", "after"), held_by("before", "match"), held_by("match", "after")).alias("section_id"))


def _find_in_long(q: DataFrame, page_text: DataFrame, sections: DataFrame) -> DataFrame:
    squeezed = page_text.withColumn("flat", X.squeeze("text"))
    pages = substring_join(q.select("paper_id", "query_id", "needle"), squeezed, "needle", "flat", ["paper_id", "page"], places=False).select("paper_id", "query_id", "needle", "page").distinct()
    held = laid_out(squeezed, pages)
    # Only (start, end) pairs leave a page's row for the numbering shuffle; its text is joined back for the hits kept.
    spans = pages.join(held.select("paper_id", "page", "flat", "_off"), ["paper_id", "page"]).select(
        "paper_id", "query_id", "page", "_off", F.explode(X.match_spans(F.col("flat"), _quoted("needle"))).alias("m"))
    hits = materialise(spans.select("paper_id", "query_id", "page", F.get("_off", F.col("m.start")).alias("start"), (F.get("_off", F.col("m.end") - 1) + 1).alias("end")))
    placed = page_numbering(hits, ["paper_id", "query_id"], [F.col("start")], "hit")
    w = Window.partitionBy("paper_id", "query_id", "page").orderBy("start")
    counted = placed.withColumn("nth", F.row_number().over(w) - 1)
    worded = materialise(counted.join(page_text.select("paper_id", "page", "text"), ["paper_id", "page"]).select(
        "paper_id", "query_id", "page", "start", "end", "hit", "nth", *_context(F.col("start"), F.col("end"))))
    ways = worded.select("paper_id", "query_id", "hit", F.posexplode(F.array(
        F.concat("before", "match", "after"), F.concat("before", "match"), F.concat("match", "after"))).alias("way", "_t")).withColumn("needle", X.squeeze("_t")).drop("_t")
    body = sections.select("paper_id", F.col("ord").alias("s_ord"), "section_id", X.squeeze("text").alias("flat"))
    where = substring_join(ways, body, "needle", "flat", ["paper_id", "s_ord", "section_id"], places=False).groupBy("paper_id", "query_id", "hit").agg(
        F.min_by("section_id", F.struct("way", "s_ord")).alias("section_id"))
    return worded.join(where, ["paper_id", "query_id", "hit"], "left")


def rank_definitions(hits: DataFrame, page_text: DataFrame) -> DataFrame:
    """Hits with the sentence around them scored by the definition cues; likely ones first by score, then paper order."""
    text = page_text.select("paper_id", "page", F.col("text").alias("_t"))
    before, after = X.sentence_around(F.col("_t"), F.col("start"), F.col("end"))
    scored = (hits.join(text, ["paper_id", "page"]).withColumn("s_before", before).withColumn("s_after", after).drop("_t")
              .withColumn("rules", X.definition_rules(F.col("s_before"), F.col("s_after"), F.col("hit") == 0)).withColumn("score", X.definition_score(F.col("rules")))
              .withColumn("likely", F.col("score") >= X.LIKELY_SCORE))
    w = Window.partitionBy("paper_id", "query_id").orderBy(F.desc("likely"), F.when(F.col("likely"), -F.col("score")).otherwise(0), "hit")
    return scored.withColumn("rank", F.row_number().over(w) - 1)


def term_occurrences(terms: DataFrame, words: DataFrame | Lines) -> DataFrame:
    """Every run of a page's words equal to a term's, case-free, edge punctuation ignored, with the box around the run.

    A page's words are one array, which meets the terms of its paper that have their first word on it; only the runs found become rows.
    `terms`: paper_id, term. `at` is the run's first word on the page."""
    tokens = F.filter(F.transform(F.filter(F.split(X.flat("term"), " "), lambda t: t != ""), X.bare_word), lambda t: t != "")
    t = terms.select("paper_id", "term", tokens.alias("tok")).where(F.size("tok") > 0)
    asked = t.groupBy("paper_id").agg(F.collect_set(F.struct("term", "tok")).alias("_terms"))
    met = page_words(words).join(asked, "paper_id")

    def runs(ws: Column, bare: Column) -> Column:
        def same(term: Column, i: Column) -> Column:
            return (F.get(bare, i) == F.get(term["tok"], F.lit(0))) & ((F.size(term["tok"]) == 1) | (F.slice(bare, i + 1, F.size(term["tok"])) == term["tok"]))

        def box(run: Column) -> list[Column]:
            side = lambda fn, c: fn(F.transform(run, lambda w: w[c])).alias(c)
            return [side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")]

        places = F.sequence(F.lit(0), F.size(bare) - 1)
        here = F.filter("_terms", lambda term: F.array_contains(bare, F.get(term["tok"], F.lit(0))))
        return F.flatten(F.transform(here, lambda term: F.transform(F.filter(places, lambda i: same(term, i)), lambda i: let(
            F.slice(ws, i + 1, F.size(term["tok"])), lambda run: F.struct(term["term"].alias("term"), i.alias("at"), *box(run))))))

    found = let(page_array(words), lambda ws: let(F.transform(ws, lambda w: X.bare_word(w["text"])), lambda bare: runs(ws, bare)))
    return met.select("paper_id", "page", F.explode(found).alias("_r")).select("paper_id", "_r.term", "page", "_r.at", *[f"_r.{c}" for c in CORNERS])


# -- references --------------------------------------------------------------------


def references(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per in-text pointer."""
    return docs.select("paper_id", *keys, F.explode(X.find_references(F.col(text))).alias("r")).select("paper_id", *keys, "r.*")


def bibliography(page_text: DataFrame) -> DataFrame:
    """Each numbered entry: the first line on the last page that starts "[n] Capital", trimmed to its entry. An entry takes along the lines
    up to the next that ends it, not the rest of its page."""
    lined = page_text.withColumn("_l", F.split("text", "\n"))
    starts = F.filter(F.transform("_l", lambda ln, i: F.when(F.concat_ws("\n", ln, F.get("_l", i + 1)).rlike(r"(?U)^\[\d+\]\s+(?=\p{Lu})"), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform("_l", lambda ln, i: F.when(X.ends_entry(ln), i)), lambda i: i.isNotNull())
    each = lined.withColumn("_ends", ends).withColumn("i", F.explode(starts)).withColumn("key", F.regexp_extract(F.get("_l", F.col("i")), r"^\[(\d+)\]", 1))
    stop = F.coalesce(F.get(F.filter("_ends", lambda e: e > F.col("i")), F.lit(0)), F.size("_l"))
    text = F.array_join(F.slice("_l", F.col("i") + 1, stop - F.col("i")), "\n")
    chosen = each.select("paper_id", "page", "key", "i", text.alias("_t")).groupBy("paper_id", "key").agg(
        F.max_by(F.struct("page", "_t"), F.struct("page", -F.col("i"))).alias("b"))
    return chosen.select("paper_id", "key", F.col("b.page").alias("page"), X.first_entry(F.col("b._t")).alias("entry"))


def equation_regions(refs: DataFrame, page_text: DataFrame, regions: DataFrame) -> DataFrame:
    """Formula regions on the pages that print "(n)", per reference."""
    printed = page_text.select("paper_id", "page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\(\s*(\d+)\s*\)"), F.lit(1)))).alias("key"))
    formulas = regions.where("label = 'formula'").select("paper_id", "page", F.col("ord").alias("region_ord"), *CORNERS)
    return refs.where("kind = 'equation'").join(printed, ["paper_id", "key"]).join(formulas, ["paper_id", "page"])


def resolve_references(refs: DataFrame, figures: DataFrame, sections: DataFrame, regions: DataFrame, page_text: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each pointer points at: figure or table by label, section by number, formula candidates, bibliography entry.
    Pointers to nothing are left out."""
    keys = ["paper_id", *keys, "kind", "key", "start", "end"]
    refs = materialise(refs.select(*keys))  # pages are scanned for pointers once, not for each kind
    label = F.concat(F.when(F.col("kind") == "table", "Table ").otherwise("Figure "), "key")
    f = figures.groupBy("paper_id", F.col("label").alias("_l")).agg(F.min_by("figure_id", "ord").alias("target"))
    figs = refs.where(F.col("kind").isin("figure", "table")).withColumn("_l", label).join(f, ["paper_id", "_l"]).select(*keys, "target")
    s = sections.where("number IS NOT NULL").groupBy("paper_id", F.col("number").alias("key")).agg(F.min_by("section_id", "ord").alias("target"))
    secs = refs.where("kind = 'section'").join(s, ["paper_id", "key"]).select(*keys, "target")
    eq = equation_regions(refs, page_text, regions).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("region_ord")).cast("array<string>"), ",").alias("target"))
    cites = refs.where("kind = 'citation'").join(bibliography(page_text).select("paper_id", "key", F.col("entry").alias("target")), ["paper_id", "key"]).select(*keys, "target")
    return figs.unionByName(secs).unionByName(eq).unionByName(cites)


def equation_target(refs: DataFrame, page_text: DataFrame, regions: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first candidate formula whose own words carry the number."""
    keys = ["paper_id", *keys, "key", "start"]
    cand = equation_regions(refs, page_text, regions)
    boxes = cand.select("paper_id", "page", "region_ord", *[F.col(c).alias(f"q_{c}") for c in CORNERS]).distinct()
    said = text_under(words, boxes, ["region_ord"]).select("paper_id", "region_ord", F.col("text").alias("_said"))
    numbers = said.select("paper_id", "region_ord", F.explode(F.array_distinct(F.regexp_extract_all("_said", F.lit(r"\(\s*(\d+)\s*\)"), F.lit(1)))).alias("key"))
    return cand.join(numbers, ["paper_id", "region_ord", "key"]).groupBy(*keys).agg(F.min("region_ord").alias("region_ord"))


def cut_at(docs: DataFrame, spans: DataFrame, keys: Sequence[str], text: str = "text", link: str = "link") -> DataFrame:
    """Text cut into plain and linked parts in order. `spans`: keys, start, end and a link, not overlapping."""
    keys = ["paper_id", *keys]
    per = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", link))).alias("_s"))
    return _cut_parts(docs.select(*keys, F.col(text).alias("_t")).join(per, keys, "left"), keys, link)


def _cut_parts(d: DataFrame, keys: Sequence[str], link: str) -> DataFrame:
    """`_t` cut at the ordered spans `_s`."""
    kind = d.schema["_s"].dataType
    s = F.coalesce("_s", F.array().cast(kind))
    sub = lambda a, b: F.substring("_t", a + 1, b - a)
    none_link = F.lit(None).cast(kind.elementType[link].dataType)
    parts = F.flatten(F.transform(s, lambda x, i: F.array(
        F.struct(sub(F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"]), x["start"]).alias("text"), none_link.alias(link)),
        F.struct(sub(x["start"], x["end"]).alias("text"), x[link].alias(link)))))
    cursor = F.when(F.size(s) > 0, F.element_at(s, -1)["end"]).otherwise(F.lit(0))
    tail = F.array(F.struct(sub(cursor, F.length("_t")).alias("text"), none_link.alias(link)))
    every = F.filter(F.concat(parts, tail), lambda p: (p["text"] != "") | p[link].isNotNull())
    shown = let(every, lambda found: F.when(F.size(found) > 0, found).otherwise(tail))  # the text is cut once
    return d.select(*keys, F.posexplode(shown).alias("part", "p")).select(*keys, "part", F.col("p.text").alias("text"), F.col(f"p.{link}").alias(link))


def first_wins(spans: Column) -> Column:
    """Of spans sorted by start, those not starting inside an earlier kept one."""
    start = F.struct(F.lit(0).alias("cur"), F.filter(spans, lambda _: F.lit(False)).alias("out"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        F.when(s["start"] < a["cur"], a["cur"]).otherwise(s["end"]).alias("cur"),
        F.when(s["start"] < a["cur"], a["out"]).otherwise(F.array_append(a["out"], s)).alias("out")), lambda a: a["out"])


def _grams(first: Column, second: Column) -> Column:
    """A word alone, and with the next one if there is one, as (_g, _gram)."""
    two = F.struct(F.lit(2).alias("_g"), F.when(second.isNotNull(), F.xxhash64(first, second)).alias("_gram"))
    return F.filter(F.array(F.struct(F.lit(1).alias("_g"), F.xxhash64(first).alias("_gram")), two), lambda x: x["_gram"].isNotNull())


def _asked_gram(first: Column, second: Column) -> Column:
    """The longest gram that a run of words starts with."""
    return F.when(second.isNull(), F.struct(F.lit(1).alias("_g"), F.xxhash64(first).alias("_gram"))).otherwise(
        F.struct(F.lit(2).alias("_g"), F.xxhash64(first, second).alias("_gram")))


def _longest_first(found: Column) -> Column:
    """Of (start, end, term) in any order the non-overlapping ones, earlier and then longer ones first."""
    short = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("short"), s["end"].alias("end"), s["term"].alias("term")))
    return first_wins(F.transform(F.array_sort(short), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["term"].alias("term"))))


def _terms_by_paper(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """Docs with `_s`, the `term_spans` of each: every doc meets the terms of its paper as one list, so texts are shuffled once and nothing
    becomes rows."""
    t = terms.select("paper_id", "term", X.word_key("term").alias("needle")).where("needle <> ''").distinct()
    asked = t.groupBy("paper_id").agg(F.collect_list(F.struct("term", "needle")).alias("_terms"))
    free = lambda ch: ~ch.rlike(r"[\p{L}\p{N}]")

    def spans(low: Column) -> Column:
        def places(x: Column) -> Column:
            n = F.length(x["needle"])
            whole = lambda at: ((at == 0) | free(F.substring(low, at, F.lit(1)))) & free(F.substring(low, at + n + 1, F.lit(1)))
            return F.transform(F.filter(starts(low, x["needle"]), whole), lambda at: F.struct(at.alias("start"), (at + n).alias("end"), x["term"].alias("term")))

        return _longest_first(F.flatten(F.transform(F.filter("_terms", lambda x: F.contains(low, x["needle"])), places)))

    return docs.join(asked, "paper_id", "left").withColumn("_s", F.when(F.col("_terms").isNotNull(), let(F.lower(text), spans))).drop("_terms")


def cut_at_terms(docs: DataFrame, terms: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`cut_at` the `term_spans`. A paper of at most `contains.WHOLE` characters is shuffled once, by itself; longer ones are spread."""
    keys = ["paper_id", *keys]
    docs = materialise(docs.select(*keys, F.col(text).alias("_t")))
    large = long_keys(docs, "_t", ["paper_id"])
    if large is None:
        return _cut_parts(_terms_by_paper(docs, terms, "_t"), keys, "term")
    of = lambda df, how: df.join(large, "paper_id", how)
    short = _cut_parts(_terms_by_paper(of(docs, "left_anti"), of(terms, "left_anti"), "_t"), keys, "term")
    long = of(docs, "left_semi")
    return short.unionByName(cut_at(long, term_spans(long, of(terms, "left_semi"), keys[1:], "_t"), keys[1:], "_t", "term"))


def term_spans(docs: DataFrame, terms: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Whole-word, case-free places of terms in reflowed text, longest first, not overlapping.

    A term that has words meets the texts of its paper where its first word, or its first two, stand; only one of marks alone needs the
    substring join."""
    keys = list(keys)
    d = docs.withColumn("_low", F.lower(text))
    words = F.regexp_extract_all("needle", F.lit(WORD), F.lit(0))
    t = terms.select("paper_id", "term", X.word_key("term").alias("needle")).distinct().withColumn("_words", words)
    worded = t.where(F.size("_words") > 0).withColumn("_x", _asked_gram(F.get("_words", F.lit(0)), F.get("_words", F.lit(1)))).select(
        "paper_id", "term", "needle", "_x._g", "_x._gram", F.length(F.regexp_extract("needle", rf"^(?:(?!{WORD}).)*", 0)).alias("_lead"))
    gaps = F.transform(F.split("_low", WORD, -1), F.length)
    hits = F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))
    w = Window.partitionBy("paper_id", *keys).orderBy("_i")
    runs = d.select("paper_id", *keys, F.posexplode(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))).alias("_i", "_p")).select(
        "paper_id", *keys, "_i", "_p.gap", "_p.hit")
    starts = runs.select("paper_id", *keys, "hit", F.lead("hit").over(w).alias("_next"), (F.sum(F.col("gap") + F.length("hit")).over(w) - F.length("hit")).alias("_start"))
    grams = starts.select("paper_id", *keys, "_start", F.explode(_grams(F.col("hit"), F.col("_next"))).alias("_x")).select("paper_id", *keys, "_start", "_x._g", "_x._gram")
    met = grams.join(worded, ["paper_id", "_g", "_gram"]).withColumn("at", F.col("_start") - F.col("_lead")).where("at >= 0").select("paper_id", *keys, "term", "needle", "at")
    bare = substring_join(t.where(F.size("_words") == 0).select("paper_id", "term", "needle"), d, "needle", "_low", ["paper_id", *keys])
    n = F.length("needle")
    hit = (met.unionByName(bare.select("paper_id", *keys, "term", "needle", F.col("at").cast("long").alias("at"))).join(d.select("paper_id", *keys, "_low"), ["paper_id", *keys])
           .where(F.substring("_low", (F.col("at") + 1).cast("int"), n) == F.col("needle")))
    free = lambda ch: ~ch.rlike(r"[\p{L}\p{N}]")
    prev = F.when(F.col("at") > 0, F.substring("_low", F.col("at").cast("int"), F.lit(1))).otherwise(F.lit(""))
    nxt = F.substring("_low", (F.col("at") + n + 1).cast("int"), F.lit(1))
    whole = hit.where(free(prev) & free(nxt)).select("paper_id", *keys, F.col("at").cast("int").alias("start"), (F.col("at") + n).cast("int").alias("end"), "term")
    order = _longest_first(F.collect_list(F.struct("start", "end", "term")))
    return whole.groupBy("paper_id", *keys).agg(order.alias("s")).select("paper_id", *keys, F.explode("s").alias("s")).select("paper_id", *keys, "s.*")


def paint_marks(blocks: DataFrame, marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which part of a block's text each mark covers. `blocks`: paper_id, block_id, text (reflowed); `marks`: paper_id, h_id,
    ord, exact, prefix, suffix (reflowed); `pairs`: (paper_id, block_id, h_id) by geometry.

    A whole quote goes to the occurrence whose neighbours agree longest with its context, a tie is left unpainted; else
    a part of at least 12 characters at the block's edge. Overlapping marks: the first wins."""
    b = blocks.select("paper_id", "block_id", "text", X.strip_ws("text").alias("s"))
    m = marks.select("paper_id", "h_id", "ord", X.strip_ws("exact").alias("needle"), X.strip_ws(F.coalesce("prefix", F.lit(""))).alias("pre"),
                     X.strip_ws(F.coalesce("suffix", F.lit(""))).alias("suf")).where("needle <> ''")
    asked = pairs.join(m, ["paper_id", "h_id"])
    hit = substring_join(asked, b, "needle", "s", ["paper_id", "block_id"], ["paper_id", "block_id"]).withColumn("at", F.col("at").cast("int"))
    hit = hit.join(b.select("paper_id", "block_id", "s"), ["paper_id", "block_id"])
    n = F.length("needle")
    head, tail = F.substring("s", F.lit(1), F.col("at")), F.substring("s", F.col("at") + n + 1, F.length("suf"))
    run = lambda longest, same: F.array_max(F.filter(F.sequence(F.lit(0), longest), same))
    before = run(F.least(F.length("pre"), F.col("at")), lambda k: F.right(head, k) == F.right("pre", k))
    after = run(F.least(F.length("suf"), F.length(tail)), lambda k: F.left(tail, k) == F.left("suf", k))
    scored = hit.withColumn("score", before + after)
    best = scored.groupBy("paper_id", "block_id", "h_id", "ord").agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "at")).alias("all"), F.first("needle").alias("needle"))
    winners = F.filter("all", lambda x: x["score"] == F.col("top"))
    whole = best.where(F.size(winners) == 1).select("paper_id", "block_id", "h_id", "ord", winners[0]["at"].alias("s0"), (winners[0]["at"] + F.length("needle")).alias("s1"))
    rest = asked.join(hit.select("paper_id", "block_id", "h_id").distinct(), ["paper_id", "block_id", "h_id"], "left_anti").join(b.select("paper_id", "block_id", "s"), ["paper_id", "block_id"])
    cap = F.least(F.length("needle") - 1, F.length("s"))
    sizes = F.when(cap >= MIN_PARTIAL_CHARS, F.sequence(F.lit(MIN_PARTIAL_CHARS), cap)).otherwise(F.array().cast("array<int>"))
    ends = F.array_max(F.filter(sizes, lambda k: F.right("s", k) == F.left("needle", k)))
    begins = F.array_max(F.filter(sizes, lambda k: F.left("s", k) == F.right("needle", k)))
    inner = (F.length("s") >= MIN_PARTIAL_CHARS) & F.contains("needle", "s")
    at_end = ends.isNotNull() & (ends >= F.coalesce(begins, F.lit(0)))
    part = rest.withColumn("s0", F.when(at_end, F.length("s") - ends).when(begins.isNotNull(), F.lit(0)).when(inner, F.lit(0))).withColumn(
        "s1", F.when(at_end, F.length("s")).when(begins.isNotNull(), begins).when(inner, F.length("s"))).where("s0 IS NOT NULL").select("paper_id", "block_id", "h_id", "ord", "s0", "s1")
    spans = whole.unionByName(part).join(b.select("paper_id", "block_id", X.kept_offsets("text").alias("_off")), ["paper_id", "block_id"]).select(
        "paper_id", "block_id", "h_id", "ord", F.get("_off", F.col("s0")).alias("start"), (F.get("_off", F.col("s1") - 1) + 1).alias("end"))
    order = F.array_sort(F.collect_list(F.struct("start", "ord", "end", "h_id")))
    kept = spans.groupBy("paper_id", "block_id").agg(first_wins(order).alias("k")).select("paper_id", "block_id", F.explode("k").alias("k")).select("paper_id", "block_id", "k.start", "k.end", "k.h_id")
    return cut_at(blocks.select("paper_id", "block_id", "text"), kept, ["block_id"], link="h_id")
