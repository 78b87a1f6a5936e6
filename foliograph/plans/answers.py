"""Queries for grounding, terms and key sentences (GD, JN-22/24/25/29, AG-17..20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import anchoring as A
from foliograph.operators import documents as D
from foliograph.operators import grounding as GD
from foliograph.operators import pieces as P
from foliograph.operators import search as S
from foliograph.operators.words import CORNERS
from foliograph.plans.anchoring import paper_terms
from foliograph.plans.graph import board, no_tags
from foliograph.plans.prelude import add_table
from foliograph.plans.registry import query

add_table("pspans", """
  SELECT * FROM (SELECT paper_id, page, ord, x0, y0, x1, y1, 'p' || (page + 1) || '-r' || row_number() OVER (PARTITION BY paper_id, page ORDER BY ord) AS span_id,
         trim(array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ')) AS text FROM regions WHERE label NOT IN ('page-header', 'page-footer', 'footnote', 'caption')) WHERE text <> ''""", "regions")
add_table("claims", """
  SELECT a.paper_id, 'p1-r2' AS span_id, array_to_string(list_slice(string_split(CASE WHEN a.paper_id % 2 = 0 OR a.paper_id % 4 = 1 THEN a.text ELSE coalesce(b.text, a.text) END, ' '), 1,
         CASE WHEN a.paper_id % 2 = 0 THEN 5 WHEN a.paper_id % 4 = 1 THEN 2 ELSE 5 END), ' ') AS quote
  FROM pspans a LEFT JOIN pspans b ON b.paper_id = a.paper_id + 1 AND b.span_id = 'p1-r2' WHERE a.span_id = 'p1-r2'""", "pspans")
add_table("every_claim", """
  SELECT a.paper_id, a.span_id, array_to_string(list_slice(string_split(CASE WHEN (a.paper_id + a.ord) % 2 = 0 OR (a.paper_id + a.ord) % 4 = 1 THEN a.text ELSE coalesce(b.text, a.text) END, ' '), 1,
         CASE WHEN (a.paper_id + a.ord) % 4 = 1 THEN 2 ELSE 3 + (a.ord % 9) END), ' ') AS quote
  FROM pspans a LEFT JOIN pspans b ON b.paper_id = a.paper_id + 1 AND b.span_id = a.span_id""", "pspans")
HELD = r"""
  SELECT c.paper_id, c.span_id, c.quote, s.page, s.x0 FROM (SELECT *, trim(regexp_replace(nfc_normalize(quote), '[\s\p{Z}]+', ' ', 'g')) AS q FROM %s) c
  JOIN pspans s ON s.paper_id = c.paper_id AND s.span_id = c.span_id WHERE len(string_split(q, ' ')) >= 3 AND regexp_matches(trim(regexp_replace(nfc_normalize(s.text), '[\s\p{Z}]+', ' ', 'g')),
    '(^|[^\p{L}\p{N}\p{M}_])' || regexp_escape(q) || '($|[^\p{L}\p{N}\p{M}_])')"""
add_table("every_held", HELD % "every_claim", "every_claim", "pspans")
add_table("held_claims", HELD % "claims", "claims", "pspans")


def spans(lib):
    return lib.shared("spans", lambda: GD.paper_spans(lib.regions(), lib.word_lines()))


def claims(lib):
    s = spans(lib).where("span_id = 'p1-r2'").select("paper_id", "span_id", "text")
    nxt = s.select((F.col("paper_id") - 1).alias("paper_id"), F.col("text").alias("other"))
    p = F.col("paper_id")
    own = (p % 2 == 0) | (p % 4 == 1)
    words = F.slice(F.split(F.when(own, F.col("text")).otherwise(F.coalesce("other", "text")), " "), F.lit(1), F.when(p % 4 == 1, 2).otherwise(5))
    return s.join(nxt, "paper_id", "left").select("paper_id", "span_id", F.array_join(words, " ").alias("quote"))


def every_claim(lib):
    """A claim on every span of every paper: words of its own, too few words, or words of the next paper's span."""
    s = spans(lib).select("paper_id", "span_id", "ord", "text")
    nxt = s.select((F.col("paper_id") - 1).alias("paper_id"), "span_id", F.col("text").alias("other"))
    k = F.col("paper_id") + F.col("ord")
    own = (k % 2 == 0) | (k % 4 == 1)
    words = F.slice(F.split(F.when(own, F.col("text")).otherwise(F.coalesce("other", "text")), " "), F.lit(1), F.when(k % 4 == 1, 2).otherwise(3 + F.col("ord") % 9))
    return s.join(nxt, ["paper_id", "span_id"], "left").select("paper_id", "span_id", F.array_join(words, " ").alias("quote"))


@query("gd01_paper_spans", "SELECT paper_id, page, span_id, md5(text) AS text_md5 FROM pspans", ("pspans",))
def _(lib):
    return spans(lib).select("paper_id", "page", "span_id", F.md5("text").alias("text_md5"))


@query("gd02_ground", "SELECT paper_id, span_id, quote, page, x0 FROM every_held", ("every_held",))
def _(lib):
    return GD.ground(every_claim(lib), spans(lib)).select("paper_id", "span_id", "quote", "page", "x0")


def answers(lib):
    """Model answers as text: one term and one slot on the claim; every ninth is cut short, every fifth sent twice."""
    g = F.array(F.struct(F.col("span_id").alias("span"), "quote"), F.struct(F.lit("p1-r99").alias("span"), "quote"))
    none = F.array().cast("array<struct<span:string,quote:string>>")
    p = F.col("paper_id")
    body = F.to_json(F.struct(
        F.array(F.struct(F.lit(" some term ").alias("term"), F.when(p % 3 == 0, none).otherwise(g).alias("defined_in"), F.lit("It means {this}.").alias("explanation"), F.when(p % 3 == 1, none).otherwise(g).alias("grounds"))).alias("terms"),
        F.array(F.struct(F.when(p % 7 == 0, "Unknown").otherwise("Problem").alias("slot"), F.concat(g, g).alias("spans"))).alias("where_to_look")))
    raw = F.when(p % 9 == 0, F.substring(body, F.lit(1), F.length(body) - 1)).when(p % 5 == 0, F.concat(F.lit("{}\n"), body)).otherwise(body)
    return claims(lib).select("paper_id", raw.alias("raw"))


def parsed(lib):
    return lib.shared("parsed", lambda: GD.parse_answers(answers(lib), GD.PASS_SCHEMA)[0])


@query("gd06_parse_answers", "SELECT paper_id, paper_id % 9 <> 0 AS valid FROM claims", ("claims",))
def _(lib):
    good, bad = GD.parse_answers(answers(lib), GD.PASS_SCHEMA)
    return good.select("paper_id", F.lit(True).alias("valid")).unionByName(bad.select("paper_id", F.lit(False).alias("valid")))


@query("gd03_ground_terms", """
SELECT paper_id, 'some term' AS term, CASE WHEN paper_id % 3 <> 1 THEN 'It means {this}.' END AS explanation, CASE WHEN paper_id % 3 = 0 THEN 0 ELSE 1 END AS defined_in, CASE WHEN paper_id % 3 = 1 THEN 0 ELSE 1 END AS grounds
FROM held_claims WHERE paper_id % 9 <> 0""", ("held_claims",))
def _(lib):
    return GD.ground_terms(parsed(lib), spans(lib)).select("paper_id", "term", "explanation", F.size("defined_in").alias("defined_in"), F.size("grounds").alias("grounds"))


def slots(lib):
    return lib.spark.createDataFrame([(0, "Background"), (1, "Problem")], "ord int, name string")


@query("gd04_ground_slots", "SELECT paper_id, 'Problem' AS slot, span_id, quote FROM held_claims WHERE paper_id % 9 <> 0 AND paper_id % 7 <> 0", ("held_claims",))
def _(lib):
    return GD.ground_slots(parsed(lib), spans(lib), slots(lib)).select("paper_id", "slot", "span_id", "quote")


@query("gd05_ground_lines", """
SELECT c.paper_id, c.quote, r.ord AS block, r.y0 + 4 AS y0, r.y1 - 4 AS y1 FROM held_claims c JOIN pspans s ON s.paper_id = c.paper_id AND s.span_id = c.span_id JOIN regions r ON r.paper_id = s.paper_id AND r.ord = s.ord""", ("held_claims", "pspans"))
def _(lib):
    held = GD.ground(claims(lib), spans(lib)).withColumn("q_id", F.col("span_id")).withColumn("has_lines", F.lit(False))
    lines = GD.ground_lines(held, A.page_index(lib.page_text()), lib.page_text(), lib.word_lines())
    return lines.join(held.select("paper_id", "q_id", "quote"), ["paper_id", "q_id"]).select("paper_id", "quote", "block", "y0", "y1")


@query("gd07_ask_results", """
SELECT c.paper_id, 'So it is.' AS answer, CASE WHEN h.paper_id IS NOT NULL THEN 1 ELSE 0 END AS grounds, 'n-t' AS notes FROM claims c LEFT JOIN held_claims h ON h.paper_id = c.paper_id""", ("claims", "held_claims"))
def _(lib):
    raw = claims(lib).select("paper_id", F.lit(1).alias("call_id"), F.to_json(F.struct(F.lit(" So it is. ").alias("answer"), F.array(F.struct(F.col("span_id").alias("span"), "quote")).alias("grounds"),
                                                                                   F.array(F.lit("n-t"), F.lit("n-gone"), F.lit("n-t")).alias("notes"))).alias("raw"))
    done = GD.ask_results(GD.parse_answers(raw, GD.ASK_SCHEMA)[0], spans(lib), board(lib)[0])
    return done.select("paper_id", "answer", F.coalesce(F.size("grounds"), F.lit(0)).alias("grounds"), F.array_join("notes", ",").alias("notes"))


@query("gd08_likely_sentence")
def _(lib):
    from foliograph.plans.anchoring import found, searches
    h = found(lib).where("hit = 0").select("paper_id", "page", "start", "end").join(searches(lib), "paper_id")
    r = h.select("paper_id", F.lit("r").alias("request_id"), F.when(F.col("paper_id") % 5 == 0, "other").otherwise(F.col("query")).alias("word"), "page", "start", "end")
    return GD.likely_sentence(r, lib.page_text())


@query("gd09_stale_answers", "SELECT doc_id AS paper_id FROM documents WHERE doc_id % 3 = 0")
def _(lib):
    d = F.col("doc_id")
    papers = lib.table("documents").select(d.alias("paper_id"), F.when(d % 3 == 0, F.timestamp_seconds(F.lit(2000))).otherwise(F.timestamp_seconds(F.lit(1000))).alias("extracted_at"))
    made = lib.table("documents").select(d.alias("paper_id"), F.timestamp_seconds(F.lit(1000)).alias("extracted_at"))
    return GD.stale_answers(made, papers).select("paper_id")


@query("gd10_merge_answers", """
SELECT doc_id AS paper_id, 'pass' AS kind, 'reader' AS key, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS body FROM documents
UNION ALL SELECT doc_id, 'definition', 'a', CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0""")
def _(lib):
    d = lib.table("documents").select(F.col("doc_id").alias("paper_id"))
    at = lambda n: F.timestamp_seconds(F.lit(n)).alias("extracted_at")
    row = lambda df, kind, key, body, n: df.select("paper_id", F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.lit(body).alias("body"), at(n))
    papers = d.select("paper_id", F.when(F.col("paper_id") % 3 == 0, F.timestamp_seconds(F.lit(2))).otherwise(F.timestamp_seconds(F.lit(1))).alias("extracted_at"))
    current = row(d, "pass", "reader", "old", 1).unionByName(row(d, "definition", "a", "old", 1))
    out = GD.merge_answers(current, row(d.where("paper_id % 2 = 0"), "pass", "reader", "new", 2), row(d.where("paper_id % 5 = 0"), "definition", "a", "new", 2), papers)
    return out.select("paper_id", "kind", "key", "body")


def requests(lib):
    """Ask about each paper's third word under the box of its own line; every fourth asks for a word that is not there."""
    w = lib.words().where("block = 1 AND word_no = 2").select("paper_id", F.lit("r").alias("request_id"), "page", F.when(F.col("paper_id") % 4 == 0, "zzz not here").otherwise(F.col("text")).alias("word"), *CORNERS)
    return w.withColumn("y0", F.col("y0") - 2).withColumn("y1", F.col("y1") + 2)


@query("jn22_define_context")
def _(lib):
    return GD.define_context(requests(lib), spans(lib), lib.sections()[1], lib.word_lines())


@query("jn24_ai_underlines", """
SELECT t.paper_id, t.term, t.page, t.x0, t.y0 FROM term_hits t WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.paper_id = t.paper_id AND m.page = t.page AND t.x0 < m.x1 AND m.x0 < t.x1 AND t.y0 < m.y1 AND m.y0 < t.y1)""", ("term_hits", "marks"))
def _(lib):
    hits = lib.shared("term_hits", lambda: S.term_occurrences(paper_terms(lib), lib.word_lines()))
    return P.not_overlapping(hits, lib.highlights(), ["term", "at"]).select("paper_id", "term", "page", "x0", "y0")


add_table("ai_terms", "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY term) - 1 AS i, term, 'About ' || term AS explanation FROM terms", "terms")


def ai_terms(lib):
    from pyspark.sql import Window
    w = Window.partitionBy("paper_id").orderBy("term")
    return paper_terms(lib).select("paper_id", (F.row_number().over(w) - 1).alias("i"), "term", F.concat(F.lit("About "), "term").alias("explanation"))


@query("jn25_term_entry", r"""
SELECT paper_id, ' ' || term || '  ' AS word, CASE WHEN paper_id % 3 = 0 THEN ' ' || term || '  ' ELSE t2 END AS term, CASE WHEN paper_id % 3 = 0 THEN 'Saved' ELSE e2 END AS explanation FROM (
  SELECT a.paper_id, a.term, arg_min(b.term, b.i) AS t2, arg_min(b.explanation, b.i) AS e2 FROM ai_terms a JOIN ai_terms b ON a.paper_id = b.paper_id AND lower(a.term) = lower(b.term) GROUP BY 1, 2)""", ("ai_terms",))
def _(lib):
    t = ai_terms(lib)
    looked = t.select("paper_id", F.concat(F.lit(" "), "term", F.lit("  ")).alias("word"))
    saved = t.where("paper_id % 3 = 0").select("paper_id", X.word_key("term").alias("key"), F.lit("Saved").alias("explanation")).distinct()
    return GD.term_entry(looked, t.where("paper_id % 3 <> 0"), saved)


@query("jn29_is_kept", "SELECT paper_id, h_id AS sentence_id FROM marks WHERE paper_id % 3 <> 0", ("marks",))
def _(lib):
    lines = lib.highlights().select("paper_id", F.col("h_id").alias("sentence_id"), F.lit(0).alias("line_ord"), "page", "x0", "x1", *[(F.col(c) + F.when(F.col("paper_id") % 3 == 0, 1000.0).otherwise(2.0)).alias(c) for c in ("y0", "y1")])
    return P.kept_sentences(lines, lib.highlights().withColumn("rect_ord", F.lit(0)))


@query("ag17_glossary", r"""
SELECT m.paper_id, h_id, trim(regexp_replace(exact, '[\s\p{Z}]+', ' ', 'g')) AS term, CASE WHEN m.paper_id % 7 <> 0 AND m.paper_id % 4 <> 0 THEN 'n-t' END AS note_id FROM marks m WHERE m.paper_id % 2 = 1""", ("marks",))
def _(lib):
    nodes, edges, _r = board(lib)
    h = lib.highlights().withColumn("tags", F.when(F.col("paper_id") % 2 == 1, F.array(F.lit("t-mine"))).otherwise(no_tags()))
    tags = lib.spark.createDataFrame([("t-mine", " Term "), ("t-question", "question")], "tag_id string, name string")
    return D.glossary(h, tags, edges, nodes)


@query("ag18_ai_glossary", "SELECT paper_id, i, term, explanation FROM ai_terms a WHERE NOT EXISTS (SELECT 1 FROM ai_terms b WHERE b.paper_id = a.paper_id AND b.i = 0 AND b.paper_id % 2 = 0 AND lower(b.term) = lower(a.term))", ("ai_terms",))
def _(lib):
    t = ai_terms(lib)
    return D.ai_glossary(t, t.where("i = 0 AND paper_id % 2 = 0").select("paper_id", "term"))


@query("ag19_term_cards")
def _(lib):
    from foliograph.plans.anchoring import found
    ranked = S.rank_definitions(found(lib), lib.page_text())
    terms = ranked.select("paper_id", F.col("query_id").alias("h_id")).distinct().withColumn("note_id", F.when(F.col("paper_id") % 2 == 0, "n-t"))
    ai = terms.where("paper_id % 3 = 0").select("paper_id", "h_id", F.when(F.col("paper_id") % 2 == 0, "the quoted sentence").alias("defined_in"), F.lit("in plain words").alias("explanation"))
    return D.term_cards(terms, ranked, ai)


@query("ag20_key_sentences", """
SELECT paper_id, slot, CASE slot WHEN 'Background' THEN 0 WHEN 'Problem' THEN 1 ELSE 4294967296 + i END AS slot_rank, i, quote, page FROM (
  SELECT paper_id, CASE i WHEN 0 THEN 'Gone' WHEN 1 THEN 'Problem' ELSE 'Background' END AS slot, i, quote, page FROM (SELECT paper_id, quote, page, unnest([0, 1, 2]) AS i FROM held_claims))""", ("held_claims",))
def _(lib):
    held = GD.ground(claims(lib), spans(lib))
    three = held.select("paper_id", "quote", "page", F.posexplode(F.array(F.lit("Gone"), F.lit("Problem"), F.lit("Background"))).alias("i", "slot")).withColumn("k", F.lit(1))
    return D.key_sentences(three, slots(lib)).select("paper_id", "slot", "slot_rank", "i", "quote", "page")
