"""Documents out: literature notes, paper text, prompts, glossaries, as ordered paragraphs.

A document is rows (paper_id, pos, text) where `pos` is a struct that sorts; nothing is gathered until `as_text`, and the
Markdown sink writes the rows sorted without gathering at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators.graph import both_ways, carries, connected_notes, paper_order, reader_layer_only, slot_of
from foliograph.operators.pieces import highlights_in
from foliograph.operators.spread import materialise
from foliograph.operators.words import CORNERS

LAST = 1 << 60
SELECTION_CHARS = 4000


def pos(*keys) -> Column:
    cols = [F.lit(k) if isinstance(k, int) else k for k in keys]
    cols += [F.lit(0)] * (7 - len(cols))
    return F.struct(*[c.cast("long").alias(f"k{i}") for i, c in enumerate(cols)]).alias("pos")


def as_text(paragraphs: DataFrame, sep: str = "\n\n", end: str = "\n") -> DataFrame:
    """One text per paper."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return paragraphs.groupBy("paper_id").agg(F.concat(F.array_join(F.transform(listed, lambda p: p["text"]), sep), F.lit(end)).alias("text"))


def paper_markdown(papers: DataFrame, sections: DataFrame, section_rects: DataFrame) -> DataFrame:
    """Text by section: the first is the title, the rest carry their level and pages."""
    pages = sections.select("paper_id", "section_id", "page").unionByName(section_rects.select("paper_id", "section_id", "page")).groupBy("paper_id", "section_id").agg(
        F.min("page").alias("a"), F.max("page").alias("b"))
    s = sections.join(pages, ["paper_id", "section_id"])
    head = F.when(F.col("ord") == 0, F.concat(F.lit("# "), "title")).otherwise(
        F.concat(F.expr("repeat('#', depth + 1)"), F.lit(" "), "title", F.lit(" ("), X.page_range(F.col("a"), F.col("b")), F.lit(")")))
    rows = s.select("paper_id", pos(F.col("ord"), 0), head.alias("text")).unionByName(
        s.where(X.strip_ws("text") != "").select("paper_id", pos(F.col("ord"), 1), X.ends_trimmed("text").alias("text")))
    bare = papers.join(sections.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", pos(0), F.concat(F.lit("# "), F.col("paper_id").cast("string")).alias("text"))
    return rows.unionByName(bare)


def export_paragraphs(papers: DataFrame, nodes: DataFrame, node_rects: DataFrame, highlights: DataFrame, edges: DataFrame, regions: DataFrame, tags: DataFrame,
                      wanted: Column, order: str = "paper", ids: bool = False) -> DataFrame:
    """The literature note: pieces in reading order (or by slot), each with its highlights and notes; then highlights outside
    any piece, then the remaining notes. A highlight and a note are written once, at their first place.

    `papers`: paper_id, title, goal. `nodes` also carry caption, clip, has_sketch. `highlights`: one row a line rect."""
    level = 2 if order == "paper" else 3
    first_box = F.min_by(F.struct("page", *CORNERS), "rect_ord")
    boxes = node_rects.groupBy("paper_id", "node_id").agg(first_box.alias("b")).select("paper_id", "node_id", "b.*")
    pieces = nodes.where(F.col("type").isin("chunk", "figure")).join(boxes, ["paper_id", "node_id"])
    rows = paper_order(pieces.select("paper_id", "node_id", "page", *CORNERS), regions, ["node_id"], "piece_row").select("paper_id", "node_id", "piece_row")
    home = None
    if order == "template":
        slots = nodes.select("paper_id", F.col("node_id").alias("slot_id"), F.col("ord").alias("slot_ord"), F.col("tags").alias("slot_tags"))
        home = slot_of(nodes).join(slots, ["paper_id", "slot_id"])
        rows = rows.join(home.select("paper_id", "node_id", "slot_ord"), ["paper_id", "node_id"], "left").withColumn("blk", F.coalesce("slot_ord", F.lit(LAST))).drop("slot_ord")
    else:
        rows = rows.withColumn("blk", F.lit(LAST))
    rows = materialise(rows)
    heads = highlights.groupBy("paper_id", "h_id").agg(F.min_by(F.struct("page", *CORNERS), "rect_ord").alias("b"), F.first("exact").alias("exact"), F.first("tags").alias("tags"))
    marks = materialise(paper_order(heads.select("paper_id", "h_id", "exact", "tags", "b.*"), regions, ["h_id"], "mark_row").select("paper_id", "h_id", "exact", "tags", "page", "mark_row"))
    held = materialise(highlights_in(highlights, node_rects.join(rows.select("paper_id", "node_id"), ["paper_id", "node_id"], "left_semi")))
    good_marks = marks.where(carries(F.col("tags"), wanted))
    by_mark = held.join(good_marks.select("paper_id", "h_id"), ["paper_id", "h_id"], "left_semi")
    shown = rows.join(pieces.where(carries(F.col("tags"), wanted)).select("paper_id", "node_id").unionByName(by_mark.select("paper_id", "node_id")).distinct(), ["paper_id", "node_id"], "left_semi")
    # Where each wanted highlight is first written.
    place = by_mark.join(shown, ["paper_id", "node_id"]).groupBy("paper_id", "h_id").agg(F.min(F.struct("blk", "piece_row")).alias("p"))
    loose = good_marks.join(held.select("paper_id", "h_id").distinct(), ["paper_id", "h_id"], "left_anti").select("paper_id", "h_id", "mark_row")
    at = place.join(good_marks, ["paper_id", "h_id"]).select("paper_id", "h_id", F.col("p.blk").alias("blk"), F.lit(2).alias("sec"), F.col("p.piece_row").alias("piece_row"), "mark_row").unionByName(
        loose.select("paper_id", "h_id", F.lit(LAST).alias("blk"), F.lit(3).alias("sec"), F.lit(0).cast("long").alias("piece_row"), "mark_row"))
    at = materialise(at)
    # Every place a note could be written; the first wins.
    content = nodes.where("type = 'note'").where((X.strip_ws(F.coalesce("text", F.lit(""))) != "") | F.col("has_sketch"))
    links = connected_notes(edges, nodes)
    under_mark = at.join(links, (at.paper_id == links.paper_id) & (at.h_id == links.item_id)).select(
        at.paper_id, "note_id", pos(F.col("blk"), F.col("sec"), F.col("piece_row"), 1, F.col("mark_row"), 2, F.col("edge_ord")))
    under_piece = shown.join(links, (shown.paper_id == links.paper_id) & (shown.node_id == links.item_id)).select(
        shown.paper_id, "note_id", pos(F.col("blk"), 2, F.col("piece_row"), 2, F.col("edge_ord")))
    rest = content.where(carries(F.col("tags"), wanted)).select("paper_id", F.col("node_id").alias("note_id"), pos(LAST, 4, F.col("ord")))
    places = under_mark.unionByName(under_piece).unionByName(rest)
    if home is not None:
        in_slot = content.join(home, ["paper_id", "node_id"]).where(carries(F.col("tags"), wanted) | carries(F.col("slot_tags"), wanted))
        places = places.unionByName(in_slot.select("paper_id", F.col("node_id").alias("note_id"), pos(F.col("slot_ord"), 1, F.col("ord"))))
    notes = materialise(places.groupBy("paper_id", "note_id").agg(F.min("pos").alias("pos")).join(content.select("paper_id", F.col("node_id").alias("note_id"), "text", "origin", "has_sketch"), ["paper_id", "note_id"]))

    def comment(id_col: Column) -> Column:
        return F.when(F.lit(ids), F.concat(F.lit("<!-- id: "), id_col, F.lit(" -->")))

    def paras(df: DataFrame, *texts: Column) -> DataFrame:
        """Rows of one place, in order; nulls left out."""
        return (df.select("paper_id", "pos", F.posexplode(F.array(*texts)).alias("k", "text")).where("text IS NOT NULL")
                .select("paper_id", F.struct(F.col("pos"), F.col("k")).alias("pos"), "text"))

    names = tags.agg(F.map_from_entries(F.collect_list(F.struct("tag_id", "name"))).alias("m")).scalar()
    page_of = F.concat(F.lit("p. "), (F.col("page") + 1).cast("string"))
    title = X.piece_title(F.col("type"), F.col("node_id"), F.col("caption"), F.col("text"), F.col("text"))
    piece_rows = shown.join(pieces, ["paper_id", "node_id"]).withColumn("_title", title).withColumn("pos", pos(F.col("blk"), 2, F.col("piece_row"), 0))
    figure = F.col("type") == "figure"
    out = paras(piece_rows, F.concat(F.lit("#" * level + " "), "_title", F.lit(" ("), page_of, F.lit(")")), comment(F.col("node_id")),
                F.when(figure & F.col("clip").isNotNull(), F.concat(F.lit("!["), "_title", F.lit("]("), "clip", F.lit(")"))),
                F.when(figure & (X.strip_ws(F.coalesce("caption", F.lit(""))) != ""), X.ends_trimmed("caption")))
    quoted = F.array_join(F.transform(F.split(X.ends_trimmed("exact"), r"\r\n|\r|\n"), lambda ln: F.rtrim(F.concat(F.lit("> "), ln))), "\n")
    mark_rows = at.join(marks.drop("mark_row"), ["paper_id", "h_id"]).withColumn("_names", names).withColumn("pos", pos(F.col("blk"), F.col("sec"), F.col("piece_row"), 1, F.col("mark_row"), 1))
    called = F.array_join(F.filter(F.transform("tags", lambda t: F.col("_names")[t]), lambda n: n.isNotNull()), ", ")
    meta = F.array_join(F.filter(F.array(F.when(F.col("sec") == 3, page_of), F.nullif(called, F.lit(""))), lambda m: m.isNotNull()), " · ")
    out = out.unionByName(paras(mark_rows, quoted, F.when(meta != "", F.concat(F.lit("*"), meta, F.lit("*"))), comment(F.col("h_id"))))
    body = X.ends_trimmed(F.coalesce("text", F.lit("")))
    out = out.unionByName(paras(notes, F.when(F.col("has_sketch"), F.concat(F.lit("![sketch](notes/"), "note_id", F.lit(".svg)"))),
                                F.when(body != "", F.when(F.col("origin") == "ai", F.concat(F.lit("**AI:** "), body)).otherwise(body)), comment(F.col("note_id"))))
    some = lambda df: df.select("paper_id").distinct()
    out = out.unionByName(paras(some(loose).withColumn("pos", pos(LAST, 3, -1)), F.lit("#" * level + " Highlights outside any chunk")))
    last_notes = notes.where((F.col("pos.k0") == LAST) & (F.col("pos.k1") == 4))
    out = out.unionByName(paras(some(last_notes).withColumn("pos", pos(LAST, 4, -1)), F.lit("#" * level + " Notes")))
    out = out.unionByName(paras(papers.withColumn("pos", pos(-1)), F.concat(F.lit("# "), "title"), F.when(X.strip_ws(F.coalesce("goal", F.lit(""))) != "", F.concat(F.lit("*Reading goal: "), X.ends_trimmed("goal"), F.lit("*")))))
    if home is not None:
        slots = nodes.where("type = 'group' AND prompt IS NOT NULL AND prompt <> ''").withColumn("pos", pos(F.col("ord"), 0))
        out = out.unionByName(paras(slots, F.rtrim(F.concat(F.lit("## "), F.coalesce("name", F.lit("")))), F.concat(F.lit("*"), X.ends_trimmed("prompt"), F.lit("*"))))
        tail = some(shown.where(F.col("blk") == LAST)).unionByName(some(loose)).unionByName(some(last_notes)).distinct()
        out = out.unionByName(paras(tail.withColumn("pos", pos(LAST, 0)), F.lit("## Not in a slot")))
    return out


def board_paragraphs(papers, nodes, node_rects, highlights, edges, regions, tags) -> DataFrame:
    """The reader's own layer in paper order, every id as a comment."""
    mine, links = reader_layer_only(nodes, edges)
    return export_paragraphs(papers, mine, node_rects, highlights, links, regions, tags, F.array().cast("array<string>"), "paper", ids=True)


def tag_names(tags: DataFrame) -> Column:
    return tags.agg(F.map_from_entries(F.collect_list(F.struct("tag_id", "name"))).alias("m")).scalar()


def reader_layer(boards: DataFrame, nodes: DataFrame, edges: DataFrame, highlights: DataFrame, tags: DataFrame) -> DataFrame:
    """The reader's marks as tagged, escaped lines: goal, highlights, notes with connections, edges, groups with members.
    `boards`: paper_id, goal. `highlights`: one row a mark, with ord."""
    mine, links = reader_layer_only(nodes, edges)
    names = lambda col: X.escaped_attr(F.array_join(F.transform(col, lambda t: F.coalesce(F.col("_names")[t], t)), ", "))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text")
    out = boards.select("paper_id", pos(-1), F.lit("<reader>").alias("text")).unionByName(boards.select("paper_id", pos(0), say("<goal>", X.escaped(F.coalesce("goal", F.lit(""))), "</goal>")))
    h = highlights.withColumn("_names", tag_names(tags)).select("paper_id", pos(1, F.col("ord")), say('<highlight id="', F.col("h_id"), '" tags="', names(F.col("tags")), '">', X.escaped(F.col("exact")), "</highlight>"))
    ends = both_ways(links).groupBy("paper_id", F.col("end_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "edge_id", "other_id"))), lambda s: s["other_id"]), ", ").alias("ends"))
    n = mine.where("type = 'note'").join(ends, ["paper_id", "node_id"], "left").select("paper_id", pos(2, F.col("ord")), say(
        '<note id="', F.col("node_id"), '" connected="', X.escaped_attr(F.coalesce("ends", F.lit(""))), '">', X.escaped(F.coalesce("text", F.lit(""))), "</note>"))
    e = links.withColumn("_names", tag_names(tags)).select("paper_id", pos(3, F.col("ord")), say('<connection from="', F.col("from_id"), '" to="', F.col("to_id"), '" tags="', names(F.col("tags")), '"/>'))
    kids = mine.where("parent_id IS NOT NULL").groupBy("paper_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda s: s["node_id"]), ", ").alias("members"))
    g = mine.where("type = 'group'").join(kids, ["paper_id", "node_id"]).select("paper_id", pos(4, F.col("ord")), say(
        '<group id="', F.col("node_id"), '" name="', X.escaped_attr(F.coalesce("name", F.lit(""))), '" members="', X.escaped_attr(F.col("members")), '"/>'))
    end = boards.select("paper_id", pos(5), F.lit("</reader>").alias("text"))
    return out.unionByName(h).unionByName(n).unionByName(e).unionByName(g).unionByName(end)


def clip_selection(text: Column) -> Column:
    return F.when(F.length(text) <= SELECTION_CHARS, text).otherwise(F.concat(F.substring(text, 1, SELECTION_CHARS - 1), F.lit("…")))


def spans_block(spans: DataFrame) -> DataFrame:
    """Spans as tagged, escaped lines."""
    return spans.select("paper_id", pos(0, F.col("ord")), F.concat(F.lit('<span id="'), "span_id", F.lit('">'), X.escaped(F.col("text")), F.lit("</span>")).alias("text"))


def pass_prompts(spans: DataFrame, slots: DataFrame) -> DataFrame:
    """One prompt a paper: its spans, then the slot names."""
    names = slots.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]), ", ").alias("n")).scalar()
    return as_text(spans_block(spans), "\n", "").withColumn("_n", names).select("paper_id", F.concat("text", F.lit("\n\nSlots: "), "_n").alias("prompt"))


def define_prompts(requests: DataFrame, context: DataFrame, spans: DataFrame, likely: DataFrame) -> DataFrame:
    """One prompt a request: the spans near the word, the likely sentence when there is one, the word."""
    line = F.concat(F.lit('<span id="'), "span_id", F.lit('">'), X.escaped(F.col("text")), F.lit("</span>"))
    block = context.join(spans, ["paper_id", "span_id"]).groupBy("paper_id", "request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda s: s["l"]), "\n").alias("_b"))
    j = requests.join(block, ["paper_id", "request_id"]).join(likely, ["paper_id", "request_id"], "left")
    hint = F.when(F.col("sentence").isNotNull(), F.concat(F.lit("\n\nLikely definition in the paper: <likely>"), X.escaped(F.col("sentence")), F.lit("</likely>"))).otherwise("")
    return j.select("paper_id", "request_id", F.concat("_b", hint, F.lit("\n\nWord: <word>"), X.escaped(F.col("word")), F.lit("</word>")).alias("prompt"))


def ask_prompts(questions: DataFrame, spans: DataFrame, layer: DataFrame, history: DataFrame) -> DataFrame:
    """One prompt a question: spans, the reader's layer, the kept chat, the clipped selection, the question. `questions`:
    paper_id, question, selection. `history`: kept turns (paper_id, line_no, question, answer)."""
    turn = F.concat(F.lit("<turn><asked>"), X.escaped(F.col("question")), F.lit("</asked><answered>"), X.escaped(F.col("answer")), F.lit("</answered></turn>"))
    turns = as_text(history.select("paper_id", pos(F.col("line_no")), turn.alias("text")), "\n", "").select("paper_id", F.concat(F.lit("<history>\n"), "text", F.lit("\n</history>")).alias("_h"))
    block = as_text(spans_block(spans), "\n", "").withColumnRenamed("text", "_s")
    marks = as_text(layer, "\n", "").withColumnRenamed("text", "_l")
    j = questions.join(block, "paper_id", "left").join(marks, "paper_id", "left").join(turns, "paper_id", "left")
    chosen = F.when(F.coalesce("selection", F.lit("")) != "", F.concat(F.lit("<selection>"), X.escaped(clip_selection(F.col("selection"))), F.lit("</selection>")))
    asked = F.concat(F.lit("<question>"), X.escaped(F.col("question")), F.lit("</question>"))
    return j.select("paper_id", F.concat_ws("\n\n", F.coalesce("_s", F.lit("")), "_l", "_h", chosen, asked).alias("prompt"))


# -- glossaries --------------------------------------------------------------------


def term_tags(tags: DataFrame) -> DataFrame:
    return tags.where((F.col("tag_id") == "t-term") | (F.lower(F.trim("name")) == "term")).select("tag_id")


def glossary(highlights: DataFrame, tags: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Highlights marked as a term, with the reader's first note on each; sorted alphabetically within a paper."""
    ids = term_tags(tags).agg(F.collect_set("tag_id").alias("t")).scalar()
    terms = highlights.withColumn("_ids", ids).where(F.arrays_overlap("tags", "_ids")).select("paper_id", "h_id", X.flat("exact").alias("term"))
    first = connected_notes(edges, nodes).where("origin = 'reader'").groupBy("paper_id", F.col("item_id").alias("h_id")).agg(F.min_by("note_id", "note_ord").alias("note_id"))
    return terms.join(first, ["paper_id", "h_id"], "left").orderBy("paper_id", F.collate("term", "UNICODE_CI_AI"), "h_id")


def ai_glossary(ai_terms: DataFrame, kept: DataFrame) -> DataFrame:
    """The pass's terms the reader has not kept. `kept`: paper_id, term."""
    have = kept.select("paper_id", X.word_key("term").alias("_k")).distinct()
    return ai_terms.withColumn("_k", X.word_key("term")).join(have, ["paper_id", "_k"], "left_anti").drop("_k").orderBy("paper_id", F.collate("term", "UNICODE_CI_AI"), "i")


def term_cards(terms: DataFrame, ranked: DataFrame, ai: DataFrame) -> DataFrame:
    """Ordered parts of each term's card: the reader's note, the definition in the paper (the pass's own, else the best
    likely sentence), the pass's explanation. `terms`: paper_id, h_id, note_id; `ranked`: rank_definitions with
    query_id = h_id; `ai`: paper_id, h_id, defined_in, explanation."""
    best = ranked.where("rank = 0 AND likely").select("paper_id", F.col("query_id").alias("h_id"), F.trim(F.concat("s_before", "match", "s_after")).alias("sentence"))
    j = terms.join(best, ["paper_id", "h_id"], "left").join(ai, ["paper_id", "h_id"], "left")
    part = lambda kind, col: F.when(col.isNotNull() & (col != ""), F.struct(F.lit(kind).alias("kind"), col.alias("text")))
    parts = F.array_compact(F.array(part("note", F.col("note_id")), part("definition", F.coalesce("defined_in", "sentence")), part("ai", F.col("explanation"))))
    return j.select("paper_id", "h_id", F.posexplode(parts).alias("part", "p")).select("paper_id", "h_id", "part", "p.kind", "p.text")


def key_sentences(slot_spans: DataFrame, slots: DataFrame) -> DataFrame:
    """Sentences grouped by slot in template order, unknown slots after, in the order first seen. `slot_spans`: paper_id, i,
    slot, k, quote, page."""
    known = slots.select(F.col("name").alias("slot"), F.col("ord").cast("long").alias("_o"))
    seen = slot_spans.groupBy("paper_id", "slot").agg(F.min("i").alias("_seen"))
    ranked = seen.join(known, "slot", "left").withColumn("slot_rank", F.coalesce("_o", F.lit(1 << 32) + F.col("_seen"))).select("paper_id", "slot", "slot_rank")
    return slot_spans.join(ranked, ["paper_id", "slot"]).select("paper_id", "slot", "slot_rank", "i", "k", "quote", "page")
