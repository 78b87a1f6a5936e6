"""The annotation graph: hierarchy, connections, edits.

`nodes`: paper_id, node_id, ord, type, parent_id, tags, name, prompt, tray, origin, text. `edges`: paper_id, edge_id, ord,
from_id, to_id (undirected). Only groups have children, so closures are walked over groups alone and every other node
joins the finished closure once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.functions.rects import area, rect
from foliograph.operators.layout import reading_position, section_at
from foliograph.operators.pieces import highlights_in
from foliograph.operators.spread import materialise, page_numbering
from foliograph.operators.words import CORNERS



def ancestors(nodes: DataFrame) -> DataFrame:
    """(paper_id, node_id, ancestor_id, depth): every group above a node, nearest first. A cycle ends where it closes.

    Known paths double: a round puts the paths of up to 2**k steps behind every path of exactly 2**k, so a chain of n groups
    takes log2(n) rounds. On a cycle paths never end; there only the shortest to each group counts, and the rounds are over
    when they bring no new pair."""
    groups = nodes.where("type = 'group'").select("paper_id", "node_id", "parent_id")
    up = groups.where("parent_id IS NOT NULL").join(groups.select("paper_id", F.col("node_id").alias("parent_id")), ["paper_id", "parent_id"], "left_semi")
    done = materialise(up.select("paper_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")))
    far, reach, round_, ring = done, 1, 0, False
    pairs = done.count()
    while pairs:
        round_ += 1
        ends = far.select("paper_id", "node_id", F.col("ancestor_id").alias("via"))
        beyond = ends.join(done.withColumnRenamed("node_id", "via"), ["paper_id", "via"]).select("paper_id", "node_id", "ancestor_id", (F.col("depth") + reach).alias("depth"))
        beyond = materialise(beyond)
        far = materialise(beyond.where(F.col("depth") == 2 * reach))
        ring = ring or not beyond.where("node_id = ancestor_id").isEmpty()
        both = done.unionByName(beyond)
        if ring:
            both = both.where("node_id <> ancestor_id").groupBy("paper_id", "node_id", "ancestor_id").agg(F.min("depth").alias("depth"))
        done, reach = materialise(both), 2 * reach
        before, pairs = pairs, done.count()
        if pairs == before and not (ring and round_ == 1):
            break
    leaves = nodes.where("type <> 'group' AND parent_id IS NOT NULL").select("paper_id", "node_id", "parent_id")
    own = leaves.join(groups.select("paper_id", F.col("node_id").alias("parent_id")), ["paper_id", "parent_id"], "left_semi").select(
        "paper_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    far = leaves.join(done.withColumnRenamed("node_id", "parent_id"), ["paper_id", "parent_id"]).select("paper_id", "node_id", "ancestor_id", (F.col("depth") + 1).alias("depth"))
    return done.unionByName(own).unionByName(far)


def _closure(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """What `ancestors` gives, made only where the caller has not made it."""
    return ancestors(nodes) if above is None else above


def slot_of(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """The nearest enclosing group with a prompt."""
    slots = nodes.where("type = 'group' AND prompt IS NOT NULL AND prompt <> ''").select("paper_id", F.col("node_id").alias("ancestor_id"))
    up = _closure(nodes, above)
    return up.join(slots, ["paper_id", "ancestor_id"]).groupBy("paper_id", "node_id").agg(F.min_by("ancestor_id", "depth").alias("slot_id"))


def in_tray(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Nodes inside a tray group at any depth."""
    trays = nodes.where("type = 'group' AND tray").select("paper_id", F.col("node_id").alias("ancestor_id"))
    return _closure(nodes, above).join(trays, ["paper_id", "ancestor_id"], "left_semi").select("paper_id", "node_id").distinct()


def absolute_positions(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """A node's position plus that of every ancestor."""
    at = nodes.select("paper_id", F.col("node_id").alias("ancestor_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    over = _closure(nodes, above).join(at, ["paper_id", "ancestor_id"]).groupBy("paper_id", "node_id").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    zero = F.lit(0.0)
    return nodes.join(over, ["paper_id", "node_id"], "left").select(
        "paper_id", "node_id", (F.col("x") + F.coalesce("_x", zero)).alias("abs_x"), (F.col("y") + F.coalesce("_y", zero)).alias("abs_y"))


def carries(tags: Column, active: Column) -> Column:
    """No active tag passes all; else any in common."""
    return (F.size(active) == 0) | F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), active)


def hidden_nodes(nodes: DataFrame, active: Column, held: DataFrame | None = None, highlights: DataFrame | None = None,
                 above: DataFrame | None = None) -> DataFrame:
    """Nodes a tag filter hides: without an active tag, without a marked highlight inside, without a shown descendant.
    `held`: (paper_id, node_id, h_id)."""
    shown = nodes.where(carries(F.col("tags"), active)).select("paper_id", "node_id")
    if held is not None and highlights is not None:
        marked = highlights.where(carries(F.col("tags"), active)).select("paper_id", "h_id")
        shown = shown.unionByName(held.join(marked, ["paper_id", "h_id"], "left_semi").select("paper_id", "node_id"))
    up = _closure(nodes, above).join(shown.distinct(), ["paper_id", "node_id"], "left_semi").select("paper_id", F.col("ancestor_id").alias("node_id"))
    return nodes.select("paper_id", "node_id").join(shown.unionByName(up).distinct(), ["paper_id", "node_id"], "left_anti")


def parents_first(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Sort keys (first_ord, depth, ord) under which each parent comes before its children, otherwise stable."""
    up = _closure(nodes, above)
    own = nodes.select("paper_id", "node_id", "ord")
    below = up.join(own, ["paper_id", "node_id"]).groupBy("paper_id", F.col("ancestor_id").alias("node_id")).agg(F.min("ord").alias("_below"))
    depth = up.groupBy("paper_id", "node_id").agg(F.max("depth").alias("depth"))
    return own.join(below, ["paper_id", "node_id"], "left").join(depth, ["paper_id", "node_id"], "left").select(
        "paper_id", "node_id", F.least("ord", "_below").alias("first_ord"), F.coalesce("depth", F.lit(0)).alias("depth"), "ord")


# -- connections -------------------------------------------------------------------


def both_ways(edges: DataFrame) -> DataFrame:
    """(paper_id, end_id, other_id, edge_id, ord): each edge from both of its ends."""
    pair = F.array(F.struct(F.col("from_id").alias("end_id"), F.col("to_id").alias("other_id")), F.struct(F.col("to_id").alias("end_id"), F.col("from_id").alias("other_id")))
    return edges.select("paper_id", "edge_id", "ord", F.explode(pair).alias("p")).select("paper_id", "p.end_id", "p.other_id", "edge_id", "ord")


def connected_notes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Notes linked to each item, each once, with the order of the first edge and of the note."""
    notes = nodes.where("type = 'note'").select("paper_id", F.col("node_id").alias("other_id"), F.col("ord").alias("note_ord"), "origin")
    return (both_ways(edges).join(notes, ["paper_id", "other_id"]).groupBy("paper_id", F.col("end_id").alias("item_id"), F.col("other_id").alias("note_id"))
            .agg(F.min("ord").alias("edge_ord"), F.first("note_ord").alias("note_ord"), F.first("origin").alias("origin")))


def pair_key() -> Column:
    return F.struct(F.least("from_id", "to_id"), F.greatest("from_id", "to_id"))


def new_connections(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that are no self edge and no second edge between a pair; the first of several wins."""
    fresh = candidates.where("from_id <> to_id").withColumn("_k", pair_key()).join(edges.select("paper_id", pair_key().alias("_k")).distinct(), ["paper_id", "_k"], "left_anti")
    rest = F.struct("edge_id", "from_id", "to_id", "ord")
    return fresh.groupBy("paper_id", "_k").agg(F.min_by(rest, F.struct("ord", "edge_id")).alias("e")).select("paper_id", "e.*")


def reshape(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after chunks were replaced (`mapping`: paper_id, old_id, keep_id): ends rewired, self and repeated edges dropped."""
    m = mapping.select("paper_id", F.col("old_id").alias("from_id"), F.col("keep_id").alias("_f"))
    t = mapping.select("paper_id", F.col("old_id").alias("to_id"), F.col("keep_id").alias("_t"))
    moved = edges.join(m, ["paper_id", "from_id"], "left").join(t, ["paper_id", "to_id"], "left").select(
        "paper_id", "edge_id", "ord", F.coalesce("_f", "from_id").alias("from_id"), F.coalesce("_t", "to_id").alias("to_id"))
    return moved.where("from_id <> to_id").withColumn("_k", pair_key()).groupBy("paper_id", "_k").agg(
        F.min_by(F.struct("edge_id", "from_id", "to_id", "ord"), F.struct("ord", "edge_id")).alias("e")).select("paper_id", "e.*")


def remove_items(nodes: DataFrame, edges: DataFrame, removals: DataFrame, above: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after deleting ids. Children of a removed group move to the nearest surviving ancestor and keep their
    place on the board; edges touching a removed end go."""
    gone = removals.select("paper_id", F.col("id").alias("node_id")).distinct()
    kept = nodes.join(gone, ["paper_id", "node_id"], "left_anti")
    orphans = kept.join(gone.withColumnRenamed("node_id", "parent_id"), ["paper_id", "parent_id"], "left_semi").select("paper_id", "node_id")
    above = _closure(nodes, above)
    home = (above.join(orphans, ["paper_id", "node_id"], "left_semi").join(gone.withColumnRenamed("node_id", "ancestor_id"), ["paper_id", "ancestor_id"], "left_anti")
            .groupBy("paper_id", "node_id").agg(F.min_by("ancestor_id", "depth").alias("new_parent")))
    at = materialise(absolute_positions(nodes, above))
    lifted = (orphans.join(home, ["paper_id", "node_id"], "left").join(at, ["paper_id", "node_id"])
              .join(at.select("paper_id", F.col("node_id").alias("new_parent"), F.col("abs_x").alias("px"), F.col("abs_y").alias("py")), ["paper_id", "new_parent"], "left")
              .select("paper_id", "node_id", "new_parent", (F.col("abs_x") - F.coalesce("px", F.lit(0.0))).alias("nx"), (F.col("abs_y") - F.coalesce("py", F.lit(0.0))).alias("ny"), F.lit(True).alias("lifted")))
    moved = kept.join(lifted, ["paper_id", "node_id"], "left")
    out = moved.select(*[(F.when(F.col("lifted"), F.col({"parent_id": "new_parent", "x": "nx", "y": "ny"}[c])).otherwise(F.col(c)).alias(c)
                          if c in ("parent_id", "x", "y") else F.col(c)) for c in nodes.columns])
    ends = removals.select("paper_id", F.col("id").alias("from_id")).distinct()
    left = (edges.join(ends, ["paper_id", "from_id"], "left_anti").join(ends.withColumnRenamed("from_id", "to_id"), ["paper_id", "to_id"], "left_anti")
            .join(removals.select("paper_id", F.col("id").alias("edge_id")).distinct(), ["paper_id", "edge_id"], "left_anti"))
    return out, left


def apply_tags(items: DataFrame, changes: DataFrame, tags: DataFrame) -> DataFrame:
    """Retag: `main` replaces the first tag (an empty one drops it), `add` is appended; unknown tag ids are ignored. `items`:
    paper_id, id, tags; `changes`: paper_id, id, main, add."""
    known = tags.agg(F.collect_set("tag_id").alias("k")).scalar()   # the tag file is a handful of rows
    none = F.array().cast("array<string>")
    j = items.join(changes, ["paper_id", "id"], "left")
    extras = F.filter(F.slice("tags", 2, F.size("tags")), lambda t: ~t.eqNullSafe(F.col("main")))
    main = F.when(F.col("main").isNull(), F.col("tags")).when(F.col("main") == "", extras).otherwise(F.concat(F.array("main"), extras))
    every = F.array_distinct(F.concat(main, F.coalesce("add", none)))
    return j.withColumn("_known", known).select("paper_id", "id", F.filter(every, lambda t: F.array_contains("_known", t)).alias("tags"))


def piece_of_quote(pieces: DataFrame, quotes: DataFrame) -> DataFrame:
    """The first piece whose text holds the quote's first 40 characters, else the middle of three, else the first.
    `pieces`: paper_id, chunk_id, piece_ord (from 0), text."""
    needle = F.substring(X.flat("exact"), 1, 40)
    q = quotes.select("paper_id", "chunk_id", needle.alias("_n"))
    j = pieces.join(q, ["paper_id", "chunk_id"])
    return j.groupBy("paper_id", "chunk_id").agg(F.min(F.when(F.contains(X.flat("text"), F.col("_n")), F.col("piece_ord"))).alias("_f"), F.count("*").alias("_c")).select(
        "paper_id", "chunk_id", F.coalesce("_f", F.when(F.col("_c") == 3, 1).otherwise(0)).cast("long").alias("piece_ord"))


def chunk_holder(highlight_rects: DataFrame, nodes: DataFrame, node_rects: DataFrame) -> DataFrame:
    """The one chunk that draws a highlight: outside the tray first, then the least total area, then board order."""
    chunks = nodes.where("type = 'chunk'").select("paper_id", "node_id", "ord")
    size = node_rects.groupBy("paper_id", "node_id").agg(F.sum(area(rect())).alias("area"))
    tray = in_tray(nodes).withColumn("tray", F.lit(1))
    held = highlights_in(highlight_rects, node_rects).join(chunks, ["paper_id", "node_id"]).join(size, ["paper_id", "node_id"]).join(tray, ["paper_id", "node_id"], "left")
    return held.groupBy("paper_id", "h_id").agg(F.min_by("node_id", F.struct(F.coalesce("tray", F.lit(0)), "area", "ord")).alias("node_id"))


def resolve_edges(edges: DataFrame, nodes: DataFrame, holders: DataFrame) -> DataFrame:
    """Each edge drawn between nodes: a highlight's end is its holder's. Unresolved edges go; when only the far end is a
    highlight the ends are swapped."""
    own = nodes.select("paper_id", "node_id")

    def end(df: DataFrame, col: str, out: str) -> DataFrame:
        n = own.select("paper_id", F.col("node_id").alias(col), F.lit(True).alias(f"{out}_own"))
        h = holders.select("paper_id", F.col("h_id").alias(col), F.col("node_id").alias(f"{out}_held"))
        j = df.join(n, ["paper_id", col], "left").join(h, ["paper_id", col], "left")
        return j.withColumn(out, F.when(F.col(f"{out}_own"), F.col(col)).otherwise(F.col(f"{out}_held"))).withColumn(
            f"{out}_handle", F.when(F.col(f"{out}_own").isNull() & F.col(f"{out}_held").isNotNull(), F.col(col)))

    j = end(end(edges, "from_id", "a"), "to_id", "b").where("a IS NOT NULL AND b IS NOT NULL")
    swap = F.col("b_handle").isNotNull() & F.col("a_handle").isNull()
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return j.select("paper_id", "edge_id", pick("a", "b").alias("source"), pick("a_handle", "b_handle").alias("source_handle"), pick("b", "a").alias("target"), pick("b_handle", "a_handle").alias("target_handle"))


def connection_labels(edges: DataFrame, highlights: DataFrame, nodes: DataFrame, node_rects: DataFrame, sections: DataFrame, section_rects: DataFrame) -> DataFrame:
    """For each highlight and edge, the other end as a note or as a chip "→ §3 first three words"."""
    marks = highlights.select("paper_id", F.col("h_id").alias("id"), "page", *CORNERS, F.col("exact").alias("words"), F.lit("highlight").alias("kind"))
    first = node_rects.groupBy("paper_id", "node_id").agg(F.min_by(F.struct("page", *CORNERS), "rect_ord").alias("b"))
    things = nodes.join(first, ["paper_id", "node_id"], "left").select("paper_id", F.col("node_id").alias("id"), "b.page", *[F.col(f"b.{c}").alias(c) for c in CORNERS],
                                                                      F.when(F.col("type") == "group", F.col("name")).otherwise(F.col("text")).alias("words"), F.col("type").alias("kind"))
    every = marks.unionByName(things)
    placed = section_at(every.where("x0 IS NOT NULL"), section_rects, ["id"]).join(sections.select("paper_id", "section_id", "number", "title"), ["paper_id", "section_id"])
    named = every.join(placed.select("paper_id", "id", X.section_ref(F.col("number"), F.col("title")).alias("ref")), ["paper_id", "id"], "left")
    arrow = F.lit("→ ")
    chip = (F.when(F.col("kind") == "group", F.concat(arrow, F.when(F.coalesce("words", F.lit("")) == "", "a group").otherwise(F.col("words"))))
            .when(F.col("kind") != "note", F.concat(arrow, F.when(F.col("ref").isNull(), "").otherwise(F.concat("ref", F.lit(" "))), X.first_words(F.coalesce("words", F.lit(""))))))
    ends = both_ways(edges).join(highlights.select("paper_id", F.col("h_id").alias("end_id")), ["paper_id", "end_id"], "left_semi")
    return ends.join(named.select("paper_id", F.col("id").alias("other_id"), "kind", chip.alias("label")), ["paper_id", "other_id"]).select(
        "paper_id", F.col("end_id").alias("h_id"), "edge_id", "other_id", "kind", "label")


def unanswered_questions(highlights: DataFrame, nodes: DataFrame, edges: DataFrame, tag: str = "t-question") -> DataFrame:
    """Items tagged as a question with no edge to a reader's note that says something."""
    answers = nodes.where((F.col("type") == "note") & (F.col("origin") == "reader") & (X.strip_ws(F.coalesce("text", F.lit(""))) != "")).select("paper_id", F.col("node_id").alias("other_id"))
    answered = both_ways(edges).join(answers, ["paper_id", "other_id"], "left_semi").select("paper_id", F.col("end_id").alias("id")).distinct()
    said = F.when(F.col("type") == "group", F.coalesce("name", F.lit(""))).when(F.col("type") == "note", F.coalesce(F.get(X.kept_lines(F.col("text")), F.lit(0)), F.lit(""))).otherwise(F.col("text"))
    asked = highlights.where(F.array_contains("tags", tag)).select("paper_id", F.col("h_id").alias("id"), F.lit("highlight").alias("kind"), F.col("exact").alias("text")).unionByName(
        nodes.where(F.array_contains("tags", tag)).select("paper_id", F.col("node_id").alias("id"), F.col("type").alias("kind"), said.alias("text")))
    return asked.join(answered, ["paper_id", "id"], "left_anti")


TRAY_PAD, TRAY_TOP, TRAY_STEP = 20, 48, 44


def paper_order(items: DataFrame, regions: DataFrame, keys: list[str], out: str = "row") -> DataFrame:
    """Items numbered in reading order: page, region position (unknown last), top, left, then id."""
    placed = reading_position(items, regions, keys)
    return page_numbering(placed, ["paper_id"], [F.asc_nulls_last("region_ord"), F.col("y0"), F.col("x0"), *[F.col(k) for k in keys]], out)


def missing_pieces(sections: DataFrame, section_rects: DataFrame, figures: DataFrame, regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sections and figures not yet on the board, in paper order, each at its own row among all pieces."""
    first = section_rects.groupBy("paper_id", "section_id").agg(F.min_by(F.struct("page", *CORNERS), "run_ord").alias("b"))
    secs = sections.select("paper_id", "section_id").join(first, ["paper_id", "section_id"]).select("paper_id", F.col("section_id").alias("source_id"), F.lit("chunk").alias("type"), "b.*")
    figs = figures.select("paper_id", F.col("figure_id").alias("source_id"), F.lit("figure").alias("type"), "page", *CORNERS)
    rows = paper_order(secs.unionByName(figs), regions, ["source_id"])
    have = nodes.where("source_id IS NOT NULL").select("paper_id", "source_id").distinct()
    return rows.join(have, ["paper_id", "source_id"], "left_anti").select("paper_id", "source_id", "type", "row", F.lit(TRAY_PAD).alias("x"), (F.lit(TRAY_TOP) + F.col("row") * TRAY_STEP).alias("y"))


def ghost_rows(sections: DataFrame, section_rects: DataFrame, figures: DataFrame, regions: DataFrame, nodes: DataFrame, highlights: DataFrame, edges: DataFrame) -> DataFrame:
    """Per section whose chunk is not a tray's child: where its chunk is, its marks and its notes."""
    tray = nodes.where("type = 'group' AND tray").select("paper_id", F.col("node_id").alias("parent_id"))
    inside = nodes.where("type = 'chunk' AND source_id IS NOT NULL").join(tray, ["paper_id", "parent_id"], "left_semi").select("paper_id", F.col("source_id").alias("section_id"))
    shown = sections.join(inside, ["paper_id", "section_id"], "left_anti")
    chunk = nodes.where("type = 'chunk'").groupBy("paper_id", F.col("source_id").alias("section_id")).agg(F.min_by(F.struct("node_id", "parent_id"), "ord").alias("c"))
    groups = nodes.where("type = 'group'").select("paper_id", F.col("node_id").alias("parent_id"), F.col("name").alias("group_name"), F.lit(True).alias("is_group"))
    held = highlights_in(highlights, section_rects.withColumnRenamed("section_id", "node_id")).select("paper_id", F.col("node_id").alias("section_id"), "h_id")
    marks = held.groupBy("paper_id", "section_id").agg(F.count("*").alias("marks"))
    at = materialise(shown.join(chunk, ["paper_id", "section_id"], "left").select("paper_id", "section_id", "ord", "number", "title", "c.node_id", "c.parent_id"))
    things = held.select("paper_id", "section_id", F.col("h_id").alias("item_id")).unionByName(at.where("node_id IS NOT NULL").select("paper_id", "section_id", F.col("node_id").alias("item_id")))
    notes = things.join(connected_notes(edges, nodes), ["paper_id", "item_id"]).groupBy("paper_id", "section_id").agg(F.count_distinct("note_id").alias("notes"))
    every = missing_pieces(sections, section_rects, figures, regions, nodes.where("false")).where("type = 'chunk'").select("paper_id", F.col("source_id").alias("section_id"), "row")
    j = (at.join(groups, ["paper_id", "parent_id"], "left").join(marks, ["paper_id", "section_id"], "left").join(notes, ["paper_id", "section_id"], "left").join(every, ["paper_id", "section_id"], "left"))
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    where = (F.when(F.col("node_id").isNull(), "not on the board").when(F.col("is_group"), F.concat(F.lit("→ in "), F.when(F.coalesce("group_name", F.lit("")) == "", "a group").otherwise(F.col("group_name")))).otherwise("→ on the board"))
    zero = F.lit(0).cast("long")
    return j.select("paper_id", "section_id", (F.lit(TRAY_TOP) + F.col("row") * TRAY_STEP).alias("y"), "node_id", F.concat(
        X.section_label(F.col("number"), F.col("title")), F.lit(" "), where, F.lit(" · "), plural(F.coalesce("marks", zero), "mark"), F.lit(" · "), plural(F.coalesce("notes", zero), "note")).alias("text"))


def agent_targets(agent_notes: DataFrame, highlights: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each agent note is about: a highlight first, else a node, with a 44-character label; null when the id is gone."""
    chip = 44
    h = highlights.select("paper_id", F.col("h_id").alias("on"), X.first_line("exact", chip).alias("h_label"))
    label = (F.when(F.col("type") == "chunk", F.coalesce(F.nullif(X.first_line("text", chip), F.lit("")), F.lit("Piece")))
             .when(F.col("type") == "figure", F.coalesce(F.nullif(X.first_line("text", chip), F.lit("")), F.lit("Figure")))
             .when(F.col("type") == "group", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Group"))).otherwise(F.lit("Note")))
    n = nodes.select("paper_id", F.col("node_id").alias("on"), label.alias("n_label"))
    j = agent_notes.join(h, ["paper_id", "on"], "left").join(n, ["paper_id", "on"], "left")
    return j.withColumn("target_kind", F.when(F.col("h_label").isNotNull(), "highlight").when(F.col("n_label").isNotNull(), "node")).withColumn("label", F.coalesce("h_label", "n_label")).drop("h_label", "n_label")


def place_agent_notes(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of agent notes put on the board: an AI note each, joined to its target when it has one."""
    note_id = F.concat(F.lit("n-"), F.substring(F.upper(F.sha2(F.concat_ws("/", F.col("paper_id").cast("string"), "file"), 256)), 1, 26))
    body = F.concat(X.ends_trimmed("text"), F.lit("\n"))
    text = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), "title", F.lit("\n\n"), body)).otherwise(body)
    nodes = targets.select("paper_id", note_id.alias("node_id"), F.lit("note").alias("type"), F.lit("ai").alias("origin"), text.alias("text"))
    edges = targets.where("target_kind IS NOT NULL").select("paper_id", F.concat(F.lit("e-"), F.substring(note_id, 3, 26)).alias("edge_id"), F.col("on").alias("from_id"), note_id.alias("to_id"))
    return nodes, edges


def reader_layer_only(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The board without the AI's notes and any edge touching them."""
    ai = nodes.where("type = 'note' AND origin = 'ai'").select("paper_id", "node_id")
    left = edges.join(ai.withColumnRenamed("node_id", "from_id"), ["paper_id", "from_id"], "left_anti").join(ai.withColumnRenamed("node_id", "to_id"), ["paper_id", "to_id"], "left_anti")
    return nodes.where("NOT (type = 'note' AND origin <=> 'ai')"), left


def any_tagged(nodes: DataFrame, highlights: DataFrame, edges: DataFrame) -> DataFrame:
    rows = nodes.select("paper_id", "tags").unionByName(highlights.select("paper_id", "tags")).unionByName(edges.select("paper_id", "tags"))
    return rows.groupBy("paper_id").agg(F.bool_or(F.size("tags") > 0).alias("any_tagged"))


# -- checks ------------------------------------------------------------------------


def validate_board(nodes: DataFrame, edges: DataFrame, highlights: DataFrame, rects: DataFrame | None = None) -> DataFrame:
    """Violations: (paper_id, id, problem)."""
    def say(df: DataFrame, col: str, problem: str) -> DataFrame:
        return df.select("paper_id", F.col(col).alias("id"), F.lit(problem).alias("problem"))

    ids = (nodes.select("paper_id", F.col("node_id").alias("id"), F.lit("n-").alias("p")).unionByName(edges.select("paper_id", F.col("edge_id").alias("id"), F.lit("e-").alias("p")))
           .unionByName(highlights.select("paper_id", F.col("h_id").alias("id"), F.lit("h-").alias("p"))))
    twice = ids.groupBy("paper_id", "id").agg(F.count("*").alias("n")).where("n > 1")
    prefix = ids.where(~(F.startswith("id", "p") & (F.length("id") > F.length("p"))))
    kids = nodes.where("parent_id IS NOT NULL").select("paper_id", "node_id", "parent_id", "ord")
    par = nodes.groupBy("paper_id", F.col("node_id").alias("parent_id")).agg(F.min("ord").alias("p_ord"), F.first("type").alias("p_type"))
    under = kids.join(par, ["paper_id", "parent_id"], "left")
    ends = nodes.select("paper_id", F.col("node_id").alias("end")).unionByName(highlights.select("paper_id", F.col("h_id").alias("end"))).distinct()
    loose = edges.select("paper_id", "edge_id", F.explode(F.array("from_id", "to_id")).alias("end")).join(ends, ["paper_id", "end"], "left_anti").select("paper_id", "edge_id").distinct()
    out = (say(twice, "id", "duplicate id").unionByName(say(prefix, "id", "wrong prefix")).unionByName(say(under.where("p_type IS NULL"), "node_id", "unknown parent"))
           .unionByName(say(under.where("p_type <> 'group'"), "node_id", "parent is not a group")).unionByName(say(under.where("p_ord >= ord"), "node_id", "listed before its parent"))
           .unionByName(say(loose, "edge_id", "unknown end")))
    if rects is not None:
        out = out.unionByName(say(rects.where("NOT (x0 < x1 AND y0 < y1)"), "id", "corners not ordered"))
    return out


PAPER_ID = r"^[a-z0-9][a-z0-9.-]*$"
NODE_ID = "^n-[0-9A-HJKMNP-TV-Z]{26}$"


def valid_paper_id(col: Column) -> Column:
    return col.rlike(PAPER_ID) & ~F.contains(col, F.lit(".."))


def valid_node_id(col: Column) -> Column:
    return col.rlike(NODE_ID)


# -- versions -------------------------------------------------------------------------


def board_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Build events between two snapshots of things (paper_id, id, kind, type, parent_id, tags, text): what was highlighted,
    cut, connected, grouped, retagged and removed."""
    cols = ("kind", "type", "parent_id", "tags", "text")
    b = before.select("paper_id", "id", F.lit(True).alias("was"), *[F.col(c).alias(f"b_{c}") for c in cols])
    a = after.select("paper_id", "id", F.lit(True).alias("is"), *cols)
    j = a.join(b, ["paper_id", "id"], "full")
    fresh = F.col("was").isNull()
    action = (F.when(F.col("is").isNull(), "remove").when(fresh & (F.col("kind") == "highlight"), "highlight")
              .when(fresh & (F.col("kind") == "edge"), "connect").when(fresh & F.col("type").isin("chunk", "figure"), "cut")
              .when(~fresh & ~F.col("tags").eqNullSafe(F.col("b_tags")), "tag"))
    single = j.withColumn("action", action).where("action IS NOT NULL").select("paper_id", "action", "id")
    joined = j.where(F.col("is") & ~fresh & F.col("parent_id").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("b_parent_id"))).select("paper_id", F.col("parent_id").alias("id"))
    made = j.where(fresh & (F.col("type") == "group")).select("paper_id", "id")
    groups = after.where("type = 'group'").select("paper_id", "id").join(joined.unionByName(made).distinct(), ["paper_id", "id"], "left_semi")
    return single.unionByName(groups.select("paper_id", F.lit("group").alias("action"), "id"))


def cache_edges(highlights: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Migration: an edge for each highlight naming an existing note that nothing connects to it yet. `highlights`: h_id, note."""
    notes = nodes.where("type = 'note'").select("paper_id", F.col("node_id").alias("note"))
    named = highlights.where("note IS NOT NULL").join(notes, ["paper_id", "note"], "left_semi").select(
        "paper_id", F.concat(F.lit("e-"), F.regexp_replace("h_id", "^h-", "")).alias("edge_id"), F.col("h_id").alias("from_id"), F.col("note").alias("to_id"))
    return named.withColumn("_k", pair_key()).join(edges.select("paper_id", pair_key().alias("_k")).distinct(), ["paper_id", "_k"], "left_anti").drop("_k")
