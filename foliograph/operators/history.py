"""Chat, activity and version history: batch forms of the per-paper logs (WN-01..03, EX-13, FL-04, batch twins of ST)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators.spread import materialise, running

HISTORY_BUDGET = 150_000
KINDS = ("session", "build", "read", "ai")
MAX_ACTION, MAX_EVENTS, MAX_BYTES = 32, 200, 64 * 1024
DEFAULT_READ = 500
DWELL_MIN_MS = 2000
QUOTE_CHARS = 80


def current_chat(chat: DataFrame) -> DataFrame:
    """Turns after each paper's last divider line."""
    cut = chat.where("new_chat").groupBy("paper_id").agg(F.max("line_no").alias("_cut"))
    return chat.where("NOT new_chat").join(cut, "paper_id", "left").where("_cut IS NULL OR line_no > _cut").drop("_cut")


def history_within_budget(turns: DataFrame, budget: int = HISTORY_BUDGET) -> DataFrame:
    """The latest turns whose characters fit the budget, with whether older ones were left out. The running total counts
    back from the last line, in blocks, so one long chat is not one task's window."""
    size = F.length("question") + F.length("answer")
    back = running(turns.withColumn("_neg", -F.col("line_no")), ["paper_id"], "_neg", size, "_total")
    trimmed = back.groupBy("paper_id").agg((F.max("_total") > budget).alias("trimmed"))
    return back.where(F.col("_total") <= budget).drop("_neg", "_total").join(trimmed, "paper_id")


def last_events(activity: DataFrame, order: str, limit: int = DEFAULT_READ) -> DataFrame:
    """The last `limit` events of each paper. `row_number` under a small limit is a per-task top-k before the shuffle."""
    w = Window.partitionBy("paper_id").orderBy(F.col(order).desc())
    return activity.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def rejection(kind: Column, action: Column, extra: Column | None = None) -> Column:
    """Why an event is refused, or null."""
    why = F.when(kind.isNull() | ~kind.isin(*KINDS), "kind").when(action.isNull() | ~F.length(action).between(1, MAX_ACTION), "action")
    return why if extra is None else why.when(F.size(extra) > 0, "extra fields")


def validate_activity(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason). A batch over 200 events or 64 KiB, or holding a bad event, is refused whole when
    events carry a `batch_id` and their `bytes`."""
    judged = events.withColumn("reason", rejection(F.col("kind"), F.col("action")))
    if "batch_id" in events.columns:
        sizes = judged.groupBy("batch_id").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b"), F.count("reason").alias("_bad"))
        judged = judged.join(sizes, "batch_id").withColumn("reason", F.when(F.col("_b") > MAX_BYTES, "too large").when(F.col("_n") > MAX_EVENTS, "too many").otherwise(
            F.coalesce("reason", F.when(F.col("_bad") > 0, "bad batch")))).drop("_n", "_b", "_bad")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def quoted(words: Column) -> Column:
    line = X.flat(F.coalesce(words, F.lit("")))
    return F.concat(F.lit("“"), F.when(F.length(line) > QUOTE_CHARS, F.concat(F.rtrim(F.substring(line, 1, QUOTE_CHARS - 1)), F.lit("…"))).otherwise(line), F.lit("”"))


def duration(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).otherwise(
        F.concat(minutes.cast("string"), F.lit(" min"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" s"))).otherwise("")))


def describe_events(events: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One plain sentence an event. `detail` is JSON text; tag names come from the small tag table as one map."""
    d = lambda key: F.coalesce(F.get_json_object("detail", f"$.{key}"), F.lit(""))
    many = lambda key: F.coalesce(F.from_json(F.get_json_object("detail", f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
    count = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    thing = F.when(d("id").startswith("h-"), "a highlight").when(d("id").startswith("e-"), "a connection").otherwise("a piece")
    if tags is not None:
        names = tags.agg(F.map_from_entries(F.collect_list(F.struct("tag_id", "name"))).alias("m")).scalar()
        rows = events.withColumn("_names", names)
        called = F.filter(F.transform(many("tags"), lambda t: F.col("_names")[t]), lambda n: n.isNotNull())
    else:
        rows, called = events.withColumn("_names", F.lit(None)), F.array().cast("array<string>")
    ids, text = F.size(many("ids")), d("text")
    tagged = F.when(F.size(many("tags")) == 0, say("Took the tags off ", thing)).otherwise(
        say("Tagged ", thing, " ", F.when(F.size(called) > 0, F.array_join(called, ", ")).otherwise("with a deleted tag")))
    views = F.when(d("view") == "paper", "the paper").when(d("view") == "board", "the board").when(d("view") == "both", "the paper and board side by side").otherwise("another view")
    k = F.concat_ws(":", "kind", "action")
    # The sentence of each kind and action.
    said = {
        "build:highlight": say("Highlighted ", quoted(text)), "build:cut": F.when(text != "", say("Cut ", quoted(text), " onto the board")).otherwise("Cut a piece onto the board"),
        "build:note": F.when(text != "", say("Wrote a note: ", quoted(text))).otherwise("Emptied a note"), "build:connect": F.lit("Connected two things"),
        "build:group": say("Grouped ", count(F.size(many("members")), "piece"), F.when(d("name") != "", say(" as ", quoted(d("name")))).otherwise("")),
        "build:tag": tagged, "build:remove": say("Deleted ", count(ids, "thing")), "build:split": say("Split a chunk in ", F.when(ids <= 2, "two").otherwise(ids.cast("string"))),
        "build:cutout": F.lit("Cut out part of a chunk"), "build:join": say("Joined ", count(ids, "chunk")), "build:undo": F.lit("Undid a change"), "build:redo": F.lit("Redid a change"),
        "session:open": F.lit("Opened the paper"), "session:close": F.lit("Left the paper"), "read:view": say("Switched to ", views),
        "read:page": say("Read page ", d("page"), " for ", duration(F.coalesce(F.get_json_object("detail", "$.seconds").cast("long"), F.lit(0)))),
        "read:find": say("Searched the paper for ", quoted(text)), "ai:on": F.lit("Turned AI help on"), "ai:off": F.lit("Turned AI help off"),
        "ai:define": say("Asked AI to define ", quoted(d("word"))), "ai:key-sentences": F.lit("Opened the key sentences"), "ai:jump": say("Went to a key sentence: ", quoted(text)),
        "ai:keep": F.when(d("slot") != "", say("Kept a key sentence: ", quoted(text))).otherwise(say("Kept the AI term ", quoted(text))),
    }
    sentence = None
    for key, value in said.items():
        sentence = F.when(k == key, value) if sentence is None else sentence.when(k == key, value)
    return rows.withColumn("sentence", sentence.otherwise(F.concat_ws(": ", "kind", "action"))).drop("_names")


def timeline(events: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    return describe_events(events, tags).withColumn("clock", F.date_format("t", "HH:mm"))


# -- batch twins of the streams ---------------------------------------------------


def page_dwell(views: DataFrame, key: str = "session") -> DataFrame:
    """Stays of at least two seconds: (session, page from 1, seconds). A repeated page is no move; a null page ends reading.
    `views`: session, t, page, seq."""
    w = Window.partitionBy(key).orderBy("t", "seq")
    moved = views.withColumn("_prev", F.lag("page").over(w)).withColumn("_first", F.lag("seq").over(w).isNull()).where(F.col("_first") | ~F.col("page").eqNullSafe(F.col("_prev")))
    ms = (F.unix_micros(F.col("_until").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 1000
    stay = moved.withColumn("_until", F.lead("t").over(w)).where("page IS NOT NULL AND _until IS NOT NULL").withColumn("ms", ms).where(F.col("ms") >= DWELL_MIN_MS)
    return stay.select(key, "t", (F.col("page") + 1).alias("page"), F.floor(F.col("ms") / 1000 + 0.5).cast("long").alias("seconds"))


def note_edits(edits: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Ended edits whose text differs from the last baseline: the first text seen, then each end. `edits`: paper_id, note_id,
    seq, kind (seen/ended), text."""
    w = Window.partitionBy("paper_id", "note_id").orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    last_end = F.last(F.when(F.col("kind") == "ended", F.col("text")), ignorenulls=True).over(earlier)
    first_seen = F.first(F.when(F.col("kind") == "seen", F.col("text")), ignorenulls=True).over(earlier)
    was = F.coalesce(last_end, first_seen, F.lit(""))
    return edits.withColumn("was", was).where("kind = 'ended' AND text <> was").select("paper_id", "note_id", "seq", "text")


def versioned_writes(writes: DataFrame) -> DataFrame:
    """Each write with whether its expected version was current and the version after it. A fold over `seq`."""
    from foliograph.operators.spread import ordered_fold

    def step(version, row):
        ok = row["expected"] == row["expected"] and row["expected"] is not None and int(row["expected"]) == version
        after = version + 1 if ok else version
        return after, [{"paper_id": row["paper_id"], "seq": row["seq"], "accepted": ok, "version": after}]

    return ordered_fold(writes.select("paper_id", "seq", "expected"), ["paper_id"], ["seq"], lambda: 0, step, "paper_id long, seq long, accepted boolean, version long")


def debounced_saves(edits: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """Of edits closer than the gap only the last is saved."""
    return edits.groupBy("paper_id", F.session_window("t", gap).alias("w")).agg(F.max_by(F.struct("t", "text"), F.struct("t", "seq")).alias("e")).select("paper_id", "e.t", "e.text")


def assemble_answers(deltas: DataFrame, first: int = 0) -> DataFrame:
    """Answer pieces of each finished call in order as one text. The call ends at its first done or error marker by number: an error
    gives nothing, a missing piece before the end neither, and what comes after the end does not count; of pieces with one
    number one counts. `deltas`: call_id, seq (from `first`), kind (delta/done/error), text."""
    once = deltas.where(F.col("seq") >= first).groupBy("call_id", "seq").agg(F.min(F.struct("kind", "text")).alias("p")).select("call_id", "seq", "p.kind", "p.text")
    ends = once.where("kind <> 'delta'").groupBy("call_id").agg(F.min_by("kind", "seq").alias("_end"), F.min("seq").alias("_at")).where("_end = 'done'")
    pieces = once.where("kind = 'delta'").join(ends, "call_id").where(F.col("seq") < F.col("_at"))
    whole = pieces.groupBy("call_id").agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("raw"))
    return ends.join(whole, "call_id", "left").where(F.coalesce("_n", F.lit(0)) == F.col("_at") - first).select("call_id", F.coalesce("raw", F.lit("")).alias("raw"))


def board_events(before: Mapping[str, tuple], after: Mapping[str, tuple]) -> list[tuple[str, str]]:
    """(action, id) between two versions of a board, each id -> (kind, type, parent_id, tags): the rule of `graph.board_diff` for one
    board at a time."""
    fresh = {"highlight": "highlight", "edge": "connect", "chunk": "cut", "figure": "cut"}
    found = [("remove", id) for id in before if id not in after]
    groups = set()
    for id, (kind, type_, parent, tags) in after.items():
        was = before.get(id)
        if was is None:
            if (action := fresh.get(kind) or fresh.get(type_)) is not None:
                found.append((action, id))
            if type_ == "group":
                groups.add(id)
        else:
            if tags != was[3]:
                found.append(("tag", id))
            if parent is not None and parent != was[2] and parent in after and after[parent][1] == "group":
                groups.add(parent)
    return found + [("group", id) for id in groups]


def board_change_feed(snapshots: DataFrame) -> DataFrame:
    """Build events between each version and the next. `snapshots`: paper_id, version, id, kind, type, parent_id, tags, text; a row
    with a null id says that a version exists, which is all there is of an empty board."""
    from foliograph.operators.graph import board_diff

    key = lambda v: F.concat_ws("@", F.col("paper_id").cast("string"), v.cast("string"))
    snapshots = materialise(snapshots)
    versions, things = snapshots.select("paper_id", "version").distinct(), snapshots.where("id IS NOT NULL")
    followed = versions.join(versions.select("paper_id", (F.col("version") - 1).alias("version")), ["paper_id", "version"], "left_semi")
    following = versions.join(versions.select("paper_id", (F.col("version") + 1).alias("version")), ["paper_id", "version"], "left_semi")
    after = things.join(following, ["paper_id", "version"], "left_semi").withColumn("paper_id", key(F.col("version"))).drop("version")
    before = things.join(followed, ["paper_id", "version"], "left_semi").withColumn("paper_id", key(F.col("version") + 1)).drop("version")
    d = board_diff(before, after)
    return d.select(F.substring_index("paper_id", "@", 1).cast("long").alias("paper_id"), F.substring_index("paper_id", "@", -1).cast("long").alias("version"), "action", "id")
