"""Structured Streaming forms of the logs. Each has a batch twin in `operators.history` giving the same rows.

Streams whose rows have an order keep it by event time (`inorder`): a row is handled once the watermark has passed it, so the result
is that of the batch twin for all rows before the last watermark, however the input was cut. State of a key is a page and a
time, a text, a version or the open pieces of one answer; it goes when the key rests.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from foliograph.operators import grounding
from foliograph.operators.history import DWELL_MIN_MS, board_events, rejection, timeline
from foliograph.streaming.inorder import PROVIDER, ROCKSDB, InOrder, in_order, plain

NO_TIMEOUT = "NoTimeout"
#: Milliseconds after which a key at rest is forgotten.
IDLE_MS = 24 * 3600 * 1000


def _types(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def activity_ingest(events: DataFrame, good_path: str, bad_path: str, checkpoint: str):
    """Accepted events to the log, refused ones with their reason to quarantine, from one pass over each micro-batch."""
    judged = events.withColumn("reason", rejection(F.col("kind"), F.col("action")))

    def write(batch: DataFrame, batch_id: int) -> None:
        # Output folders are named by batch, so a batch run again after a failure replaces its own files only.
        batch = batch.persist()
        batch.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        batch.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        batch.unpersist()

    return judged.withWatermark("t", "1 hour").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Dwell(InOrder):
    columns, out = "t long, seq long, page int", ("session", "t", "page", "seconds")

    def begin(self, handle) -> None:
        self.open = handle.getValueState("open", "page int, since long")

    def forget(self) -> None:
        self.open.clear()

    def step(self, key: tuple, rows: Sequence[tuple]) -> list[tuple]:
        page, since = self.open.get() if self.open.exists() else (None, 0)
        found = []
        for now, _, here in rows:
            if page is not None and here == page:
                continue
            if page is not None and (now - since) / 1000 >= DWELL_MIN_MS:
                found.append((key[0], pd.Timestamp(since, unit="us"), page + 1, int((now - since) / 1_000_000 + 0.5)))
            page, since = here, now
        self.open.update((page, since))
        return found


def page_dwell(views: DataFrame, delay: str = "1 minute", idle: int = IDLE_MS) -> DataFrame:
    """Stays of at least two seconds per session, emitted when the watermark passes the move that ends them. `views`: session, t, page,
    seq."""
    return in_order(views, "session", _Dwell(idle), "session long, t timestamp, page int, seconds long", delay)


class _NoteEdits(InOrder):
    columns, out = "t long, seq long, kind string, text string", ("note_id", "seq", "text")

    def begin(self, handle) -> None:
        self.base = handle.getValueState("base", "text string")

    def forget(self) -> None:
        self.base.clear()

    def step(self, key: tuple, rows: Sequence[tuple]) -> list[tuple]:
        base = self.base.get()[0] if self.base.exists() else None
        found = []
        for _, seq, kind, text in rows:
            if kind == "seen":
                base = text if base is None else base
            else:
                if (base or "") != text:
                    found.append((key[0], seq, text))
                base = text
        if base is not None:
            self.base.update((base,))
        return found


def note_edits(edits: DataFrame, delay: str = "1 minute", idle: int = IDLE_MS) -> DataFrame:
    """Ended edits that changed the text. `edits`: note_id, t, seq, kind, text. A note at rest for `idle` starts afresh."""
    return in_order(edits, "note_id", _NoteEdits(idle), "note_id string, seq long, text string", delay)


def versioned_writes(writes: DataFrame) -> DataFrame:
    """Accepted writes and conflicts per paper. `writes`: paper_id, seq, expected."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            ok = not pd.isna(r.expected) and int(r.expected) == version
            version += int(ok)
            out.append((key[0], r.seq, ok, version))
        state.update((version,))
        yield pd.DataFrame(out, columns=["paper_id", "seq", "accepted", "version"])

    return writes.groupBy("paper_id").applyInPandasWithState(run, _types("paper_id long, seq long, accepted boolean, version long"), _types("version long"), "append", NO_TIMEOUT)


class _Answers(StatefulProcessor):
    """Pieces of one call, taken in the order of their numbers. Pieces that come early wait; a closed call stays known until it has
    rested for `idle`, so what comes after its end changes nothing."""

    def __init__(self, first: int, idle: int):
        self.first, self.idle = first, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "seq long", "kind string, text string")
        self.said = handle.getListState("said", "text string")
        self.at = handle.getValueState("at", "next long, closed boolean, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, closed, last = self.at.get() if self.at.exists() else (self.first, False, 0)
        done = False
        for frame in rows:
            for t, seq, kind, text in frame[["t", "seq", "kind", "text"]].itertuples(index=False, name=None):
                last = max(last, plain(t) // 1000)
                if closed or seq < number:
                    continue
                if not self.early.containsKey((int(seq),)):
                    self.early.updateValue((int(seq),), (kind, plain(text)))
        while not closed and self.early.containsKey((number,)):
            kind, text = self.early.getValue((number,))
            self.early.removeKey((number,))
            if kind == "delta":
                self.said.appendValue((text or "",))
                number += 1
            else:
                closed, done = True, kind == "done"
        self.at.update((number, closed, last))
        self.handle.registerTimer(last + self.idle)
        if closed:
            whole = "".join(x[0] for x in self.said.get()) if done and self.said.exists() else ""
            self.said.clear()
            self.early.clear()
            if done:
                yield pd.DataFrame([(key[0], whole)], columns=["call_id", "raw"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.at.exists() and self.at.get()[2] + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.at.clear()
            self.said.clear()
            self.early.clear()
        return iter(())

    def close(self) -> None:
        pass


def assemble_answers(deltas: DataFrame, first: int = 0, delay: str = "10 minutes", idle: int = IDLE_MS) -> DataFrame:
    """A call's pieces as one text when all up to its end are there. The end is the first done or error marker by number; an error
    closes the call with nothing, and nothing after the end counts. `deltas`: call_id, t, seq (from `first`), kind, text."""
    conf = deltas.sparkSession.conf
    if conf.get(PROVIDER, "") != ROCKSDB:
        conf.set(PROVIDER, ROCKSDB)
    kind = deltas.schema["call_id"].dataType.simpleString()
    return deltas.withWatermark("t", delay).groupBy("call_id").transformWithStateInPandas(_Answers(first, idle), f"call_id {kind}, raw string", "Append", "EventTime")


def answer_sink(deltas: DataFrame, calls: DataFrame, spans: DataFrame, notes: DataFrame, path: str, checkpoint: str, **options):
    """Finished answers parsed and checked against their paper, written by micro-batch; a batch run again replaces its own files.
    `calls`: call_id, paper_id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        good, _ = grounding.parse_answers(batch.join(calls, "call_id"), grounding.ASK_SCHEMA)
        grounding.ask_results(good, spans, notes).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return assemble_answers(deltas, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts a board is cut into by the ids of its items, each part a key of its own. A key has a cost of its own, so small boards take few.
BOARD_PARTS = 4
#: What a version's rows say of a group in one part: that the part holds it, and that an item of the part moved there.
HELD, JOINED = "held", "joined"


class _BoardFeed(InOrder):
    columns = "t long, seq long, id string, kind string, type string, parent_id string, tags string"
    out = ("paper_id", "t", "version", "action", "id")

    def begin(self, handle) -> None:
        self.items = handle.getValueState("items", "items binary")
        self.version = handle.getValueState("version", "version long")

    def forget(self) -> None:
        self.items.clear()
        self.version.clear()

    def step(self, key: tuple, rows: Sequence[tuple]) -> list[tuple]:
        found = []
        last = self.version.get()[0] if self.version.exists() else None
        held = pickle.loads(self.items.get()[0]) if last is not None and self.items.exists() else {}
        versions: dict[int, dict[str, tuple]] = {}
        times = {}
        for t, version, id, *item in rows:
            now = versions.setdefault(version, {})
            times[version] = t
            if id is not None:
                now[id] = tuple(item)
        for version in sorted(versions):
            now = versions[version]
            if last is not None and version == last + 1:
                due = pd.Timestamp(times[version] // 1000 + 1, unit="ms")  # when the watermark has passed it: not late for the next step
                found += [(key[0], due, version, action, id) for action, id in item_events(held, now)]
            held, last = now, version
        self.items.update((pickle.dumps(held),))
        self.version.update((last,))
        return found


def item_events(before: Mapping[str, tuple], after: Mapping[str, tuple]) -> list[tuple[str, str]]:
    """(action, id) of a board's part: each item's own events (`history.board_events`), and what it knows of groups."""
    alone = {id: (kind, type_, None, tags) for id, (kind, type_, _, tags) in after.items()}  # groups are settled over all parts
    own = board_events(before, alone)
    known = [(HELD, id) for id, item in after.items() if item[1] == "group"]
    moved = {item[2] for id, item in after.items() if item[2] is not None and id in before and before[id][2] != item[2]}
    return own + known + [(JOINED, id) for id in moved]


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    """Each item with its part; every part hears of every version."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields] + [T.StructField("part", T.IntegerType())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple] = set()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            items = table.filter(pc.is_valid(table["id"])).combine_chunks()
            own = pa.array([zlib.crc32(x.encode()) % parts for x in items["id"].to_pylist()], pa.int32())
            yield from items.append_column("part", own).to_batches()
            new = [v for v in table.select(["paper_id", "t", "seq"]).group_by(["paper_id", "t", "seq"]).aggregate([]).to_pylist() if tuple(v.values()) not in said]
            said.update(tuple(v.values()) for v in new)
            if new:
                every = pa.Table.from_pylist([v | {"part": part} for v in new for part in range(parts)], pa.schema([*table.schema, pa.field("part", pa.int32())]))
                yield from every.to_batches()

    return rows.mapInArrow(dealt, schema)


def board_change_feed(snapshots: DataFrame, delay: str = "1 minute", idle: int = IDLE_MS, parts: int = BOARD_PARTS) -> DataFrame:
    """Build events between a paper's consecutive versions, named as by `history.board_change_feed`. `snapshots`: paper_id, t, version, id,
    kind, type, parent_id, tags; a version's rows share its t, and a row with a null id says that the version exists, which is all there is
    of an empty board.

    A board is cut into `parts` by its items' ids; a part's state is what it held in the last version. Which groups gained items is known
    over all parts only, so a second step puts together what they say of a group; it holds nothing beyond the watermark."""
    rows = snapshots.select("paper_id", "t", F.col("version").alias("seq"), "id", "kind", "type", "parent_id", F.concat_ws("\x01", "tags").alias("tags"))
    said = in_order(_by_part(rows, parts), ["paper_id", "part"], _BoardFeed(idle), "paper_id long, t timestamp, version long, action string, id string", delay, "t")
    of_group = F.col("action").isin("group", HELD, JOINED)
    heard = said.groupBy("t", "paper_id", "version", "id", F.when(~of_group, F.col("action")).alias("own")).agg(
        F.bool_or(F.col("action") == HELD).alias("held"), F.bool_or(F.col("action").isin("group", JOINED)).alias("gained"))
    return heard.where("own IS NOT NULL OR (held AND gained)").select("paper_id", "version", F.coalesce("own", F.lit("group")).alias("action"), "id")


def debounced_saves(edits: DataFrame, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Of edits closer than the gap only the last is saved; a session is emitted once the watermark has passed it."""
    windowed = edits.withWatermark("t", late).groupBy("paper_id", F.session_window("t", gap))
    return windowed.agg(F.max_by(F.struct("t", "text"), F.struct("t", "seq")).alias("e")).select("paper_id", "e.t", "e.text")


def activity_timeline(events: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Sentences with their clock as a stateless stream."""
    return timeline(events, tags)
