"""Each stream gives the rows of its batch twin, whatever the micro-batches."""

import datetime
import random

from pyspark.sql import functions as F

from foliograph.operators import history as H
from foliograph.plans import history as PH
from foliograph.streaming import activity as ST


def stream_of(spark, df, tmp_path, order, files=3):
    """The table as a stream of a few files, one micro-batch each, in order."""
    path = str(tmp_path / "in")
    rows = df.orderBy(*order).toPandas()
    step = len(rows) // files + 1
    for i in range(files):
        part = spark.createDataFrame(rows.iloc[i * step:(i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, tmp_path, mode="append"):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def arriving(spark, df, tmp_path, batches, name="in"):
    """Rows as a stream, each list of rows a micro-batch of its own."""
    path = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, df).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], df).schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


VIEWS = "session long, t timestamp, page int, seq long"


def test_page_dwell_orders_rows_across_batches(spark, tmp_path):
    """Rows out of order in three batches give the batch twin's rows, whatever the cut; none is negative."""
    rng = random.Random(5)
    rows = [(s, at(rng.randrange(0, 4000)), rng.choice([None, 0, 1, 2, 2, 2]), i) for i, s in enumerate(rng.choices(range(4), k=120))]
    rows += [(s, at(100_000), None, 900 + s) for s in range(5)]  # moves the watermark past the others
    twin = spark.createDataFrame(rows[:-5], VIEWS)
    want = sorted((r.session, r.page, r.seconds) for r in H.page_dwell(twin).collect())
    early = sorted(rows[:-5], key=lambda r: r[1].timestamp() + rng.randrange(0, 900))  # up to a quarter of an hour out of order
    for k, cut in enumerate((40, 75)):
        folder = tmp_path / str(k)
        stream = ST.page_dwell(arriving(spark, VIEWS, folder, [early[:cut], early[cut:], rows[-5:]]), "1 hour", 10**12)
        got = sorted((r.session, r.page, r.seconds) for r in drain(stream, folder).collect() if r.t < at(100_000 - 3600))
        assert [r for r in got if r[2] < 50_000] == want and all(r[2] >= 2 for r in got)


def test_page_dwell_drops_late_rows_and_forgets(spark, tmp_path):
    batches = [[(1, at(0), 0, 0), (1, at(10), 1, 1), (2, at(0), 5, 0)], [(9, at(5_000), 0, 0)], [(9, at(5_001), 0, 1)], [(1, at(3), 7, 9), (9, at(5_002), 0, 5)],
               [(9, at(900_000), 0, 2)], [(1, at(900_010), 2, 3), (1, at(900_020), 3, 4)], [(9, at(901_000), 0, 3)], [(9, at(902_000), 0, 4)]]
    got = drain(ST.page_dwell(arriving(spark, VIEWS, tmp_path, batches), "1 minute", 3_600_000), tmp_path)
    # The row of second 3 came after the watermark; page 1 (second 10) was forgotten long before second 900010.
    assert sorted((r.session, r.page, r.seconds) for r in got.where("session < 9").collect()) == [(1, 1, 10), (1, 3, 10)]


def test_page_dwell_passes_over_rows_without_a_number(spark, tmp_path):
    """They belong to other events: no stay ends there, but the watermark moves on."""
    batches = [[(1, at(0), 4, 0), (1, at(10), None, None)], [(1, at(60), 5, 1), (1, at(70), 5, None)], [(2, at(900), None, None)], [(2, at(901), None, None)]]
    got = drain(ST.page_dwell(arriving(spark, VIEWS, tmp_path, batches), "1 minute", 10**12), tmp_path)
    assert [(r.session, r.page, r.seconds) for r in got.collect()] == [(1, 5, 60)]


def test_page_dwell_case(spark):
    rows = [(1, 0.0, 4, 0), (1, 1.9, 5, 1), (1, 4.4, None, 2)]
    v = spark.createDataFrame(rows, "session int, s double, page int, seq int").select("session", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("t"), "page", "seq")
    assert [tuple(r) for r in H.page_dwell(v).select("page", "seconds").collect()] == [(6, 3)]


def test_note_edits(spark, lib, tmp_path):
    edits = PH.edit_events(lib).select(F.col("paper_id").cast("string").alias("note_id"), "t", "seq", "kind", "text")
    last = edits.agg(F.max("t")).head()[0]
    shaken = edits.withColumn("at", F.unix_micros("t") + F.when(F.col("seq") % 3 == 0, 3_000_000_000).otherwise(0))
    rows = [tuple(r)[:5] for r in shaken.orderBy("at").collect()]
    batches = [rows[:300], rows[300:310], rows[310:], [("end", last + datetime.timedelta(days=9), 0, "seen", "")]]
    got = drain(ST.note_edits(arriving(spark, edits.schema, tmp_path, batches), "1 hour", 10**12), tmp_path)
    assert same(got, H.note_edits(edits.withColumn("paper_id", F.lit(1)), ("t", "seq")).select("note_id", "seq", "text"))


def test_versioned_writes(spark, lib, tmp_path):
    writes = PH.writes(lib)
    got = drain(ST.versioned_writes(stream_of(spark, writes, tmp_path, ["seq"])), tmp_path)
    assert same(got.select("paper_id", "seq", "accepted", "version"), H.versioned_writes(writes).select("paper_id", "seq", "accepted", "version"))


DELTAS = "call_id long, seq long, kind string, text string, t timestamp"


def test_assemble_answers(spark, tmp_path):
    """Out of order, with repeats, gaps, errors before and after the end, and pieces after it: stream and twin agree."""
    rng = random.Random(9)
    rows = []
    for call in range(40):
        n = rng.randint(0, 6)
        pieces = [(call, i, "delta", f"{call}.{i} ") for i in range(n)] + [(call, n, rng.choice(["done", "done", "error"]), None)]
        pieces += rng.choice([[], [(call, n + 1, "error", None)], [(call, n + 1, "done", None)], [(call, n + 2, "delta", "late")], pieces[:1]])
        if call % 6 == 0 and n:
            pieces.pop(rng.randrange(n))  # a piece is missing
        rows += [(*p, at(rng.randrange(60))) for p in pieces]
    rng.shuffle(rows)
    got = drain(ST.assemble_answers(arriving(spark, DELTAS, tmp_path, [rows[:60], rows[60:110], rows[110:]]), idle=10**12), tmp_path)
    want = H.assemble_answers(spark.createDataFrame(rows, DELTAS))
    assert want.count() > 12 and same(got.select("call_id", "raw"), want)


def test_a_closed_call_is_forgotten_after_its_rest(spark, tmp_path):
    batches = [[(1, 0, "delta", "a", at(0)), (1, 1, "done", None, at(1)), (2, 1, "done", None, at(1))], [(1, 0, "delta", "b", at(2)), (1, 1, "done", None, at(2))],
               [(5, 0, "delta", "x", at(90_000))], [(5, 1, "delta", "x", at(90_001))], [(1, 0, "delta", "c", at(90_002)), (1, 1, "done", None, at(90_002)), (2, 0, "delta", "z", at(90_002))]]
    got = drain(ST.assemble_answers(arriving(spark, DELTAS, tmp_path, batches), idle=600_000), tmp_path)
    assert sorted((r.call_id, r.raw) for r in got.collect()) == [(1, "a"), (1, "c")]


def test_debounced_saves_closed_sessions(spark, lib, tmp_path):
    edits = lib.activity().select("paper_id", "t", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("text"))
    got = drain(ST.debounced_saves(stream_of(spark, edits, tmp_path, ["t"]), "1 hour", "0 seconds"), tmp_path).collect()
    want = set(map(tuple, H.debounced_saves(edits, "1 hour").collect()))
    assert got and all(tuple(r) in want for r in got)   # the last, still open, sessions are not emitted yet


def test_ingest(spark, lib, tmp_path):
    events = lib.activity().select("paper_id", "event_id", "t", "kind", "action")
    q = ST.activity_ingest(stream_of(spark, events, tmp_path, ["event_id"]), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    good, bad = H.validate_activity(events)
    assert spark.read.parquet(str(tmp_path / "good")).count() == good.count() and spark.read.parquet(str(tmp_path / "bad")).count() == bad.count()


def test_timeline_is_stateless(spark, lib, tmp_path):
    events = PH.detailed(lib).select("event_id", "t", "kind", "action", "detail")
    got = drain(ST.activity_timeline(stream_of(spark, events, tmp_path, ["event_id"])), tmp_path)
    assert same(got.select("event_id", "sentence", "clock"), H.timeline(events).select("event_id", "sentence", "clock"))


THINGS = "paper_id long, version long, t timestamp, id string, kind string, type string, parent_id string, tags array<string>, text string"


def test_board_change_feed(spark, tmp_path):
    """Random boards over six versions, one of them empty, in three batches out of order: stream and twin agree."""
    rng = random.Random(3)
    rows = []
    for paper in range(3):
        for version in range(6):
            rows.append((paper, version, at(version * 60), None, None, None, None, None, None))
            for k in range(0 if version == 3 else 14):
                if rng.random() < 0.7:
                    kind, type_ = [("node", "group"), ("node", "chunk"), ("node", "note"), ("edge", None), ("highlight", None)][k % 5]
                    parent = rng.choice([None, "i0", "i5", "i1"]) if kind == "node" else None
                    rows.append((paper, version, at(version * 60), f"i{k}", kind, type_, parent, rng.choice([[], ["t"], ["t", "u"]]), ""))
    late = [*sorted(rows, key=lambda r: r[1] + rng.choice([0, 0, 1])), (99, 0, at(9_000), None, None, None, None, None, None)]
    got = drain(ST.board_change_feed(arriving(spark, THINGS, tmp_path, [late[:50], late[50:120], late[120:]]), "5 minutes", 10**12), tmp_path)
    want = H.board_change_feed(spark.createDataFrame(rows, THINGS))
    assert want.where("action = 'remove' AND version = 3").count() > 10 and want.select("action").distinct().count() == 6
    rows = [sorted((r.paper_id, r.version, r.action, r.id) for r in x.collect()) for x in (got, want)]
    assert rows[0] == rows[1]


def test_a_board_spreads_over_its_parts(spark, tmp_path):
    """One board's items are handled by several keys, and a group that items of several parts join is named once."""
    item = lambda version, id, type_, parent: (1, version, at(version * 60), id, "node", type_, parent, [], "")
    rows = [item(0, "g", "group", None), *[item(0, f"n{k}", "note", None) for k in range(9)], item(1, "g", "group", None), *[item(1, f"n{k}", "note", "g") for k in range(9)]]
    snapshots = spark.createDataFrame(rows, THINGS).select("paper_id", "t", F.col("version").alias("seq"), "id")
    dealt = ST._by_part(snapshots.coalesce(1), 4).collect()
    assert {r.part for r in dealt if r.id is not None} == {r.part for r in dealt if r.id is None} == set(range(4))
    assert sum(r.id is not None for r in dealt) == len(rows) and sum(r.id is None for r in dealt) == 2 * 4
    got = drain(ST.board_change_feed(arriving(spark, THINGS, tmp_path, [rows[:14], rows[14:], [(9, 0, at(9_000), *[None] * 6)]]), "5 minutes", 10**12), tmp_path)
    assert [tuple(r) for r in got.collect()] == [(1, 1, "group", "g")]
