"""A small library on disk, read back as tables; sinks; migration; logs."""

import json

import pytest
from pyspark.sql import functions as F

from foliograph.operators import documents as D
from foliograph.operators import history as H
from foliograph.sources import library as L
from foliograph.sources import sinks

RECT = {"page": 0, "rect": [50.0, 72.0, 290.0, 92.0]}
NOTE = "n-01ARZ3NDEKTSV4RRFFQ69G5FAV"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("lib")

    def put(path, text):
        p = base / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text if isinstance(text, str) else json.dumps(text, indent=2))

    source = {"schema": 1, "paper_id": "other-name", "extracted_at": "2024-01-01T00:00:00Z", "extractor": "x", "pages": [{"index": 0, "width": 612.0, "height": 792.0, "rotation": 0}],
              "sections": [{"id": "sec-0", "number": None, "depth": 1, "title": "A Paper", "heading_rect": RECT, "extent": [RECT], "text": "Hello"}],
              "figures": [{"id": "fig-1", "kind": "figure", "label": "Figure 1", "caption": "Figure 1. x", "caption_rect": RECT, "rect": RECT, "confidence": "region"}],
              "regions": [{"page": 0, "rect": RECT["rect"], "label": "title"}], "page_text": [{"page": 0, "text": "A Paper\nHello"}]}
    put("papers/a-paper-1234/source.json", source)
    put("papers/b-paper-5678/source.json", {**source, "sections": []})
    put("papers/Bad..Name/source.json", source)
    quote = {"exact": "Hello", "prefix": "", "suffix": ""}
    put("papers/a-paper-1234/board.json", {
        "paper_id": "a-paper-1234", "version": 3, "goal": "Learn", "nodes": [{"id": NOTE, "type": "note", "position": {"x": 1, "y": 2}, "data": {"tags": [], "note": "n.md"}},
                                                                           {"id": "n-c", "type": "chunk", "position": {"x": 0, "y": 0}, "data": {"tags": ["t-x"], "region": {"rects": [RECT], "start": quote, "end": quote}}}],
        "edges": [{"id": "e-1", "source": "n-c", "target": NOTE, "targetHandle": f"{NOTE}-in"}],
        "highlights": [{"id": "h-1", "tags": [], "note": NOTE, "anchor": {"page": 0, "rect": RECT["rect"], "quote": quote, "position": 8}}]})
    put(f"papers/a-paper-1234/notes/{NOTE}.md", f"---\nid: {NOTE}\n---\nMy words\n")
    put("papers/a-paper-1234/notes/readme.md", "not a note")
    put(f"papers/a-paper-1234/notes/{NOTE}.svg", "<svg/>")
    put("papers/a-paper-1234/agent/one.md", "---\ntitle: \"Look here\"\non: h-1 # the mark\n---\nText\n")
    put("papers/a-paper-1234/agent/two.md", "---\nnot a field\n---\nText\n")
    put("papers/a-paper-1234/agent/.hidden.md", "x")
    put("papers/a-paper-1234/agent/placed/old.md", "x")
    put("papers/a-paper-1234/activity.jsonl", '{"t":"2024-01-01T00:00:00Z","kind":"read","action":"page","detail":{"page":1}}\n\n{"t":"2024-01-01T00:0\n{"t":"2024-01-01T00:01:00Z","kind":"ai","action":"on","detail":{}}\n')
    return str(base)


def test_read_library(spark, root):
    t = L.read_library(spark, root)
    assert sorted(r["paper_id"] for r in t["papers"].collect()) == ["a-paper-1234", "b-paper-5678"]
    assert t["sections"].first()["title"] == "A Paper" and t["section_rects"].first()["x1"] == 290.0
    assert t["figures"].first()["cap_x0"] == 50.0 and t["regions"].first()["label"] == "title"
    assert [tuple(r) for r in L.paper_list(t["papers"], t["sections"]).collect()] == [("a-paper-1234", "A Paper", 1), ("b-paper-5678", "b-paper-5678", 1)]


def test_read_boards_migrates_the_first_schema(spark, root):
    t = L.read_boards(spark, root)
    assert {(r["paper_id"], r["version"]) for r in t["boards"].collect()} == {("a-paper-1234", 3), ("b-paper-5678", 0)}
    edges = {(r["edge_id"], r["from_id"], r["to_id"]) for r in t["edges"].collect()}
    assert edges == {("e-1", "n-c", NOTE), ("e-1", "h-1", NOTE)}
    assert t["highlight_rects"].first()["y0"] == 72.0
    assert {r["node_id"]: r["origin"] for r in t["nodes"].collect()}[NOTE] == "reader"


def test_logs_skip_only_the_torn_line(spark, root):
    good, bad = L.read_log(spark, root, "activity")
    assert [r["action"] for r in good.orderBy("t").collect()] == ["page", "on"] and bad.count() == 1
    assert L.read_log(spark, root, "chat")[0].count() == 0


def test_notes(spark, root):
    n = L.read_notes(spark, root).collect()
    assert [(r["node_id"], r["markdown"], r["has_sketch"]) for r in n] == [(NOTE, "My words\n", True)]
    a = {r["file"]: (r["title"], r["on"], r["text"]) for r in L.read_agent_notes(spark, root).collect()}
    assert a == {"one.md": ("Look here", "h-1", "Text\n"), "two.md": (None, None, "---\nnot a field\n---\nText\n")}


def test_defaults(spark, root, tmp_path):
    assert L.read_tags(spark, root).count() == 4 and L.read_template(spark, root).count() == 9
    (tmp_path / "template.json").write_text('{"schema": 1, "slots": [{"name": " A ", "prompt": " p "}, {"name": " ", "prompt": "q"}]}')
    assert [(r["name"], r["prompt"]) for r in L.read_template(spark, str(tmp_path)).collect()] == [("A", "p")]


def test_write_markdown_keeps_the_order(spark, lib, tmp_path):
    secs, ext = lib.sections()
    papers = lib.table("documents").select(F.col("doc_id").alias("paper_id"))
    paras, out = D.paper_markdown(papers, secs, ext), str(tmp_path / "out")
    sinks.write_markdown(paras, out, "paper", buckets=5)
    sinks.write_markdown(paras.where("paper_id < 3"), out, "board", buckets=5)
    assert same(D.as_text(sinks.read_markdown(spark, out, "paper")), D.as_text(paras))
    rows = [r for f in spark.read.parquet(out).where("document = 'paper' AND bucket = 2").inputFiles() for r in spark.read.parquet(f).select("paper_id", "pos").collect()]
    assert rows == sorted(rows) or len(spark.read.parquet(out).where("document = 'paper' AND bucket = 2").inputFiles()) > 1
    assert sinks.read_markdown(spark, out, "board").select("paper_id").distinct().count() == 3


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_log_batches_replace_themselves(spark, tmp_path):
    """A replayed micro-batch, before and after compaction, changes nothing; an unfinished run is not read."""
    path, schema = str(tmp_path / "log"), "paper_id long, seq long"
    rows = spark.range(90).select((F.col("id") % 7).alias("paper_id"), F.col("id").alias("seq"))
    stream = lambda name: sinks.append_log(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), path, str(tmp_path / name), once=True)
    for k in range(3):
        rows.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream("first").awaitTermination()
    assert same(sinks.read_appended(spark, path, schema), rows) and sinks._runs(spark, path) == [(0, 0), (1, 1), (2, 2)]
    stream("again").awaitTermination()  # a new checkpoint runs all batches again
    assert same(sinks.read_appended(spark, path, schema), rows)
    sinks.compact_log(spark, path, schema, buckets=4)
    assert same(sinks.read_appended(spark, path, schema), rows) and sinks._runs(spark, path) == [(0, 2)]
    stream("later").awaitTermination()
    assert same(sinks.read_appended(spark, path, schema), rows) and sinks._runs(spark, path) == [(0, 2)]
    rows.write.parquet(f"{path}/run=3-3")
    (tmp_path / "log" / "run=3-3" / "_SUCCESS").unlink()
    assert same(sinks.read_appended(spark, path, schema), rows)
    assert sinks.read_appended(spark, str(tmp_path / "none"), schema).count() == 0


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {f"f{k}.txt": [f"{k}:{i}" + "x" * (i * 7 % 50) for i in range(n)] for k, n in enumerate((0, 1, 300, 500))}
    texts["gaps.txt"] = ["", "a", "", "", "b", ""]
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    small = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = L.ordered_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = {}
    for r in got:
        found.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.value
    assert {n: [lines[i] for i in range(len(lines))] for n, lines in found.items()} == {n: x for n, x in texts.items() if x}


def test_chat_read_in_file_order(spark, tmp_path):
    """The current chat and its history within a budget, straight from a log on disk."""
    folder = tmp_path / "papers" / "a-paper"
    folder.mkdir(parents=True)
    lines = [{"t": "2024-01-01T00:00:00Z", "question": f"q{i}", "answer": "a" * 8, "grounds": [], "notes": []} for i in range(6)]
    lines.insert(2, {"t": "2024-01-01T00:00:00Z", "new_chat": True})
    (folder / "chat.jsonl").write_text("\n".join(["", *map(json.dumps, lines[:4]), "{torn", "", *map(json.dumps, lines[4:])]) + "\n")
    rows, torn = L.read_log(spark, str(tmp_path), "chat")
    assert [(r.line_no, r.line) for r in torn.collect()] == [(5, "{torn")]
    turns = H.current_chat(rows.withColumn("new_chat", F.coalesce("new_chat", F.lit(False))))
    assert [(r.line_no, r.question) for r in turns.orderBy("line_no").collect()] == [(4, "q2"), (7, "q3"), (8, "q4"), (9, "q5")]
    kept = H.history_within_budget(turns, 25).orderBy("line_no").collect()
    assert [(r.question, r.trimmed) for r in kept] == [("q4", True), ("q5", True)]
