"""Scan a library of paper folders into tables: `<root>/papers/<paper_id>/source.json, board.json, notes/*.md, ...`.

Schemas are declared, so a scan reads each file once and prunes unused children; the folder name is the paper's id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators.graph import valid_node_id, valid_paper_id
from foliograph.operators.words import CORNERS

PAGE_RECT = "struct<page:int,rect:array<double>>"
SOURCE_SCHEMA = (
    "schema int, paper_id string, extracted_at timestamp, extractor string, "
    "pages array<struct<index:int,width:double,height:double,rotation:int>>, "
    f"sections array<struct<id:string,number:string,depth:int,title:string,heading_rect:{PAGE_RECT},extent:array<{PAGE_RECT}>,text:string>>, "
    f"figures array<struct<id:string,kind:string,label:string,caption:string,caption_rect:{PAGE_RECT},rect:{PAGE_RECT},confidence:string>>, "
    "regions array<struct<page:int,rect:array<double>,label:string>>, page_text array<struct<page:int,text:string>>")
QUOTE = "struct<exact:string,prefix:string,suffix:string>"
ANCHOR = f"struct<rects:array<{PAGE_RECT}>,quote:{QUOTE},start:{QUOTE},end:{QUOTE},position:long,state:string,page:int,rect:array<double>>"
BLOCK = "struct<kind:string,page:int,rect:array<double>,text:string,label:string>"
BOARD_SCHEMA = (
    "schema int, paper_id string, version long, goal string, anchor_basis string, "
    "nodes array<struct<id:string,type:string,parentId:string,position:struct<x:double,y:double>,data:struct<tags:array<string>,region:"
    f"{ANCHOR},blocks:array<{BLOCK}>,source_id:string,note:string,origin:string,name:string,tray:boolean,prompt:string,caption:string,clip:string,text:string>>>, "
    "edges array<struct<id:string,`from`:string,`to`:string,source:string,target:string,sourceHandle:string,targetHandle:string,data:struct<tags:array<string>>>>, "
    f"highlights array<struct<id:string,tags:array<string>,note:string,anchor:{ANCHOR}>>")
ACTIVITY_SCHEMA = "t timestamp, kind string, action string, detail string, _corrupt_record string"
CHAT_SCHEMA = "t timestamp, question string, selection string, answer string, grounds string, notes array<string>, new_chat boolean, _corrupt_record string"
AI_LOG_SCHEMA = "time timestamp, kind string, model string, route string, prompt string, raw string, grounded string, error string, extracted_at timestamp, _corrupt_record string"
LOGS = {"activity": ("activity.jsonl", ACTIVITY_SCHEMA), "chat": ("chat.jsonl", CHAT_SCHEMA), "ai": ("ai-log.jsonl", AI_LOG_SCHEMA)}

# The tags and slots a library starts with.
PRESET_TAGS = [("t-supports", "supports", "#15803D"), ("t-contradicts", "contradicts", "#B91C1C"), ("t-question", "question", "#7C3AED"), ("t-term", "term", "#0F766E")]
DEFAULT_SLOTS = [
    ("Background", "What do you need to know first: terms, notation, setup?"),
    ("Problem", "What problem is this solving, and why should anyone care?"),
    ("Prior work & gap", "What did earlier work do, and what did it miss?"),
    ("Main point", "In your own words: what is the one thing this paper shows?"),
    ("How it works", "What are the key parts of the approach?"),
    ("Evidence", "Does the evidence actually support the claim?"),
    ("Limits", "What does it assume, and where does it stop holding?"),
    ("My take", "What do the authors conclude, and do you agree?"),
    ("Open questions", "What is still open? What would you ask the authors?"),
]
FRONT_MATTER = r"(?s)\A---\nid: [^\n]+\n---\n"
AGENT_FRONT = r"(?s)\A---\n(.*?)\n---\n"


def folder_id(up: int = 2):
    """The paper's folder name in the scanned file's path."""
    return F.element_at(F.split("_metadata.file_path", "/"), -up)


def corners(rect: str) -> list:
    return [F.get(F.col(rect), F.lit(i)).alias(c) for i, c in enumerate(CORNERS)]


def _scan(spark: SparkSession, path: str, schema: str, **options) -> DataFrame | None:
    """None when no file matches."""
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def sources(spark: SparkSession, root: str) -> DataFrame:
    raw = _scan(spark, f"{root}/papers/*/source.json", SOURCE_SCHEMA, multiLine=True)
    raw = spark.createDataFrame([], SOURCE_SCHEMA) if raw is None else raw.withColumn("paper_id", folder_id())
    return raw.where(valid_paper_id(F.col("paper_id")))


def read_library(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """papers, pages, page_text, regions, sections, section_rects, figures."""
    raw = sources(spark, root)
    child = lambda name: raw.select("paper_id", F.posexplode(name).alias("ord", "c"))
    secs = child("sections")
    return {
        "papers": raw.select("paper_id", F.size("pages").alias("page_count"), "extractor", "extracted_at"),
        "pages": child("pages").select("paper_id", F.col("c.index").alias("page"), "c.width", "c.height", F.coalesce("c.rotation", F.lit(0)).alias("rotation")),
        "page_text": child("page_text").select("paper_id", "c.page", "c.text"),
        "regions": child("regions").select("paper_id", "ord", "c.page", *corners("c.rect"), "c.label"),
        "sections": secs.select("paper_id", F.col("c.id").alias("section_id"), "ord", "c.number", F.coalesce("c.depth", F.lit(1)).alias("depth"), "c.title",
                                F.col("c.heading_rect.page").alias("page"), *corners("c.heading_rect.rect"), F.coalesce("c.text", F.lit("")).alias("text")),
        "section_rects": secs.select("paper_id", F.col("c.id").alias("section_id"), "ord", F.posexplode("c.extent").alias("run_ord", "r")).select(
            "paper_id", "section_id", "ord", "run_ord", "r.page", *corners("r.rect")),
        "figures": child("figures").select("paper_id", F.col("c.id").alias("figure_id"), "ord", "c.kind", "c.label", F.coalesce("c.caption", F.lit("")).alias("caption"),
                                           F.col("c.rect.page").alias("page"), *corners("c.rect.rect"),
                                           *[F.get("c.caption_rect.rect", F.lit(i)).alias(f"cap_{k}") for i, k in enumerate(CORNERS)], F.col("c.caption_rect.page").alias("cap_page"), "c.confidence"),
    }


def raw_boards(spark: SparkSession, root: str) -> DataFrame:
    raw = _scan(spark, f"{root}/papers/*/board.json", BOARD_SCHEMA, multiLine=True)
    return spark.createDataFrame([], BOARD_SCHEMA) if raw is None else raw.withColumn("paper_id", folder_id())


def migrate_boards(raw: DataFrame) -> DataFrame:
    """Schema 1 boards in schema 2's shape: a highlight's page and rect become its one line, an edge's handles its ends, a
    note gains an origin, and a highlight's named note an edge of its own. Schema 2 boards pass through. A chunk's text is
    dropped; its blocks are `pieces.chunk_blocks` of its region."""
    old = F.coalesce("schema", F.lit(1)) == 1
    marks = F.coalesce("highlights", F.array())
    ids = F.transform(marks, lambda h: h["id"])
    new_marks = F.transform(marks, lambda h: h.withField("anchor", h["anchor"].withField("rects", F.array(F.struct(h["anchor"]["page"].alias("page"), h["anchor"]["rect"].alias("rect"))))))
    end = lambda node, handle: F.when(F.array_contains(ids, handle), handle).otherwise(node)
    new_edges = F.transform("edges", lambda e: e.withField("from", end(e["source"], e["sourceHandle"])).withField("to", end(e["target"], e["targetHandle"])))
    new_nodes = F.transform("nodes", lambda n: F.when(n["type"] == "note", n.withField("data.origin", F.lit("reader"))).otherwise(n))
    notes = F.transform(F.filter(F.coalesce("nodes", F.array()), lambda n: n["type"] == "note"), lambda n: n["id"])
    stepped = (raw.withColumn("_notes", notes).withColumn("edges", F.when(old, new_edges).otherwise(F.col("edges"))).withColumn("nodes", F.when(old, new_nodes).otherwise(F.col("nodes"))))
    linked = lambda h: F.exists(F.coalesce("edges", F.array()), lambda e: ((e["from"] == h["id"]) & (e["to"] == h["note"])) | ((e["to"] == h["id"]) & (e["from"] == h["note"])))
    cached = F.filter(marks, lambda h: F.array_contains("_notes", h["note"]) & ~linked(h))
    none = F.lit(None).cast("string")
    added = F.transform(cached, lambda h: F.struct(F.concat(F.lit("e-"), F.regexp_replace(h["id"], "^h-", "")).alias("id"), h["id"].alias("from"), h["note"].alias("to"), none.alias("source"), none.alias("target"),
                                                   none.alias("sourceHandle"), none.alias("targetHandle"), F.struct(F.array().cast("array<string>").alias("tags")).alias("data")))
    return (stepped.withColumn("edges", F.when(old, F.concat(F.coalesce("edges", F.array().cast(raw.schema["edges"].dataType)), added)).otherwise(F.col("edges")))
            .withColumn("highlights", F.when(old, new_marks).otherwise(F.col("highlights"))).withColumn("schema", F.lit(2)).drop("_notes"))


def read_boards(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """boards (every paper; version 0 without a file), nodes, node_rects, blocks, edges, highlights, highlight_rects."""
    raw = migrate_boards(raw_boards(spark, root))
    papers = sources(spark, root).select("paper_id")
    no_tags = F.array().cast("array<string>")
    child = lambda name: raw.select("paper_id", F.posexplode(name).alias("ord", "c"))
    nodes, marks = child("nodes"), child("highlights")
    return {
        "boards": papers.join(raw.select("paper_id", "version", "goal", "anchor_basis"), "paper_id", "left").select(
            "paper_id", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("goal", F.lit("")).alias("goal"), "anchor_basis"),
        "nodes": nodes.select("paper_id", F.col("c.id").alias("node_id"), F.col("ord").cast("long").alias("ord"), "c.type", F.col("c.parentId").alias("parent_id"),
                              F.coalesce("c.data.tags", no_tags).alias("tags"), "c.data.source_id", "c.data.name", "c.data.prompt", F.coalesce("c.data.tray", F.lit(False)).alias("tray"),
                              F.when(F.col("c.type") == "note", F.coalesce("c.data.origin", F.lit("reader"))).alias("origin"), F.col("c.data.region.start.exact").alias("text"),
                              "c.data.caption", "c.data.clip", "c.position.x", "c.position.y"),
        "node_rects": nodes.select("paper_id", F.col("c.id").alias("node_id"), F.posexplode("c.data.region.rects").alias("rect_ord", "r")).select("paper_id", "node_id", "rect_ord", "r.page", *corners("r.rect")),
        "blocks": nodes.select("paper_id", F.col("c.id").alias("node_id"), F.posexplode("c.data.blocks").alias("block_ord", "b")).select("paper_id", "node_id", "block_ord", "b.kind", "b.page", *corners("b.rect"), "b.text", "b.label"),
        "edges": child("edges").select("paper_id", F.col("c.id").alias("edge_id"), F.col("ord").cast("long").alias("ord"), F.col("c.from").alias("from_id"), F.col("c.to").alias("to_id"), F.coalesce("c.data.tags", no_tags).alias("tags")),
        "highlights": marks.select("paper_id", F.col("c.id").alias("h_id"), F.col("ord").cast("long").alias("ord"), F.coalesce("c.tags", no_tags).alias("tags"), "c.anchor.quote.exact",
                                   F.coalesce("c.anchor.quote.prefix", F.lit("")).alias("prefix"), F.coalesce("c.anchor.quote.suffix", F.lit("")).alias("suffix"),
                                   F.coalesce("c.anchor.position", F.lit(0)).alias("position"), F.coalesce("c.anchor.state", F.lit("anchored")).alias("state")),
        "highlight_rects": marks.select("paper_id", F.col("c.id").alias("h_id"), F.posexplode("c.anchor.rects").alias("rect_ord", "r")).select("paper_id", "h_id", "rect_ord", "r.page", *corners("r.rect")),
    }


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of text files, numbered from 0 in file order. A file may be read in many splits.

    A task reads a split's lines one after another, so their running ids differ from the split's first by the place in the split; the
    splits of a file, a row each, add up to where each of them starts. No file is sorted or read by one task."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value",
                                                               F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return raw.join(starts, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def read_log(spark: SparkSession, root: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, damaged lines) of a JSON-lines log with their `line_no` in the file; one torn line never hides the rest. Blank lines are
    no rows, but count."""
    name, schema = LOGS[kind]
    path = f"{root}/papers/*/{name}"
    try:
        lines = ordered_lines(spark, path).select(F.element_at(F.split("file", "/"), -2).alias("paper_id"), "line_no", "value").where("trim(value) <> ''")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        lines = spark.createDataFrame([], "paper_id string, line_no long, value string")
    read = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.withColumn("r", read)
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select("paper_id", "line_no", "r.*").drop("_corrupt_record"), parsed.where(bad).select("paper_id", "line_no", F.col("value").alias("line"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], "value string, paper_id string, file string, modified timestamp")
    return raw.select("value", folder_id(3).alias("paper_id"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """paper_id, node_id, markdown, has_sketch: front matter gone, the id from the file's name."""
    stem = F.regexp_replace("file", r"\.md$", "")
    notes = _texts(spark, f"{root}/papers/*/notes/*.md").withColumn("node_id", stem).where(valid_node_id(F.col("node_id")))
    sketches = _texts(spark, f"{root}/papers/*/notes/*.svg").select("paper_id", F.regexp_replace("file", r"\.svg$", "").alias("node_id"), F.lit(True).alias("_s"))
    return notes.join(sketches, ["paper_id", "node_id"], "left").select("paper_id", "node_id", F.regexp_replace("value", FRONT_MATTER, "").alias("markdown"), F.coalesce("_s", F.lit(False)).alias("has_sketch"))


def parse_agent_notes(raw: DataFrame) -> DataFrame:
    """`title` and the first word of `on` from front matter; malformed front matter is none at all. `raw`: value, file, ..."""
    head = F.regexp_extract("value", AGENT_FRONT, 1)
    lines = F.filter(F.transform(F.split(head, "\n"), X.ends_trimmed), lambda ln: ln != "")
    field = r"(?U)^[A-Za-z_][\w-]*:[ \t]*.*$"
    good = F.col("value").rlike(AGENT_FRONT) & F.forall(lines, lambda ln: ln.rlike(field))

    def value(name: str):
        found = F.filter(lines, lambda ln: ln.rlike(rf"^{name}:"))
        text = F.trim(F.regexp_replace(F.coalesce(F.element_at(F.when(F.size(found) > 0, found), -1), F.lit("")), rf"^{name}:[ \t]*", ""))
        return F.regexp_replace(text, r"^([\"'])(.*)\1$", "$2")

    none = F.lit(None).cast("string")
    keep = [c for c in raw.columns if c != "value"]
    return raw.select(*keep, F.when(good, F.nullif(value("title"), F.lit(""))).otherwise(none).alias("title"),
                      F.when(good, F.nullif(F.get(F.split(F.trim(value("on")), r"\s+"), F.lit(0)), F.lit(""))).otherwise(none).alias("on"),
                      F.when(good, F.regexp_replace("value", AGENT_FRONT, "")).otherwise(F.col("value")).alias("text"))


def read_agent_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes waiting in `agent/`, newest first; placed and hidden ones are not listed."""
    raw = _texts(spark, f"{root}/papers/*/agent/*.md").where(F.col("file").rlike(r"^[^/\\.][^/\\]*\.md$"))
    return parse_agent_notes(raw).orderBy(F.desc("modified"), F.desc("file"))


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    raw = _scan(spark, f"{root}/tags.json", "schema int, tags array<struct<id:string,name:string,colour:string>>", multiLine=True)
    if raw is None:
        return spark.createDataFrame(PRESET_TAGS, "tag_id string, name string, colour string")
    return raw.select(F.explode("tags").alias("t")).select(F.col("t.id").alias("tag_id"), "t.name", "t.colour")


def clean_slots(slots: DataFrame) -> DataFrame:
    """Names and prompts trimmed, nameless slots out, numbered anew by what is left."""
    rows = slots.select("ord", X.ends_trimmed("name").alias("name"), X.ends_trimmed("prompt").alias("prompt")).where("name <> ''")
    return rows


def read_template(spark: SparkSession, root: str) -> DataFrame:
    raw = _scan(spark, f"{root}/template.json", "schema int, slots array<struct<name:string,prompt:string>>", multiLine=True)
    if raw is None:
        return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(DEFAULT_SLOTS)], "ord int, name string, prompt string")
    return clean_slots(raw.select(F.posexplode("slots").alias("ord", "s")).select("ord", "s.name", "s.prompt"))


def paper_list(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """Id, first section's title else the id, page count; sorted by id."""
    first = sections.where("ord = 0").select("paper_id", F.col("title").alias("_t"))
    return papers.join(first, "paper_id", "left").select("paper_id", F.coalesce("_t", F.col("paper_id").cast("string")).alias("title"), "page_count").orderBy("paper_id")
