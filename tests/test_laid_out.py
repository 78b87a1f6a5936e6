"""Pages meet their candidates with their text alone."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import anchoring as A


def test_text_is_shuffled_once(spark):
    pages = spark.createDataFrame([(1, 0, "some words\nof a page"), (1, 1, " a\x1cb "), (2, 0, "unasked")], "paper_id int, page int, text string")
    index = A.page_index(pages)
    wanted = spark.createDataFrame([(1, 0), (1, 0), (1, 1)], "paper_id int, page int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = A.laid_out(index, wanted)
        plan = held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    read = re.search(r"ReadSchema: struct<(.*?)>", plan)[1]
    assert "text:string" in read and "stripped" not in read
    want = index.where("paper_id = 1").select("paper_id", "page", "stripped", X.kept_offsets("text").alias("_off"))
    got = held.select("paper_id", "page", "stripped", "_off")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stripped_of_another_rule_comes_along(spark):
    index = spark.createDataFrame([(1, 0, "ab-\ncd", "abcd")], "paper_id int, page int, text string, stripped string")
    every = lambda text: F.sequence(F.lit(0), F.length(text) - 1)
    assert A.laid_out(index, index.select("paper_id", "page"), every).select("stripped").head()[0] == "abcd"


def test_marks_and_chunks_share_their_index(spark, monkeypatch):
    """The pages of a new extraction are stripped and written once for both."""
    box, corners = (0.0, 0.0, 9.0, 9.0), "x0 double, y0 double, x1 double, y1 double"
    pages = spark.createDataFrame([(1, 0, "changed text")], "paper_id int, page int, text string")
    regions = spark.createDataFrame([(1, 0, 0, *box, "text", "changed text")], f"paper_id int, page int, ord int, {corners}, label string, text string")
    stored = spark.createDataFrame([(1, "highlight", "h", "old", "old", "anchored", 0)], "paper_id int, kind string, id string, basis string, paper_basis string, state string, position long")
    marks = spark.createDataFrame([(1, "h", 0, *box)], f"paper_id int, q_id string, page int, {corners}")
    chunks = spark.createDataFrame([(1, "c", 0, 0, *box)], f"paper_id int, node_id string, rect_ord int, page int, {corners}")
    words = spark.createDataFrame([(1, 0)], "paper_id int, page int")
    made, used, whole = [], [], A.page_index

    class Stop(Exception):
        pass

    def stop(*given):
        used.append(given[-1])
        raise Stop

    monkeypatch.setattr(A, "page_index", lambda p: made.append(whole(p)) or made[-1])
    monkeypatch.setattr(A, "resolve_highlights", lambda *given: used.append(given[-1]) or (None, None))
    monkeypatch.setattr(A, "resolve_chunks", stop)
    try:
        A.reanchor(stored, marks, marks, chunks, chunks, pages, regions, words, pages)
    except Stop:
        pass
    assert len(made) == 1 and used == [made[0], made[0]]


def test_offsets_of_odd_texts(spark):
    """Characters outside the first plane count once, an empty text has none, nothing is matched for each character."""
    texts = ["", " ", "a\U0001F600 b　\x85c\n\x1c", "\U0001F600", "é\tx"]
    plan = spark.range(1).select(X.kept_offsets(F.lit("a b")))._jdf.queryExecution().logical().toString()
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", X.kept_offsets("text").alias("o")).orderBy("i").collect()
    assert [r.o for r in found] == [[i for i, ch in enumerate(t) if ch not in X.WS_CHARS] for t in texts]
    assert "regexp_extract_all" not in plan
