"""A marked line that its paper repeats is found on its own page."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from foliograph.operators import chunks as C
from foliograph.plans import registered


def papers(spark, root):
    line = "the same words stand here again today and tomorrow"
    docs = [(p, "\n".join([line] * 60), "en", "src1", 60 * len(line)) for p in (25, 44, 81, 102)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(25, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{root}/labels.parquet")


def test_repeated_lines_keep_their_page(spark, tmp_path):
    papers(spark, tmp_path)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    held = registered()
    want = con.execute(held.oracles["an17_quotes_in_region"]).fetchall()
    found = held.queries["an17_quotes_in_region"](spark, str(tmp_path)).select("paper_id", "q_id", "page").collect()
    assert want and sorted(map(tuple, found)) == sorted(want)


def test_only_broken_papers_give_words(spark):
    pages = spark.createDataFrame([(1, 0, "a multi-\nple of multiple"), (1, 1, "none"), (2, 0, "no break here")], "paper_id int, page int, text string")
    index = {(r.paper_id, r.page): r.stripped for r in C.card_index(pages).collect()}
    assert index == {(1, 0): "amultipleofmultiple", (1, 1): "none", (2, 0): "nobreakhere"}
    two = C.card_index(pages, 2, C.card_texts(pages)).select("paper_id", "page", "stripped", F.col("page_start")).collect()
    assert [tuple(r) for r in two] == [(1, 0, "amultipleofmultiplenone", 0)]
