"""Words that are laid out where they are used give the rows of words laid out beforehand, and are not shuffled word by word."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliograph.operators import anchoring as A
from foliograph.operators import pieces as P
from foliograph.operators import search as S
from foliograph.operators import words as W
from foliograph.plans.anchoring import paper_terms
from foliograph.plans.layout import as_query_rects


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def shuffled(df) -> int:
    """Rows written by the shuffles of a plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = {}, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return sum(found.values())


def test_text_and_words_under(lib):
    rects = as_query_rects(lib.drags())
    keys = ["sel_id"]
    assert rows(W.text_under(lib.word_lines(), rects, keys), "paper_id", "sel_id", "text") == rows(W.text_under(lib.words(), rects, keys), "paper_id", "sel_id", "text")
    columns = ["paper_id", "page", "block", "line", "sel_id", "word_ord", "x0", "y0", "x1", "y1", "text"]
    assert rows(W.words_under(lib.word_lines(), rects, keys), *columns) == rows(W.words_under(lib.words(), rects, keys), *columns)


def test_matched_words(lib):
    spans = lib.highlights().select("paper_id", "h_id", "page", F.col("page_offset").alias("start"), (F.col("page_offset") + F.length("exact")).alias("end"))
    columns = ["paper_id", "page", "h_id", "block", "line", "word_ord", "x0", "y0", "x1", "y1", "text"]
    found = [A.matched_words(spans, words, lib.page_text(), ["h_id"]) for words in (lib.word_lines(), lib.words())]
    assert rows(found[0], *columns) == rows(found[1], *columns)


def test_term_occurrences_shuffle_lines(lib):
    """The words of a page are no rows of any shuffle."""
    terms = paper_terms(lib)
    columns = ["paper_id", "term", "page", "at", "x0", "y0", "x1", "y1"]
    found = S.term_occurrences(terms, lib.word_lines())
    assert rows(found, *columns) == rows(S.term_occurrences(terms, lib.words()), *columns)
    assert shuffled(found) < lib.words().count() / 4


def test_not_overlapping_items_once(spark):
    items = spark.createDataFrame([(1, 0, i, 10.0 * i, 0.0, 10.0 * i + 5, 300.0) for i in range(4)], "paper_id int, page int, k int, x0 double, y0 double, x1 double, y1 double")
    others = spark.createDataFrame([(1, 0, 12.0, 290.0, 16.0, 400.0), (1, 0, 25.0, 0.0, 30.0, 300.0), (2, 0, 0.0, 0.0, 99.0, 99.0)], "paper_id int, page int, x0 double, y0 double, x1 double, y1 double")
    left = P.not_overlapping(items, others, ["k"])
    assert sorted(r.k for r in left.collect()) == [0, 2, 3]
    assert not re.search(r"_band", left._jdf.queryExecution().toString())


def test_only_touched_lines_are_laid_out(spark):
    """A span lays out the words of its own lines, each line once; all spans of a page that match in either form are told apart."""
    lines = [(1, 0, i, 0, 100 * i, 10.0 * i, 10.0 * i + 8, " ".join(f"w{i}\x1cx{k}" for k in range(30))) for i in range(20)]
    rows_ = spark.createDataFrame(lines, "paper_id int, page int, block int, line int, line_first long, l_y0 double, l_y1 double, text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        seen.add(1)
        return text.split(" ")

    def laid(of):
        return W.let(cut(of("text")), lambda ws: F.transform(ws, lambda w, i: F.struct(
            (of("line_first") + i).alias("word_ord"), (of("l_y0") + i).alias("x0"), of("l_y0").alias("y0"), (of("l_y0") + i + 1).alias("x1"), of("l_y1").alias("y1"), w.alias("text"))))

    pages = spark.createDataFrame([(1, 0, "\n".join(row[-1] for row in lines))], "paper_id int, page int, text string")
    text = pages.head().text
    spans = spark.createDataFrame([(1, 0, str(k), text.index("w3") + k, text.index("w5") - 2) for k in range(9)], "paper_id int, page int, k string, start int, end int")
    held = W.Lines(rows_.localCheckpoint(), laid, lambda of: of("text"))
    columns = ["paper_id", "page", "k", "block", "line", "word_ord", "x0", "y0", "x1", "y1", "text"]
    whole = held.rows.select("paper_id", "page", "block", "line", F.explode(laid(F.col)).alias("w")).select("paper_id", "page", "block", "line", "w.*")
    want = rows(A.matched_words(spans, whole, pages, ["k"]), *columns)
    seen.value = 0
    got = rows(A.matched_words(spans, held, pages, ["k"]), *columns)
    assert want == got and len(got) > 9 * 50
    assert 0 < seen.value <= 2


def test_quotes_that_occur_once_need_no_words(spark, lib):
    """What is on the page but once does not depend on the words under the rect."""
    pages = spark.createDataFrame([(1, 0, "one two three\nfour two five")], "paper_id int, page int, text string")
    asked = spark.createDataFrame([(1, 0, "a", "three\nfour", 0.0, 0.0, 9.0, 9.0)], "paper_id int, page int, k string, exact string, q_x0 double, q_y0 double, q_x1 double, q_y1 double")
    broken = W.Lines(lib.word_lines().rows.limit(1), lambda of: F.raise_error(F.lit("words were laid out")).cast(
        "array<struct<word_ord:bigint,x0:double,y0:double,x1:double,y1:double,text:string>>"), lambda of: of("text"))
    assert [tuple(r) for r in A.quote_under(asked, pages, broken.where(lambda r: r.withColumn("paper_id", F.lit(1)).withColumn("page", F.lit(0))), ["k"]).select("k", "start", "prefix", "suffix").collect()] == [
        ("a", 8, "one two ", " two five")]


def test_covered_lines_are_not_laid_out(spark, lib):
    """Only lines that a rectangle cuts are laid out for its text."""
    held = lib.word_lines()
    refused = lambda of: F.raise_error(F.concat(F.lit("laid out: "), of("text"))).cast(
        "array<struct<word_ord:bigint,x0:double,y0:double,x1:double,y1:double,text:string>>")
    over = lib.regions().select("paper_id", "page", "ord", *[F.col(c).alias(f"q_{c}") for c in W.CORNERS])
    want = rows(W.text_under(lib.words(), over, ["ord"]), "paper_id", "ord", "text")
    assert want and rows(W.text_under(W.Lines(held.rows, refused, held.said, held.reach), over, ["ord"]), "paper_id", "ord", "text") == want


def test_settled_quotes_are_not_cut(spark, monkeypatch):
    """An exact place that misses the full score by less than a changed character costs is final."""
    pages = spark.createDataFrame([(1, k, f"page {k} has its own words and nothing more of them") for k in range(40)], "paper_id int, page int, text string")
    quotes = spark.createDataFrame([(1, "a", "page 7 has its own words", "", "", 0, 0), (1, "b", "page 7 had its own words", "", "", 0, 0)],
                                   "paper_id int, q_id string, exact string, prefix string, suffix string, position int, page_hint int")
    index, cut, whole = A.page_index(pages), [], A.piece_candidates
    monkeypatch.setattr(A, "piece_candidates", lambda q, *rest: cut.extend(r.q_id for r in q.collect()) or whole(q, *rest))
    found = {r.q_id: (r.page, r.start) for r in A.find_quote(quotes, index).collect()}
    assert cut == ["b"] and found == {"a": (7, 0), "b": (7, 0)}
