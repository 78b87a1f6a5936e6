"""Hand-made cases for the column expressions."""

import pytest
from pyspark.sql import functions as F

from foliograph.functions import rects as R
from foliograph.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("title, number, depth", [("3.1 Title", "3.1", 2), ("A Simple Framework", None, 1), ("A. Proofs", "A", 1), ("2) Next", "2", 1), ("3.1.4 Deep", "3.1.4", 3), ("2024", None, 1)])
def test_section_number(spark, title, number, depth):
    assert one(spark, X.section_number("t"), t=title) == number
    assert one(spark, X.section_depth("t"), t=title) == depth


@pytest.mark.parametrize("text, kind, number", [("Figure 3. x", "figure", "3"), ("Table 3 shows", None, None), ("fig. 12: y", "figure", "12"), ("TABLE 2: z", "table", "2")])
def test_caption(spark, text, kind, number):
    assert one(spark, X.caption_kind("t"), t=text) == kind
    assert one(spark, X.caption_number("t"), t=text) == number


@pytest.mark.parametrize("text, expected", [("5.2 Super Mario Bros.", True), ("3 layers are used.", False), ("12", False), ("lower case", False), ("Method", True), ("x" * 121, False), ("■ Results", True)])
def test_is_heading(spark, text, expected):
    assert one(spark, X.is_heading(F.lit("section-header"), F.lit(3), "t"), t=text) is expected


def test_title_label_counts_on_first_page_only(spark):
    assert one(spark, X.is_heading(F.lit("title"), F.lit(1), "t"), t="Method") is False


def test_strip_and_offsets(spark):
    assert one(spark, X.strip_ws("t"), t="a \n b c") == "abc"
    assert one(spark, X.kept_offsets("t"), t="a \n b c") == [0, 4, 6]


def test_rectangles(spark):
    a, b = R.Rect(*[F.lit(float(v)) for v in (0, 0, 10, 10)]), R.Rect(*[F.lit(float(v)) for v in (5, 0, 15, 10)])
    assert one(spark, R.overlap_ratio(a, b)) == 0.5
    flat = R.Rect(*[F.lit(float(v)) for v in (3, 3, 3, 9)])
    assert one(spark, R.overlap_ratio(flat, b)) == 0.0
    assert one(spark, R.intersection(a, R.Rect(*[F.lit(float(v)) for v in (10, 0, 15, 10)])).x0) is None
    assert one(spark, R.normalise(R.Rect(*[F.lit(float(v)) for v in (9, 8, 1, 2)])).x0) == 1.0


def test_grounding_form(spark):
    assert one(spark, X.grounding_form("t"), t="diﬃcult  learn-\n ing") == "difficult learning"


def test_titles(spark):
    assert one(spark, X.quote_title("t"), t="5.1\nLearning rate\nmore") == "5.1 Learning rate"
    assert one(spark, X.first_line("t", 10), t="\n## A rather long heading") == "A rather …"
    assert one(spark, X.preview("t", 20), t="one two three four five six") == "one two three four…"


def test_sentence(spark):
    text = "First one. We define the gate (G) as a value. Next."
    at = text.index("gate")
    before, after = X.sentence_around(F.col("t"), F.lit(at), F.lit(at + 4))
    assert one(spark, before, t=text) == "We define the "
    assert one(spark, after, t=text) == " (G) as a value."


def test_definition_rules(spark):
    rules = X.definition_rules(F.lit("We define the "), F.lit(" (G) as a value"), F.lit(False))
    assert one(spark, rules) == ["we define", "abbreviation follows"]
    assert one(spark, X.definition_score(rules)) == 4
    weak = X.definition_rules(F.lit("x"), F.lit(" , i.e. y"), F.lit(True))
    assert one(spark, X.definition_score(weak)) == 2


def test_references(spark):
    text = "See Fig. 2, Table 1 and Eq. (3) in Section 4.1 and [3, 12]; Equation 5, §2."
    found = [(r["kind"], r["key"], text[r["start"]:r["end"]]) for r in one(spark, X.find_references(F.col("t")), t=text)]
    assert found == [("figure", "2", "Fig. 2"), ("table", "1", "Table 1"), ("equation", "3", "Eq. (3)"), ("section", "4.1", "Section 4.1"), ("citation", "3", "3"), ("citation", "12", "12"),
                     ("equation", "5", "Equation 5"), ("section", "2", "§2")]


def test_first_entry(spark):
    text = "\nDuchi, John, and Hazan, Elad. Adaptive sub-\ngradient methods.\nHinton, G. Deep.\n"
    assert one(spark, X.first_entry(F.col("t")), t=text) == "Duchi, John, and Hazan, Elad. Adaptive sub-gradient methods."
    assert one(spark, X.first_entry(F.col("t")), t="[1] One\ntwo\n12\nthree") == "[1] One two"


def test_slug(spark):
    assert one(spark, X.paper_slug(F.lit("Deep Nets!"), F.lit("arXiv: 1512.03385v1"), F.lit("x"))) == "deep-nets-1512.03385"


def test_definition_query_asks_for_the_cues_of_its_sql(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    folder = tmp_path / "documents.parquet"
    lines = "one line\nof words that is, with other cues\ni.e. a term and no more"
    spark.createDataFrame([(k, lines) for k in range(3)], "doc_id long, text string").write.parquet(str(folder))
    got = queries()["ex17_definition_score"](spark, str(tmp_path)).select("paper_id", "ord", "score", "rules").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    want = con.execute(f"SELECT paper_id, ord, score, rules FROM ({oracle_sql()['ex17_definition_score']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 9
