"""Search and sections shuffle a paper's text once where the paper is short, with the rows of the way that longer papers take."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliograph.operators import contains, layout
from foliograph.operators import search as S
from foliograph.plans.anchoring import searches
from foliograph.sources.fixtures import Library


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def shuffles(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "\n\n", "one line", "\n".join(["", "a b", " "] * 30), "\n" * 25 + "late", "\n".join(f"line {i} of {i % 7}" for i in range(85))]
    docs = [(k * 15 + p, t, "en", "s", len(t or "")) for k, t in enumerate(texts) for p in range(15)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    return Library(spark, root)


def test_page_text_needs_no_shuffle(spark, odd):
    assert rows(odd.page_text()) == rows(odd.page_text(odd.regions()))
    assert rows(odd.changed_page_text()) == rows(odd.page_text(odd.regions(odd.changed_lines())))
    assert shuffles(spark, odd._paged(F.split("text", "\n"))) == 0


def test_sections_shuffle_text_once(spark, lib, monkeypatch):
    regions, pages = lib.headed_regions(), lib.pages()
    short = layout.build_sections(regions, pages)[0]
    assert shuffles(spark, short) == 1
    want = rows(short)
    for block in (1, 12):  # all papers long, and some
        monkeypatch.setattr(layout, "BLOCK", block)
        assert rows(layout.build_sections(regions, pages)[0]) == want


def test_find_by_paper(spark, lib, monkeypatch):
    asked = searches(lib).unionByName(searches(lib).select("paper_id", F.lit("r").alias("query_id"), F.lit(" A").alias("query")))
    pages, sections = lib.page_text(), lib.sections()[0]
    asked = asked.localCheckpoint()
    found = S.find_in_papers(asked, pages, sections)
    assert shuffles(spark, found) <= 4  # the queries made distinct, then queries, pages and sections by paper
    want = rows(found)
    assert len(want) > 100
    for whole in (0, 2000):
        monkeypatch.setattr(contains, "WHOLE", whole)
        assert rows(S.find_in_papers(asked, pages, sections)) == want


def test_sections_read_the_documents_once(lib):
    """Sections, their rectangles and their pieces come from one kept table; pages need no shuffle."""
    kept = layout.sectioned(lib.headed_body())
    assert "documents.parquet" not in kept._jdf.queryExecution().executedPlan().toString()
    assert rows(kept) == rows(layout.section_rows(lib.headed_regions()))
    assert "Exchange" not in lib.pages()._jdf.queryExecution().executedPlan().toString()
    assert rows(lib.pages().select("paper_id", "page")) == rows(lib.regions().select("paper_id", "page").distinct())


def test_cut_at_terms(spark, odd, lib, monkeypatch):
    """Both ways cut as `cut_at` does at the `term_spans`; the short one shuffles a text once."""
    from foliograph.plans.anchoring import paper_terms

    text = "Graph nets: a Graph, graphs and (graph nets) -- graph\n-- nets"
    made = (spark.createDataFrame([(1, 0, text), (1, 1, ""), (2, 0, "no terms")], "paper_id long, page int, text string"),
            spark.createDataFrame([(1, t) for t in ("graph", "Graph nets", "GRAPH", "--", "nets", "(graph", "", " ")], "paper_id long, term string"))
    for docs, terms in (made, (lib.page_text(), paper_terms(lib)), (odd.page_text(), paper_terms(odd))):
        want = rows(S.cut_at(docs, S.term_spans(docs, terms, ["page"]), ["page"], link="term"))
        short = S.cut_at_terms(docs, terms, ["page"])
        assert want and rows(short) == want and shuffles(spark, short) <= 4
        with monkeypatch.context() as small:
            small.setattr(contains, "WHOLE", 12)
            assert rows(S.cut_at_terms(docs, terms, ["page"])) == want


def test_whole_lines_need_no_shuffle(spark):
    """Only texts with a hyphen at a line end are joined with words; the papers without one give none."""
    pages = spark.createDataFrame([(1, 0, "a multi-\r\nple of multiple"), (1, 1, "none"), (2, 0, "no breakhere")], "paper_id int, page int, text string")
    assert {r.paper_id for r in S.broken_words(pages).collect()} == {1}
    for words in (S.broken_words(pages), S.paper_words(pages)):
        assert sorted((r.paper_id, r.text) for r in S.reflow(pages, words, ["page"]).collect()) == [(1, "a multiple of multiple"), (1, "none"), (2, "no break-here")]


def test_entries_take_their_own_lines(spark, monkeypatch):
    """An entry does not carry the rest of its page, and is what the rest of its page gives."""
    lines = ["[1] One et al.", "Two, A. title-", "word", "", "[2] Three", " [3] in text", "[4]", "Four", "12", "x", "[1] Uno", "dos\r", "[5] none", "[6] Six", " ", "seven"]
    pages = spark.createDataFrame([(1, 0, "\n".join(lines)), (1, 1, "[2] Last\nof all"), (2, 0, "nothing")], "paper_id int, page int, text string")
    whole = S.X.first_entry
    rest = {"1": 0, "4": 6, "6": 13}
    want = {k: spark.range(1).select(whole(F.lit("\n".join(lines[i:])))).head()[0] for k, i in rest.items()} | {"2": "[2] Last of all"}
    assert {r.key: r.entry for r in S.bibliography(pages).collect()} == want
    monkeypatch.setattr(S.X, "first_entry", lambda t: t)
    assert max(len(r.entry.split("\n")) for r in S.bibliography(pages).collect()) <= 4


def test_pointers_are_found_once(spark, lib):
    """The kinds of pointers read one table, so a page is scanned once for all of them."""
    from foliograph.plans import anchoring as P

    refs = S.references(P.pointing_text(lib), ["page"]).withColumnRenamed("page", "doc")
    done = S.resolve_references(refs, lib.figures(), lib.sections()[0], P.formulas(lib), P.bibliography_text(lib), ["doc"])
    assert "see Figure" not in done._jdf.queryExecution().executedPlan().toString()
