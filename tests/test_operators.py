"""Operators against hand-made tables and brute force."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliograph.functions.similarity import best_window, lcs_length, similarity
from foliograph.operators import anchoring as A
from foliograph.operators import contains
from foliograph.operators import graph as G
from foliograph.operators import grounding as GD
from foliograph.operators import history as H
from foliograph.operators import layout as L
from foliograph.operators import search as S
from foliograph.operators.contains import substring_join
from foliograph.operators.spread import materialise, page_numbering, running

BOX = "x0 double, y0 double, x1 double, y1 double"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_matches_the_plain_recurrence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 90))) for _ in range(2))
        assert lcs_length(a, b) == slow_lcs(a, b)
    assert similarity("", "") == 1.0 and similarity("a", "") == 0.0


@pytest.mark.parametrize("m", [8, 40, 64, 65, 130])
def test_best_window_is_the_best_of_all(m):
    rng = random.Random(m)
    for _ in range(4):
        needle = "".join(rng.choices("abcde", k=m))
        text = "".join(rng.choices("abcdef", k=60)) + needle[: m // 2] + "x" + needle[m // 2 + 1:] + "".join(rng.choices("abcdef", k=50))
        windows = [text[max(0, i):i + m] for i in range(1 - m, len(text))]
        best = max(2 * slow_lcs(needle, w) / (m + len(w)) for w in windows if w)
        assert best_window(needle, text, 0.0)[2] == pytest.approx(best)


def test_substring_join_finds_every_occurrence(spark):
    rng = random.Random(5)
    texts = [(i % 3, i, "".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(40)]
    needles = [(i % 3, i, "".join(rng.choices("ab", k=rng.randint(1, 9)))) for i in range(30)]
    got = substring_join(spark.createDataFrame(needles, "paper_id int, n int, needle string"), spark.createDataFrame(texts, "paper_id int, t int, body string"), "needle", "body", ["t"])
    want = {(n, t, i) for p, n, nd in needles for q, t, b in texts if p == q for i in range(len(b)) if b.startswith(nd, i)}
    rows = [(r["n"], r["t"], r["at"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_short_papers_meet_as_they_stand_and_long_ones_by_blocks(spark, monkeypatch):
    rng = random.Random(6)
    texts = [(i % 3, i, "".join(rng.choices("ab\\\U0001f600\n", k=rng.randint(0, 60 if i % 3 else 200)))) for i in range(40)]
    needles = [(i % 3, i, "".join(rng.choices("ab\\\U0001f600\n", k=rng.randint(0, 3)))) for i in range(30)] + [(0, 30, "\\E"), (1, 31, "\\Q"), (2, 32, "aa")]
    want = {(n, t, i) for p, n, nd in needles for q, t, b in texts if p == q and nd for i in range(len(b)) if b.startswith(nd, i)}
    frames = spark.createDataFrame(needles, "paper_id int, n int, needle string"), spark.createDataFrame(texts, "paper_id int, t int, body string")
    by_blocks, asked = contains._by_blocks, []
    monkeypatch.setattr(contains, "_by_blocks", lambda *a: asked.append(1) or by_blocks(*a))
    for whole, blocks in ((10_000, 0), (1000, 1), (0, 1)):
        monkeypatch.setattr(contains, "WHOLE", whole)
        asked.clear()
        rows = [(r["n"], r["t"], r["at"]) for r in substring_join(*frames, "needle", "body", ["t"]).collect()]
        assert set(rows) == want and len(rows) == len(want) and len(asked) == blocks
        held = {(r["n"], r["t"]) for r in substring_join(*frames, "needle", "body", ["t"], places=False).collect()}
        assert held == {w[:2] for w in want}


def test_kept_tables_are_packed(spark):
    kept = materialise(spark.range(2000).selectExpr("id", "repeat('the same words again ', 50) AS text"))
    size = sum(Path(f.removeprefix("file://")).stat().st_size for f in kept.inputFiles())
    assert kept.where("length(text) = 1050").count() == 2000 and size < 200_000  # 2 MB of text


def test_running_crosses_blocks(spark):
    rows = [(p, i, i % 7) for p in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "paper_id int, ord int, v int")
    got = running(df, ["paper_id"], "ord", F.col("v"), "s", block=8).collect()
    assert {(r["paper_id"], r["ord"]): r["s"] for r in got} == {(p, i): sum(j % 7 for j in range(i + 1)) for p in (1, 2) for i in range(50)}


def test_page_numbering(spark):
    df = spark.createDataFrame([(1, p, y) for p in range(5) for y in range(3)], "paper_id int, page int, y int")
    got = page_numbering(df, ["paper_id"], [F.col("y")], "row").collect()
    assert all(r["row"] == r["page"] * 3 + r["y"] for r in got)


def test_column_runs_never_cross_the_gap(spark):
    rects = [(1, 1, 0, 0, 50.0, 100.0, 290.0, 120.0), (1, 1, 1, 0, 50.0, 130.0, 290.0, 150.0), (1, 1, 2, 0, 320.0, 80.0, 560.0, 100.0), (1, 1, 3, 0, 320.0, 110.0, 560.0, 130.0), (1, 1, 4, 1, 50.0, 80.0, 290.0, 90.0)]
    df = spark.createDataFrame(rects, f"paper_id int, s int, ord int, page int, {BOX}")
    pages = spark.createDataFrame([(1, 0, 612.0), (1, 1, 612.0)], "paper_id int, page int, width double")
    got = [tuple(r[c] for c in ("run_ord", "page", "x0", "y0", "x1", "y1")) for r in L.column_runs(df, pages, ["paper_id", "s"]).orderBy("run_ord").collect()]
    assert got == [(0, 0, 50.0, 100.0, 290.0, 150.0), (1, 0, 320.0, 80.0, 560.0, 130.0), (2, 1, 50.0, 80.0, 290.0, 90.0)]


def test_inline_headings_continue_the_sequence(spark):
    heads = [(1, 0, 0, "section-header", "3.2.1 Deep", None), (1, 1, 0, "text", "body", None)]
    regions = spark.createDataFrame([(p, o, pg, 0.0, 0.0, 500.0, 500.0, lb, hl, t) for p, o, pg, lb, t, hl in heads], f"paper_id long, ord int, page int, {BOX}, label string, header_level int, text string")
    texts = ["3.2.2 Next", "plain", "9 Wrong", "plain", "4 Last", "plain", "3.3 Back", "plain", "5 thin", "6 Thin"]
    lines = [(1, 0, 1, 0.0, float(i * 20), 100.0, float(i * 20 + 12), t, not t.endswith("thin"), 10.0) for i, t in enumerate(texts)]
    ln = spark.createDataFrame(lines, f"paper_id long, page int, block long, {BOX}, text string, bold boolean, size double")
    sizes = spark.createDataFrame([(1, 0, 10.0)], "paper_id long, page int, body_size double")
    got = [r["text"] for r in L.inline_headings(ln, sizes, regions).orderBy("line_idx").collect()]
    assert got == ["3.2.2 Next", "4 Last"]


def test_join_hyphens(spark):
    docs = spark.createDataFrame([(1, 0, "algo-\nrithms and state-of-the-\nart x-\ny-\nz")], "paper_id int, d int, text string")
    words = lambda *w: spark.createDataFrame([(1, x) for x in w], "paper_id int, word string")
    assert S.join_hyphens(docs, words("algorithms"), ["d"]).first()["text"] == "algorithms and state-of-the-\nart x-\ny-\nz"
    assert S.join_hyphens(docs, words("xy"), ["d"]).first()["text"] == "algo-\nrithms and state-of-the-\nart xy-\nz"


def quotes(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "paper_id long, q_id string, exact string, prefix string, suffix string, position long, page_hint int")


def test_reflow_keeps_unknown_hyphens(spark):
    docs = spark.createDataFrame([("p", 0, "a state-of-the-\nart way"), ("p", 1, "algo-\nrithms and\nmore")], "paper_id string, k int, text string")
    words = spark.createDataFrame([("p", "algorithms")], "paper_id string, word string")
    got = {r.k: r.text for r in S.reflow(docs, words, ["k"]).collect()}
    assert got == {0: "a state-of-the-art way", 1: "algorithms and more"}


def rewritten(rng, text, share):
    """`text` with about a share of its characters lost, gained or replaced."""
    out = []
    for ch in text:
        roll = rng.random()
        out.append("" if roll < share / 3 else ch + rng.choice("xyz") if roll < share * 2 / 3 else rng.choice("xyz") if roll < share else ch)
    return "".join(out)


def plain_place(needle, pre, suf, position, hint, pages, least=0.6):
    """The best place by trying every page: pages are (page, text), whitespace-free here, so offsets need no mapping."""
    total, at_page, found = max(1, sum(len(t) for _, t in pages)), 0, []
    for page, text in sorted(pages):
        hits = [(i, i + len(needle), 1.0) for i in range(len(text)) if text.startswith(needle, i)]
        if not hits and len(needle) >= 8 and (best := best_window(needle, text, least)):
            hits = [best]
        for s, e, alike in hits:
            side = [1.0 if not want else similarity(want, got) for want, got in ((pre, text[max(0, s - len(pre)):s]), (suf, text[e:e + len(suf)]))]
            score = (50 * alike + 20 * side[0] + 20 * side[1] + 2 * (1 - min(1, abs(at_page + s - position) / total))) / 92
            if score >= 0.5:
                found.append((round(score, 9), -abs(page - hint), -page, -s))
        at_page += len(text)
    return max(found, default=None)


def test_find_quote_is_the_best_of_all_pages(spark):
    rng = random.Random(11)
    papers = {p: [(n, "".join(rng.choices("abcdefgh", k=rng.choice([12, 60, 150, 200])))) for n in range(rng.randint(1, 5))] for p in range(14)}
    rows = []
    for p, pages in papers.items():
        for k, share in enumerate((0.0, 0.03, 0.1, 0.25, 0.9)):
            n, text = rng.choice(pages)
            i = rng.randrange(max(1, len(text) - 40))
            rows.append((p, f"q{k}", rewritten(rng, text[i:i + rng.choice([20, 40])], share) or "a", text[max(0, i - 8):i], text[i + 40:i + 48], rng.randrange(300), n))
    for p in (0, 1):  # a copy on another page scores above the changed place the quote came from, and a quote longer than its page
        papers[p].append((9, rewritten(rng, papers[p][0][1], 0.02)))
        rows.append((p, "long", "ab" + rewritten(rng, papers[p][0][1], 0.02) * 2, "", "", 0, 0))
    pages = spark.createDataFrame([(p, n, t) for p, ps in papers.items() for n, t in ps], "paper_id long, page int, text string")
    asked = spark.createDataFrame(rows, "paper_id long, q_id string, exact string, prefix string, suffix string, position long, page_hint int")
    got = {(r.paper_id, r.q_id): (round(r.score, 9), -abs(r.page - r.page_hint), -r.page) for r in A.find_quote(asked, A.page_index(pages)).collect()}
    want = {(r[0], r[1]): plain_place(*r[2:], papers[r[0]]) for r in rows}
    assert got == {k: v[:3] for k, v in want.items() if v}
    assert sum(0.5 < v[0] < 0.99 for v in want.values() if v) > 20


@pytest.mark.parametrize("least", [0.95, 0.85])
def test_changed_copies_are_found_in_any_paper(spark, least):
    rng = random.Random(17)
    passages = [(k, "".join(rng.choices("abcdefghijkl", k=rng.choice([30, 70])))) for k in range(6)]
    papers = {p: [(n, "".join(rng.choices("abcdefghijkl", k=rng.randint(0, 120))) + (rewritten(rng, rng.choice(passages)[1], rng.choice([0, 0.02, 0.06])) if n % 2 else ""))
                  for n in range(4)] for p in range(12)}
    papers[50] = [(0, passages[0][1][5:27]), (1, passages[1][1][:-1] + "q")]  # pages shorter than the passage
    pages = spark.createDataFrame([(p, n, t) for p, ps in papers.items() for n, t in ps], "paper_id long, page int, text string")
    asked = spark.createDataFrame([(k, t, "", "", 0, 0) for k, t in passages], "q_id long, exact string, prefix string, suffix string, position long, page_hint int")
    found = A.find_everywhere(asked, A.page_index(pages), least)
    got = {(r.q_id, r.paper_id): (round(r.score, 9), -r.page, -r.page) for r in found.collect()}
    want = {(k, p): plain_place(t, "", "", 0, 0, ps, least) for k, t in passages for p, ps in papers.items()}
    assert got == {k: v[:3] for k, v in want.items() if v}
    assert len({v[0] for v in got.values()}) > 5 and (0, 50) in got
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_marks_over_three_pages_are_found(spark):
    texts = ["start alpha beta gamma", "delta epsilon zeta eta", "theta iota kappa end"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "paper_id long, page int, text string")
    quote = "gamma" + texts[1] + "theta iota"
    quotes = spark.createDataFrame([(1, "q", quote, "", "", 17, 0, 3), (1, "gone", "nothing like it at all here", "", "", 17, 0, 3)],
                                   "paper_id long, q_id string, exact string, prefix string, suffix string, position int, page_hint int, span int")
    found = A.over_pages(quotes, A.page_index(pages), 3).orderBy("page").collect()
    assert [(r.q_id, texts[r.page][r.start:r.end]) for r in found] == [("q", "gamma"), ("q", texts[1]), ("q", "theta iota")]


def test_find_quote(spark):
    text = "one cat sat. two cat sat. three cat sat. four cat sat."
    pages = spark.createDataFrame([(1, 0, text), (1, 1, "nothing of the kind is printed here at all")], "paper_id long, page int, text string")
    third = text.index("cat sat", text.index("three"))
    q = quotes(spark, ("third", "cat sat", "three ", ". four", third, 0), ("exact", "two cat", "sat. ", " sat.", 13, 0), ("gone", "zebras quite elsewhere", "", "", 0, 0), ("fuzzy", "three cot sat. four", "", "", 20, 0))
    got = {r["q_id"]: r for r in A.find_quote(q, A.page_index(pages)).collect()}
    assert got["third"]["start"] == third and got["third"]["score"] == pytest.approx(1.0)
    assert got["exact"]["score"] == pytest.approx(1.0)
    assert "gone" not in got
    assert text[got["fuzzy"]["start"]:got["fuzzy"]["end"]] == "three cat sat. four"


def test_find_quote_against_brute_force(spark):
    """Every page of the paper scored in plain Python gives the same winner."""
    rng = random.Random(11)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    pages = [" ".join(rng.choices(vocab, k=40)) for _ in range(4)]
    rows = []
    for i in range(12):
        page = rng.randrange(4)
        words = pages[page].split()
        at = rng.randrange(len(words) - 6)
        piece = words[at:at + 6]
        if i % 2:
            piece[2] = "omega"
        start = len(" ".join(words[:at])) + (1 if at else 0)
        rows.append((f"q{i}", " ".join(piece), pages[page][max(0, start - 32):start], "", start, page))
    index = A.page_index(spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)], "paper_id long, page int, text string"))
    got = {r["q_id"]: (r["page"], r["start"], round(r["score"], 9)) for r in A.find_quote(quotes(spark, *rows), index).collect()}
    total = sum(map(len, pages))
    for q_id, exact, prefix, suffix, position, hint in rows:
        needle, pre = exact.replace(" ", ""), prefix.replace(" ", "")
        best = None
        for p in sorted(range(4), key=lambda n: abs(n - hint)):
            flat = pages[p].replace(" ", "")
            offs = [i for i, c in enumerate(pages[p]) if c != " "]
            cands = [(i, i + len(needle), 1.0) for i in range(len(flat)) if flat.startswith(needle, i)]
            if not cands and (w := best_window(needle, flat, 0.6)):
                cands = [w]
            for s, e, qs in cands:
                before = flat[max(0, s - len(pre)):s] if pre else ""
                glob = sum(map(len, pages[:p])) + offs[s]
                score = (50 * qs + 20 * similarity(pre, before) + 20 * 1.0 + 2 * (1 - min(1, abs(glob - position) / total))) / 92
                if score >= 0.5 and (best is None or score > best[2]):
                    best = (p, offs[s], score)
        assert got[q_id] == (best[0], best[1], round(best[2], 9)), q_id


def test_split_match_takes_exact_pieces(spark):
    pages = spark.createDataFrame([(1, 0, "Left column text. The quote starts here"), (1, 1, "Figure words. and goes on there. Then more")], "paper_id long, page int, text string")
    q = quotes(spark, ("x", "The quote starts here and goes on there.", "column text. ", " Then", 18, 0))
    got = [(r["page"], r["start"], r["end"]) for r in A.split_match(q, A.page_index(pages)).orderBy("page").collect()]
    assert got == [(0, 18, 39), (1, 14, 32)]


def test_round_trip_unchanged_text_stays_anchored(lib):
    from foliograph.plans.anchoring import mark_quotes, mark_rects

    states, moved = A.resolve_highlights(mark_quotes(lib), mark_rects(lib), lib.page_text(), lib.words())
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    # A mark whose words recur on its page is quoted at the first place, so a few may move; none is lost.
    assert "orphaned" not in counts and counts["anchored"] >= 0.9 * sum(counts.values())


def test_ground_needs_word_boundaries(spark):
    spans = spark.createDataFrame([(1, "p1-r1", 0, 1, 0.0, 0.0, 1.0, 1.0, "It fails because of the noise.")], f"paper_id int, span_id string, page int, ord int, {BOX}, text string")
    claims = spark.createDataFrame([(1, "p1-r1", "cause of the"), (1, "p1-r1", "because of the"), (1, "p1-r1", "of the"), (1, "p9-r9", "because of the")], "paper_id int, span_id string, quote string")
    assert [r["quote"] for r in GD.ground(claims, spans).collect()] == ["because of the"]


@pytest.mark.parametrize("raw, parts", [('{"a": 1}', 1), ('{"a": "}"} \n {"b": {"c": 2}}', 2), ('{"a": 1', None), ('x {"a": 1}', None), ('{"a": "\\"}"}', 1), ("", None)])
def test_split_objects(spark, raw, parts):
    got = spark.createDataFrame([(raw,)], "raw string").select(GD.split_objects(F.col("raw")).alias("p")).first()["p"]
    assert (None if got is None else len(got)) == parts


def test_history_budget(spark):
    turns = spark.createDataFrame([(1, i, "12345", "67890") for i in range(3)], "paper_id int, line_no int, question string, answer string")
    got = H.history_within_budget(turns, 25).collect()
    assert sorted(r["line_no"] for r in got) == [1, 2] and all(r["trimmed"] for r in got)


def test_new_connections(spark):
    none = spark.createDataFrame([], "paper_id int, edge_id string, from_id string, to_id string, ord int")
    cand = spark.createDataFrame([(1, "1", "a", "b", 0), (1, "2", "b", "a", 1), (1, "3", "a", "a", 2)], none.schema)
    assert [r["edge_id"] for r in G.new_connections(none, cand).collect()] == ["1"]


def test_ancestors_survive_a_cycle(spark):
    nodes = spark.createDataFrame([(1, "g1", "g2", "group"), (1, "g2", "g1", "group"), (1, "n", "g1", "chunk")], "paper_id int, node_id string, parent_id string, type string")
    got = {(r["node_id"], r["ancestor_id"], r["depth"]) for r in G.ancestors(nodes).collect()}
    assert got == {("g1", "g2", 1), ("g2", "g1", 1), ("n", "g1", 1), ("n", "g2", 2)}


def test_paint_marks(spark):
    blocks = spark.createDataFrame([(1, 1, "the cat sat on the mat and the cat ran off")], "paper_id int, block_id int, text string")
    marks = spark.createDataFrame([(1, "h1", 0, "the cat", "mat and ", " ran"), (1, "h2", 1, "the", "", ""), (1, "h3", 2, "ran off to the far hills", "", ""), (1, "h4", 3, "the cat ran off then", "", "")],
                                  "paper_id int, h_id string, ord int, exact string, prefix string, suffix string")
    pairs = marks.select("paper_id", F.lit(1).alias("block_id"), "h_id")
    got = [(r["text"], r["h_id"]) for r in S.paint_marks(blocks, marks, pairs).orderBy("part").collect()]
    assert got == [("the cat sat on the mat and ", None), ("the cat", "h1"), (" ran off", None)]


def test_split_terms_longest_first(spark):
    docs = spark.createDataFrame([(1, 1, "Deep neural networks and networks, Networked")], "paper_id int, d int, text string")
    terms = spark.createDataFrame([(1, "networks"), (1, "neural networks")], "paper_id int, term string")
    got = [(r["text"], r["term"]) for r in S.cut_at(docs, S.term_spans(docs, terms, ["d"]), ["d"], link="term").orderBy("part").collect()]
    assert got == [("Deep ", None), ("neural networks", "neural networks"), (" and ", None), ("networks", "networks"), (", Networked", None)]


def test_validate_board_finds_child_before_parent(spark):
    nodes = spark.createDataFrame([(1, "n-b", "n-a", "chunk", 0), (1, "n-a", None, "group", 1)], "paper_id int, node_id string, parent_id string, type string, ord int")
    empty_e = spark.createDataFrame([], "paper_id int, edge_id string, from_id string, to_id string")
    empty_h = spark.createDataFrame([], "paper_id int, h_id string")
    assert [(r["id"], r["problem"]) for r in G.validate_board(nodes, empty_e, empty_h).collect()] == [("n-b", "listed before its parent")]


def slow_rows(runs):
    """Each run joins the first row whose last run takes it."""
    rows = []
    for run in sorted(runs, key=lambda r: (r[4], r[3])):
        x0, y0, x1, y1 = run[3:7]
        for row in rows:
            a0, b0, a1, b1 = row[-1][3:7]
            if min(b1, y1) - max(b0, y0) > 0.5 * min(b1 - b0, y1 - y0) and 0 <= x0 - a1 <= 2 * max(row[-1][9], run[9]):
                row.append(run)
                break
        else:
            rows.append([run])
    return sorted((r[0][2], " ".join(x[7] for x in sorted(r, key=lambda x: x[3]))) for r in rows)


def test_merge_runs_are_merged_rows(spark):
    """Blocks with even rows, wide gaps, mixed heights and nested runs: the same lines as from rows, and even blocks never become rows of runs."""
    rng = random.Random(8)
    kind = f"{BOX}, text string, bold boolean, size double"
    rows = []
    for block in range(60):
        for k in range(rng.randrange(0, 14)):
            x, y = 50.0 + k % 4 * rng.choice([20, 20, 60]), 70.0 + 14 * (k // 4) + (rng.choice([0, 5, 9]) if block % 3 else 0)
            rows.append((1, block // 20, block, x, y, x + 16, y + (rng.choice([6, 12, 40]) if block % 3 else 12), f"w{k} ", rng.random() < 0.5, rng.choice([10.0, 12.0])))
    spans = spark.createDataFrame(rows, f"paper_id long, page int, block int, {kind}")
    blocks = spans.groupBy("paper_id", "page", "block").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text", "bold", "size")).alias("runs"))
    columns = ["block", "x0", "y0", "x1", "y1", "text", "bold", "size"]
    got, want = (sorted(map(tuple, d.select(*columns).collect())) for d in (L.merge_runs(blocks), L.merge_rows(spans)))
    assert got == want and len(want) > 100


def test_merge_rows_with_interleaved_heights(spark):
    state = random.Random(7)
    runs = [(1, 0, 0, 50.0, 10.0, 60.0, 20.0, "A", True, 10.0), (1, 0, 0, 300.0, 10.0, 310.0, 20.0, "B", False, 10.0), (1, 0, 0, 65.0, 10.2, 75.0, 20.2, "C", True, 10.0)]
    for block in range(1, 9):
        for n in range(40):
            x, y = state.randint(0, 60) * 5 + n / 100, state.randint(0, 6) * 11 + state.random() * 3
            runs.append((1, 0, block, x, y, x + state.randint(5, 25), y + 10, f"w{n}", n % 3 == 0, 10.0))
    df = spark.createDataFrame(runs, f"paper_id bigint, page int, block bigint, {BOX}, text string, bold boolean, size double")
    got = [(r.block, r.text) for r in L.merge_rows(df).collect()]
    assert {t for b, t in got if b == 0} == {"A C", "B"}
    assert sorted(got) == [x for b in range(9) for x in slow_rows([r for r in runs if r[2] == b])]


def boards(spark, groups, others=()):
    rows = [(1, f"g{i}", "group", None if p is None else f"g{p}") for i, p in groups] + [(1, f"c{i}", "chunk", f"g{p}") for i, p in others]
    return spark.createDataFrame(rows, "paper_id long, node_id string, type string, parent_id string")


def walked(groups, others):
    up, found = dict(groups), {}
    for name, start in [*((f"g{i}", p) for i, p in groups), *((f"c{i}", p) for i, p in others)]:
        seen, at, depth = [], start, 1
        while at is not None and at in up and f"g{at}" not in seen and f"g{at}" != name:
            seen.append(f"g{at}")
            at = up[at]
        found.update({(name, a): d for d, a in enumerate(seen, 1)})
    return found


@pytest.mark.parametrize("groups", [[(0, None)], [(0, 1), (1, 0)], [(0, 0)], [(i, i - 1 if i else None) for i in range(40)], [(i, (i + 1) % 7 if i < 7 else i - 6) for i in range(23)],
                                    [(i, None if i == 9 else (i * 7 + 3) % 31) for i in range(30)]])
def test_closure_is_that_of_walking_up(spark, groups):
    others = [(i, i * 3 % (len(groups) + 1)) for i in range(12)]
    got = {(r.node_id, r.ancestor_id): r.depth for r in G.ancestors(boards(spark, groups, others)).collect()}
    assert got == walked(groups, others)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(G, "materialise", lambda df: calls.append(1) or materialise(df))
    assert G.ancestors(boards(spark, [(i, i - 1 if i else None) for i in range(600)])).count() == 600 * 599 // 2
    assert len(calls) <= 1 + 3 * 11


def test_terms_of_any_length(spark):
    rng = random.Random(12)
    spell = ["A", "bee", "Bee.", "(cat)", "dog", "-", "the", "The", "x1"]
    pages = [[rng.choice(spell) for _ in range(60)] for _ in range(4)]
    words = [(1, p, i, float(i), 0.0, i + 0.5, 1.0, w) for p, ws in enumerate(pages) for i, w in enumerate(ws)]
    terms = {" ".join(rng.choices(["a", "BEE", "cat!", "dog", "the", "x1"], k=rng.randint(1, 4))) for _ in range(40)} | {"the", "bee cat dog the a", "--", "  the   bee "}
    bare = lambda w: re.sub(r"^\W+|\W+$", "", w).lower()
    want = set()
    for t in terms:
        toks = [b for w in t.split() if (b := bare(w))]
        want |= {(t, p, float(i), i + len(toks) - 0.5) for p, ws in enumerate(pages) for i in range(len(ws) - len(toks) + 1) if toks and [bare(w) for w in ws[i:i + len(toks)]] == toks}
    got = S.term_occurrences(spark.createDataFrame([(1, t) for t in terms], "paper_id long, term string"),
                             spark.createDataFrame(words, f"paper_id long, page int, word_ord long, {BOX}, text string"))
    rows = [(r.term, r.page, r.x0, r.x1) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and "regexp_extract_all" not in got._jdf.queryExecution().toString()


def test_term_places_in_text(spark):
    docs = [(1, 0, "The cat's Cat-flap, the CAT; concatenate (cat) cat"), (1, 1, "-- a cat flap -- a"), (1, 2, "")]
    terms = [(1, t) for t in ("cat", "cat-flap", "the cat", "(cat)", "--", "a", "flap -- a")]
    got = S.term_spans(spark.createDataFrame(docs, "paper_id long, d int, text string"), spark.createDataFrame(terms, "paper_id long, term string"), ["d"]).collect()
    want = set()
    for _, d, text in docs:  # earliest first, of those the longest, none inside another
        low, hits = text.lower(), []
        for _, t in terms:
            hits += [(m.start(), -len(t), t) for m in re.finditer(f"(?={re.escape(t)})", low) if not re.match(r"[^\W_]", low[m.start() - 1:m.start()]) and not re.match(r"[^\W_]", low[m.start() + len(t):m.start() + len(t) + 1])]
        end = 0
        for s, n, t in sorted(hits):
            if s >= end:
                want.add((d, s, s - n, t))
                end = s - n
    assert {(r.d, r.start, r.end, r.term) for r in got} == want


def test_longest_head_has_no_limit(spark):
    head = "ab" * 1_500_000
    df = spark.createDataFrame([(head + "tail", "x" + head + "y"), ("abc", "zabd"), ("q", "zzz"), ("same", "same"), ("", "text")], "q string, t string")
    assert [r[0] for r in df.select(A.longest_head(F.col("q"), F.col("t"))).collect()] == [3_000_000, 2, 0, 4, 0]


def test_only_items_over_changed_pages_are_looked_for(spark):
    """Two papers of three pages; in the new extraction a page of the first grew and one of its regions moved. Items before it keep their
    anchors, those after it are found again, and only the chunk whose rects changed gets new blocks."""
    def extraction(second, moved):
        regions, words, texts = [], [], []
        for p in (1, 2):
            n = 0
            for page in range(3):
                lines = ["alpha beta gamma", f"page {page} of paper {p}", second if (p, page) == (1, 1) else "delta epsilon zeta"]
                texts.append((p, page, "\n".join(lines)))
                for k, line in enumerate(lines):
                    y = 72.0 + 24 * k + (moved if (p, page) == (1, 2) else 0.0)
                    regions.append((p, n, page, 50.0, y, 250.0, y + 20, "text", line))
                    for i, w in enumerate(line.split()):
                        words.append((p, page, n, 0, i, 50.0 + 30 * i, y + 4, 75.0 + 30 * i, y + 16, w, n * 100 + i))
                    n += 1
        return (spark.createDataFrame(texts, "paper_id long, page int, text string"), spark.createDataFrame(regions, f"paper_id long, ord int, page int, {BOX}, label string, text string"),
                spark.createDataFrame(words, f"paper_id long, page int, block int, line int, word_no int, {BOX}, text string, word_ord long"))

    old_text, old_regions, old_words = extraction("delta epsilon zeta", 0.0)
    text, regions, words = extraction("delta epsilon zeta eta theta", 300.0)
    box = lambda y: (50.0, y, 250.0, y + 20)
    marks, ends, chunk_rects = [], [], []
    starts = {(r.paper_id, r.page): r.page_start for r in A.page_index(old_text).collect()}
    for p in (1, 2):
        for page in range(3):
            quote = f"page {page} of paper {p}"
            marks.append((p, f"h{page}", quote, "gamma\n", "\ndelta", starts[p, page] + 17, page, 1, "anchored", *box(96.0)))
            for which, exact, y in (("start", "alpha beta gamma", 72.0), ("end", quote, 96.0)):
                ends.append((p, f"c{page}", which, exact, "", "\npage" if which == "start" else "\ndelta", starts[p, page]))
            chunk_rects.append((p, f"c{page}", 0, page, 50.0, 72.0, 250.0, 116.0))
    quotes = spark.createDataFrame(marks, f"paper_id long, q_id string, exact string, prefix string, suffix string, position long, page_hint int, span int, state string, {BOX}")
    mark_rects = quotes.select("paper_id", "q_id", F.col("page_hint").alias("page"), "x0", "y0", "x1", "y1")
    ends = spark.createDataFrame(ends, "paper_id long, node_id string, which string, exact string, prefix string, suffix string, position long")
    rects = spark.createDataFrame(chunk_rects, f"paper_id long, node_id string, rect_ord int, page int, {BOX}")
    held = mark_rects.select("paper_id", F.lit("highlight").alias("kind"), F.col("q_id").alias("id"), "page").unionByName(rects.select("paper_id", F.lit("chunk").alias("kind"), F.col("node_id").alias("id"), "page"))
    paper = A.anchor_basis(old_text, old_regions).withColumnRenamed("basis", "paper_basis")
    at = quotes.select("paper_id", F.lit("highlight").alias("kind"), F.col("q_id").alias("id"), "position").unionByName(ends.where("which = 'start'").select("paper_id", F.lit("chunk").alias("kind"), F.col("node_id").alias("id"), "position"))
    stored = A.item_basis(held, old_text, old_regions).join(paper, "paper_id").join(at, ["paper_id", "kind", "id"]).withColumn("state", F.when((F.col("paper_id") == 1) & (F.col("id") == "h0"), "orphaned").otherwise("anchored"))
    sizes = regions.select("paper_id", "page").distinct().withColumn("width", F.lit(612.0))
    done = A.reanchor(stored, quotes, mark_rects, ends, rects, text, regions, words, sizes)
    states = {(r.paper_id, r.id): (r.state, r.looked_for) for r in done.states.collect()}
    assert states == {**{(p, f"{k}{n}"): ("anchored", False) for p in (1, 2) for k in "hc" for n in range(3)}, (1, "h0"): ("anchored", True), (1, "h1"): ("anchored", True), (1, "c1"): ("anchored", True),
                      (1, "h2"): ("relocated", True), (1, "c2"): ("relocated", True)}
    moved = {(r.paper_id, r.id): (r.page, r.y0) for r in done.rects.collect()}
    assert moved[1, "h2"] == (2, 400.0) and moved[1, "c2"][0] == 2 and moved[1, "c2"][1] == 372.0 and moved[1, "h1"] == (1, 96.0) and len(moved) == 12
    assert {(r.paper_id, r.node_id) for r in done.blocks.collect()} == {(1, "c2")}
    assert [r.text for r in done.blocks.orderBy("region_ord").collect()][:2] == ["alpha beta gamma\n", "page 2 of paper 1\n"]


def test_find_quote_query_has_the_exact_places_of_its_sql(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    passage = "the quick brown fox jumps over the lazy dog while seven other animals look on and say nothing at all"
    copy = passage.replace("lazy", "lady")
    filler = "\n".join(["nothing of the kind is printed here"] * 30)
    papers = [(1, f"{copy}\n{filler}\n{passage}"), (2, f"{filler}\n{copy}"), (3, f"{passage} {passage}")]
    spark.createDataFrame(papers, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.q_id, r.paper_id, r.page, r.start, r.score) for r in queries()["an04_find_quote"](spark, str(tmp_path)).collect()]
    copies = {r.paper_id for r in queries()["an04_find_copies"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT q_id, paper_id, page, start, score FROM ({oracle_sql()['an04_find_quote']})").fetchall()
    assert sorted(got) == sorted(want) and len(want) == 2 and copies == {1, 2, 3}
