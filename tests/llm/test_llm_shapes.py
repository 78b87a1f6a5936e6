"""Piece tables, divergence by level products, packing along a curve."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from foliograph.llm import curve, divergence, piecetable, queries, wordbpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"
WORDS = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
ODD = ["", " ", "\n\n", "Don't WE'LL ''S it's<|endoftext|>x", "É À ñ Ωmega ΣΑΣ İstanbul ǅ x́ àb", "1²½ 12³ 4٣", "a\x1cb\x85c d\te\x00f", "'s't're''d", "ªº µ ÿŸ ʰ ſ ß ẞ",
       "<|ENDOFTEXT|> <|x", "____--- !!!a!!!", "longword" * 40, "日本語 text 🎉 mixed", "a" * 3000, "x\xa0y z", "naïve café ─── Straße"]


# -- piece tables -----------------------------------------------------------------


def plain_form(id, text):
    t, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fim_forms_and_round_trip(spark):
    rng = random.Random(1)
    texts = [*ODD, None, "<P>", "a<S", "<<M", "P>x", "<P", "S><", "x" * 200_000 + "é" + "y" * 1000, "日" * 5000]
    texts += ["".join(rng.choices("ab<>PSMé日 \n", k=rng.randint(0, 40))) for _ in range(200)]
    rows = [(i, t, -1, "pieces") for i, t in enumerate(texts)] + [(None, "no id at all", 0, "x"), (3, "twice", 0, "x"), (3, "twice", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, form string")
    made = piecetable.fim(docs)
    shown = made.withColumn("output", piecetable.rendered(F.col("pieces"), F.col("text"))).withColumn("back", piecetable.restored(F.col("output"), F.col("form")))
    shown = shown.withColumn("again", piecetable.rendered(F.col("back"), F.col("output")))
    got = piecetable.hashed(shown, {"a": ("pieces", "text"), "b": ("back", "output")}).collect()
    assert len(got) == len(rows)
    for r in got:
        n, form, prefix, middle, output = plain_form(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, prefix, middle, output)
        assert r.again == (r.text or "") and r.a == hashlib.sha256(output.encode()).hexdigest() and r.b == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert piecetable.hashed(piecetable.fim(docs.limit(0)), {"a": ("pieces", "text")}).count() == 0


def test_cutting_descriptors_keeps_what_they_spell(spark):
    docs = spark.createDataFrame([("abcdéfgh日j", at) for at in range(0, 15)], "text string, at int")
    own = piecetable.parts(F.lit(10).cast("bigint"), F.lit(3).cast("bigint"), F.lit(7).cast("bigint"))
    order = (2, 0, 1)
    turned = piecetable.arranged(own, order)
    cut = piecetable.cut(turned, F.col("at").cast("bigint"))
    got = docs.select("at", piecetable.rendered(cut, F.col("text")).alias("t"), F.size(cut).alias("n"),
                      piecetable.rendered(piecetable.arranged(turned, piecetable.inverse(order)), F.col("text")).alias("back")).collect()
    assert all(r.t == "h日jabcdéfg" and r.back == "abcdéfgh日j" for r in got)
    assert {r.at for r in got if r.n == 4} == {1, 2, 4, 5, 7, 8, 9} and all(r.n == 3 for r in got if r.at in (0, 3, 6, 10, 14))


# -- divergence -------------------------------------------------------------------


def plain_audit(rows, min_docs, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)] for t, _, _ in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), w in zip(rows, words, strict=True):
        held[lang].update(set(w))
        counts[lang, source].update(w)
    out, joint = [], Counter()
    for lang, source in counts:
        kept = sorted(w for w, n in held[lang].items() if n >= min_docs)
        total = {s: sum(c[w] for w in kept) for (at, s), c in counts.items() if at == lang}
        p = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))  # noqa: B023,E731
        own = counts[lang, source]
        pairs = [(-sum(abs(p(own[w], total[source]) - p(counts[lang, o][w], total[o])) for w in kept), o.encode(), o) for o in total if o != source]
        everywhere = {w: sum(counts[lang, o][w] for o in total) for w in kept}
        terms = [(-(p(own[w], total[source]) - p(everywhere[w], sum(total.values()))), w.encode(), w) for w in kept if own[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(x for x in terms if x[0] < 0)[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
        for o in total:
            if source < o:
                joint.update((lang, source, own[w], o, counts[lang, o][w]) for w in kept)
    return sorted(out), joint


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "Été", "straße", "日本", "x_y", "it's", "a1b", "ÀB", "zz", "Zz", "don", "\U0001f389", "mu", "né"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(5)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 60))
        rows.append((rng.choice([" ", "\n", ", "]).join(words), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "é", "日", None])))
    return [*rows, ("", "xx", "a"), (None, "xx", "b"), ("once only here", "yy", "a"), (None, "en", "silent"), ("the " * 3000, "en", "long"), *rows[:9]]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_plain_sums(spark, monkeypatch, small):
    if small:  # many batches, blocks and tiles
        for name, value in (("BLOCK_CELLS", 24), ("TILE", 7), ("MAX_ENTRIES", 30)):
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(divergence.blocks, "__defaults__", (24,))
    rows = corpus(7, 120)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    want, joint = plain_audit(rows, 3)
    assert sorted(tuple(r) for r in divergence.audit(docs, min_docs=3).collect()) == want
    if small:
        terms = divergence.counted(docs, 3)
        tables = divergence.joint_tables(*divergence.blocks(terms, divergence.groups(docs, terms)))
        assert {tuple(r)[:5]: r.terms for r in tables.collect()} == dict(joint)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    lone = spark.createDataFrame([("a few words", "en", "s")], "text string, lang string, source string")
    assert divergence.audit(lone).count() == 0 and [tuple(r) for r in divergence.audit(lone, min_docs=1).collect()] == []


def test_prices_are_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**15 + 7, 3 * 10**16 + 1, 10**8 + 3)], "c bigint, n bigint, v bigint")
    got = big.select(divergence.price(F.col("c"), F.col("n"), F.col("v")).alias("p")).head().p
    assert got == 1 + 10**9 * (10**15 + 12) // (3 * 10**16 + 1 + 5 * (10**8 + 3))


# -- packing ----------------------------------------------------------------------


def test_encoder_gives_the_library_s_ids(monkeypatch):
    library, encoder = Tokenizer.from_str(WORDS), wordbpe.Encoder(WORDS)
    rng = random.Random(4)
    texts = [*ODD, " ".join(ODD), *("".join(rng.choices("aB'sé 1½_.\n\t日ß<|>", k=rng.randint(0, 80))) for _ in range(300)),
             *("".join(rng.choices("aA'srevldtmx 1½_.\n\tßÿŸȺİ", k=rng.randint(0, 40))) for _ in range(1500)), *map(chr, range(0x260)), *(f"a{chr(c)}b" for c in range(0x260))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.cuts

    def checked():
        ids, sizes = encoder.batch(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert all(encoder.of(t).tolist() == w for t, w in zip(texts[:60], want, strict=False))

    checked()
    monkeypatch.setattr(wordbpe, "MAX_PIECES", 50)  # forgets again and again
    monkeypatch.setattr(wordbpe, "STRETCH", 200)
    monkeypatch.setattr(wordbpe.stretches, "__defaults__", (100,))
    checked()
    long = " ".join(rng.choices(["Some", "wörds", "it's", "1234"], k=5000))
    assert encoder.of(long).tolist() == library.encode(long, add_special_tokens=False).ids
    assert [len(x) for x in encoder.batch([])] == [0, 0]


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_cuts_fill_sequences():
    for total in (0, 1, 7, 8, 9, 31, 77):
        edges = sorted({0, total, *(min(total, x) for x in (3, 5, 11, 12, 40))})
        sizes = Counter()
        for a, b in zip(edges, edges[1:], strict=False):
            found = curve.cuts(a, b, total, 8)
            assert found[0][0] == a
            for (first, sequence, base), (last, *_) in zip(found, [*found[1:], (b,)], strict=True):
                assert first - base == sizes[sequence]
                sizes[sequence] += last - first
        assert sum(sizes.values()) == total and all(n == 8 or n & (n - 1) == 0 for n in sizes.values())


def checked(rows, got, length):
    library = Tokenizer.from_str(WORDS)
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    pieces, sizes = defaultdict(list), Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes[r.sequence_id] and r.length == len(r.ids) // 4 > 0
        sizes[r.sequence_id] += r.length
        pieces[r.doc_id].append(r)
    assert sorted(sizes) == list(range(len(sizes))) and all(n == length or n < length and n & (n - 1) == 0 for n in sizes.values())
    rebuilt = Counter()
    for id, parts in pieces.items():  # pieces of a row follow one another in the stream
        ids = []
        for r in parts:
            assert r.start == len(ids)
            ids += np.frombuffer(r.ids, "<u4").tolist()
            if len(ids) == r.doc_tokens:
                rebuilt[id, tuple(ids)] += 1
                ids = []
        assert not ids
    assert rebuilt == want


def test_packing_loses_nothing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma's", "12", "délta", "x!"], k=rng.randint(0, 40)))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (None, None), (5, "five again"), (300, "very long " * 3000)] + [(400 + i, "the same copy here") for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, row int, key string")
    found = curve.pieces(docs, WORDS, 1, length=64)
    got = found.collect()
    checked(rows, got, 64)
    copies = sorted((r.sequence_id * 64 + r.offset, r.doc_id) for r in got if r.doc_id and r.doc_id >= 400 and not r.start)
    assert [d for _, d in copies] == list(range(400, 460)) and copies[-1][0] - copies[0][0] == 59 * 5
    made = {r.sequence_id: (r.length, r.ids) for r in curve.sequences(found).collect()}
    for r in got:
        assert made[r.sequence_id][1][4 * r.offset:4 * (r.offset + r.length)] == r.ids
    assert curve.pieces(docs.limit(0), WORDS, 1).count() == 0
    with pytest.raises(ValueError):
        curve.pieces(docs, WORDS, 1, length=100)


def test_neighbours_on_the_curve_are_alike(spark):
    """Texts of six vocabularies stay among their own far more than by chance."""
    rng = random.Random(8)
    names = [[f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "nrst"][k::6] for k in range(6)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(names[i % 6], k=80))) for i in range(240)], "doc_id bigint, text string")
    order = [r.doc_id % 6 for r in curve.pieces(docs, WORDS, 1).where("start = 0").orderBy("sequence_id", "offset").collect()]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 2.5 * len(order) / 6


def test_op13_against_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = curve.pieces(docs, WORDS, 1)
    checked(rows, found.collect(), 2048)
    shown = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in found.collect()}
    got = queries.QUERIES["op13_curve_packing"](spark, SMALL).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in got} == shown
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values()) and math.ceil(sum(r.length for r in got) / 2048) <= len({r.sequence_id for r in got})


def test_tables_of_a_block_are_products(spark):
    rows = pd.DataFrame({"term": ["a", "a", "b"], "source": ["s", "t", "t"], "n": [2, 1, 4], "p": [20, 11, 41]})
    zero = pd.DataFrame({"source": ["t", "s"], "p": [1, 2]})
    names, group, level, price, products = divergence._tables(rows, zero)
    found = [(names[group[x]], level[x], price[x], names[group[y]], level[y], price[y], n) for xs, ys, ns in products for x, y, n in zip(xs, ys, ns, strict=True)]
    assert sorted(found) == [("s", 0, 2, "t", 4, 41, 1), ("s", 2, 20, "t", 1, 11, 1)]
