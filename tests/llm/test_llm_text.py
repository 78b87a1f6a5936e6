"""Operators on whole texts against the libraries and brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliograph.llm import bpe, codes, decontaminate, licenses, linededup, pii, quality_model, quality_rules

ODD = [None, "", " ", "\n", "a\n\n b  c\t d", "x" * 3000, "ab " * 2000, "the the the the", "É字😀 's'll don't", "  \r\n ", "\x1cq\x85r　s", "one two three"]


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(4)
    parts = ["the ", "Ab", "'s", " ", "  ", "\n", "1", "é", "字", "!", "\t", "word", "-", "@", "."]
    texts = ODD + ["".join(random.choices(parts, k=random.randint(1, 60))) for _ in range(80)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "id twice", "x"), (3, "id twice", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").cache()


def test_bpe_is_the_librarys(spark, docs):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), ranks, P.PATTERN).count() == 0


def test_arrays_cut_like_the_pattern(monkeypatch):
    """Every kind of neighbour, contraction and white space, whichever way a text is cut."""
    assert bpe.PATTERN == P.PATTERN
    rng = random.Random(6)
    texts = ["", *map(chr, range(0x250)), *(f"a{chr(c)}'s {chr(c)}{chr(c)}b" for c in range(0x250)), "".join(map(chr, range(0x24F))), "é字 's", "x" * 5000 + " " * 5000]
    texts += ["".join(rng.choices("abstrevldm \n\t1é.!\x85\xa0" + "'" * 4, k=rng.randint(0, 30))) for _ in range(4000)]
    pieces, names = bpe._Pieces(P.PATTERN), []
    for low in range(0, len(texts), 500):
        part = texts[low:low + 500]
        numbers = pieces.of(part)
        names += pieces.fresh
        pieces.fresh = []
        assert [[names[n] for n in own] for own in numbers] == [regex.findall(P.PATTERN, t) for t in part]
    assert len(names) == pieces.count


def test_bpe_restarts_and_keeps_any_column(spark, monkeypatch):
    """Tasks that forget their pieces again and again, blocks of a few texts, and columns named like the steps' own."""
    monkeypatch.setattr(bpe, "MAX_PIECES", 40)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 200)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abcdé字", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30))), -i, "x") for i in range(120)]
    docs = spark.createDataFrame(rows, "at bigint, body string, restart bigint, merged string")
    got = bpe.decode(bpe.encode(docs, ranks, P.PATTERN, text="body", ids="new"), ranks, ids="new", out="done").collect()
    assert len(got) == 120 and all(r.new == library.encode_ordinary(r.body) and bytes(r.done) == r.body.encode() and r.restart == -r.at and r.merged == "x" for r in got)
    assert bpe.encode(docs, ranks, P.PATTERN, text="body", drop_text=True).columns == ["at", "restart", "merged", "ids"]


def test_long_pieces_merge_alike():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    pairs = bpe._pair_ranks(ranks)
    for text in ("abracadabra" * 90, "aaaa" * 300, "éà" * 200):
        assert bpe._merge_long([ranks[bytes([b])] for b in text.encode()], pairs) == library.encode_ordinary(text)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_counts_and_verdict(docs):
    counted = quality_rules.counts(docs)
    for r in counted.collect():
        assert tuple(r[n] for n in quality_rules.COUNTS) == brute_counts(r.text or "")
    judged = quality_rules.judge(counted, quality_rules.fit(counted)).collect()
    assert len(judged) == docs.count() and not any(r.kept for r in judged if r.base_failed)
    assert quality_rules.fit(counted.limit(0)).prior == 0


def test_em_finds_the_accuracies():
    state = np.random.default_rng(3)
    truth = state.random(20000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.9])
    votes = np.where(state.random((20000, 4)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[state.random(votes.shape) < 0.2] = -1
    patterns, sizes = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.em(patterns, sizes.astype(float))
    odds = model.prior + sum(np.select([votes[:, r] == 0, votes[:, r] == 1], model.weights[r, :2], model.weights[r, 2]) for r in range(4))
    assert ((odds > 0) == truth).mean() > 0.95


def test_line_keys_lower_nothing_but_a_to_z(spark):
    lines = [f"A plain Line {c} of Letters" for c in ["é", "É", "ß", "ẞ", "İ", "ı", "Σ", "ς", "Ⅷ", "ⅷ", "Ⓐ", "ⓐ", "ǅ", "字", "😀", "𐐀", "𐐨", "«»", "±", "ª", "\u0301", "e\u0301", "Ａ", "ａ", "ŉ", "“", "–"]]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: bytes(r.key) for r in df.select("line", linededup.line_key(F.col("line")).alias("key")).collect()}
    assert got == {x: hashlib.md5(re.sub("[A-Z]", lambda m: m.group().lower(), x).encode()).digest() for x in lines}


def test_line_dedup_against_brute_force(spark):
    random.seed(2)
    lines = ["A line of some length ", "a line of some length", "short", "Another long line!", "", "  ", "third longer line here", "É" * 10, "é" * 10]
    rows = [(i % 40 if i % 9 else None, "\n".join(random.choices(lines, k=random.randint(0, 6)))) for i in range(120)] + [(50, None)]
    kept = linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), batches=4).collect()

    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    last = 1 << 63
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), last), last if i is None else i)
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if owner.get(key(x), last) >= (last if i is None else i)), len((t or "").split("\n"))) for i, t in rows)
    assert Counter((r.doc_id, r.text, r.n_lines) for r in kept) == want
    assert linededup.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def edit_search(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination_against_brute_force(spark):
    random.seed(1)
    items = [(i, "".join(random.choices("abcd ", k=60)).strip()) for i in range(5)] + [(9, ""), (8, None), (1, "second text of one id, long enough")]
    texts = []
    for n in range(60):
        body = list("".join(random.choices("abcd ", k=100)))
        item = list(random.choice([t for _, t in items if t]))
        for _ in range(random.randint(0, 7)):
            item[random.randrange(len(item))] = random.choice("abcdz")
        texts.append((n, "".join(body[:40] + (item if n % 3 else []) + body[40:])))
    texts += [(100, None), (101, "")]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, bench, 0.1).collect()}
    want = set()
    for d, t in texts:
        for i, x in items:
            plain = decontaminate.normal(x)
            if plain and t and (best := edit_search(plain, decontaminate.normal(t))) <= int(len(plain) * 0.1):
                want.add((d, i, best))
    assert got == want and got
    clean = {r.doc_id for r in decontaminate.clean(docs, bench, 0.1).collect()}
    assert clean == {d for d, _ in texts} - {d for d, _, _ in want}
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_base_spans_against_plain_patterns():
    random.seed(6)
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    fixed = ["mail a.b@c-d.org, x@y@z.com @q.r a@b..c", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (736) 555-2678 +12 3 ++4 555 555 555", "9" * 5000]
    for text in fixed + ["".join(random.choices("ab1234567890@.+- ()", k=80)) for _ in range(300)]:
        want = []
        for kind, pattern in enumerate(patterns):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                good = (True, kind == 1 and len(digits) < 1000 and all(int(p) <= 255 for p in m.group().split(".")), 13 <= len(digits) <= 19 and pii._luhn(digits), 9 <= len(digits) <= 15)[kind]
                want += [(kind, *m.span())] if good else []
        assert pii.base_spans(text) == want


def test_like_words_agree_in_the_field(spark):
    n = len(pii.KINDS) + 1
    weights = np.zeros((pii.FEATURES, n))
    text = "call 555-2678 now " + "filler " * 30 + "or 555-2678 later"
    graph = pii.Graph(text, [])
    assert graph.skips.tolist() == [[0, 1]]
    graph.features, weights[0, 4] = [[0], [1]], 9
    alone = pii.Field(weights, np.zeros((n, n)), np.zeros((n, n))).beliefs(graph)
    linked = pii.Field(weights, np.zeros((n, n)), 3 * np.eye(n)).beliefs(graph)
    assert linked[1, 4] > alone[1, 4] + 0.3


def test_pii_rows(spark, docs):
    found = pii.find(docs, pii.fit(docs)).collect()
    assert len(found) == docs.count() and all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in found)
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_codes_give_every_token():
    state = np.random.default_rng(0)
    ids = state.integers(0, 60000, 3000).astype(np.uint32)
    ids[::7], ids[::501] = 3, 1 << 24
    coded = codes.Codes(codes.pack(ids))
    assert [coded.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, 3000), (5, 5), (511, 1025), (2999, 3000)]:
        assert (coded.span(a, b) == ids[a:b]).all()


def test_codes_round_trip(spark, docs):
    content = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(content)
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = codes.digests(codes.read(codes.written(some, content, 1))).orderBy("doc_id").collect()
    start = 0
    for got, doc in zip(rows, some.orderBy("doc_id").collect(), strict=True):
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [1]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert codes.read(codes.written(docs, content, 1)).count() == docs.count()
    assert codes.read(codes.written(docs.limit(0), content, 1)).count() == 0


def test_quality_model_on_held_out(spark):
    random.seed(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        words = [random.choice(["river", "stone", "walking", "garden"] if good else ["WIN!!", "$$$", "CLICK", "free###"]) + random.choice(["s", "er", ""]) for _ in range(40)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    rows += [(None, None), (None, "river"), (400, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels + [(7, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    scored = quality_model.score(docs, quality_model.fit(docs, marks, 200)).withColumn("held", quality_model.held_out(F.col("doc_id"))).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert all((r.score >= 0.5) == bool(labels[r.doc_id][1]) for r in scored if r.held and r.doc_id < 400)
    assert quality_model.score(docs, quality_model.fit(docs, marks.limit(0))).count() == len(rows)


def test_licences_in_order(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\n"
    note = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit + note), (2, mit), (3, note + " " + mit), (4, "Released under the MIT License.\nText. Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "All rights reserved. All rights reserved.")]
    got = {r.doc_id: (r.n_sentences, r.licenses, r.leftover) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (2, "MIT", 0), 2: (1, "", 1), 3: (2, "", 2), 4: (2, "MIT CC-BY-NC-4.0", 0), 7: (2, "Proprietary", 0)}




MIT = """Copyright (c) 2020 Some Body
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
BSD = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
 */
"""
GPL = """{0} This program is free software{1} you can redistribute it and/or modify
{0} it under the terms of the GNU General Public License as published by
{0} the Free Software Foundation{2} either version {3} of the License, or
{0} (at your option) any later version.
{0}
{0} This program is distributed in the hope that it will be useful,
{0} but WITHOUT ANY WARRANTY; without even the implied warranty of
{0} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{0} GNU General Public License for more details.
"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """<!-- Licensed under the Apache License, Version 2.0
     (the "License"); you may not use this file except in compliance
     with the License. You may obtain a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0 -->"""


def test_licences_as_published(spark):
    rows = [(1, MIT, 3, "MIT"), (2, BSD, 4, "BSD-3-Clause"), (3, GPL.format("#", ":", ",", 3), 2, "GPL-3.0-or-later"), (4, GPL.format(";;", ";", ";", 2).replace("\n", "\r\n"), 2, "GPL-2.0-or-later"),
            (5, MPL, 1, "MPL-2.0"), (6, APACHE, 4, "Apache-2.0"), (7, "dnl All rights\ndnl reserved.", 1, "Proprietary"), (8, "This work is\nlicensed under CC BY-SA 4.0.", 1, "CC-BY-SA-4.0"),
            (9, "Made here\nReleased under the MIT License\nby us", 1, "MIT")]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(10, "All rights\n\nreserved. We are licensed under the MIT license here."), (11, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.licenses(docs).collect()}
    assert got == {r[0]: r[2:] for r in rows}
