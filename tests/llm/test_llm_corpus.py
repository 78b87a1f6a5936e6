"""Operators on the whole corpus, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from foliograph.llm import decontaminate, minhash, quality_rules, queries, sharding
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    first = {}
    for n, (id, _) in zip(name, rows, strict=True):
        first[n] = min(first.get(n, id), id)
    return {id: (first[n], len(s)) for (id, _), n, s in zip(rows, name, sets, strict=True)}


def chained(n, seed):
    """A large group whose members are like some others only, copies, and texts of their own."""
    state = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(state.randint(0, 4)):
            text[state.randrange(60)] = f"x{state.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(state.choices(base, k=30))) for i in range(10)] + [(2000, rows[0][1].upper()), (2001, "a b"), (2002, "A  b"), (2003, ""), (2004, None), (2005, " \n")]
    return rows


def test_minhash_against_all_pairs(spark):
    rows = chained(90, 3)
    got = {r.doc_id: (r.component, r.n_shingles) for r in minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_leaders_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 0)
    rows = chained(70, 5)
    got = {r.doc_id: (r.component, r.n_shingles) for r in minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_parity_sketch_never_exceeds_the_difference():
    state = np.random.default_rng(3)
    for size in (1, 40, 900, 9000):
        a = np.unique(state.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:int(size * 0.9)], state.integers(0, 1 << 63, size // 8 + 1, dtype=np.uint64)]))
        bits = sum(int(x).bit_count() for x in (minhash._parity(a) ^ minhash._parity(b)).view(np.uint64))
        differ = len(np.setxor1d(a, b))
        assert bits <= differ and (size > 100 or bits >= differ - 4)


def test_minhash_on_a_whole_table_against_shared_shingles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, holders, near = {}, defaultdict(list), defaultdict(set)
    for id, text in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[id] = {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    for id, found in sets.items():
        for shingle in found:
            holders[shingle].append(id)
    for id, found in sets.items():
        for other, common in Counter(o for shingle in found for o in holders[shingle]).items():
            if 100 * common >= 85 * (len(found) + len(sets[other]) - common):
                near[id].add(other)
    first = {}
    for id in sorted(sets):
        open_ids = [id] if id not in first else []
        while open_ids:
            at = open_ids.pop()
            if at not in first:
                first[at] = id
                open_ids += near[at]
    got = {r.doc_id: (r.component, r.n_shingles) for r in minhash.classes(docs, 3, 85).collect()}
    assert got == {id: (first[id], len(found)) for id, found in sets.items()}
    assert len(set(first.values())) < len(sets)


def test_minhash_odd_rows(spark):
    rows = [(1, "p q r s t", 0), (1, "p q r s t", 1), (None, "p q r s t", 2), (None, "lonely words here", 3), (None, None, 4), (2, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component int")
    got = sorted((r.doc_id or 0, r.component or 0, r.n_shingles) for r in minhash.classes(docs.drop("component")).collect())
    assert got == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 2, 0)]
    assert minhash.classes(docs.limit(0)).count() == 0
    assert minhash.dedup(docs).columns == docs.columns
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows += [(None, "lonely words here", 6), (7, near, 7), (None, near + " end", 8), (None, near.replace(" z", " y"), 9), (None, None, 10), (None, "aa " * 6 + near[9:], 11), (None, "aa " * 6 + near[9:] + " b", 12)]
    stay = sorted(r._node for r in minhash.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, _node int")).collect())
    assert stay[:3] == [0, 1, 3] or stay[:3] == [0, 1, 6]  # both rows of document 1, one of two equal rows without an id
    assert set(stay) - {3, 6} == {0, 1, 5, 7, min(set(stay) & {4, 10}), min(set(stay) & {11, 12})} and len(stay) == 7


def test_shards_fit_and_split_only_when_needed(spark):
    rows = [(i, "t" * (i * 37 % 500)) for i in range(300)] + [(900, "big" * 1000), (None, None), (None, "n"), (901, "")] + [(7000, "same" * 50)] * 40
    placed = sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 2000).collect()
    assert len(placed) == len(rows)
    sizes, counts = {}, {}
    for r in placed:
        sizes[r.shard, r.page] = sizes.get((r.shard, r.page), 0) + r.n_bytes
        counts[r.shard, r.page] = counts.get((r.shard, r.page), 0) + 1
    assert all(s <= 2000 or counts[k] == 1 for k, s in sizes.items())
    names = sorted({s for s, _ in sizes})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for name in names:  # the bucket above is too large, or there was no need to split it
        if name:
            above = [v for (s, _), v in sizes.items() if s.startswith(name[:-1])]
            assert sum(above) > 2000
    assert sharding.shards(spark.createDataFrame([], "doc_id bigint, text string"), 10).count() == 0


def test_pipeline_against_single_steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    counted = quality_rules.counts(docs)
    kept = [(r.doc_id, r.text) for r in quality_rules.judge(counted, quality_rules.fit(counted)).where("kept").collect()]
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t in kept:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), i), i)
    kept = [(i, "\n".join(x for x in t.split("\n") if owner.get(key(x), i) == i)) for i, t in kept]
    classes = brute_components(kept, 5, 80)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept if classes[i][0] == i}
    leaked = {i for i, t in kept.items() if any(x in decontaminate.normal(t) for x in items)}
    assert set(got) <= set(kept) - leaked and len(got) > len(kept) / 2
    assert all(r.round_trip for r in got.values())
    assert set(kept) - leaked - set(got) == {r.doc_id for r in decontaminate.matches(
        spark.createDataFrame([(i, t) for i, t in kept.items() if i not in leaked], "doc_id bigint, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}


def test_stages_take_an_empty_table(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("doc_id") < -1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SMALL)
        assert out.columns == empty.columns and out.count() == 0, name


def test_registered_queries_have_one_row_for_each_document(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op3_quality_rules", "op5_pii", "op6_minhash", "op9_quality_model"):
        assert queries.QUERIES[name](spark, SMALL).count() == n, name
