"""The rank map is laid out in little memory, also where a token has thousands of partners."""

from __future__ import annotations

import tracemalloc

from foliograph.llm.bpe import RankMap, _pair_ranks, encode


def test_many_partners_in_little_memory():
    single = [bytes([i]) for i in range(256)]
    two = [bytes([i, j]) for i in range(100, 160) for j in range(100, 167)]
    ranks = {token: i for i, token in enumerate([*single, *two, *(b" " + t for t in two)])}
    tracemalloc.start()
    table = RankMap(ranks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for key, rank in _pair_ranks(ranks).items():
        left, right = divmod(key, 1 << 20)
        entry = int(table.entries[table.offsets[left] + right + table.BASE])
        assert entry == (table.BASE + left) * table.LIMIT + rank


def test_the_plan_does_not_spell_the_map_out(spark):
    """The driver keeps a plan's text several times a query."""
    single = [bytes([i]) for i in range(256)]
    ranks = {token: i for i, token in enumerate([*single, *(bytes([i, j]) for i in range(97, 123) for j in range(97, 123))])}
    coded = encode(spark.createDataFrame([(1, "abc ab"), (2, None)], "doc_id long, text string"), ranks, r"\S+|\s+")
    assert len(coded._jdf.queryExecution().toString()) < 100_000
    ab = ranks[b"ab"]
    assert {r.doc_id: r.ids for r in coded.collect()} == {1: [ab, ord("c"), ord(" "), ab], 2: []}
