"""Benchmark items inside documents, up to an error budget.

An item of m characters may differ by `m * error_rate` edits, k. Cut into k + 1 pieces, at least one piece of it stands
unchanged in every match (pigeonhole). Pieces are found exactly with one automaton per block of items; around each hit
Myers' bit-parallel algorithm gives the smallest edit distance between the item and any stretch of the text there.

Texts and items are compared in lower case with runs of white space as one space. Null or empty texts and items match
nothing; of items that share an id each is searched. Items come in blocks of bounded size, one pass over the documents each, so the
side that is sent to executors is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ERROR_RATE = 0.08
#: Characters of items in a block.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """`budget` + 1 pieces of nearly equal length with their offsets."""
    ends = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def distance_within(item_masks: dict[str, int], m: int, text: str) -> int:
    """Smallest edit distance of the item to any stretch of `text` (Myers 1999, semi-global)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = item_masks.get(c, 0)
        carry = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        plus = down | (~(diag | up) & full)
        minus = up & diag
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(carry | plus) & full), plus & carry
        best = min(best, score)
    return best


class Matcher:
    """The automaton of all pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float):
        self.items, found = [], {}
        for id, text in items:
            plain = normal(text)
            if plain:
                masks: dict[str, int] = {}
                for i, c in enumerate(plain):
                    masks[c] = masks.get(c, 0) | 1 << i
                budget = int(len(plain) * error_rate)
                for offset, piece in pieces(plain, budget):
                    found.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((id, plain, budget, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def of(self, text: str | None, first: bool = False) -> list[tuple[object, int]]:
        """(item id, smallest distance) of the items in a text; only one of them if `first`."""
        plain = normal(text)
        if not plain or not self.items:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(plain):
            for number, offset in uses:
                starts.setdefault(number, []).append(end + 1 - size - offset)
        out = []
        for number, places in starts.items():
            id, item, budget, masks = self.items[number]
            best = budget + 1
            if item in plain:
                best = 0
            else:
                for low, high in _stretches(sorted(set(places)), budget):
                    window = plain[max(0, low - budget):high + len(item) + budget]
                    best = min(best, distance_within(masks, len(item), window))
            if best <= budget:
                out.append((id, best))
                if first:
                    break
        return out


def _stretches(places: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Start places that lie within the budget of each other, together."""
    low = high = places[0]
    for at in places[1:]:
        if at - high > budget:
            yield low, high
            low = at
        high = at
    yield low, high


def _blocks(items: DataFrame, id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Items block by block: each is fetched alone, and its size is known before."""
    items = items.select(F.col(id).alias("id"), F.col(text).alias("text")).where("length(text) > 0")
    chars = items.agg(F.sum(F.char_length("text"))).head()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for block in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()]


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """(id, item_id, distance): every item that a document holds within the budget, with its smallest distance."""
    kinds = f"`{id}` {docs.schema[id].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}, distance int"
    item_type = to_arrow_type(items.schema[item_id].dataType)
    source = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))

    def one(block: list[tuple[object, str]]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for batch in batches:
                found = [(i, *hit) for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True) for hit in matcher.of(t.as_py())]
                yield pa.RecordBatch.from_pydict({id: [x[0] for x in found], item_id: [x[1] for x in found], "distance": pa.array([x[2] for x in found], pa.int32())},
                                                 schema=pa.schema([(id, batch.schema.field("_id").type), (item_id, item_type), ("distance", pa.int32())]))
        return source.mapInArrow(search, kinds)

    parts = [one(block) for block in _blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], kinds)


def clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold none of the items."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def passing(df: DataFrame, block: list[tuple[object, str]]) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.of(t.as_py(), first=True) for t in batch.column(text)], pa.bool_()))
        return df.mapInArrow(keep, kinds)

    return reduce(passing, _blocks(items, item_id, item_text), docs)
