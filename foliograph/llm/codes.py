"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the lowest `CHUNK` bits of every id; ids that need more have
their bit set in the level's continuation bitmap, and their next bits stand on the next level, in order. A rank directory
(set bits before each block of 512) turns the place on one level into the place on the next, so any token is read without
decoding what lies before it.

Segments are rows of a Parquet table, in ascending order of documents; a document is never split between two. Null texts
count as empty and have the end id only. Rows with equal ids stand next to each other, ordered by a hash of their text; null ids
come first. An empty table gives an empty table of segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.store import new_path
from foliograph.llm.wordbpe import Encoder

CHUNK = 8
BLOCK = 512
#: A segment is closed by the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
SCHEMA = "part int, segment int, local_start bigint, ids array<{id}>, ends array<bigint>, levels array<struct<chunks: binary, more: binary, ranks: binary>>"


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of unsigned ids."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(CHUNK)
        has = more > 0
        bits = np.packbits(has, bitorder="little")
        counts = np.add.reduceat(has, np.arange(0, len(has), BLOCK)) if len(has) else np.zeros(0, np.int64)
        ranks = np.cumsum(counts) - counts
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.astype("<u8").tobytes()})
        rest = more[has]
        if not len(rest):
            return levels


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u8")) for x in levels]

    def token(self, at: int) -> int:
        """The id at one place: a byte, a bit and a rank per level."""
        value = 0
        for level, (chunks, more, ranks) in enumerate(self.levels):
            value |= int(chunks[at]) << CHUNK * level
            if not more[at >> 3] >> (at & 7) & 1:
                break
            block = at // BLOCK * BLOCK
            at = int(ranks[at // BLOCK]) + int(np.unpackbits(more[block >> 3:(at >> 3) + 1], bitorder="little")[:at - block].sum())
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from `start` to `end`: consecutive places stay consecutive on every level."""
        out, where = np.zeros(end - start, np.uint32), None
        for level, (chunks, more, ranks) in enumerate(self.levels):
            part = chunks[start:end].astype(np.uint32) << np.uint32(CHUNK * level)
            if where is None:
                out[:] = part
            else:
                out[where] |= part
            first = start // BLOCK * BLOCK
            bits = np.unpackbits(more[first >> 3:(end + 7) >> 3], bitorder="little")
            has = bits[start - first:end - first].astype(bool)
            if not has.any():
                break
            where = np.flatnonzero(has) if where is None else where[has]
            start = int(ranks[first // BLOCK]) + int(bits[:start - first].sum())
            end = start + int(has.sum())
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, id: str = "doc_id", text: str = "text") -> None:
    """Encodes every document by a tokenizers file (its content), appends `end_id` and writes the segments to `path`."""
    kind = docs.schema[id].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, number, start = Encoder.shared(tokenizer), TaskContext.get().partitionId(), 0, 0
        names, found, size = [], [], 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in found])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "local_start": pa.array([start], pa.int64()), "ids": pa.array([names], pa.list_(id_type)),
                "ends": pa.array([ends], pa.list_(pa.int64())), "levels": pa.array([pack(np.concatenate(found))], pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])))})

        for batch in batches:
            id_type = batch.schema.field("_id").type
            for first in range(0, batch.num_rows, 1024):
                rows = batch.slice(first, 1024)
                ids, sizes = encoder.batch(rows.column("_text").to_pylist())
                after = np.cumsum(sizes)
                ids, edges = np.insert(ids, after, end_id), (after + np.arange(1, len(sizes) + 1)).tolist()
                for name, a, b in zip(rows.column("_id").to_pylist(), [0, *edges[:-1]], edges, strict=True):
                    names.append(name), found.append(ids[a:b])
                    size += len(found[-1])
                    if size >= SEGMENT_IDS:
                        yield closed()
                        number, start, names, found, size = number + 1, start + size, [], [], 0
        if found:
            yield closed()

    source = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    ordered = source.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")
    ordered.mapInArrow(segments, SCHEMA.format(id=kind)).write.parquet(path)


def read(segments: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document in the segments: `start` counts the ids of all documents before
    it, `ids` are little-endian unsigned 32-bit integers."""
    totals = segments.select("part", F.element_at("ends", -1).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    kind = segments.schema["ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                names, ends, base = batch.column("ids")[row].values, batch.column("ends")[row].values.to_numpy(), batch.column("_from")[row].as_py()
                codes, starts = Codes(batch.column("levels")[row].as_py()), np.concatenate([[0], ends[:-1]])
                whole = codes.span(0, int(ends[-1])).astype("<u4")
                edges = np.concatenate([[0], ends * 4]).astype(np.int32)
                found = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays([names.cast(id_type), pa.array(base + starts), pa.array(ends - starts), found], names=[id, "start", "n_tokens", "ids"])

    placed = segments.join(offsets, "part").select((F.col("_offset") + F.col("local_start")).alias("_from"), F.col("ids"), "ends", "levels")
    return placed.mapInArrow(documents, f"`{id}` {kind}, start bigint, n_tokens bigint, ids binary")


def digests(read_back: DataFrame) -> DataFrame:
    """`read_back` with the crc32 of the ids' bytes instead of the ids."""
    return read_back.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def written(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of `docs`, written to a new table in the shared folder."""
    path = new_path(docs.sparkSession, "token-codes")
    write(docs, tokenizer, end_id, path, id, text)
    return docs.sparkSession.read.schema(SCHEMA.format(id=docs.schema[id].dataType.simpleString())).parquet(path)
