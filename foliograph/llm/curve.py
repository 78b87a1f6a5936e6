"""Packing along a space-filling curve.

A document's token ids are counted in hashed buckets, the vector is projected to `DIMS` numbers by fixed random
directions, and these, centred and scaled by the whole corpus, name a cell of a grid whose Hilbert number is the document's
key. Rows are range-sorted by (key, id, row), so neighbours on the curve, and copies above all, come one after another;
running token sums, by part and then over parts, give each document its place in the stream, and the stream is cut every
`length` ids. What is left at the end is cut into powers of two, which need no padding: no sequence is padded at all.

Only lengths are sorted. Ids meet their places in one join on the row, so a hot group of copies is spread like any other
rows, and no task holds more than its share. Every table between jobs is Parquet in the shared folder.

Null texts count as empty and have the end id only. Rows that share an id, repeated rows and rows without an id keep pieces of
their own (rows without an id come first among equal keys). Very long texts are encoded by stretches and cut like others.
An empty table gives no pieces. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.store import stored
from foliograph.llm.wordbpe import Encoder

DIMS, BITS = 4, 12
BUCKETS = 1024
#: Projections are kept as integers of so many parts of one, so that sums over the corpus are exact.
UNIT = 1 << 16
_DIRECTIONS = np.random.default_rng(20251).standard_normal((BUCKETS, DIMS))


def projected(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hashed vectors of documents (square roots of counts, length 1) along the fixed directions, in `UNIT`s. `ids` are those of
    all documents one after another, `sizes` of each how many."""
    buckets = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    cells = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes) + buckets
    vectors = np.sqrt(np.bincount(cells, minlength=len(sizes) * BUCKETS)).reshape(len(sizes), BUCKETS)
    norms = np.sqrt(np.maximum(sizes, 1))[:, None]  # the squares of the vector add up to the number of ids
    return np.rint(vectors @ _DIRECTIONS / norms * UNIT).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (n, dims), `bits` bits a coordinate."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    high = 1 << (bits - 1)
    bit = high
    while bit > 1:  # undo the turns and mirrors of each level, from the coarsest on
        below = bit - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips, bit = np.zeros_like(x[0]), high
    while bit > 1:
        flips = np.where(x[-1] & bit, flips ^ (bit - 1), flips)
        bit >>= 1
    x ^= flips
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):  # a bit of each coordinate in turn
        for d in range(dims):
            key = key << 1 | x[d] >> level & 1
    return key


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, _id, n, ids, at) of every document: ids of two bytes each if the vocabulary allows it, else of four; `at` is the
    projection. `row` numbers the rows by input split."""
    kind = docs.schema[id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, row = Encoder.shared(tokenizer), TaskContext.get().partitionId() << 40
        narrow = max(encoder.size, end_id + 1) <= 1 << 16
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids, sizes = encoder.batch([value or "" for value in part.column("_text").to_pylist()])
                after = np.cumsum(sizes)
                raw = np.insert(ids, after, end_id).astype("<u2" if narrow else "<u4").tobytes()
                edges = (after + np.arange(1, len(sizes) + 1)) * (2 if narrow else 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(sizes)), pa.int64()), part.column("_id"), pa.array(sizes + 1), pa.array([raw[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)], pa.binary()),
                     pa.FixedSizeListArray.from_arrays(pa.array(projected(ids, sizes).ravel()), DIMS).cast(pa.list_(pa.int64()))], names=["row", "_id", "n", "ids", "at"])
                row += len(sizes)

    return docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(encode, f"row bigint, _id {kind}, n bigint, ids binary, at array<bigint>")


def keyed(rows: DataFrame) -> DataFrame:
    """`rows` with the Hilbert key of `at`, centred and scaled by the mean and spread of all rows; one row reaches the driver."""
    sums = [F.sum(F.get("at", F.lit(d)).cast("decimal(20,0)")).alias(f"s{d}") for d in range(DIMS)]
    squares = [F.sum((F.get("at", F.lit(d)) * F.get("at", F.lit(d))).cast("decimal(20,0)")).alias(f"q{d}") for d in range(DIMS)]
    totals = rows.agg(F.count("*").alias("n"), *sums, *squares).head()
    count = max(int(totals["n"]), 1)
    means = [int(totals[f"s{d}"] or 0) / count for d in range(DIMS)]
    spreads = [max(int(totals[f"q{d}"] or 0) / count - means[d] ** 2, 1.0) ** 0.5 for d in range(DIMS)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").flatten().to_numpy().reshape(-1, DIMS)
            share = 1 / (1 + np.exp(np.clip(-1.702 * (at - means) / spreads, -40, 40)))  # the logistic curve spreads a bell evenly
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_id"), batch.column("n"), pa.array(hilbert(cells, BITS), pa.int64())], names=["row", "_id", "n", "key"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("row", "_id", "n", "at").mapInArrow(number, f"row bigint, _id {kind}, n bigint, key bigint")


def placed(keys: DataFrame) -> DataFrame:
    """(row, part, local): rows of `keys` in the order of (key, id, row), with the ids before each one in its part."""
    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part), pa.int32()), pa.array(ends - n, pa.int64()), batch.column("n")], names=["row", "part", "local", "n"])
            start = int(ends[-1]) if len(ends) else start

    order = ["key", "_id", "row"]
    return keys.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n").mapInArrow(running, "row bigint, part int, local bigint, n bigint")


def cuts(start: int, end: int, total: int, length: int) -> list[tuple[int, int, int]]:
    """(from, sequence, its first place) of the pieces of the stream's places `start` to `end`. Sequences have `length` places; the
    rest of the stream beyond the last full one is cut into falling powers of two."""
    full = total // length
    found, at = [], start
    while at < end and at < full * length:
        sequence = at // length
        found.append((at, sequence, sequence * length))
        at = (sequence + 1) * length
    first, sequence, rest = full * length, full, total - full * length
    while rest and at < end:
        size = 1 << (rest.bit_length() - 1)
        if at < first + size:
            found.append((max(at, first), sequence, first))
            at = first + size
        first, sequence, rest = first + size, sequence + 1, rest - size
    return found


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): every piece of every document. `ids` are little-endian unsigned
    32-bit integers, `offset` is the piece's place in its sequence, `start` its place in the document. `length` is a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = docs.schema[id].dataType.simpleString()
    rows = stored(encoded(docs, tokenizer, end_id, id, text), "curve-ids")
    places = stored(placed(keyed(rows)), "curve-places")
    parts = places.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part of the sort
    offsets = stored(parts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "curve-parts")
    total = offsets.agg(F.sum("n")).head()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                take, out = [], [[] for _ in range(6)]
                for i, (raw, at, n) in enumerate(zip(part.column("ids"), part.column("place").to_pylist(), part.column("n").to_pylist(), strict=True)):
                    view = raw.as_buffer()
                    ids = np.frombuffer(view, "<u2" if len(view) == 2 * n else "<u4").astype("<u4")
                    found = cuts(at, at + n, total, length)
                    for (first, sequence, base), (last, *_) in zip(found, [*found[1:], (at + n,)], strict=True):
                        take.append(i)
                        for column, value in zip(out, (first - at, last - first, ids[first - at:last - at].tobytes(), n, sequence, first - base), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(take, pa.int64())), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))],
                                                 names=[id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    at = places.join(offsets.select("part", "base"), "part").select("row", (F.col("base") + F.col("local")).alias("place"))
    return rows.select("row", "_id", "n", "ids").join(at, "row").select("_id", "n", "ids", "place").mapInArrow(
        cut, f"`{id}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(found: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences that the pieces make up, each at most `length` ids long."""
    ordered: Column = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("_parts")).select(
        "sequence_id", "length", F.aggregate("_parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"])).alias("ids"))


def digests(found: DataFrame) -> DataFrame:
    """`found` with the crc32 of each piece's ids instead of the ids."""
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
