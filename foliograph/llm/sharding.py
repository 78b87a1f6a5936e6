"""Shards by extendible hashing.

Rows are placed by the leading bits of a hash. A bucket whose rows exceed the byte limit is split on its next bit, others
are left alone, so the directory (leading bits to bucket) is as deep as its fullest region needs. Only DataFrame
functions are used: bytes are summed per prefix, sums of sums give every shallower prefix, and only rows of buckets that
are still too large go into the next, deeper round.

Rows with all hash bits alike (the same id and text) cannot be split by bits; beyond the limit they fill overflow pages.
A single row larger than the limit has a bucket or page of its own. Null ids and texts are hashed as such; null texts have
no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.store import stored

#: Leading bits of the hash, and how many are looked at in a round.
BITS, STEP = 60, 12


def _placed(rows: DataFrame, done: int, depth: int, limit: int) -> DataFrame:
    """(prefix, bits) of the buckets that rows, alike in their first `done` bits within a prefix, need down to `depth`."""
    key = F.substring("hash", 1, depth)
    sums = rows.groupBy(key.alias("deep")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("rows"))
    levels = sums.select("deep", "n_bytes", "rows", F.explode(F.sequence(F.lit(done), F.lit(depth))).alias("bits"))
    fits = (levels.groupBy("bits", F.expr("substring(deep, 1, bits)").alias("prefix")).agg(F.sum("n_bytes").alias("b"), F.sum("rows").alias("r"))
            .where((F.col("b") <= limit) | (F.col("r") == 1)).select("bits", "prefix"))
    return (levels.select("deep", "bits", F.expr("substring(deep, 1, bits)").alias("prefix")).join(fits, ["bits", "prefix"])
            .groupBy("deep").agg(F.min("bits").alias("bits")))


def shards(docs: DataFrame, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, depth, shard, page) of every row; `shard` is the bucket's bits, `page` is above 0 in overflow pages only."""
    whole = F.md5(F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    bits = F.lpad(F.conv(F.substring(whole, 1, BITS // 4), 16, 2), BITS, "0")
    rows = stored(docs.select(F.col(id), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), bits.alias("hash")), "shard-rows")
    total, done, parts = rows.agg(F.sum("n_bytes")).head()[0] or 0, 0, []
    depth = min(BITS, max(1, (total // limit).bit_length() + 2))
    while True:
        found = _placed(rows, done, depth, limit)
        joined = rows.join(found, F.substring("hash", 1, depth) == F.col("deep"), "left").drop("deep")
        joined = stored(joined, "shard-round")
        parts.append(joined.where("bits IS NOT NULL").select(id, "n_bytes", F.col("bits").cast("int").alias("depth"), F.expr("substring(hash, 1, bits)").alias("shard"), F.lit(0).cast("bigint").alias("page")))
        rows = joined.where("bits IS NULL").drop("bits")
        if rows.isEmpty():
            break
        if depth == BITS:
            parts.append(_pages(rows, limit, id))
            break
        done, depth = depth + 1, min(BITS, depth + STEP)
    return reduce(DataFrame.unionAll, parts)


def _pages(rows: DataFrame, limit: int, id: str) -> DataFrame:
    """Equal rows in pages of at most `limit` bytes. They are numbered within each input partition first, so that no task
    holds all rows of one hash."""
    part = rows.withColumn("_part", F.spark_partition_id())
    counts = part.groupBy("hash", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("hash", "_part").orderBy("n_bytes")) - 1
    counted = part.withColumn("_at", number).join(counts.select("hash", "_part", before.alias("_before")), ["hash", "_part"])
    page = F.floor((F.col("_before") + F.col("_at")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))))
    return counted.select(id, "n_bytes", F.lit(BITS).alias("depth"), F.col("hash").alias("shard"), page.cast("bigint").alias("page"))


def directory(placed: DataFrame) -> DataFrame:
    """(shard, page, depth, rows, n_bytes): the buckets that `shards` made."""
    return placed.groupBy("shard", "page", "depth").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("n_bytes"))
