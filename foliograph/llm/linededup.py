"""Removal of lines that other documents hold, with levelled sorted runs.

Lines that were seen stand in runs: tables of line hashes, sorted, with the document that owns each line. A batch of
documents anti-joins its lines with the runs (sort-merge joins), adds its new lines as a run of level 0, and as soon as
`fanout` runs stand on a level they are merged into one of the next level. So a line is rewritten once per level, and the
number of runs to look into grows with the logarithm of the number of batches.

Null or empty texts are one empty line. Rows of the same document id count as one document; rows without an id count as
one document that comes after all others. Columns of the input stay, but for those named like an output.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.store import new_path, stored

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: A character beyond ASCII that is neither a lower-case letter nor punctuation.
_CASED = r"[^\p{ASCII}\p{Ll}\p{P}]"
_LAST = (1 << 63) - 1


def _plain(line: Column) -> Column:
    """The stripped line in lower case (A-Z)."""
    bare = F.btrim(line, F.lit(SPACE))
    # translate works letter by letter; lower gives the same where no other letter has a lower case
    return F.when(bare.rlike(_CASED), F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(bare))


def line_keys(lines: Column) -> Column:
    """Binary hashes of an array of lines, stripped and in lower case; null for lines of fewer than `MIN_CHARS` code points.
    In an array, each line is stripped once, not once for every expression that reads it."""
    return F.transform(F.transform(lines, _plain), lambda p: F.when(F.char_length(p) >= MIN_CHARS, F.unhex(F.md5(p.cast("binary")))))


def line_key(line: Column) -> Column:
    return line_keys(F.array(line))[0]


class LineRuns:
    """The runs, on levels. A run is a Parquet table (key, owner) sorted by key in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema("key binary, owner bigint").parquet(*paths)

    def _write(self, df: DataFrame) -> str:
        path = new_path(self.spark, "line-run")
        df.sortWithinPartitions("key").write.parquet(path)
        return path

    def seen(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self._read(paths) if paths else None

    def add(self, lines: DataFrame) -> None:
        """Adds the lines (key, doc) that no run has; each goes to its smallest document."""
        new, seen = lines.groupBy("key").agg(F.min("doc").alias("owner")), self.seen()
        self._put(0, self._write(new if seen is None else new.join(seen, "key", "left_anti")))

    def _put(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._read(full).repartition("key")))


def dropped_lines(docs: DataFrame, batches: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, drop): for each document that loses lines, the hashes of those; batches follow the order of ids."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col(id), F.lit(_LAST)).cast("bigint")
    lines = stored(docs.select(doc.alias("doc"), F.explode(line_keys(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))).alias("key"))
                   .select("key", "doc").where("key IS NOT NULL"), "lines")
    bounds = lines.agg(F.expr(f"percentile_approx(doc, array({','.join(str((i + 1) / batches) for i in range(batches - 1))}))")).head()[0] if batches > 1 else []
    bounds = sorted(set(bounds or []))
    runs, found = LineRuns(spark), []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        runs.add(batch)
        found.append(stored(batch.join(runs.seen(), "key").where("owner < doc").select("doc", "key"), "line-drops"))
    return reduce(DataFrame.unionAll, found).groupBy("doc").agg(F.collect_set("key").alias("drop"))


def dedup(docs: DataFrame, batches: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` whose `text` has only the kept lines, with `n_lines` (before) and `n_dropped`."""
    drops = dropped_lines(docs, batches, id, text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    joined = (docs.drop("n_lines", "n_dropped", "_doc", "_drop").withColumn("_doc", F.coalesce(F.col(id), F.lit(_LAST)).cast("bigint"))
              .join(drops.select(F.col("doc").alias("_doc"), F.col("drop").alias("_drop")), "_doc", "left"))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(F.filter(lines, lambda line: ~F.coalesce(F.array_contains("_drop", line_key(line)), F.lit(False))))
    joined = joined.withColumns({"_kept": kept, "n_lines": F.size(lines).cast("bigint")})
    return (joined.withColumn("n_dropped", F.col("n_lines") - F.size("_kept")).withColumn(text, F.array_join("_kept", "\n"))
            .drop("_kept", "_doc", "_drop"))
