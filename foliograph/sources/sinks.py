"""Writers: Markdown documents, append-only logs, upserts by paper, and which outputs are out of date.

Outputs are laid out by hash buckets of the paper, so their number of folders does not grow with the papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int")


def write_markdown(paragraphs: DataFrame, path: str, name: str, buckets: int = BUCKETS) -> None:
    """The Markdown documents of all papers under one name: `<path>/document=<name>/bucket=<n>/`, rows (paper_id, pos, text) clustered by
    paper and in order. A name written again replaces its documents. No document is gathered into one value."""
    rows = paragraphs.select("paper_id", "pos", "text", F.lit(name).alias("document"), _bucket(buckets).alias("bucket"))
    ordered = rows.repartition("document", "bucket", "paper_id").sortWithinPartitions("document", "bucket", "paper_id", "pos")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document", "bucket").parquet(path)


def read_markdown(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The paragraphs (paper_id, pos, text) of the documents of one name."""
    return spark.read.parquet(path).where(F.col("document") == name).drop("document", "bucket")


# -- logs ------------------------------------------------------------------------------


def _runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The complete runs of a log, as first and last micro-batch: those that their writer finished and no longer run replaced."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("run=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            first, last = name[4:].split("-")
            found.append((int(first), int(last)))
    return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))


def _write_run(rows: DataFrame, path: str, first: int, last: int, buckets: int) -> None:
    spread = rows.withColumn("bucket", _bucket(buckets)).repartition("bucket")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={first}-{last}")


def append_log(stream: DataFrame, path: str, checkpoint: str, once: bool = False, buckets: int = BUCKETS):
    """Append a stream of events to a log, a run of files for each micro-batch. A micro-batch that is run again replaces its own run; one
    that a compacted run already holds is not written again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if not any(first <= batch_id <= last and first < last for first, last in _runs(batch.sparkSession, path)):
            _write_run(batch, path, batch_id, batch_id, buckets)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All events of a log that `append_log` wrote."""
    runs = _runs(spark, path)
    if not runs:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/run={first}-{last}" for first, last in runs))
    return found.drop("run", "bucket")


def compact_log(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> None:
    """The runs so far as one, a file or so for each bucket. Readers change over when it is finished; the runs it replaces stay until
    they are removed by hand, so a reader that started before is not disturbed."""
    runs = _runs(spark, path)
    if len(runs) > 1:
        _write_run(read_appended(spark, path, schema), path, runs[0][0], runs[-1][1], buckets)


def upsert_papers(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new paper inserts, a known one is replaced whole, the rest stay."""
    return current.join(incoming.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(incoming)


def stale_outputs(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Papers whose derived document is missing or older than its source. Both: paper_id, mtime."""
    return sources.join(outputs.select("paper_id", F.col("mtime").alias("_out")), "paper_id", "left").where("_out IS NULL OR _out < mtime").select("paper_id")
