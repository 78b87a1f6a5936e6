"""Shuffle-safe building blocks: running values, numbering and folds that never hold a whole paper in one task.

One paper may hold a large share of all rows, so a plain `Window.partitionBy("paper_id")` over rows is avoided. Positions
are cut into fixed blocks: a partial aggregate per block is combined over the few block rows of a paper, and the row-level
window runs inside one block only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 4096


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`). Only a session on one machine without it (local tests) gets a folder of its
    own; elsewhere executors would not see each other's files."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table several later joins read: packed Parquet in the shared folder, so a lost executor costs a
    re-read, not a recomputation, and readers take only the columns they need."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, fn: str = "sum",
            inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Running `fn` (sum, max, min) of `value` by integer position `pos` within `keys`, in two levels."""
    agg = getattr(F, fn)
    tagged = df.withColumn("_val", value).withColumn("_blk", F.floor(F.col(pos) / block))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = (tagged.groupBy(*keys, "_blk").agg(agg("_val").alias("_part"))
            .select(*keys, "_blk", agg("_part").over(before).alias("_base")))
    inside = (Window.partitionBy(*keys, "_blk").orderBy(pos)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = tagged.withColumn("_loc", agg("_val").over(inside)).join(base, [*keys, "_blk"])
    if fn == "sum":
        total = F.coalesce("_base", F.lit(0)) + F.coalesce("_loc", F.lit(0))
    else:
        pick = F.greatest if fn == "max" else F.least
        total = pick("_base", "_loc")
    return local.withColumn(out, total).drop("_val", "_blk", "_loc", "_base")


def page_numbering(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, page: str = "page") -> DataFrame:
    """0-based row number in (page, *order) within `keys`: numbered inside a page, shifted by the rows of earlier pages."""
    counts = df.groupBy(*keys, page).agg(F.count("*").alias("_n"))
    shift = running(counts, keys, page, F.col("_n"), "_shift", inclusive=False).drop("_n")
    inside = Window.partitionBy(*keys, page).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(inside) - 1).join(shift, [*keys, page])
            .withColumn(out, (F.col("_shift") + F.col("_rn")).cast("long")).drop("_rn", "_shift"))


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object],
                 step: Callable[[object, dict], tuple[object, Sequence[dict]]], schema: str,
                 finish: Callable[[object, dict], Sequence[dict]] | None = None) -> DataFrame:
    """A sequential fold per key for state no window frame can carry.

    Rows are hashed by key, sorted inside the partition and streamed through `step`, so memory is one state, not one
    group. Callers prune to the rows the fold really needs first."""
    keys, order = list(keys), list(order)
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last = None, None, None
        names = None
        for batch in batches:
            out: list[dict] = []
            names = list(batch.columns)
            for values in batch.itertuples(index=False, name=None):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != current:
                    if current is not None and finish is not None:
                        out.extend(finish(state, last))
                    current, state = key, start()
                state, emitted = step(state, row)
                last = row
                out.extend(emitted)
            if out:
                yield pd.DataFrame(out)
        if current is not None and finish is not None:
            rest = list(finish(state, last))
            if rest:
                yield pd.DataFrame(rest)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
