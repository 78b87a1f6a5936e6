"""Exact substring joins between a table of needles and a table of texts, without pairing every needle with every text.

Texts are cut into aligned blocks of `w` characters; a needle of at least 2w-1 characters covers a whole aligned block
wherever it occurs, and which one is decided by its offset modulo w. So each needle offers its first `w` windows of
length w, each text its aligned blocks, and the two meet in an equi-join; every occurrence meets exactly once and is
then verified in full. `w` follows the needle's length (a power of two), so long needles touch few blocks. Small blocks are alike in
many texts; they carry their neighbours, so a needle is compared with up to three blocks before it is joined with a text.

Blocks are rows, and so many of them cost more to shuffle than the texts do. Where the texts of one key are short together, as a
paper's pages mostly are, its needles meet them as they stand: needles and texts are shuffled once and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.operators.spread import materialise

#: Characters up to which each needle simply reads all texts of its own key: so much work a needle, whatever the table.
WHOLE = 1 << 18
#: Blocks of more characters than this say enough by their hash.
NEAR = 16


def _width(length: Column) -> Column:
    """Largest power of two w with 2w - 1 <= length."""
    return F.pow(F.lit(2), F.floor(F.log2((length + 1) / 2 + 1e-9))).cast("int")


def starts(text: Column, needle: Column) -> Column:
    """0-based places of `needle` in `text`, overlapping ones too: the text is cut before each."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    none = F.array().cast("array<int>")
    sizes = F.transform(F.split(text, quoted, -1), F.length)
    begin = F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(none).alias("out"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out"))
    return F.aggregate(F.slice(sizes, F.lit(1), F.size(sizes) - 1), begin, step, lambda a: a["out"])


def long_keys(texts: DataFrame, text: str, within: Sequence[str]) -> DataFrame | None:
    """Keys whose texts hold more than `WHOLE` characters together; None if there are none."""
    large = texts.groupBy(*within).agg(F.sum(F.length(text)).alias("_all")).where(F.col("_all") > WHOLE).select(*within)
    return None if large.isEmpty() else materialise(large)


def substring_join(needles: DataFrame, texts: DataFrame, needle: str, text: str, text_keys: Sequence[str],
                   within: Sequence[str] = ("paper_id",), places: bool = True) -> DataFrame:
    """Every occurrence of `needle` in `text` among rows equal on `within`: needle columns, text keys and `at`, the
    0-based start. Overlapping occurrences all count. Empty needles match nothing. Without `places` a text that holds the needle may
    come once instead, without `at`."""
    within = list(within)
    if not within:
        met = _by_blocks(needles, texts, needle, text, text_keys, within)
        return met if places else met.drop("at")
    if set(text_keys) <= set(within):  # one text a key
        return _as_they_stand(needles, texts, needle, text, text_keys, within, places)
    large = long_keys(texts, text, within)
    if large is None:
        return _as_they_stand(needles, texts, needle, text, text_keys, within, places)
    of = lambda df, how: df.join(large, within, how)
    short = _as_they_stand(of(needles, "left_anti"), of(texts, "left_anti"), needle, text, text_keys, within, places)
    blocks = _by_blocks(of(needles, "left_semi"), of(texts, "left_semi"), needle, text, text_keys, within)
    return short.unionByName(blocks if places else blocks.drop("at"))


def _as_they_stand(needles: DataFrame, texts: DataFrame, needle: str, text: str, text_keys: Sequence[str], within: Sequence[str], places: bool) -> DataFrame:
    held = texts.select(*within, *[k for k in text_keys if k not in within], F.col(text).alias("_text"))
    met = needles.where(F.length(needle) > 0).join(held, within).where(F.contains("_text", needle))
    return (met.withColumn("at", F.explode(starts(F.col("_text"), F.col(needle)))) if places else met).drop("_text")


def _by_blocks(needles: DataFrame, texts: DataFrame, needle: str, text: str, text_keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    keyed = (needles.where(F.length(needle) > 0)
             .withColumn("_w", _width(F.length(needle))))
    head = F.col("_r") + F.col("_w") + F.least(F.col("_w"), F.length(needle) - F.col("_r") - F.col("_w"))  # what up to three blocks hold of it
    grams = (keyed.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
             .withColumn("_gram", F.xxhash64(F.expr(f"substring({needle}, _r + 1, _w)")))
             .withColumn("_head", F.when(F.col("_w") <= NEAR, F.substring(needle, F.lit(1), head.cast("int")))))
    # At most one width per power of two: a bounded array, whatever the number of needles.
    widths = F.array_sort(F.collect_set("_w")).alias("_ws")
    carried = [k for k in text_keys if k not in within]
    bodies = texts.select(*within, *carried, F.col(text).alias("_text"))  # cut to the widths that needles of their own key have
    sized = bodies.join(keyed.groupBy(*within).agg(widths), within) if within else bodies.withColumn("_ws", keyed.select(widths).scalar())
    cut = (sized.withColumn("_w", F.explode("_ws"))
           .select(*within, *carried, "_w", F.expr("regexp_extract_all(_text, concat('(?s).{', _w, '}'), 0)").alias("_pieces")))
    near = lambda i: F.when(F.col("_w") <= NEAR, F.concat(F.coalesce(F.get("_pieces", i - 1), F.lit("")), F.get("_pieces", i), F.get("_pieces", i + 1)))
    blocks = cut.select(*within, *carried, "_w", F.posexplode(F.transform("_pieces", lambda p, i: F.struct(F.xxhash64(p).alias("gram"), near(i).alias("near")))).alias("_b", "_x")).select(
        *within, *carried, "_w", "_b", F.col("_x.gram").alias("_gram"), F.col("_x.near").alias("_near"))
    before = F.when(F.col("_b") > 0, F.col("_w")).otherwise(0)  # no neighbours at all for the last block: its text may go on
    alike = F.col("_near").isNull() | F.col("_head").isNull() | (F.substring("_near", (before - F.col("_r") + 1).cast("int"), F.length("_head")) == F.col("_head"))
    met = (grams.join(blocks, [*within, "_w", "_gram"])
           .withColumn("at", F.col("_b") * F.col("_w") - F.col("_r")).where((F.col("at") >= 0) & alike)
           .drop("_w", "_r", "_gram", "_b", "_head", "_near"))
    held = texts.select(*within, *carried, F.col(text).alias("_text"))
    return (met.join(held, [*within, *carried])
            .where(F.expr(f"substring(_text, at + 1, length({needle})) = {needle}")).drop("_text"))
