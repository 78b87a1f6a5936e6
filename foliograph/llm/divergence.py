"""How far the word use of sources diverges, by one-hot level products.

Each language keeps the terms that enough of its documents hold. A kept term's count in a group (language, source) is its level
there; level 0 counts too. Indicator columns, one for each (group, level), stand over the kept terms; the matrix of a block
of terms, multiplied by its own transpose in tiles, holds for each two groups the joint table of their levels: how many terms have level
a here and level b there. Prices depend on levels alone, so the distance of two groups is their joint table times the price
differences, summed over blocks. Counts in a tile are at most the terms of a block, which single precision holds exactly;
prices and sums are integers.

A task counts a batch of texts in Python and sends a term once per language with its counts by source, so the largest key has a row per
task. Blocks are terms of similar counts (few levels) and of bounded size, each with the groups of its language.

Null text, language and source count as ''. A row is a document, repeated ids or rows included. Ties in value fall to the
smaller item by UTF-8. Very long texts are one document among others; an empty table gives no rows. Only the three columns are read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.store import stored

MIN_DOCS, TOP = 30, 50
#: Prices: 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).
SCALE, PRIOR = 1_000_000_000, 5
#: Counts a task holds before it sends them on.
MAX_ENTRIES = 600_000
#: Terms times groups of a block, and indicator columns of a tile.
BLOCK_CELLS, TILE = 1 << 16, 1024
#: Bytes of a term in lower case; all others become spaces.
_FOLD = bytes(b + 32 if chr(b) in string.ascii_uppercase else b if b >= 128 or chr(b) in string.ascii_lowercase else 32 for b in range(256))


class _Counts:
    """Counts of terms by language and source, and documents that hold them by language."""

    def __init__(self) -> None:
        self.groups: dict[str, dict[str, Counter]] = {}
        self.docs: dict[str, Counter] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        words = text.encode().translate(_FOLD).split()
        self.groups.setdefault(lang, {}).setdefault(source, Counter()).update(words)
        self.docs.setdefault(lang, Counter()).update(set(words))

    def entries(self) -> int:
        return sum(len(c) for sources in self.groups.values() for c in sources.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(lang, term, docs, counts) of all that was added, which is forgotten."""
        for lang, docs in self.docs.items():
            terms, sources = list(docs), sorted(self.groups[lang])
            number = dict(zip(terms, range(len(terms)), strict=True))
            at = [np.fromiter(map(number.__getitem__, self.groups[lang][s]), np.int64, len(self.groups[lang][s])) for s in sources]
            n = np.concatenate([np.fromiter(self.groups[lang][s].values(), np.int64, len(x)) for s, x in zip(sources, at, strict=True)])
            which = np.repeat(np.arange(len(sources)), [len(x) for x in at])
            place = np.concatenate(at)
            order = np.argsort(place, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(terms)))])
            names, shown, held = pa.array(sources), pa.array(terms, pa.binary()).cast(pa.string()), np.fromiter(docs.values(), np.int64, len(terms))
            for low in range(0, len(terms), 10_000):
                high = min(low + 10_000, len(terms))
                part = order[ends[low]:ends[high]]
                counts = pa.StructArray.from_arrays([names.take(pa.array(which[part])), pa.array(n[part])], ["source", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (high - low)), shown.slice(low, high - low), pa.array(held[low:high]), pa.ListArray.from_arrays(pa.array(ends[low:high + 1] - ends[low], pa.int32()), counts)],
                    names=["lang", "term", "docs", "counts"])
        self.__init__()


def _keys(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))


def counted(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, source, n, lang_n, first): the occurrences of each kept term in each source that has it and in its language; `first`
    marks one row of each term. Terms are runs of ASCII letters and non-ASCII characters, with A-Z in lower case."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            columns = [batch.column(c) for c in ("lang", "source", "text")]
            for row in range(batch.num_rows):
                counts.add(*(c[row].as_py() for c in columns))
                if row % 64 == 63 and counts.entries() > MAX_ENTRIES:
                    yield from counts.rows()
        yield from counts.rows()

    sent = _keys(docs, text, lang, source).mapInArrow(count, "lang string, term string, docs bigint, counts array<struct<source:string,n:bigint>>")
    term = Window.partitionBy("lang", "term")  # a row for each task at most
    kept = sent.withColumn("_docs", F.sum("docs").over(term)).where(F.col("_docs") >= min_docs).select("lang", "term", F.inline("counts"))
    sums = kept.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))  # the exchange by (lang, term) serves all of these
    return sums.withColumns({"lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})


def groups(docs: DataFrame, terms: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, lang_total, kept): every occurring group with the occurrences of kept terms in it and in its language, and
    the number of terms that the language keeps. `terms` is what `counted` gives."""
    occurring = _keys(docs, text, lang, source).groupBy("lang", "source").agg(F.count("*").alias("docs"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("bigint")).alias("firsts"))
    every = Window.partitionBy("lang")  # a row for each source
    both = occurring.join(totals, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    return both.select("lang", "source", "total", F.sum("total").over(every).alias("lang_total"), F.sum("firsts").over(every).alias("kept"))


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exactly, for totals of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    over, under = (wide(count) + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(kept) * PRIOR
    return F.lit(1) + F.call_function("div", over, under)


def blocks(terms: DataFrame, of: DataFrame, cells: int = BLOCK_CELLS) -> tuple[DataFrame, DataFrame]:
    """The matrix in blocks of terms: (lang, block, term, source, n, p) with a row for each level above 0, and (lang, block, source, p) with
    each group of the language and its price at level 0. Terms of one block have similar counts in their language."""
    size = F.floor(F.log2(F.col("lang_n"))).cast("int")
    sources = of.groupBy("lang").agg(F.count("*").alias("sources"))
    sizes = (terms.where("first").groupBy("lang", size.alias("size")).agg(F.count("*").alias("terms")).join(sources, "lang")
             .select("lang", "size", F.ceil(F.col("terms") * F.col("sources") / cells).cast("int").alias("parts")))
    rows = terms.withColumn("size", size).join(sizes, ["lang", "size"]).withColumn("block", F.col("size") * (1 << 20) + F.pmod(F.xxhash64("term"), F.col("parts")))
    priced = rows.join(of.select("lang", "source", "total", "kept"), ["lang", "source"])
    matrix = priced.select("lang", "block", "term", "source", "n", price(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    spread = sizes.select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "size").select("lang", (F.col("size") * (1 << 20) + F.col("part")).cast("bigint").alias("block"))
    zero = spread.join(of, "lang").select("lang", "block", "source", price(F.lit(0), F.col("total"), F.col("kept")).alias("p"))
    return matrix, stored(zero, "divergence-zero")  # a table of its own: Spark can't tell the columns of two sides of one origin apart


def _tables(rows: pd.DataFrame, zero: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Names of the groups of a block; group, level and price of each indicator column; and from tile to tile the entries (column,
    column, terms) of the product of the matrix with its transpose, for columns of different groups, the smaller group first."""
    names = np.sort(zero["source"].to_numpy(object))
    base = zero.set_index("source")["p"].reindex(names).to_numpy(np.int64)
    term, terms = pd.factorize(rows["term"])
    group = np.searchsorted(names, rows["source"].to_numpy(object))
    found = pd.DataFrame({"g": group, "level": rows["n"].to_numpy(np.int64), "p": rows["p"].to_numpy(np.int64)})
    columns = pd.concat([pd.DataFrame({"g": np.arange(len(names)), "level": 0, "p": base}), found.drop_duplicates(["g", "level"])]).sort_values(["g", "level"]).reset_index(drop=True)
    at = found.merge(columns.reset_index(), on=["g", "level"], how="left")["index"].to_numpy()
    of_group, level, p = (columns[c].to_numpy(np.int64) for c in ("g", "level", "p"))
    none = np.searchsorted(of_group, np.arange(len(names)))  # the column of level 0 comes first in its group
    cell = np.tile(none, (len(terms), 1))
    cell[term, group] = at

    def indicators(low: int, high: int) -> np.ndarray:
        first, last = of_group[low], of_group[high - 1] + 1
        part = cell[:, first:last]
        here = (part >= low) & (part < high)
        one_hot = np.zeros((len(terms), high - low), np.float32)
        one_hot[np.nonzero(here)[0], part[here] - low] = 1
        return one_hot

    def products() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        edges = [*range(0, len(p), TILE), len(p)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            left = indicators(a, b)
            for c, d in zip(edges[i:], edges[i + 1:], strict=False):
                table = (left if c == a else indicators(c, d)).T @ left
                y, x = np.nonzero(table)
                n = table[y, x].astype(np.int64)
                apart = of_group[x + a] < of_group[y + c]
                yield x[apart] + a, y[apart] + c, n[apart]

    return names, of_group, level, p, products()


def joint_tables(matrix: DataFrame, zero: DataFrame) -> DataFrame:
    """(lang, source, level, other, other_level, terms): the joint tables of every two groups of a language, `source` < `other`."""
    def table(key: tuple, rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        names, group, level, _, products = _tables(rows, base)
        found = [pd.DataFrame({"lang": key[0], "source": names[group[x]], "level": level[x], "other": names[group[y]], "other_level": level[y], "terms": n}) for x, y, n in products]
        return pd.concat(found)

    made = matrix.groupBy("lang", "block").cogroup(zero.groupBy("lang", "block")).applyInPandas(table, "lang string, source string, level bigint, other string, other_level bigint, terms bigint")
    return made.groupBy("lang", "source", "level", "other", "other_level").agg(F.sum("terms").alias("terms"))


def distances(matrix: DataFrame, zero: DataFrame) -> DataFrame:
    """(lang, source, other, value): the price differences of every two groups summed over all kept terms, `source` < `other`. Each
    block's joint tables are priced where they arise, and only their sums are shuffled."""
    def priced(key: tuple, rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        names, group, _, p, products = _tables(rows, base)
        values = np.zeros(len(names) ** 2, np.int64)
        for x, y, n in products:
            np.add.at(values, group[x] * len(names) + group[y], n * np.abs(p[x] - p[y]))
        x, y = np.triu_indices(len(names), 1)
        return pd.DataFrame({"lang": key[0], "source": names[x], "other": names[y], "value": values[x * len(names) + y]})

    made = matrix.groupBy("lang", "block").cogroup(zero.groupBy("lang", "block")).applyInPandas(priced, "lang string, source string, other string, value bigint")
    return made.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language by falling distance, part `term` the
    `top` terms that the group uses more than its language."""
    terms = stored(counted(docs, min_docs, text, lang, source), "divergence-terms")
    of = stored(groups(docs, terms, text, lang, source), "divergence-groups")
    half = distances(*blocks(terms, of))
    both = stored(half.unionAll(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")), "divergence-pairs")
    others = of.select(F.col("lang").alias("of"), F.col("source").alias("other"))
    every = of.select("lang", "source").join(others, F.expr("lang = of AND source <> other")).drop("of")
    pairs = every.join(both, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    used = terms.join(of, ["lang", "source"]).withColumns({"p": price(F.col("n"), F.col("total"), F.col("kept")), "q": price(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    over = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionAll(over.select("*", rank).where(F.col("rank") <= top))
