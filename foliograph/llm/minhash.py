"""Near-duplicate documents by b-bit MinHash.

A task turns each text into the set of its word shingles, hashed to 64 bits, and takes the minima of `ROWS * BANDS` hash
functions. Bands of minima make candidates; the low `BITS` bits of every minimum are packed in bit planes, so a pair's
similarity is estimated by counting bits, corrected for chance agreement. A parity sketch (one bit flipped per shingle) bounds
from below by how many shingles two sets differ, so it drops pairs near the threshold without ever losing a link. What passes
is confirmed on the full sets.

Texts with the same words are one node, found by a hash of their words. Inside a bucket no pairs of all members are made:
while there are many pairs across components, members meet leaders, the lowest members of ever finer sub-groups, and each
is compared with the likeliest one. When few pairs are left, or leaders bring no more, all pairs that are still in different
components meet directly; only those that both sketches let through become rows. So no link that could join two components
goes untested, and a large group of copies costs little more than its first leaders.

Texts without words (or null) have no shingles and are linked with nothing. Repeated rows and rows that share an id keep
their places. Rows without an id belong to the component of a document with the same words, if there is one; otherwise they
are linked with nothing and their component is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.store import stored

ROWS, BANDS, BITS = 5, 25, 4
PLANE = 128
#: Members of a bucket meet directly when there are at most so many pairs across components for each member.
PAIRS = 8
#: Bits of a leader's sub-group in each round; a bucket has 2 ** bits leaders.
LEVELS = (0, 4)
#: Bits of the parity sketch.
PARITY = 1024
#: Pairs with one text in a block of the confirmation.
BLOCK = 1000
#: An estimate may be so many standard errors below the threshold.
SIGMAS = 4.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STATE = np.random.default_rng(20240)
_FACTORS = _STATE.integers(1, 1 << 63, PLANE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _STATE.integers(1, 1 << 63, PLANE, dtype=np.uint64)
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)
MAX_WORDS = 1_000_000


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Shingler:
    """Sets of hashed shingles; remembers the hashes of words within a task."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def of(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        words = (text or "").encode().translate(_TO_LOWER).split()
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h, words
        width = min(self.words, len(h))
        total = np.full(len(h) - width + 1, len(h) if len(h) < self.words else 0, np.uint64)
        for i in range(width):
            total = _scrambled(total * _MIX + h[i:len(h) - width + 1 + i])
        return np.unique(total), words


def _node(words: list[bytes]) -> str | None:
    return xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else None


def _minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function (32 bits), over blocks of shingles."""
    low = np.full(PLANE, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        block = shingles[start:start + 4096]
        low = np.minimum(low, (_FACTORS[:, None] * block + _SHIFTS[:, None]).min(axis=1))
    return _scrambled(low) >> np.uint64(32)


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of all minima as `BITS` planes of `PLANE` bits."""
    planes = (minima[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8), axis=1).view(np.int64).ravel()


def _parity(shingles: np.ndarray) -> np.ndarray:
    """`PARITY` bits, each the parity of the shingles that fall on it: two sets differ by at least as many shingles as bits."""
    at = (shingles >> np.uint64(32)) % np.uint64(PARITY)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, words: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, n_shingles, bits, parity, bands) of every row."""
    kind = docs.schema[id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(words)
        for batch in batches:
            nodes, sizes, bits, parity, bands = [], [], [], [], []
            for value in batch.column("_text"):
                found, plain = shingler.of(value.as_py())
                sizes.append(len(found))
                nodes.append(_node(plain))
                if len(found):
                    minima = _minima(found)
                    bits.append(_packed(minima)), parity.append(_parity(found))
                    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for row in minima[:ROWS * BANDS].reshape(BANDS, ROWS).T:
                        keys = _scrambled(keys * _MIX + row)
                    bands.append(keys.view(np.int64))
                else:
                    bits.append(None), parity.append(None), bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())),
                                              pa.array(parity, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["_id", "node", "n_shingles", "bits", "parity", "bands"])

    return docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(sign, f"_id {kind}, node string, n_shingles bigint, bits array<bigint>, parity array<bigint>, bands array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) from (node, text); rows whose text is not the node's (an id used twice) are left out."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(words)
        for batch in batches:
            nodes, sets = [], []
            for node, value in zip(batch.column("node").to_pylist(), batch.column("_text"), strict=True):
                found, plain = shingler.of(value.as_py())
                if _node(plain) == node:
                    nodes.append(node), sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "_text").mapInArrow(make, "node string, shingles array<bigint>").dropDuplicates(["node"])


def _differing(a: str, b: str) -> str:
    """SQL for the number of minima whose low bits differ."""
    words = PLANE // 64
    return " + ".join("bit_count(" + " | ".join(f"({a}[{p * words + w}] ^ {b}[{p * words + w}])" for p in range(BITS)) + ")" for w in range(words))


def _most_differing(threshold: float) -> int:
    """Differing minima of a pair whose estimate, corrected for chance agreement, is `SIGMAS` errors below the threshold."""
    chance = 2.0 ** -BITS
    agree = threshold + (1 - threshold) * chance
    floor = max(0.0, threshold - SIGMAS * (agree * (1 - agree) / PLANE) ** 0.5 / (1 - chance))
    return int((1 - chance) * (1 - floor) * PLANE)


def _possible(a: str, b: str, percent: int) -> str:
    """SQL that holds for every pair of similar sets but those whose estimate is too far off: the parity sketches first, which
    never err (a sets' difference d of s shingles in both means a similarity of (s - d) / (s + d))."""
    odd = " + ".join(f"bit_count({a}.parity[{i}] ^ {b}.parity[{i}])" for i in range(PARITY // 64))
    return (f"({odd}) * {100 + percent} <= ({a}.n_shingles + {b}.n_shingles) * {100 - percent} "
            f"AND {_differing(f'{a}.bits', f'{b}.bits')} <= {_most_differing(percent / 100)}")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. A `b` of many pairs (a leader) meets them in blocks."""
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")).join(blocks, "b").withColumn("_block", F.explode(F.expr("sequence(0, _blocks - 1)"))).drop("_blocks")
    left = pairs.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("_blocks")).cast("int").alias("_block"))
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a").join(right, ["b", "_block"])
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common * 100 >= (F.size("_a") + F.size("_b") - common) * percent).select("a", "b")


def _named(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest name among all nodes that `edges` (a, b) connect with a node, by neighbours and jumps."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    names = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp"))
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        jump = names.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        step = stored(names.join(near, "node").join(jump, "comp", "left").select("node", F.least("comp", "near", "over").alias("to"), F.col("comp").alias("was")), "names")
        names = step.select("node", F.col("to").alias("comp"))
        if step.where("to <> was").isEmpty():
            return names


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of all members of shared buckets that have a link.

    Members of one component need not meet, so the largest component of a bucket only answers: the others ask its leaders,
    and in the end all of it. Rounds of leaders go on as long as they bring down the pairs across components."""
    nodes = members.select("node").distinct()
    labels, links = nodes.withColumn("comp", F.col("node")), []
    rounds, before, last = iter(LEVELS), float("inf"), False
    while not last:
        current, level = members.join(labels, "node"), next(rounds, None)
        parts = current.groupBy("band", "comp").agg(F.count("*").alias("m")).groupBy("band").agg(
            F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.max(F.struct("m", "comp"))["comp"].alias("main"))
        parts = stored(parts.select("band", "main", "size", ((F.col("size") * F.col("size") - F.col("squares")) / 2).alias("open")).where("open > 0"), "buckets")
        many = parts.where(F.col("open") > F.col("size") * PAIRS).agg(F.sum("open")).head()[0]
        last = not many or level is None or many > before * 0.9
        before = many
        here = current.join(parts.select("band", "main"), "band")
        if not last:
            sub = F.col("rank").bitwiseAND((1 << level) - 1).alias("sub")
            lead = here.groupBy("band", sub).agg(F.min(F.struct("rank", "node", "comp", "bits", "parity", "n_shingles")).alias("l")).select("band", "l.*")
            pairs = here.where("comp <> main").alias("m").join(lead.alias("l"), F.expr(f"m.band = l.band AND m.comp <> l.comp AND {_possible('m', 'l', percent)}"))
            pairs = (pairs.select(F.col("m.node").alias("a"), F.col("l.node").alias("b"), F.expr(_differing("m.bits", "l.bits")).alias("far"))
                     .groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")))
        else:
            apart = F.expr(f"m.band = o.band AND m.comp <> o.comp AND (o.comp = o.main OR m.node < o.node) AND {_possible('m', 'o', percent)}")
            pairs = here.where("comp <> main").alias("m").join(here.alias("o"), apart)
            pairs = pairs.select(F.col("m.node").alias("a"), F.col("o.node").alias("b")).distinct()
        links.append(stored(_confirmed(pairs, sets, percent), "links"))
        if not last:
            labels = stored(nodes.join(_named(reduce(DataFrame.unionAll, links)), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "labels")
    return _named(reduce(DataFrame.unionAll, links))


def classes(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, n_shingles, component) of every row: documents are linked from `percent` per cent Jaccard similarity of their
    shingle sets on, `component` is the smallest id reachable."""
    signed = stored(signatures(docs, words, id, text), "signatures")
    nodes = stored(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("first"), *(F.first(c).alias(c) for c in ("bits", "parity", "n_shingles", "bands"))), "nodes")
    bands = nodes.where("first IS NOT NULL").select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    members = stored(bands.join(shared, "band").join(nodes.select("node", "bits", "parity", "n_shingles"), "node").withColumn("rank", F.xxhash64("node")), "members")
    if not members.isEmpty():
        wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("first").alias("_id"), "node")
        texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(wanted, "_id")
        labels = _linked(members, stored(_sets(texts, words), "shingle-sets"), percent)
        ends = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        ends = nodes.withColumn("comp", F.col("node"))
    firsts = ends.groupBy("comp").agg(F.min("first").alias("component"))
    named = ends.select("node", "comp").join(firsts, "comp").select("node", "component")
    found = signed.select("_id", "node", "n_shingles").join(named, "node", "left")
    return found.select(F.col("_id").alias(id), "node", "n_shingles", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component")).alias("component"))


#: Added to a hash of the text, the id of rows without one: above all ids that count documents.
_NAMELESS = 1 << 62


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component the one whose id is the smallest, and those without words. Rows without an id
    (whole numbers) are linked like others and stay only where no row with an id is in their component, of equal texts one."""
    if docs.schema[id].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        found = classes(docs, words, percent, id, text)
        stay = found.where(F.col(id).eqNullSafe(F.col("component"))).select(F.col(id).alias("_stays")).distinct()
        return docs.join(stay, F.col(id).eqNullSafe(F.col("_stays")), "left_semi")
    key = F.coalesce(F.col(id).cast("bigint"), F.xxhash64(text).bitwiseAND(_NAMELESS - 1) + F.lit(_NAMELESS))
    name = "_node"
    while name in docs.columns:
        name += "_"
    named = docs.withColumn(name, key)
    found = classes(named, words, percent, name, text)
    stay = found.where(F.col(name) == F.col("component")).select(name).distinct()
    kept = named.join(stay, name, "left_semi")
    return kept.where(F.col(id).isNotNull()).unionByName(kept.where(F.col(id).isNull()).dropDuplicates([name])).select(*(F.col(f"`{c}`") for c in docs.columns))
