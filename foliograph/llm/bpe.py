"""Byte-level BPE on Spark.

Texts are split into pieces in Python (the pattern needs current Unicode tables). Each task hands every distinct piece once,
as an array of byte tokens, to Spark's higher-order functions, which fold the ranked merges with one constant rank map. A
last step in the same task puts the ids of a document's pieces together. No shuffle, no state beyond one task: a lost
executor costs its own tasks only.

Null texts count as empty and give no ids. Columns of the input stay, whatever their names, but for one named like an output,
which is replaced. Repeated rows are encoded one by one, very long texts whole; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.store import stored
from foliograph.llm.wordbpe import _BORDER, _EDGE, _KINDS, _MARK, _SPACE, Hasher

# Fixed value: the pattern whose matches `cut` finds in arrays.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces a task remembers before it starts afresh.
MAX_PIECES = 1_000_000
#: A fold over an array takes the square of its length, so pieces of more bytes are merged with a heap instead.
FOLD_BYTES = 512
#: Texts are handled in blocks of about so many characters; the first row of a block brings the new pieces of all. Arrays over a block, and that
#: row on both sides of the JVM, are what a task holds besides its pieces.
BLOCK_CHARS = 1 << 18
#: Rows that Spark hands to Python at a time; texts are long rows, and each of two steps holds such a batch twice.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Input splits that a task takes one after another: the more text a task sees, the fewer of its pieces are new.
SPLITS_PER_TASK = 3
#: Places of partners that are looked at together while the rank map is laid out: some left tokens have ten thousand partners.
TRIED = 1 << 18
_LEFT = 1 << 20
_FOREIGN = re.compile(f"[{chr(_EDGE)}-{chr(0x10FFFF)}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of every two tokens whose bytes joined are a token, by left * 2**20 + right."""
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found[left * _LEFT + right] = rank
    return found


class RankMap:
    """The rank map. Spark searches a map value key by key, so the map is laid out as two arrays: the
    partners of a left token stand at its offset plus the right token, where no other left token has put one (row
    displacement), each entry with its owner. A lookup reads two elements however many pairs there are.

    Inside the fold a token is `BASE` + id and a rank is below `BASE`; `LIMIT` and more mean that there is no such pair."""

    BASE, LIMIT = 1 << 41, 1 << 20

    def __init__(self, ranks: dict[bytes, int]):
        rows: dict[int, list[tuple[int, int]]] = {}
        for key, rank in _pair_ranks(ranks).items():
            rows.setdefault(key // _LEFT, []).append((key % _LEFT, rank))
        self.edge = max(ranks.values()) + 1
        free = np.ones(16 * self.edge, bool)
        offsets = np.zeros(self.edge + 1, np.int64)
        entries = np.full(len(free), (self.BASE + self.edge + 1) * self.LIMIT, np.int64)
        low, last = 0, {}
        for left, row in sorted(rows.items(), key=lambda r: -len(r[1])):
            right, rank = np.array(row, np.int64).T
            first = int(right.min())
            block = max(16, min(4096 if len(row) > 50 else 256, TRIED // len(row)))
            for near in range(max(low, last.get(len(row), 0)), len(free), block):  # places of the first partner, tried by the block
                starts = near + np.flatnonzero(free[near:near + block]) - first
                fits = starts[free[starts[:, None] + right].all(axis=1)] if len(starts) else starts
                if len(fits):
                    break
            at, last[len(row)] = int(fits[0]), int(fits[0]) + first
            free[right + at], offsets[left] = False, at
            entries[right + at] = (self.BASE + left) * self.LIMIT + rank
            while not free[low]:
                low += 1
        shift = max(0, -int(offsets.min()))
        used = int(np.flatnonzero(~free).max()) + 1
        self.entries = np.concatenate([np.full(shift, entries[-1]), entries[:used], np.full(self.edge + 1, entries[-1])])
        self.offsets = offsets + shift - self.BASE

    def value(self, spark: SparkSession) -> Column:
        """Both arrays as one struct, which Spark reads from a row in the shared folder when the query starts. Written out in the plan they
        would stand in every text that the driver keeps of it."""
        arrays = [pa.array([values], pa.list_(pa.int64())) for values in (self.offsets, self.entries)]
        row = stored(spark.createDataFrame(pa.table(arrays, ["offsets", "entries"])).coalesce(1), "rank-map")
        return row.select(F.struct("offsets", "entries").alias("ranks")).scalar()

    def rank(self, table: Column, left: Column, right: Column) -> Column:
        """Rank of the token made of two adjacent ones; at least `LIMIT` if there is none."""
        entry = F.get(table["entries"], F.get(table["offsets"], left - self.BASE) + right)
        return entry.bitwiseXOR(F.shiftleft(left, 20))


_MAPS: list[tuple[dict[bytes, int], RankMap]] = []


def rank_map(ranks: dict[bytes, int]) -> RankMap:
    """The map of a vocabulary; the last one made is kept, for the driver need not lay it out for every query."""
    if not _MAPS or _MAPS[0][0] != ranks:
        _MAPS[:] = [(dict(ranks), RankMap(ranks))]
    return _MAPS[0][1]


def merged(tokens: Column, ranks: RankMap, table: Column) -> Column:
    """Tokens of one piece after all merges: the lowest rank first, the leftmost of equal ones, as BPE defines it.

    `tokens` are the byte tokens between two edge tokens. The state of the fold is one array of tokens with the ranks of
    neighbours between them; since a token's id is its rank, a merge is a splice around the lowest element."""
    start = F.flatten(F.transform(tokens, lambda x, i: F.array(x, ranks.rank(table, x, F.get(tokens, i + 1)))))

    def splice(row: Column, low: Column, at: Column) -> Column:
        token = low + ranks.BASE
        return F.concat(F.slice(row, F.lit(1), at - 3),
                        F.array(ranks.rank(table, F.get(row, at - 4), token), token, ranks.rank(table, token, F.get(row, at + 2))),
                        F.slice(row, at + 3, F.lit(1 << 30)))

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """`use` of a value that is worked out once, however often it is used."""
        return F.get(F.transform(F.array(value), use), 0)

    def step(row: Column, _: Column) -> Column:
        return bound(F.array_min(row), lambda low: F.when(low >= ranks.LIMIT, row).otherwise(
            bound(F.array_position(row, low).cast("int"), lambda at: splice(row, low, at))))

    return F.filter(F.aggregate(F.slice(tokens, F.lit(4), F.lit(1 << 30)), start, step), lambda x: x >= ranks.BASE)


def cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of `PATTERN` start and end in texts of characters below U+0250, each text between two borders."""
    kind = _KINDS[codes]
    new = np.ones(len(codes), bool)
    new[1:] = kind[1:] != kind[:-1]
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(codes))
    spaces = (kind[first] == _SPACE) & (kind[np.minimum(ends, len(codes) - 1)] != _BORDER)  # white space at a text's end is one match
    last, after, several = ends[spaces] - 1, ends[spaces], ends[spaces] - first[spaces] > 1
    led = codes[last] == ord(" ")  # a space goes with what follows it
    new[after[led]] = False
    new[last[several | led]] = True
    quote = np.flatnonzero((codes[1:-2] == ord("'")) & (kind[:-3] != _MARK) & (codes[:-3] != ord(" "))) + 1  # one that begins a match
    a, b = codes[quote + 1], codes[quote + 2]
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    taken = quote[one | two]
    new[taken + 1] = False
    new[taken + np.where(one, 2, 3)[one | two]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(codes))
    words = kind[starts] != _BORDER
    return starts[words], ends[words]


class _Pieces:
    """Numbers the distinct pieces of a task. Texts of characters below U+0250 are cut many at a time, their pieces known by a 64-bit hash;
    others, and all texts under another pattern, are split by the pattern itself."""

    def __init__(self, pattern: str):
        self.pattern, self.arrays, self.hasher = regex.compile(pattern), pattern == PATTERN, Hasher()
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.others: dict[str, int] = {}
        self.count, self.fresh = 0, []

    def _split(self, text: str) -> list[int]:
        found = []
        for m in self.pattern.finditer(text):
            at = self.others.get(m.group())
            if at is None:
                at = self.others[m.group()] = self.count
                self.count += 1
                self.fresh.append(m.group())
            found.append(at)
        return found

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        edge = chr(_EDGE)  # stands in none of the texts
        whole = edge + "".join(t + edge for t in texts) + edge * 2
        codes = np.frombuffer(whole.encode("utf-16-le"), np.uint16)
        starts, ends = cut(codes)
        wanted, first, back = np.unique(self.hasher.of(codes, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, wanted)
        found = np.minimum(at, max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[found] != wanted) if len(self.hashes) else np.arange(len(wanted))
        self.numbers = np.insert(self.numbers, at[new], np.arange(self.count, self.count + len(new), dtype=np.int32))
        self.hashes = np.insert(self.hashes, at[new], wanted[new])
        self.count += len(new)
        self.fresh += [whole[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        number = self.numbers[np.searchsorted(self.hashes, wanted)][back]
        borders = np.searchsorted(starts, np.cumsum([1 + len(t) for t in texts]))
        return np.split(number, borders)[:len(texts)]

    def of(self, texts: list[str]) -> list:
        """Numbers of the pieces of each text."""
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.arrays and not _FOREIGN.search(t)]
        if plain:
            for i, numbers in zip(plain, self._cut([texts[i] for i in plain]), strict=True):
                out[i] = numbers
        return [self._split(t) if n is None else n for t, n in zip(texts, out, strict=True)]


def _merge_long(tokens: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges for one long piece, with a heap of neighbour ranks and links to the next token."""
    ids: list[int | None] = list(tokens)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = []

    def offer(at: int) -> None:
        nxt = after[at] if at >= 0 else len(ids)
        if nxt < len(ids) and (rank := pairs.get(ids[at] * _LEFT + ids[nxt])) is not None:
            heapq.heappush(heap, (rank, at, ids[at], nxt, ids[nxt]))

    for at in range(len(ids)):
        offer(at)
    while heap:
        rank, at, left, nxt, right = heapq.heappop(heap)
        if ids[at] != left or after[at] != nxt or ids[nxt] != right:
            continue
        ids[at], ids[nxt], after[at] = rank, None, after[nxt]
        if after[at] < len(ids):
            before[after[at]] = at
        offer(at)
        offer(before[at])
    return [x for x in ids if x is not None]


def scan_tasks(docs: DataFrame) -> int:
    """Tasks for a plain table scan, `SPLITS_PER_TASK` splits each. (Of a frame with shuffles this would run them.)"""
    return max(1, -(-docs.rdd.getNumPartitions() // SPLITS_PER_TASK))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", tasks: int | None = None,
           drop_text: bool = False) -> DataFrame:
    """`docs` with the array<int> column `ids`: the tokens of the whole text, each match of `pattern` encoded separately, in
    at most `tasks` tasks (`scan_tasks`) if that is given. With `drop_text` the text goes as soon as it is cut.

    `ranks` is a vocabulary of bounded size whose ids are its ranks and which holds every single byte. Long pieces take
    a heap (`FOLD_BYTES`) with the same result. The order of rows inside a task carries state between the steps, so
    nothing may reorder rows in between; no operator stands there but a projection."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":  # Spark's own; a session that says otherwise is left alone
        conf.set(BATCH_ROWS, "1000")
    table = rank_map(ranks)
    kept = docs.drop(ids, *([text] if drop_text else []))
    carried = [f"c{i}" for i in range(len(kept.columns))]  # the caller's columns, out of the way of the steps' own
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(a) for c, a in zip(kept.columns, carried, strict=True)))
    if tasks:
        source = source.coalesce(tasks)
    rows = pa.list_(pa.list_(pa.int64()))
    base, last = table.BASE, table.edge  # all that the Python steps need of the rank map

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, single, pairs = _Pieces(pattern), [ranks[bytes([b])] for b in range(256)], None
        tokens, edge = [base + x for x in single], base + last
        for batch in batches:
            for start, end in _blocks(pc.utf8_length(batch.column("text")).to_numpy(), BLOCK_CHARS):
                part, restart = batch.slice(start, end - start), pieces.count > MAX_PIECES
                if restart:
                    pieces.clear()
                at = pieces.of(part.column("text").to_pylist())
                fold, ready = [], []
                for raw in map(str.encode, pieces.fresh):
                    if raw in ranks:
                        fold.append(()), ready.append((ranks[raw],))
                    elif len(raw) > FOLD_BYTES:
                        pairs = pairs or _pair_ranks(ranks)
                        fold.append(()), ready.append(_merge_long([single[b] for b in raw], pairs))
                    else:
                        fold.append([edge, *[tokens[b] for b in raw], edge]), ready.append(())
                pieces.fresh = []
                others = [None] * (end - start - 1)
                numbers = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), pa.int32()), pa.array(np.concatenate([np.asarray(x, np.int32) for x in at])))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), numbers, pa.array([fold, *others], rows), pa.array([ready, *others], rows),
                                                  pa.array([restart, *[False for _ in others]])], names=[*carried, "at", "new", "done", "restart"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(base)
        for batch in batches:
            restarts = np.flatnonzero(batch.column("restart").to_numpy(zero_copy_only=False))
            for start, end in zip([0, *restarts], [*restarts, batch.num_rows], strict=True):
                if start in restarts:
                    known = _Known(base)
                part = batch.slice(start, end - start)
                known.add(part.column("merged").flatten(), part.column("done").flatten())
                at = part.column("at")
                values, ends = known.ids(at.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))],
                                                 names=[*carried, "ids"])

    kinds = "".join(f"{a} {f.dataType.simpleString()}, " for a, f in zip(carried, kept.schema.fields, strict=True))
    cut_rows = source.mapInArrow(split, f"{kinds}at array<int>, new array<array<bigint>>, done array<array<bigint>>, restart boolean")
    folds = F.when(F.col("new").isNotNull(), F.get(F.transform(F.array("ranks"), lambda t: F.transform("new", lambda piece: merged(piece, table, t))), 0))
    folded = cut_rows.withColumn("ranks", table.value(docs.sparkSession)).select(*carried, "at", folds.alias("merged"), "done", "restart").mapInArrow(join, f"{kinds}ids array<int>")
    return folded.select(*(F.col(a).alias(c) for c, a in zip(kept.columns, carried, strict=True)), F.col("ids").alias(ids))


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes add up to about `most`; at least one row each."""
    if len(sizes):
        number = (np.cumsum(sizes) - sizes) // most
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        yield from zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True)


class _Known:
    """Ids of the pieces of a task by number, in one growing array."""

    def __init__(self, base: int) -> None:
        self.base, self.flat, self.used = base, np.zeros(1 << 16, np.int32), 0
        self.ends, self.count = np.zeros(1 << 14, np.int64), 0

    def add(self, folded: pa.ListArray, done: pa.ListArray) -> None:
        """Each piece is in one of both lists; a folded one has an edge token on either side, which is left out."""
        folds, sizes = (np.diff(x.offsets.to_numpy()) for x in (folded, done))
        lengths = np.maximum(folds - 2, 0) + sizes
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        tokens = folded.flatten().to_numpy() - self.base
        inner = np.ones(len(tokens), bool)
        last = np.cumsum(folds)[folds > 0]
        inner[last - 1] = inner[last - folds[folds > 0]] = False
        block, from_fold = self.flat[self.used:self.used + total], np.repeat(folds > 0, lengths)
        block[from_fold], block[~from_fold] = tokens[inner], done.flatten().to_numpy()
        self.ends[self.count + 1:self.count + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used, self.count = self.used + total, self.count + len(lengths)

    def ids(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered pieces one after another, and where each row's end (`rows`: ends in `at`)."""
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends[rows]


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the binary column `out`: the bytes of all tokens of `ids`, joined by Spark as their hexadecimal digits. Null ids give no
    bytes; an id that the vocabulary lacks raises."""
    shown = {rank: token.hex() for token, rank in ranks.items()}
    table = F.split(F.lit(",".join(shown.get(i, "?") for i in range(max(shown) + 1))), ",")
    joined = F.array_join(F.transform(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: F.element_at(table, i + 1)), "")
    whole = F.unhex(joined)
    return df.withColumn(out, F.when(whole.isNull(), F.raise_error(F.lit("an id that the vocabulary lacks")).cast("binary")).otherwise(whole))
