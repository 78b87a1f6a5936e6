"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over buffers that never change: its own text, and one buffer of
sentinels. Cutting splits the descriptor that holds the place; an arrangement permutes descriptors and its inverse puts them
back; nothing is copied until a text is rendered, and hashes are fed from the buffers descriptor by descriptor. All
descriptor work is Spark column expressions, row by row without a shuffle; only the streamed hash runs in Python. A lost
executor costs its own tasks.

Places and lengths count code points. Null texts count as empty; empty texts, texts that hold a sentinel and the share of
`plain_percent` stay plain: one descriptor (none if empty). A null id draws as the empty string would. Repeated rows give
equal rows; very long texts are read from their buffers in place; an empty table gives an empty table. Input columns stay,
but for those named like an output, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before the prefix, the suffix and the middle; their buffer is the three in a row.
PREFIX, SUFFIX, MIDDLE = SENTINELS = "<P>", "<S>", "<M>"
#: Buffers of descriptors.
TEXT, MARKS = 0, 1
PIECE = "struct<buffer:int,start:bigint,length:bigint>"
#: Places of prefix, suffix and middle (0, 1, 2 in a document's own order: prefix, middle, suffix) in each arranged form.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


def piece(buffer: int, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("bigint").alias("start"), length.cast("bigint").alias("length"))


def whole(n: Column) -> Column:
    """The descriptors of an uncut text of `n` code points."""
    return F.when(n > 0, F.array(piece(TEXT, F.lit(0), n))).otherwise(F.array().cast(f"array<{PIECE}>"))


def parts(n: Column, *places: Column) -> Column:
    """The descriptors of a text cut at ascending `places`: one more than places, some of them empty."""
    edges = [F.lit(0).cast("bigint"), *places, n]
    return F.array(*(piece(TEXT, a, b - a) for a, b in zip(edges, edges[1:], strict=False)))


def cut(pieces: Column, at: Column) -> Column:
    """`pieces` with a border at place `at` of what they spell: the descriptor across it is split in two."""
    lengths = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, p: a + p["length"])

    def split(p: Column, k: Column) -> Column:
        inner = at - lengths(k)
        head = F.struct(p["buffer"].alias("buffer"), p["start"].alias("start"), inner.cast("bigint").alias("length"))
        tail = F.struct(p["buffer"].alias("buffer"), (p["start"] + inner).cast("bigint").alias("start"), (p["length"] - inner).cast("bigint").alias("length"))
        return F.when((inner > 0) & (inner < p["length"]), F.array(head, tail)).otherwise(F.array(p))

    return F.flatten(F.transform(pieces, split))


def arranged(pieces: Column, order: tuple[int, ...]) -> Column:
    """The descriptors in a new order: place k takes the one that stood at `order[k]`."""
    return F.array(*(F.get(pieces, F.lit(k)) for k in order))


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    """The order that undoes `order`."""
    return tuple(sorted(range(len(order)), key=order.__getitem__))


def _draw(id: Column, seed: int) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1 by sha256 of `seed:id`."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fim(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and pieces: the
    descriptors of the document in its form, sentinels included."""
    value = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _draw(F.col(id), seed)
    marked = F.lit(False)
    for mark in SENTINELS:
        marked = marked | F.contains(value, F.lit(mark))
    plain = (value == "") | marked | (h3 % 100 >= 100 - plain_percent)
    out = docs.drop("n", "form", "prefix_chars", "middle_chars", "pieces").withColumn("n", F.char_length(value).cast("bigint"))
    places = F.array_sort(F.array(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
    out = out.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    out = out.withColumn("prefix_chars", F.when(F.col("form") != "plain", F.get(places, F.lit(0))))
    out = out.withColumn("middle_chars", F.when(F.col("form") != "plain", F.get(places, F.lit(1)) - F.get(places, F.lit(0))))
    own = parts(F.col("n"), F.col("prefix_chars"), F.col("prefix_chars") + F.col("middle_chars"))
    made = whole(F.col("n"))
    for form, order in FORMS.items():
        marks = [piece(MARKS, F.lit(3 * k), F.lit(3)) for k in (0, 2, 1)]  # in the document's order: prefix, middle, suffix
        spelled = F.flatten(F.array(*(F.array(marks[k], F.get(own, F.lit(k))) for k in order)))
        made = F.when(F.col("form") == form, spelled).otherwise(made)
    return out.withColumn("pieces", F.filter(made, lambda p: p["length"] > 0))


def rendered(pieces: Column, text: Column) -> Column:
    """The text that descriptors over `text` and the sentinels spell."""
    marks = F.lit("".join(SENTINELS))
    spell = lambda p: F.substring(F.when(p["buffer"] == TEXT, F.coalesce(text, F.lit(""))).otherwise(marks), (p["start"] + 1).cast("int"), p["length"].cast("int"))
    return F.array_join(F.transform(pieces, spell), "")


def restored(output: Column, form: Column) -> Column:
    """Descriptors over an arranged text that spell the document it was made from: cut at the sentinels, which go, and put back
    by the inverse permutation. No text between sentinels holds one, and no two can overlap, so each is found by its first place."""
    n = F.char_length(output).cast("bigint")
    made = whole(n)
    for name, order in FORMS.items():
        starts = [F.instr(output, mark).cast("bigint") - 1 for mark in [(PREFIX, MIDDLE, SUFFIX)[k] for k in order]]
        found = F.array(*(piece(TEXT, start + 3, end - start - 3) for start, end in zip(starts, [*starts[1:], n], strict=True)))
        made = F.when(form == name, arranged(found, inverse(order))).otherwise(made)
    return F.filter(made, lambda p: p["length"] > 0)


def _places(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets of code point places in UTF-8 bytes."""
    if not len(at) or int(at[-1]) <= 0:
        return np.zeros(len(at), np.int64)
    starts = (raw & 0xC0) != 0x80
    if starts.all():
        return at
    return np.append(np.flatnonzero(starts), len(raw))[at]


def hashed(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with sha256 columns: `wanted` names for each the column of descriptors and the column of the text they stand on.
    The bytes go from the text's buffer into the hash, one descriptor after another; no text is put together."""
    df = df.drop(*wanted)
    columns, marks = df.columns, "".join(SENTINELS).encode()

    def digests(pieces: pa.ListArray, texts: pa.StringArray) -> list[str]:
        out, ends = [], pieces.offsets.to_numpy()
        flat = pieces.values
        buffer, start, length = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("buffer", "start", "length"))
        for row in range(len(pieces)):
            low, high = int(ends[row]), int(ends[row + 1])
            scalar = texts[row].as_buffer()
            view = memoryview(scalar) if scalar is not None else memoryview(b"")
            own = np.flatnonzero(buffer[low:high] == TEXT) + low
            edges = np.stack([start[own], start[own] + length[own]])
            flat_edges, back = np.unique(edges, return_inverse=True)
            begins, finishes = _places(np.frombuffer(view, np.uint8), flat_edges)[back.reshape(edges.shape)] if len(own) else (np.zeros(0, np.int64),) * 2
            state, k = hashlib.sha256(), 0
            for at in range(low, high):
                if buffer[at] == TEXT:
                    state.update(view[begins[k]:finishes[k]])
                    k += 1
                else:
                    state.update(marks[start[at]:start[at] + length[at]])
            out.append(state.hexdigest())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [pa.array(digests(batch.column(pieces), batch.column(text)), pa.string()) for pieces, text in wanted.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *sums], names=[*columns, *wanted])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, ", ".join([kinds, *(f"`{name}` string" for name in wanted)]))
