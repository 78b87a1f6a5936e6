"""Indel similarity (2·LCS / total length) for pairs that joins have already pruned. Small numpy helpers behind two
vectorised UDFs; Spark has edit distance with substitutions only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2.0 * lcs_length(a, b) / (len(a) + len(b))


@pandas_udf(T.DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence."""
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def window_lcs(needle: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, LCS) of the needle against every window of its length over the text, cut windows at both ends included.

    All windows advance together: one 64-bit word of the needle is a column of unsigned integers with a carry between words."""
    m, n = len(needle), len(text)
    points = np.frombuffer(needle.encode("utf-32-le"), dtype=np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    words = (m + 63) // 64
    table = np.zeros((len(alphabet) + 1, words), dtype=np.uint64)
    for i, c in enumerate(codes):
        table[c, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    body = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    at = np.searchsorted(alphabet, body)
    at = np.where((at < len(alphabet)) & (alphabet[np.minimum(at, len(alphabet) - 1)] == body), at, len(alphabet))
    padded = np.concatenate([np.full(m - 1, len(alphabet)), at, np.full(m - 1, len(alphabet))])
    count = n + m - 1
    rows = [np.full(count, np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(words)]
    for j in range(m):
        step = padded[j:j + count]
        carry = np.zeros(count, dtype=np.uint64)
        for w in range(words):
            row = rows[w]
            hit = row & table[step, w]
            total = row + hit
            over = total < row
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            rows[w] = total | (row - hit)
    lcs = np.zeros(count, dtype=np.int64)
    for w in range(words):
        bits = min(64, m - 64 * w)
        low = np.uint64(0xFFFFFFFFFFFFFFFF) if bits == 64 else np.uint64((1 << bits) - 1)
        lcs += bits - np.bitwise_count(rows[w] & low).astype(np.int64)
    first = np.arange(count) - (m - 1)
    starts, ends = np.maximum(first, 0), np.minimum(first + m, n)
    # A window cut at the start must end, one cut at the end must begin, and a whole one end on a character of the needle.
    known = at < len(alphabet)
    ok = np.where(first + m > n, known[starts], known[ends - 1])
    return starts, ends, np.where(ok, lcs, -1)


def _run(needle: str, text: str, at: int, backwards: bool) -> int:
    i, m = 0, len(needle)
    if backwards:
        while i < m and i < at and needle[m - 1 - i] == text[at - 1 - i]:
            i += 1
    else:
        while i < m and at + i < len(text) and needle[i] == text[at + i]:
            i += 1
    return i


def best_window(needle: str, text: str, cutoff: float) -> tuple[int, int, float] | None:
    """The window most like the needle, its edges moved to the longest exact runs within half a needle either side."""
    if not text:
        return None
    if len(needle) > len(text):
        starts, ends, lcs = window_lcs(text, needle)
        score = float(np.max(np.where(lcs >= 0, 2.0 * lcs / (len(text) + ends - starts), 0.0)))
        lo, hi = 0, len(text)
    else:
        starts, ends, lcs = window_lcs(needle, text)
        ratio = np.where(lcs >= 0, 2.0 * lcs / (len(needle) + ends - starts), 0.0)
        best = int(np.argmax(ratio))
        score, lo, hi = float(ratio[best]), int(starts[best]), int(ends[best])
    if score < cutoff:
        return None
    pad = max(1, len(needle) // 2)
    first = max(range(max(0, lo - pad), min(len(text), lo + pad) + 1), key=lambda c: (_run(needle, text, c, False), -c))
    last = max(range(max(0, hi - pad), min(len(text), hi + pad) + 1), key=lambda c: (_run(needle, text, c, True), -c))
    return (first, last, score) if last > first else (lo, hi, score)


PLACE = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("score", T.DoubleType())])


@pandas_udf(PLACE)
def fuzzy_window(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = [best_window(n, t, 0.6) for n, t in zip(needle, text, strict=True)]
    return pd.DataFrame({"s": pd.array([f[0] if f else None for f in found], dtype="Int32"),
                         "e": pd.array([f[1] if f else None for f in found], dtype="Int32"),
                         "score": pd.array([f[2] if f else None for f in found], dtype="Float64")})
