"""Weak supervision for document quality.

Rules look at counts of the text and vote good (1), bad (0) or abstain (-1). Expectation-maximisation estimates, without
labels, how each rule votes on good and on bad documents and how common both are; a document is kept when its posterior
probability of being good is at least one half and it does not fail the base rules.

Null texts count as empty: no words, which fails the base. Repeated rows are judged one by one, an empty table gives an empty
table. Columns of the input stay; one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("_upper", "_bangs", "_top", "_lines", "_ended")
_UPPER = bytes(range(65, 91))
MIN_WORDS = 50

#: Each rule: (good where, bad where) as functions of the count columns; between both it abstains.
RULES = {
    "length": (lambda c: c["n_words"] >= 60, lambda c: c["n_words"] < 20),
    "symbols": (lambda c: c["n_symbols"] * 50 <= c["n_words"], lambda c: c["n_symbols"] * 10 > c["n_words"]),
    "repeats": (lambda c: c["n_repeat_words"] * 10 <= c["n_words"], lambda c: c["n_repeat_words"] * 10 > c["n_words"] * 3),
    "lines": (lambda c: c["n_dup_lines"] * 10 <= c["_lines"], lambda c: c["n_dup_lines"] * 10 > c["_lines"] * 3),
    "word_length": (lambda c: (c["word_chars"] >= c["n_words"] * 3) & (c["word_chars"] <= c["n_words"] * 10),
                    lambda c: (c["word_chars"] < c["n_words"] * 2) | (c["word_chars"] > c["n_words"] * 14)),
    "capitals": (lambda c: c["_upper"] * 6 <= c["word_chars"], lambda c: c["_upper"] * 5 > c["word_chars"] * 2),
    "bangs": (lambda c: c["_bangs"] * 50 <= c["n_words"], lambda c: c["_bangs"] * 5 > c["n_words"]),
    "one_word": (lambda c: c["_top"] * 7 <= c["n_words"], lambda c: c["_top"] * 4 > c["n_words"]),
    "line_ends": (lambda c: c["_ended"] * 2 >= c["_lines"], lambda c: c["_ended"] * 10 < c["_lines"]),
}


def _repeated(at: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(at) < 4:
        return 0
    pairs = np.unique(at[:-1] * (at.max() + 1) + at[1:], return_inverse=True)[1]
    keys, where, counts = np.unique(pairs[:-1] * (at.max() + 1) + at[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(len(at), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def _counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    joined = b"".join(words)
    return (len(words), len(joined.decode()), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), _repeated(at),
            len(joined) - len(joined.translate(None, _UPPER)), text.count("!"), int(np.bincount(at).max()) if words else 0,
            len(lines), sum(x.rstrip(" \t\x0b\x0c\r\"')»”").endswith((".", "!", "?", ":", "…")) for x in lines))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the counts that the rules look at, of whole texts."""
    names = (*COUNTS, *_MORE)
    docs = docs.drop(*names)
    columns = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_counts(x.as_py() or "") for x in batch.column(text)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x) for x in found.T)], names=[*columns, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(count, ", ".join([*kinds, *(f"`{n}` bigint" for n in names)]))


def votes(rules: dict = RULES) -> dict[str, Column]:
    c = {n: F.col(n) for n in (*COUNTS, *_MORE)}
    return {name: F.when(bad(c), 0).when(good(c), 1).otherwise(-1) for name, (good, bad) in rules.items()}


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * 50)


class LabelModel:
    """Log odds of good against bad: a prior and, for each rule, a weight of a bad, a good and no vote."""

    def __init__(self, prior: float, weights: np.ndarray):
        self.prior, self.weights = prior, weights

    def probability(self, named: dict[str, Column]) -> Column:
        terms = [F.when(v == 0, float(w[0])).when(v == 1, float(w[1])).otherwise(float(w[2])) for v, w in zip(named.values(), self.weights, strict=True)]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(float(self.prior)))))


def em(patterns: np.ndarray, sizes: np.ndarray, rounds: int = 100) -> LabelModel:
    """Two classes, votes independent within a class. `patterns` are distinct vote rows, `sizes` how many documents have each.

    It starts from rules whose bad votes mean more than their good ones, smooths by one document per cell, and keeps every
    rule's orientation: a good vote never speaks for bad, nor a bad one for good."""
    if not len(sizes):
        return LabelModel(0.0, np.zeros((patterns.shape[1], 3)))
    seen = np.stack([patterns == v for v in (0, 1, -1)], axis=2).astype(float)  # pattern, rule, vote
    good, share = np.array([[0.02, 0.78, 0.2]] * patterns.shape[1]), 0.8
    bad = np.array([[0.3, 0.5, 0.2]] * patterns.shape[1])
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + np.einsum("prv,rv->p", seen, np.log(good) - np.log(bad))
        belief = sizes / (1 + np.exp(-np.clip(odds, -500, 500)))
        good = np.einsum("p,prv->rv", belief, seen) + 1
        bad = np.einsum("p,prv->rv", sizes - belief, seen) + 1
        good, bad = good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True)
        share = (belief.sum() + 1) / (sizes.sum() + 2)
        weights = np.log(good) - np.log(bad)
        weights[:, 0], weights[:, 1] = np.minimum(weights[:, 0], 0), np.maximum(weights[:, 1], 0)
        bad = good / np.exp(weights)
        bad /= bad.sum(axis=1, keepdims=True)
    return LabelModel(float(np.log(share / (1 - share))), np.log(good) - np.log(bad))


def fit(counted: DataFrame, rules: dict = RULES) -> LabelModel:
    """The label model of all rows. Spark counts vote patterns first; at most 3 ** len(rules) of them reach the driver."""
    named = votes(rules)
    found = counted.select(*(v.alias(n) for n, v in named.items())).groupBy(*named).agg(F.count("*").alias("_n")).orderBy(*named).collect()
    return em(np.array([r[:-1] for r in found]).reshape(-1, len(named)), np.array([r[-1] for r in found], float))


def judge(counted: DataFrame, model: LabelModel, rules: dict = RULES) -> DataFrame:
    """Counted documents with `base_failed`, `quality` (posterior probability) and `kept`."""
    judged = counted.withColumn("base_failed", base_failed()).withColumn("quality", model.probability(votes(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*_MORE)
