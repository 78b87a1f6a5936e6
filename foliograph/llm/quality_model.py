"""A quality classifier of supervised subword embeddings.

Every word stands for itself and its character n-grams, hashed into buckets. A document is the average of the vectors of
all these features over its whole text; a softmax layer gives the probability of each label. Vectors and output are learned
together by stochastic gradient descent in numpy, on a bounded sample of labelled documents, in one task. Since the output
is linear in the average, scoring needs one number per bucket: the difference of both outputs.

Null or empty texts are scored by the output's bias alone. Without labels of both kinds every score is the share of label
1, or one half. Labels of one document that differ count as the lowest; of rows that share an id the smallest text is
learned from. Rows without an id are scored, not learned from, and not held out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIMENSIONS = 1 << 16, 8
GRAMS = (3, 4)
#: At most so many labelled documents are learned from, those whose ids have the lowest hashes.
SAMPLE = 6000
EPOCHS, RATE = 6, 2.0
HELD_OUT_OF = 5
MAX_WORDS = 300_000
_MARKS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _features(word: str) -> np.ndarray:
    """Buckets of a word: the word with its case shape, and its character n-grams between marks of start and end."""
    shape = "A" if word.isupper() and len(word) > 1 else "a"
    plain = f"<{word.lower()}>"
    grams = [shape + word.lower(), "#" + shape] + [plain[i:i + n] for n in GRAMS for i in range(len(plain) - n + 1)]
    return np.array([zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams], np.int64)


def _words(text: str) -> list[str]:
    """Runs of letters, digits or marks; a word that repeats the one before is the repeat sign instead."""
    found = []
    for chunk in text.split():
        found += [chunk] if chunk.isalpha() else _MARKS.findall(chunk)
    return [w if w != before else "\x00again" for w, before in zip(found, [None, *found], strict=False)]


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, size: int, id: str, text: str, label: str) -> DataFrame:
    """(text, label) of the sample: ids are chosen from the narrow table of labels before any text is moved."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.min(label).alias("_label")).where(~held_out(F.col(id)))
    chosen = known.join(docs.select(id), id, "left_semi").orderBy(F.xxhash64(id), id).limit(size)
    return docs.select(id, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(chosen, id).groupBy(id).agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))


def _vectors(sample: DataFrame) -> DataFrame:
    """(order, label, buckets, counts): the sample as sparse features."""
    def hash_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = []
            for order, label, text in zip(batch["order"], batch["_label"], batch["_text"], strict=True):
                parts = []
                for w in _words(text):
                    if (f := known.get(w)) is None:
                        if len(known) > MAX_WORDS:
                            known.clear()
                        f = known[w] = _features(w)
                    parts.append(f)
                buckets, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                rows.append((order, int(label), buckets.astype(np.int32), counts.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["order", "label", "buckets", "counts"])

    return sample.select(F.xxhash64(F.struct(*sample.columns)).alias("order"), "_label", "_text").mapInPandas(hash_all, "order bigint, label int, buckets array<int>, counts array<int>")


def train(labels: np.ndarray, buckets: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Weights of the buckets, then the bias: log odds of label 1 for a document of that feature alone."""
    weights = np.zeros(BUCKETS + 1)
    share = labels.mean() if len(labels) else 0.5
    if not 0 < share < 1:
        weights[-1] = np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1))
        return weights
    state = np.random.default_rng(7)
    vectors = state.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    output, bias = state.normal(0, 0.1, (DIMENSIONS, 2)), np.log([1 - share, share])
    steps, total = 0, EPOCHS * len(labels)
    for _ in range(EPOCHS):
        for i in state.permutation(len(labels)):
            rate = RATE * (1 - steps / total)
            steps += 1
            if not len(buckets[i]):
                continue
            part = counts[i] / counts[i].sum()
            mean = part @ vectors[buckets[i]]
            scores = mean @ output + bias
            chance = np.exp(scores - scores.max())
            error = chance / chance.sum()
            error[labels[i]] -= 1
            back = output @ error
            output -= rate * 0.5 * np.outer(mean, error)
            bias -= rate * 0.02 * error
            vectors[buckets[i]] -= rate * np.minimum(part * 40, 4)[:, None] * back
    weights[:-1], weights[-1] = vectors @ (output[:, 1] - output[:, 0]), bias[1] - bias[0]
    return weights


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """The weights, learned in one task from at most `size` documents; one row of fixed size comes back."""
    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", ignore_index=True)
        return pd.DataFrame({"weights": [train(rows["label"].to_numpy(), list(rows["buckets"]), list(rows["counts"]))]})

    found = _vectors(_sample(docs, labels, size, id, text, label)).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "weights array<double>").head()
    return np.array(found[0]) if found else np.zeros(BUCKETS + 1)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 of every whole text."""
    docs = docs.drop(out)
    columns = docs.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, int]] = {}
        for batch in batches:
            scores = []
            for value in batch.column(text):
                total, number = 0.0, 0
                for w in _words(value.as_py() or ""):
                    if (pair := known.get(w)) is None:
                        if len(known) > MAX_WORDS:
                            known.clear()
                        f = _features(w)
                        pair = known[w] = (float(weights[f].sum()), len(f))
                    total += pair[0]
                    number += pair[1]
                scores.append(total / max(number, 1) + weights[-1])
            chance = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(chance)], names=[*columns, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rate, f"{kinds}, `{out}` double")
