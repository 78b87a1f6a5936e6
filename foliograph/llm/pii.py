"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field labels every word that holds a digit or an at sign (all other words are outside by
definition) as outside, email, ip, card or phone: each word has a potential from its shape and its neighbours' shapes,
neighbouring words share a potential, and so do distant words of one document that are alike (the same text, the same last
seven digits, the same address). Loopy belief propagation makes like words agree; a word whose probability of one kind is
high becomes a span where no base span is. Base spans always stay.

Potentials are learned piecewise on a bounded sample of documents, with the words inside base spans as labels. Null texts
count as empty and have no spans. Rows are handled one by one; other columns stay but for those named like an output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents to learn from: those with the lowest hashes of their ids.
SAMPLE = 20_000
FEATURES, EPOCHS, RATE = 1 << 14, 5, 0.3
ROUNDS = 12
#: Least probability of one kind for an added span.
SURE = 0.9

_AT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign in turn: what stands left of it reaches back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (right := _AT.match(text, at + 1)):
            yield start, right.end()
            done = right.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                found.append((3, *m.span()))
    return found


def _shape(word: str) -> str:
    plain = re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", word[:80])))
    return re.sub(r"([Aa])\1+", r"\1", plain)


class Graph:
    """The words of a document that may be personal data: spans, features, labels by the base spans, and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        signs = np.array([bool(_SIGN.search(text, a, b)) for a, b in words], bool)
        self.places = np.flatnonzero(signs)
        self.spans = [words[i] for i in self.places]
        self.features = [self._features(text, words, i) for i in self.places]
        self.labels = np.zeros(len(self.spans), np.int64)
        starts, ends = (np.array([s[i] for s in self.spans], np.int64) for i in (0, 1))
        for kind, a, b in base:
            self.labels[np.searchsorted(ends, a, "right"):np.searchsorted(starts, b, "left")] = kind + 1
        self.chain = np.flatnonzero(np.diff(self.places) == 1)
        self.skips = self._alike(text)

    @staticmethod
    def _features(text: str, words: list[tuple[int, int]], i: int) -> list[int]:
        word = text[slice(*words[i])]
        digits = sum(c.isdigit() for c in word)
        before = _shape(text[slice(*words[i - 1])]) if i else "^"
        after = _shape(text[slice(*words[i + 1])]) if i + 1 < len(words) else "$"
        shape = _shape(word)
        bare = shape.strip(".,;:!?()\"'")
        number = re.sub("[^0-9]", "", word)
        sound = "luhn" + str(_luhn(number)) if 13 <= len(number) <= 19 else "ip" + str(bool(_IP.fullmatch(word.strip(".,;")) and base_spans(word))) if word.count(".") > 2 else "-"
        names = ["v" + sound, "s" + shape, "b" + bare, f"d{min(digits, 20)}", f"l{min(len(word), 30)}", "p" + shape[:3], "e" + bare[-3:], "@" + str("@" in word), "." + str(min(word.count("."), 4)),
                 f"only{len(bare.strip('9')) == 0}", "<" + (before if _SIGN.search(before) else "w"), ">" + (after if _SIGN.search(after) else "w"), "+" + word[0] if word[0] in "+(" else "n"]
        return [zlib.crc32(n.encode()) % FEATURES for n in names]

    def _alike(self, text: str) -> np.ndarray:
        """Each word and the next one like it: linear in the words, whatever their repeats."""
        last: dict[str, int] = {}
        pairs = set()
        for n, (a, b) in enumerate(self.spans):
            word = text[a:b].strip(".,;:!?()\"'").lower()
            digits = re.sub("[^0-9]", "", word)
            keys = ["t" + word] + (["d" + digits[-7:]] if len(digits) >= 7 else []) + (["@" + word.partition("@")[0]] if "@" in word else [])
            for key in keys:
                if key in last:
                    pairs.add((last[key], n))
                last[key] = n
        return np.array(sorted(pairs), np.int64).reshape(-1, 2)


class Field:
    """Weights of features and labels, and log potentials of neighbours and of like words."""

    def __init__(self, weights: np.ndarray, near: np.ndarray, like: np.ndarray):
        self.weights, self.near, self.like = weights, near, like

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Marginals of the words by loopy belief propagation over neighbours and like words."""
        own = np.array([self.weights[f].sum(axis=0) for f in graph.features]).reshape(-1, len(KINDS) + 1)
        edges = np.concatenate([np.stack([graph.chain, graph.chain + 1], axis=1), graph.skips])
        if not len(edges):
            return _normal(own)
        pair = np.concatenate([np.repeat(self.near[None], len(graph.chain), axis=0), np.repeat(self.like[None], len(graph.skips), axis=0)])
        source, target = np.concatenate([edges, edges[:, ::-1]]).T
        potential = np.concatenate([pair, pair.transpose(0, 2, 1)])
        half = len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        messages = np.zeros((2 * half, own.shape[1]))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, target, messages)
            sent = total[source] - messages[back]
            sent = np.logaddexp.reduce(sent[:, :, None] + potential, axis=1)
            sent -= np.logaddexp.reduce(sent, axis=1, keepdims=True)
            if np.abs(sent - messages).max() < 1e-4:
                messages = sent
                break
            messages = (messages + sent) / 2
        total = own.copy()
        np.add.at(total, target, messages)
        return _normal(total)

    def added(self, text: str, graph: Graph, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of sure words outside the base spans; neighbours of one kind are one span."""
        found = []
        if not graph.spans:
            return found
        chance = self.beliefs(graph)
        best = chance[:, 1:].argmax(axis=1)
        sure = (chance[np.arange(len(best)), best + 1] >= SURE) & (graph.labels == 0)
        for n in np.flatnonzero(sure):
            a, b = graph.spans[n]
            word = text[a:b]
            start = a + len(word) - len(word.lstrip(".,;:!?\"'"))
            end = b - (len(word) - len(word.rstrip(".,;:!?\"'")))
            if end <= start:
                continue
            kind = int(best[n])
            if found and found[-1][0] == kind and n and sure[n - 1] and graph.places[n] == graph.places[n - 1] + 1:
                start = found.pop()[1]
            found.append((kind, start, end))
        return found


def _normal(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True))


def learn(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of weights from rows of (labels, features, near, like); unknown words lean to the outside."""
    n = len(KINDS) + 1
    weights, near, like, share = np.zeros((FEATURES, n)), np.ones((n, n)), np.ones((2, 2)), np.ones(n)
    rows = rows.sort_values("order", ignore_index=True)
    labels = [np.asarray(x, np.int64) for x in rows["labels"]]
    features = [np.stack(x).astype(np.int64) for x in rows["features"]]
    for y, edges, pairs in zip(labels, rows["near"], rows["like"], strict=True):
        edges, pairs = np.asarray(edges, np.int64), np.asarray(pairs, np.int64).reshape(-1, 2)
        np.add.at(share, y, 1)
        np.add.at(near, (y[edges], y[edges + 1]), 1)
        same = y[pairs[:, 0]] == y[pairs[:, 1]]
        like[0, 0] += same.sum()
        like[0, 1] += (~same).sum()
    if labels:
        y, x = np.concatenate(labels), np.concatenate(features)
        order = np.random.default_rng(5)
        for epoch in range(EPOCHS):
            for start in np.array_split(order.permutation(len(y)), max(1, len(y) // 16)):
                error = _normal(weights[x[start]].sum(axis=1))
                error[np.arange(len(start)), y[start]] -= 1
                np.add.at(weights, x[start], -RATE / (1 + epoch) * error[:, None, :])
    joint = near / near.sum()
    pmi = np.log(joint) - np.log(joint.sum(axis=1, keepdims=True)) - np.log(joint.sum(axis=0, keepdims=True))
    agree = np.clip(np.log(like[0, 0] / like[0, 1]), 0.5, 3)
    return pd.DataFrame({"weights": [weights.ravel()], "near": [np.clip(pmi, -2, 2).ravel()], "like": [(agree * np.eye(n)).ravel()]})


def fit(docs: DataFrame, size: int = SAMPLE, id: str = "doc_id", text: str = "text") -> Field:
    """The field, learned in one task from at most `size` documents (of rows that share an id the smallest text)."""
    chosen = docs.select(id).where(F.col(id).isNotNull()).distinct().orderBy(F.xxhash64(id), id).limit(size)
    sample = docs.select(id, F.col(text).alias("_text")).where(F.col("_text").rlike("[0-9@]")).join(chosen, id).groupBy(id).agg(F.min("_text").alias("_text"))

    def graphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(o, Graph(t, base_spans(t))) for o, t in zip(batch["order"], batch["_text"], strict=True)]
            yield pd.DataFrame([(o, g.labels, g.features, g.chain, g.skips.ravel()) for o, g in made], columns=["order", "labels", "features", "near", "like"])

    rows = sample.select(F.xxhash64(id, "_text").alias("order"), "_text").mapInPandas(graphs, "order bigint, labels array<bigint>, features array<array<int>>, near array<bigint>, like array<bigint>")
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "weights array<double>, near array<double>, like array<double>").head()
    n = len(KINDS) + 1
    if not found:
        return Field(np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((n, n)))
    return Field(np.array(found[0]).reshape(FEATURES, n), np.array(found[1]).reshape(n, n), np.array(found[2]).reshape(n, n))


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """`docs` with `base` and `spans`: arrays of (kind, start, end), offsets in code points."""
    docs = docs.drop("base", "spans")
    columns = docs.columns
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shown = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for value in batch.column(text):
                plain = value.as_py() or ""
                found = base_spans(plain) if _SIGN.search(plain) else []
                base.append(shown(found))
                every.append(shown(found + field.added(plain, Graph(plain, found), found)) if _SIGN.search(plain) else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(base, spans), pa.array(every, spans)], names=[*columns, "base", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.mapInArrow(search, f"{kinds}, base {kind}, spans {kind}")
