"""Ids of whole texts by a tokenizers file, for tasks that see many texts.

No token spans white space, so a text is handled by stretches that end at a space. Where the file's normaliser and splitting
rule are the known ones (NFC, white space, lower case; runs of letters, single digits, marks), texts of characters
below U+0250 are cut here, many at a time in arrays: there NFC changes nothing and lower case goes letter by letter. Each
distinct piece is given to the file's model once while a worker remembers it, and is known by its 64-bit hash. Texts with other
characters, texts with an added token and all texts under another file go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

#: Pieces a worker remembers before it starts afresh, about 25 bytes each.
MAX_PIECES = 2_000_000
#: A text is handled by so many characters, up to the next space; so are many short texts at once.
STRETCH = 1 << 19
_EDGE = 0x250

# The normaliser and the splitting rule of the file that pieces are cut by here.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_END = "</w>"
_SPACES = {*range(0x9, 0xE), 0x20, 0x85, 0xA0}

_SPACE, _LETTER, _NUMBER, _MARK, _BORDER = range(5)
_SHARED: dict[str, Encoder] = {}


def _kind(c: int) -> int:
    category = unicodedata.category(chr(c))[0]
    return _SPACE if c in _SPACES else _LETTER if category == "L" else _NUMBER if category == "N" else _MARK


_KINDS = np.array([_kind(c) for c in range(_EDGE)] + [_BORDER], np.uint8)
_FACTOR = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20252).integers(1, 1 << 63, _EDGE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _byte_characters() -> dict[int, str]:
    """The character that stands for a byte in byte-level vocabularies: visible ones for themselves, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + n) for n, b in enumerate(hidden)}


def _foreign() -> re.Pattern:
    """Characters that can't be cut here: U+0250 and above, and those whose lower case is not one character below that."""
    odd = [c for c in range(_EDGE) if len(chr(c).lower()) != 1 or ord(chr(c).lower()) >= _EDGE]
    return re.compile(f"[^\\x00-\\u{_EDGE - 1:04x}]" + "".join(f"|\\u{c:04x}" for c in odd))


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """`text` cut at spaces into parts of about `size` characters."""
    start = 0
    while len(text) - start > size:
        end = text.find(" ", start + size)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of lower-case characters start and end. The last character is a space."""
    kind = _KINDS[codes]
    new = np.ones(len(codes), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    quote = np.flatnonzero((codes[:-2] == ord("'")) & new[:-2])  # one that begins its run of marks may take letters along
    a, b = codes[quote + 1], codes[quote + 2]
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    taken = quote[one | two]
    new[taken + 1] = False
    new[taken + np.where(one, 2, 3)[one | two]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(codes))
    words = kind[starts] != _SPACE
    return starts[words], ends[words]


class Hasher:
    """64-bit hashes of stretches of characters below U+0250 and a little above: sums of the characters' numbers times rising powers,
    shifted to their own start."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(codes):
            factor, back = np.full(len(codes), _FACTOR, np.uint64), np.full(len(codes), pow(_FACTOR, -1, 1 << 64), np.uint64)
            self.powers, self.inverses = (np.concatenate([np.ones(1, np.uint64), np.cumprod(x)]) for x in (factor, back))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[codes] * self.powers[:len(codes)])])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        h = (h ^ (ends - starts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class _Known:
    """Pieces by ascending hash, and the ids of each piece in one array."""

    def __init__(self, kind: type) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.flat, self.used = np.zeros(1 << 16, kind), 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the pieces with these ascending hashes, -1 for unknown ones; they hold until the next `add`."""
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def add(self, hashes: np.ndarray, ids: Sequence[list[int]]) -> None:
        sizes = np.array([len(x) for x in ids], np.uint32)
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 2, self.flat.dtype)])
        self.flat[self.used:self.used + total] = [x for one in ids for x in one]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, (self.used + np.cumsum(sizes) - sizes).astype(np.uint32))
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used += total


class Encoder:
    """Encodes texts by one tokenizers file, given as its content."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        plan = json.loads(tokenizer)
        self.tokenizer = Tokenizer.from_str(tokenizer)
        del plan["model"]["vocab"], plan["model"]["merges"]
        splits = (plan.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.cuts = ((plan.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and splits[0].get("pattern") == {"Regex": _SPLIT}
                     and splits[0].get("behavior") == "Removed" and plan["model"].get("end_of_word_suffix") == _WORD_END and not plan["model"].get("dropout"))
        self.added = [t["content"] for t in plan.get("added_tokens", [])]
        self.foreign, self.shown = _foreign(), _byte_characters()
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.hasher, self.kind = Hasher(), np.uint16 if self.size <= 1 << 16 else np.uint32
        self.known = _Known(self.kind)

    @classmethod
    def shared(cls, tokenizer: str) -> Encoder:
        """The worker's encoder: kept for its next tasks, for the vocabulary takes long to load."""
        if tokenizer not in _SHARED:
            _SHARED.clear()
            _SHARED[tokenizer] = cls(tokenizer)
        return _SHARED[tokenizer]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, piece: str) -> list[int]:
        """Ids of a new piece, from the file's model: it takes a piece as one character for each byte."""
        plain = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown)
        return [t.id for t in self.tokenizer.model.tokenize(plain)]

    def _cut(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all `texts`, and how many each has."""
        whole = " ".join([*texts, ""]).lower()
        codes = np.frombuffer(whole.encode("utf-16-le"), np.uint16)
        starts, ends = pieces(codes) if len(codes) > 2 else (np.zeros(0, np.int64),) * 2
        if len(codes) <= 2 and whole.strip():
            return (ids := self._whole(whole)), np.array([len(ids), *[0] * (len(texts) - 1)])
        hashes, first, back = np.unique(self.hasher.of(codes, starts, ends), return_index=True, return_inverse=True)
        at = self.known.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known.hashes) + len(new) > MAX_PIECES:
                self.known, new = _Known(self.kind), np.arange(len(hashes))
            self.known.add(hashes[new], [self._learn(whole[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = self.known.find(hashes)
        number = at[back]
        sizes = self.known.sizes[number].astype(np.int64)
        after = np.cumsum(sizes)
        ids = self.known.flat[np.repeat(self.known.starts[number] - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)].astype(np.uint32)
        borders = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))  # pieces of a text start before its border
        return ids, np.diff(np.concatenate([[0], after])[borders], prepend=0)

    def batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has. No special tokens are put around a text."""
        found: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, str]] = []

        def settle() -> None:
            if waiting:
                ids, sizes = self._cut([part for _, part in waiting])
                found.append(ids)
                np.add.at(counts, [i for i, _ in waiting], sizes)
                waiting.clear()

        room = STRETCH
        for i, text in enumerate(texts):
            own = not self.cuts or any(token in text for token in self.added)
            for part in stretches(text):
                if own or len(part) > 4 * STRETCH or self.foreign.search(part):
                    settle()
                    found.append(self._whole(part))
                    counts[i] += len(found[-1])
                    room = STRETCH
                else:
                    if len(part) > room:
                        settle()
                        room = STRETCH
                    waiting.append((i, part))
                    room -= len(part) + 1
        settle()
        return np.concatenate(found) if found else np.zeros(0, np.uint32), counts

    def of(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        return self.batch([text])[0]
