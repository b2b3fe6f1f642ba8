"""Token ids of whole text columns: the tokenizers library encodes each distinct word, numpy spreads the ids.

Byte-level BPE never merges across the boundaries of its pre-tokens, so a text's ids are those of its
pre-tokens in order. Texts of ASCII and Latin-1 letters are cut into pre-tokens by numpy; other texts go to the
library, and so does a whole text that holds one of the tokenizer's added tokens. All ways give the ids of
Tokenizer.encode as the library is by default.

A text over CHUNK bytes is encoded in pieces that are cut before a blank after an ASCII letter, digit or sign, where a
pre-token starts whatever stands around; so memory is bounded by the piece (and four bytes an id) for any text
with blanks. A word is known again by its length and, beyond eight bytes, a 128-bit hash.
"""

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quarterdeck.llm.words import CHUNK, chunks, span_keys, text_buffer

_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_QUOTE, _BLANK = ord("'"), 32
_ENDS = np.zeros((256, 256), np.uint8)  # letters after a quote that belong to it
for _c in b"stmd":
    _ENDS[_c, :] = 1
for _a, _b in (b"re", b"ve", b"ll"):
    _ENDS[_a, _b] = 2


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of byte-level BPE start; offsets[0] is 0."""
    n = len(data)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge = edge[:n]
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start & ~edge & (kind != _SPACE))
    after = runs[kind[runs - 1] == _SPACE]
    start[after - 1] = True
    start[after[data[after - 1] == _BLANK]] = False
    quoted = runs[(data[runs - 1] == _QUOTE) & start[runs - 1] & (kind[runs] == _LETTER) & start[runs]]
    for at in quoted.tolist():  # rare
        end = int(offsets[np.searchsorted(offsets, at, "right")])
        following = int(data[at + 1]) if at + 1 < end else 0
        if length := int(_ENDS[data[at], following]):
            start[at] = False
            if at + length < end and kind[at + length] == _LETTER:
                start[at + length] = True
    return np.flatnonzero(start)


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of nothing but ASCII and the letters U+00C0 to U+00FF."""
    high = data >= 0x80
    follows = np.zeros(len(data), bool)
    follows[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    bad = np.flatnonzero(high & (data != 0xC3) & ~follows)
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    plain = np.ones(len(offsets) - 1, bool)
    for at in (bad, signs):
        plain[np.searchsorted(offsets, at, "right") - 1] = False
    return plain


class Encoder:
    """Encodes text columns; keeps the ids of up to `keep` distinct words between batches."""

    SLOTS = 21

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks, self.refs = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32)
        self.first, self.count, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.n_words = self.n_ids = 0

    def _added(self, texts: list[str]) -> int:
        """Stores the ids of new words; returns the number of the first."""
        counts, parts = np.zeros(len(texts), np.int64), []
        alone = len(self.newline) != 1
        odd = [alone or "\n" in x or not x.strip() for x in texts]
        group: list[int] = []

        def flush() -> None:
            ids = np.array(self.tokenizer.encode("\n".join(texts[i] for i in group) + "\n", add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(ids == self.newline[0])
            counts[group] = np.diff(np.r_[-1, ends]) - 1
            parts.append(np.delete(ids, ends))
            group.clear()

        for i, x in enumerate(texts):
            if odd[i]:
                if group:
                    flush()
                ids = self.tokenizer.encode(x, add_special_tokens=False).ids
                counts[i] = len(ids)
                parts.append(np.array(ids, np.uint32))
            else:
                group.append(i)
                if len(group) == 2048:
                    flush()
        if group:
            flush()
        ids, base = np.concatenate(parts), self.n_words
        for name, n, more in (("first", base, len(texts)), ("count", base, len(texts)), ("ids", self.n_ids, len(ids))):
            old = getattr(self, name)
            if len(old) < n + more:
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old), more), old.dtype)]))
        self.first[base : base + len(texts)] = self.n_ids + np.r_[0, np.cumsum(counts)[:-1]]
        self.count[base : base + len(texts)] = counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_words, self.n_ids = base + len(texts), self.n_ids + len(ids)
        return base

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pretoken_starts(data, offsets)
        ends = np.r_[starts[1:], len(data)]
        hashes, checks = span_keys(data, starts, ends)
        slots = (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        refs = self.refs[slots].astype(np.int64)
        missing = np.flatnonzero((self.hashes[slots] != hashes) | (self.checks[slots] != checks))
        if len(missing):
            _, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if (checks[missing][at][back] != checks[missing]).any():  # words that share 64 bits
                _, at, back = np.unique(np.rec.fromarrays([hashes[missing], checks[missing]]), return_index=True, return_inverse=True)
            raw, at = data.tobytes(), missing[at]
            base = self._added([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            refs[missing] = base + back
            self.hashes[slots[at]], self.checks[slots[at]], self.refs[slots[at]] = hashes[at], checks[at], np.arange(base, base + len(at))
        counts = self.count[refs]
        total = np.r_[0, np.cumsum(counts)]
        ids = self.ids[np.repeat(self.first[refs] - total[:-1], counts) + np.arange(total[-1])]
        if self.n_words > self.keep:
            self.forget()
        return ids, total[np.searchsorted(starts, offsets)]

    def _holds_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold the text of an added token."""
        raw, out = data.tobytes(), np.zeros(len(offsets) - 1, bool)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    out[row] = True
                    at = raw.find(token, int(offsets[row + 1]))
                else:
                    at = raw.find(token, at + 1)
        return out

    def _library(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _alone(self, data: np.ndarray, plain: bool, whole: bool) -> np.ndarray:
        """Ids of one text, piece by piece unless it must stay whole."""
        parts = []
        for a, b in [(0, len(data))] if whole else pieces(data):
            part = data[a:b]
            parts.append(self._plain(part, np.array([0, len(part)]))[0] if plain else self._library(part.tobytes()))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (first row, ids, offsets of ids by row) for some rows after the other, until all are done."""
        data, offsets = text_buffer(column)
        for first, last in chunks(offsets):
            at = offsets[first : last + 1] - offsets[first]
            part = data[offsets[first] : offsets[last]]
            if not len(part):
                yield first, np.empty(0, np.uint32), np.zeros(last - first + 1, np.int64)
                continue
            added = self._holds_added(part, at)
            plain = plain_rows(part, at) & ~added
            if last == first + 1:
                ids = self._alone(part, bool(plain[0]), bool(added[0]))
                yield first, ids, np.array([0, len(ids)])
                continue
            cuts = np.r_[0, np.flatnonzero(np.diff(plain)) + 1, last - first]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if not plain[a]:
                    for row in range(a, b):
                        ids = self._library(part[at[row] : at[row + 1]].tobytes())
                        yield first + row, ids, np.array([0, len(ids)])
                elif at[a] == at[b]:
                    yield first + a, np.empty(0, np.uint32), np.zeros(b - a + 1, np.int64)
                else:
                    ids, ends = self._plain(part[at[a] : at[b]], at[a : b + 1] - at[a])
                    yield first + a, ids, ends


def pieces(data: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of a text of about limit bytes, cut only before a blank after an ASCII character that is no white space."""
    a, n = 0, len(data)
    while n - a > limit:
        b, step = 0, limit
        while not b and a + step < n:  # a longer piece only where nothing can be cut
            part = data[a : a + step + 1]
            cuts = np.flatnonzero((part[1:] == _BLANK) & (part[:-1] > _BLANK) & (part[:-1] < 127))
            b = int(cuts[-1]) + 1 if len(cuts) else 0
            step *= 2
        if not b:
            break
        yield a, a + b
        a += b
    yield a, n


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that its words serve all the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release(path: str) -> None:
    """Gives back the memory of the words that this Python worker's encoder knows; its tokenizer stays loaded."""
    if (found := _encoders.get(path)) and found.n_words:
        found.forget()
