"""Words, word hashes and word shingles of whole Arrow text columns, by numpy over the column's own bytes.

A word is a maximal run of ASCII letters or digits and of bytes of non-ASCII characters. Folded words are in
lower case, by Unicode's simple mapping of single characters, so that copies that differ in case or punctuation agree.

Spans are hashed eight bytes at a time by bijective mixing, so different words of up to eight bytes never share
a hash; longer ones share one of 64 bits by chance only. A shingle's hash is the mixed sum of its words' hashes times powers,
modulo 2**64: different shingles share one by chance, or if a text was made for it.
"""

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once; one longer document is scanned alone.
CHUNK = 1 << 20
SHINGLE = 5
#: Spans over this many bytes are hashed one by one.
LONG_SPAN = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_SPAN_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def powers(n: int) -> np.ndarray:
    """Powers 0 to n of the base modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])


@cache
def simple_lower() -> np.ndarray:
    """The lower-case letter of each code point below the last cased one."""
    out = np.arange(0x1E944, dtype=np.uint32)
    for c in range(len(out)):
        lower = chr(c).lower()
        if len(lower) == 1:
            out[c] = ord(lower)
    out[0x130] = ord("i")
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null row is empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of byte spans, together one of 128 bits; of spans of up to eight bytes they are bijective.

    Equal bytes give equal hashes wherever they stand. The second is the length of a span of up to eight bytes.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    view = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    sizes = ends - starts
    first = mixed(view[starts] & _SPAN_MASK[np.minimum(sizes, 8)])
    second = sizes.astype(np.uint64)
    live = np.flatnonzero(sizes > 8)
    if not len(live):
        return first, second
    long = live[sizes[live] > LONG_SPAN]
    live = live[sizes[live] <= LONG_SPAN]
    one, two = first[live] + second[live] * _OTHER, mixed(first[live] ^ _BASE)
    done = 8
    at = np.arange(len(live))
    while len(at):
        own = live[at]
        part = view[starts[own] + done] & _SPAN_MASK[np.minimum(sizes[own] - done, 8)]
        one[at] = mixed(one[at] * _BASE + part)
        two[at] = mixed(two[at] * _OTHER ^ part)
        done += 8
        at = at[sizes[own] > done]
    first[live], second[live] = one, two
    for k in long.tolist():
        digest = hashlib.blake2b(padded[starts[k] : ends[k]], digest_size=16).digest()
        first[k], second[k] = np.frombuffer(digest, "<u8")
    return first, second


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first of span_keys()."""
    return span_keys(data, starts, ends)[0]


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of UTF-8 in lower case, and their offsets; of bytes that are no UTF-8, A-Z alone is folded."""
    if not len(data) or int(data.max()) < 0x80:
        return LOWER[data], offsets
    if int(data.max()) <= 0xC3:  # Latin-1 letters only
        data = LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
        data[lead] += 32
        return data, offsets
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:
        return LOWER[data], offsets
    table = simple_lower()
    cased = points < len(table)
    lower = points.copy()
    lower[cased] = table[points[cased]]
    ends = np.r_[0, np.cumsum(np.ones(len(lower), np.uint8) + (lower > 0x7F) + (lower > 0x7FF) + (lower > 0xFFFF), dtype=np.int64)]
    row = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)][offsets]
    return np.frombuffer(lower.tobytes().decode("utf-32-le").encode(), np.uint8), ends[row]


class Words(NamedTuple):
    starts: np.ndarray  # byte offsets in the chunk
    ends: np.ndarray
    bounds: np.ndarray  # words of row i: bounds[i] to bounds[i + 1]
    data: np.ndarray  # folded bytes of the chunk
    offsets: np.ndarray  # bytes of row i in data


def words(data: np.ndarray, offsets: np.ndarray, unicode: bool = True) -> Words:
    """Words of rows that lie one after the other in data, in lower case (A-Z alone, unless unicode)."""
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    data, offsets = folded(data, offsets) if unicode else (LOWER[data], offsets)
    n = len(data)
    is_word = IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    joined = np.zeros(n + 1, bool)  # byte i continues the word of byte i - 1
    joined[1:n] = is_word[1:] & is_word[:-1]
    joined &= ~edge
    starts = np.flatnonzero(is_word & ~joined[:n])
    ends = np.flatnonzero(is_word & ~joined[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), data, offsets)


def word_hashes(found: Words) -> np.ndarray:
    return span_hashes(found.data, found.starts, found.ends)


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words that stand consecutively in a row, in order, and their bounds by row."""
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    out = np.r_[0, np.cumsum(counts)]
    if not out[-1]:
        return np.empty(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    up = powers(n)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += hashes[at + k] * up[k + 1]
    return mixed(total), out


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_hashes; a row of 1 to n - 1 words has one shingle, of all its words."""
    found, at = shingle_hashes(hashes, bounds, n)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return found, at
    up = powers(n)
    whole = np.array([mixed(np.sum(hashes[bounds[r] : bounds[r + 1]] * up[1 : counts[r] + 1], keepdims=True) + np.uint64(counts[r]))[0] for r in short.tolist()], np.uint64)
    sizes = np.diff(at)
    found = np.insert(found, at[short], whole)
    sizes[short] = 1
    return found, np.r_[0, np.cumsum(sizes)]


class Vocabulary:
    """A few hashes, found among many by a table of their top 16 bits first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.top = np.zeros(1 << 16, bool)
        self.top[self.hashes >> np.uint64(48)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of known hashes, their numbers)."""
        at = np.flatnonzero(self.top[hashes >> np.uint64(48)])
        number = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[number] == hashes[at]
        return at[same], number[same]
