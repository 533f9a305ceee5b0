"""Words of whole texts as NumPy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text.
Every word gets a 64-bit hash from one pass of vector operations over the bytes:
a polynomial prefix sum gives the hash of any byte range by two lookups.  Texts
are handled in chunks of about CHUNK bytes; one longer text is a chunk by itself,
so memory is bounded by the larger of the two.

Null texts count as empty.  All functions are pure, so a retried task gives the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and its inverse powers, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        for k, base in enumerate((_BASE, _INV)):
            out = np.full(size, base, U)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a chunk: byte ranges, 64-bit hashes, and first[d]..first[d + 1] as the words of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P with P[i] the sum of byte value times base^position below i, and the inverse powers."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def scan(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts data[bounds[d]:bounds[d + 1]]."""
    if lower:
        data = _LOWER[data]
    return ranges(data, *word_ranges(data, bounds), bounds)


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    space = _IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a new text ends a word too
    edge[bounds] = True
    word = ~space
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    return starts, np.flatnonzero(word & (~after | edge[1:])) + 1


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> Words:
    """Hashed byte ranges; none crosses a bound."""
    total, down = prefix_hash(data)
    value = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))
    return Words(data, starts, ends, value, np.searchsorted(starts, bounds))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) over an Arrow string array; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, body = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, last, raw[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word windows and the text of each; a text of fewer words has its whole sequence as one."""
    n, counts = len(words.hash), words.counts
    h, doc = words.hash, words.document()
    parts, owners = [], []
    if n >= k:
        keep = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        g = mix(h[keep] + U(k))
        for j in range(1, k):
            g = mix(g * U(0x9FB21C651E98DF25) + h[keep + j])
        parts.append(g)
        owners.append(doc[keep])
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            at = words.first[short]
            g = mix(h[at] + U(m))
            for j in range(1, m):
                g = mix(g * U(0x9FB21C651E98DF25) + h[at + j])
            parts.append(g)
            owners.append(short)
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owners)


def distinct_sets(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each owner, and first[d]..first[d + 1] as those of owner d."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1))
