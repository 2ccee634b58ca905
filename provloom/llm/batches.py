"""Texts of Arrow batches as flat arrays: words, hashes, shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are worked on at a time
PIECE_BYTES = 2 << 20

#: spans from so many bytes are hashed by BLAKE2b; below, a polynomial modulo 2 ** 64 is faster, and the words on which
#: all such polynomials collide are four times as long
LONG_SPAN = 256

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the bounds of each; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word."""
    return _WORD[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes that are not white space."""
    w = _WORD[data]
    begins, ends = w.copy(), w.copy()
    begins[1:] &= ~w[:-1]
    ends[:-1] &= ~w[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= w[inner]
    ends[inner - 1] |= w[inner - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(bounds, s, "right") - 1


def powers(n: int, base: int, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, PIECE_BYTES + 1), base, _U)
        p[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(p)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; one to one."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, _U)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(n + 1, _BASE, "up")[:n], out=total[1:])
    h = (total[ends] - total[starts]) * powers(n + 1, _BACK, "down")[starts]
    h = mixed(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``width`` words within a text, in order; a text of fewer words
    is one shingle. Each text's shingles begin at its words in order."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(count, out=first[1:])
    m = len(word_hash)
    h = np.zeros(m, _U)
    place = np.arange(m) - first[doc]
    held = np.minimum(count[doc], width)
    ok = place + held <= count[doc]
    at = np.flatnonzero(ok)
    size = held[at]
    for k in range(width):
        more = size > k
        sub = at[more]
        h[sub] = h[sub] * _U(0x9FB21C651E98DF25) + word_hash[sub + k]
    short = size < width
    out = mixed(h[at] + size.astype(_U))
    if short.any():  # one shingle for the whole of a short text
        keep = ~short | (place[at] == 0)
        return out[keep], doc[at][keep]
    return out, doc[at]
