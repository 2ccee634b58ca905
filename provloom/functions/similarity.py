"""Indel similarity ratio 2*LCS/(|a|+|b|): a JVM fold and an Arrow UDF that agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word row per character (bit-parallel)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hits = row & where.get(ch, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if total == 0 else 2.0 * lcs_length(a, b) / total


def reaches(a: str, b: str, threshold: float, strict: bool = False) -> bool:
    """Whether the ratio reaches the threshold; lengths alone rule out most pairs."""
    total = len(a) + len(b)
    bound = 1.0 if total == 0 else 2.0 * min(len(a), len(b)) / total
    if bound < threshold or (strict and bound <= threshold):
        return False
    r = ratio(a, b)
    return r > threshold if strict else r >= threshold


#: below so many texts a loop of one-text comparisons is faster than arrays
FEW = 24
_BUCKETS = 32


class Texts:
    """Texts that are compared with one text after the other: lengths, character counts and flat characters, so that
    a comparison is a few array operations for all texts at once."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, flat = np.unique(chars, return_inverse=True)
        self.flat = flat.astype(np.int32)
        bucket = np.repeat(np.arange(len(texts)) * _BUCKETS, self.size) + self.flat % _BUCKETS
        self.counts = np.bincount(bucket, minlength=len(texts) * _BUCKETS).reshape(-1, _BUCKETS).astype(np.int32)

    def lcs_lengths(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Longest common subsequence of text ``i`` with each of ``rows``: the bit-parallel row, one lane per text."""
        m = int(self.size[i])
        words = max(1, -(-m // 64))
        where = np.zeros((len(self.alphabet), words), np.uint64)
        place = np.arange(m)
        np.bitwise_or.at(where, (self.flat[self.start[i] : self.start[i] + m], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        order = np.argsort(-self.size[rows], kind="stable")  # texts that go on are a prefix
        start, size = self.start[rows][order], self.size[rows][order]
        row = np.full((words, len(rows)), ~np.uint64(0))
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for j, n in enumerate(active.tolist()):
            char = self.flat[start[:n] + j]
            carry = None
            for w in range(words):
                v = row[w, :n]
                hits = v & where[char, w]
                total = v + hits
                if words > 1:
                    over = total < v
                    if carry is not None:
                        more = total + carry
                        over |= more < total
                        total = more
                    carry = over.astype(np.uint64)
                row[w, :n] = total | (v ^ hits)
        bits = np.full(words, ~np.uint64(0))
        if m % 64 or not m:
            bits[-1] = np.uint64((1 << (m % 64)) - 1)
        out = np.empty(len(rows), np.int64)
        out[order] = m - np.bitwise_count(row & bits[:, None]).sum(0, dtype=np.int64)
        return out

    def reaching(self, i: int, rows: np.ndarray, threshold: float, strict: bool = False) -> np.ndarray:
        """Those of ``rows`` whose ratio with text ``i`` reaches the threshold. Lengths, then counts of characters bound
        the common subsequence from above and rule out most."""
        def passes(common, total):
            r = np.where(total == 0, 1.0, 2.0 * common / np.maximum(total, 1))
            return r > threshold if strict else r >= threshold

        rows = rows[passes(np.minimum(self.size[i], self.size[rows]), self.size[i] + self.size[rows])]
        if len(rows) > 2:
            rows = rows[passes(np.minimum(self.counts[i], self.counts[rows]).sum(1), self.size[i] + self.size[rows])]
        if len(rows) < FEW:
            return np.array([k for k in rows.tolist() if reaches(self.texts[i], self.texts[k], threshold, strict)], np.int64)
        return rows[passes(self.lcs_lengths(i, rows), self.size[i] + self.size[rows])]

    def first_matches(self, threshold: float, keepers: int | None = None) -> np.ndarray:
        """For every text, in order, the first text kept before it that it reaches, -1 if it is kept itself. With ``keepers``
        the first so many texts are all kept and the others are only compared with them."""
        n = len(self.texts)
        match = np.full(n, -1)
        left = np.arange(keepers or 0, n)
        if keepers is not None:
            for i in range(keepers):
                if not len(left):
                    break
                match[self.reaching(i, left, threshold)] = i
                left = left[match[left] < 0]
            return match
        while len(left):
            i, left = int(left[0]), left[1:]
            match[self.reaching(i, left, threshold)] = i
            left = left[match[left] < 0]
        return match


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_ratio_native(a: Column, b: Column) -> Column:
    """The same ratio as a fold over characters, for short strings and for places without Python."""
    chars_b = F.split(b, "")
    start = F.array_repeat(F.lit(0), (F.length(b) + 1).cast("int"))

    def step(prev: Column, ca: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda row, j: F.concat(
                row,
                F.array(
                    F.when(F.get(chars_b, j - 1) == ca, F.get(prev, j - 1) + 1).otherwise(
                        F.greatest(F.get(prev, j), F.get(row, j - 1))
                    )
                ),
            ),
        )

    lcs = F.try_element_at(F.aggregate(F.split(a, ""), start, step), F.lit(-1))
    total = F.length(a) + F.length(b)
    return (
        F.when(total == 0, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * lcs / total)
    )
