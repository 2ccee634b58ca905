"""Spelling variants grouped by a bit-sliced position index.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point makes one of
the other. For a set of words the index keeps, per (position, letter), a bitset of the words with that letter there.
A word is looked up by one pass over its letters: ``zero`` holds the words that agree so far, three more sets hold
those that agree but for a replaced letter, for a letter more and for a letter less, read from the index at the
same, the next and the previous position. All are bitsets, so a step decides on all words of the set at once.

The index is built per block, so that work and memory do not grow with the square of the vocabulary: of two near
words, the shorter of L letters, either the first or the last L // 2 letters agree. Blocks are (L, side, those
letters) with the words of L and L + 1 letters. A pair that agrees at both ends counts at the front only. A block of
more than ``TILE`` words is dealt: each of its tiles of words meets each of its parts of look-ups in a task of its own.

A word's form is its near word of largest count, if that is ``RATIO`` times its own; roots follow forms by pointer
doubling, which ends soon as counts rise by that factor at every step.

Defined results: null and empty texts give no words; rows count as often as they repeat; a null doc_id is written
as the empty string; ties of count go to the smallest word in code-point order; an empty table gives no rows; only
doc_id and text are read, other columns, whatever their names, do not matter."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.shared import written

LETTERS = 6
LEAST_N = 5
RATIO = 5
#: one occurrence in so many loses a letter
DROP_EVERY = 199
#: words of one index
TILE = 4096
#: distinct words that a task holds before it hands them on
HELD_WORDS = 400_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def occurrences(text: str, doc_id, letters: int = LETTERS) -> Counter:
    """Counts of the words of one text, runs of fewer letters left out."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(re.findall(rf"[A-Za-zÀ-ÿ]{{{letters},}}", text)).items():
        run = run.lower() if run.isascii() else run.translate(_LOWER)
        h = zlib.crc32(run.encode(), prefix)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < letters:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, letters: int = LETTERS, least: int = LEAST_N) -> DataFrame:
    """word and n of every word that occurs often enough."""

    def handed(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    counts.update(occurrences(text.as_py(), doc_id, letters))
                if len(counts) > HELD_WORDS:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """Bitsets of words: by (position, letter) and by length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.all = (1 << len(words)) - 1
        self.at: dict[tuple[int, str], int] = defaultdict(int)
        self.size: dict[int, int] = defaultdict(int)
        for i, w in enumerate(words):
            bit = 1 << i
            self.size[len(w)] |= bit
            for place in enumerate(w):
                self.at[place] |= bit

    def near(self, word: str, front: int = 0) -> int:
        """The words at one edit from ``word``; with ``front``, those that agree in so many first letters are left out."""
        zero, changed, longer, shorter, agree = self.all, 0, 0, 0, 0
        at = self.at.get
        for p, c in enumerate(word):
            if p == front:
                agree = zero
            here = at((p, c), 0)
            changed = changed & here | zero & ~here
            longer = (longer | zero) & at((p + 1, c), 0)
            shorter = shorter & at((p - 1, c), 0) | zero
            zero &= here
        m, size = len(word), self.size.get
        found = changed & size(m, 0) | (longer | zero) & size(m + 1, 0) | shorter & size(m - 1, 0)
        return found & ~agree if front else found

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out


_BLOCK = ["l", "side", "part", "tile", "turn"]


def blocks(words: DataFrame, letters: int = LETTERS, tile: int = TILE) -> DataFrame:
    """Rows (l, side, part, tile, turn, role, word, n): role 0 is in the index, 1 is looked up, 2 is both."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    w = words.select("word", "n", lengths.alias("l")).where(F.col("l") >= letters)
    half = F.floor(F.col("l") / 2).cast("int")
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")),
        F.struct(F.lit(1).alias("side"), F.expr("right(word, cast(l div 2 as int))").alias("part")),
    )
    w = w.select("word", "n", "l", F.explode(ends).alias("end")).select("word", "n", "l", "end.side", "end.part")
    key = ["l", "side", "part"]
    counts = w.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    w = w.join(counts, key)  # a word without company in its block has no near word there
    tiles = F.ceil(F.col("m") / tile).cast("int")
    own = F.pmod(F.xxhash64("word"), F.lit(1) * tiles).cast("int")
    every = F.sequence(F.lit(0), tiles - 1)
    dealt = F.concat(
        F.transform(every, lambda i: F.struct(own.alias("tile"), i.alias("turn"), F.lit(0).alias("role"))),
        F.transform(every, lambda i: F.struct(i.alias("tile"), own.alias("turn"), F.lit(1).alias("role"))),
    )
    whole = F.array(F.struct(F.lit(0).alias("tile"), F.lit(0).alias("turn"), F.lit(2).alias("role")))
    w = w.select(*key, "word", "n", F.explode(F.when(F.col("m") <= tile, whole).otherwise(dealt)).alias("at"))
    return w.select(*key, "at.tile", "at.turn", "at.role", "word", "n")


def near_words(words: DataFrame, letters: int = LETTERS, tile: int = TILE) -> DataFrame:
    """word, n_near, best (struct of -n and word) of every word that has near words."""

    def looked_up(key, rows):
        length, side = key[0], key[1]
        index = PositionIndex([w for role, w, _ in rows if role != 1])
        n = [k for role, _, k in rows if role != 1]
        out = []
        for role, word, _ in rows:
            if role == 0:
                continue
            found = index.near(word, length // 2 if side else 0)
            if len(word) > length:  # words of this length meet their like in a block of their own
                found &= index.size.get(length, 0)
            if found:
                at = index.members(found)
                most, best = min((-n[i], index.words[i]) for i in at)
                out.append((word, len(at), -most, best))
        return out

    def handed(out):
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for *at, role, word, n in zip(*(batch.column(c).to_pylist() for c in (*_BLOCK, "role", "word", "n")), strict=True):
                if at != key:
                    if len(rows) > 1:
                        out += looked_up(key, rows)
                    key, rows = at, []
                    if len(out) > 5000:
                        yield handed(out)
                        out = []
                rows.append((role, word, n))
        if len(rows) > 1:
            out += looked_up(key, rows)
        yield handed(out)

    dealt = blocks(words, letters, tile).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles: the last word that forms lead to."""
    up = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if up.join(above, "root", "left_semi").isEmpty():
            return up
        up = written(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST_N, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = written(vocabulary(docs, letters, least), "spelling-words")
    near = words.join(near_words(words, letters, tile), "word", "left")
    passes = -F.col("best.less") >= ratio * F.col("n")
    out = near.select(
        "word", F.when(passes, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(passes, -F.col("best.less")).alias("form_n"),
    )
    out = written(out, "spelling-forms")
    last = roots(out.where("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
