"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item is found in a document when some stretch of the document differs from it by at most
``rate`` edits per character (insertions, deletions, substitutions). Items are cut into as many pieces as the
error budget plus one: whatever the errors, one piece is whole. All pieces of all items form one automaton that
finds the exact hits in one pass over a text; a hit points at a window of the text, and Myers' bit-parallel
distance decides there.

Texts and items are compared in lower case with white space runs as one blank.

Defined results: null and empty texts match nothing; null items and items shorter than ``least_chars`` are not
searched (a few words occur in any text); a document that holds an item many times gives one row, the best
place, the first of equals; repeated rows are answered each; extra columns pass by. The benchmark is the query
set: it is broadcast in blocks of ``BLOCK_CHARS`` characters at most about, one pass over the documents per
block, so that no broadcast grows with it."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.batches import pieces

RATE = 0.08
LEAST_CHARS = 32
BLOCK_CHARS = 500_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = budget + 1
    return [(len(item) * k // n, item[len(item) * k // n : len(item) * (k + 1) // n]) for k in range(n)]


def best_distance(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """Smallest edit distance between ``item`` and any stretch of ``text`` and the first end that has it; None
    above ``budget``. Myers' algorithm, the item's characters being bits of one number."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = budget + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        gain = down | (full & ~(d0 | up))
        loss = d0 & up
        if gain & top:
            score += 1
        elif loss & top:
            score -= 1
        gain, loss = (gain << 1) & full, (loss << 1) & full  # a match may begin anywhere
        up = (loss | (full & ~(d0 | gain))) & full
        down = d0 & gain
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= budget else None


class Items:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(key, text, int(len(text) * rate)) for key, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, budget) in enumerate(self.items):
            for offset, piece in cut(text, budget):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(key, distance, budget, end) of every item that the text holds, ends in the plain text."""
        if self.empty or not text:
            return []
        hits: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                hits.setdefault(i, set()).add(last - size + 1 - offset)
        out = []
        for i in sorted(hits):
            key, item, budget = self.items[i]
            best = None
            places = sorted(hits[i])
            k = 0
            while k < len(places) and not (best and best[0] == 0):
                first = last = places[k]
                while k < len(places) and places[k] - last <= 2 * budget:
                    last = places[k]
                    k += 1
                begin = max(0, first - budget)
                got = best_distance(item, text[begin : last + len(item) + budget], budget if best is None else best[0] - 1)
                if got:
                    best = got[0], begin + got[1]
            if best:
                out.append((key, best[0], budget, best[1]))
        return out


_BUILT: dict[tuple, Items] = {}


def _built(items: list[tuple[object, str]], rate: float) -> Items:
    """The automaton, built once per worker and block."""
    key = (tuple(items), rate)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(items, rate)
    return _BUILT[key]


def item_blocks(benchmark: DataFrame, least_chars: int, block_chars: int) -> list[list[tuple[object, str]]]:
    """Searchable items in blocks, dealt by a hash of their id; one block is held at a time."""
    able = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = able.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    n = int(chars) // block_chars + 1
    for b in range(n):
        rows = able.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "text").toLocalIterator()
        items = [(r.item_id, t) for r in rows if len(t := plain(r.text)) >= least_chars]
        if items:
            yield items


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, end_char: one row per document row and item that it holds."""
    spark = docs.sparkSession
    ids = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, distance int, budget int, end_char long"

    def pass_of(block):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches):
            items = _built(shipped.value, rate)
            for batch in batches:
                for part in pieces(batch, "text"):
                    at, rows = [], []
                    for i, t in enumerate(part.column("text").to_pylist()):
                        for row in items.find(plain(t or "")):
                            at.append(i)
                            rows.append(row)
                    keys = part.column("doc_id").take(pa.array(at, pa.int64()))
                    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(columns[0], pa.int64() if ids[1] == "bigint" else None), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
                        ["doc_id", "item_id", "distance", "budget", "end_char"],
                    )

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found = [pass_of(block) for block in item_blocks(benchmark, least_chars, block_chars)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item; all columns."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, least_chars, block_chars):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            items = _built(shipped.value, rate)
            for batch in batches:
                for part in pieces(batch, "text"):
                    yield part.filter(pa.array([not items.find(plain(t or "")) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
