"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words and hashed by its 3-word shingles, repeats included; a bit of its
fingerprint is 1 if it is set in over half of the hashes. Two fingerprints link at ``DISTANCE`` or fewer differing
bits.

The 64 bits are cut into ``BLOCKS`` blocks. A pair that differs in at most two bits differs in at most two blocks,
so it shares all blocks of one choice of three: distinct fingerprints are joined on the bits of every choice, 39 of
them, and the Hamming distance decides. The join is done group by group, in order, and writes a star per connected
group instead of its pairs. A group of more than ``GROUP`` fingerprints, as thousands of copies with a changed word
or two make, is not compared with itself: the bits that its members do not share yet are cut into blocks again and
the group is joined on three of those in addition. After three cuts four bits are left, so no group is above 16
then; nothing is capped, and the work of a level is at most ten rows per member.

Defined results: null and empty texts and texts without words have fingerprint zero and link like any other;
repeated rows are answered each; a null doc_id is a component's smallest id only if it has no other; an empty table
gives no rows; only doc_id and text are read, other columns, whatever their names, do not matter."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.batches import flat, lower_ascii, pieces, word_bytes, words
from provloom.llm.components import components
from provloom.llm.shared import written

WIDTH, SEED = 3, 42
DISTANCE = 2
#: blocks of a cut; pairs share all but ``DISTANCE`` of them
BLOCKS = 5
#: fingerprints that are compared with each other at once; a larger group is cut once more
GROUP = 128
#: shingles whose bits are unfolded at a time
CHUNK = 1 << 14

_U = np.uint64


# --- fingerprints -------------------------------------------------------------------------------


def text_fingerprints(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Fingerprint of every text, unsigned."""
    data, bounds = flat(column)
    data = lower_ascii(data)
    s, e, doc = words(data, bounds)
    n = len(column)
    # the words of all texts behind each other, a blank after each
    length = e - s
    line = np.full(int(length.sum()) + len(s), 32, np.uint8)
    line[np.arange(len(line) - len(s)) + np.repeat(np.arange(len(s)), length)] = data[word_bytes(data)]
    end = np.cumsum(length + 1) - 1
    start = end - length
    # shingles: first and last word
    count = np.bincount(doc, minlength=n)
    held = np.minimum(count, width)
    place = np.arange(len(s)) - (np.cumsum(count) - count)[doc]
    first = np.flatnonzero(place + held[doc] <= count[doc])
    doc = doc[first]
    last = first + held[doc] - 1
    line = line.tobytes()
    ones = np.zeros((n, 64), np.int64)
    for i in range(0, len(first), CHUNK):
        a, b, d = start[first[i : i + CHUNK]].tolist(), end[last[i : i + CHUNK]].tolist(), doc[i : i + CHUNK]
        h = np.fromiter((xxhash.xxh64_intdigest(line[x:y], SEED) for x, y in zip(a, b, strict=True)), _U, len(a))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    total = np.bincount(doc, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(_U).reshape(-1)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = text_fingerprints(part.column("text"), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


# --- blocks -------------------------------------------------------------------------------------


def block_choices(shared: int, distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of the bits that a pair within ``distance`` may share, one of them for sure, if it shares those of
    ``shared``: the other bits are cut into blocks and all but ``distance`` of them are added."""
    free = [b for b in range(64) if not shared >> b & 1]
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return [shared | sum(choice) for choice in combinations(masks, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance; counting bits of a signed number would count those of its absolute value."""
    return np.bitwise_count((a ^ b).view(_U))


def group_links(x: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Stars (centre, member) of the connected groups among a few fingerprints."""
    near = differing(x[:, None], x[None]) <= distance
    label = np.arange(len(x))
    while True:
        least = np.where(near, label[None], len(x)).min(1)
        if (least == label).all():
            break
        label = least
    member = np.flatnonzero(label != np.arange(len(x)))
    return x[label[member]], x[member]


_OUT = "kind int, a long, b long, c long"


def joined_on_blocks(keyed: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Groups of the rows (mask, value, fp) of one (mask, value), distinct. Gives links (0, centre, member, 0), and for
    groups of more than ``group`` members rows (1, mask, value, fp) with larger masks."""
    choices: dict[int, np.ndarray] = {}

    def links(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], ["kind", "a", "b", "c"])

    def cut_again(mask, fp):
        if mask not in choices:
            choices[mask] = np.array([_signed(m) for m in block_choices(mask & (1 << 64) - 1, distance)], np.int64)
        m = np.tile(choices[mask], len(fp))
        fp = np.repeat(fp, len(choices[mask]))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(m), np.int32)), pa.array(m), pa.array(fp & m), pa.array(fp)], ["kind", "a", "b", "c"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        large = None  # the group that is being cut again
        for batch in batches:
            mask, value, fp = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            last = int(edge[-1]) if len(edge) else 0  # the last group may go on
            yield from whole(mask[:last], value[:last], fp[:last], large)
            if last:
                large = None
            held = [mask[last:], value[last:], fp[last:]]
            if len(held[0]) > group or large is not None and len(held[0]):
                large = (int(held[0][0]), int(held[1][0]))
                yield cut_again(large[0], held[2])
                held = [np.zeros(0, np.int64)] * 3
        if len(held[0]):
            yield from whole(*held, large)

    def whole(mask, value, fp, large):
        if not len(mask):
            return
        first = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
        size = np.diff(np.append(first, len(mask)))
        if large is not None and (int(mask[0]), int(value[0])) == large:
            yield cut_again(large[0], fp[: size[0]])
            first, size = first[1:], size[1:]
        two = first[size == 2]
        two = two[differing(fp[two], fp[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for i, k in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if k > group:
                yield cut_again(int(mask[i]), fp[i : i + k])
            else:
                x, y = group_links(fp[i : i + k], distance)
                a.append(x)
                b.append(y)
        yield links(np.concatenate(a), np.concatenate(b))

    rows = keyed.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return rows.mapInArrow(run, _OUT)


def close_links(distinct: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(a, b): links whose connected groups are those of all pairs within ``distance`` among the distinct ``fp``.
    ``group`` is 16 at least, so that three cuts do."""
    if group < 16:
        raise ValueError("a group that is compared at once has room for 16 fingerprints at least")
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in block_choices(0, distance)]))
    rows = distinct.select("fp", masks.alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    found = None
    while True:
        level = written(joined_on_blocks(rows, distance, group), "simhash-blocks")
        links = level.where("kind = 0").select("a", "b")
        found = links if found is None else found.union(links)
        rows = level.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("value"), F.col("c").alias("fp"))
        if rows.isEmpty():
            return found.distinct()


# --- documents ----------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    rows = written(fingerprints(docs, width), "simhash-rows")
    homes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-homes")
    labels = components(close_links(homes, distance, group)).withColumnRenamed("node", "fp")
    linked = written(labels.join(homes, "fp"), "simhash-linked")
    least = linked.groupBy("label").agg(F.min("least").alias("linked_id"))
    linked = linked.join(least, "label").select("fp", "linked_id")
    named = written(homes.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "least").alias("component_id")), "simhash-named")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
