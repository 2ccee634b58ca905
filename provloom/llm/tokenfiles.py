"""Token-id files with a minimal perfect hash over their keys.

Documents are range-partitioned by doc_id; every partition is a shard, written as one Parquet file of blocks
in ascending order. A block holds the ids of consecutive documents as little-endian unsigned 32-bit integers,
``block_ids`` of them at most unless one document has more, and an index of its keys: a minimal perfect hash
that maps each key to a slot, and per slot a 32-bit fingerprint of the key, the offset in the block and the
number of ids. A lookup takes the block by its key range, hashes the key through a few levels of bits, checks
the fingerprint and reads its ids: constant time, no search among keys.

The hash is a cascade: keys are hashed into a bit array, those that fall alone keep their bit, the others go to
the next, smaller array; the slot is the number of bits set before the key's bit.

Defined results: a null text is empty and has its end id only; documents with one doc_id stand in (text) order
and the key leads to the first of them; a null doc_id comes first and has no key; an empty table gives a file
set without blocks; extra columns are not written. The folder is one that executors share. A shard is
streamed, a task holds one Arrow batch, one block and one row group of its file."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provloom.llm.batches import mixed, pieces, span_hashes
from provloom.llm.shared import shared_path

END_ID = 0
BLOCK_IDS = 1 << 18
#: bytes of text that are encoded at a time; the arrays made for a byte take some 30 bytes
ENCODE_BYTES = 1 << 19
#: bytes of a row group of the files; writer and reader hold one
GROUP_BYTES = 8 << 20
#: bits of an array per key that enters it, in percent
ROOM = 200

BLOCKS = "shard int, block int, low long, high long, n_docs int, n_ids long, keys binary, sizes binary, levels binary, level_bits binary, slots binary, ids binary"

# --- tokens -------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts by a byte-level vocabulary of the tokenizers library.

    The library's own splitting of a text into words is reproduced on arrays of code points, every distinct
    word is encoded once by the library, and ids are put together from the words. A text that names an added
    token is left to the library as a whole."""

    #: distinct words kept per worker
    MOST_WORDS = 2_000_000
    #: words that the library encodes in one call
    AT_ONCE = 4096

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = _kinds()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)

    def learn(self, new: np.ndarray, words: list[str]) -> None:
        """Adds words, given by their hashes, in rising order."""
        if len(self.known) + len(new) > self.MOST_WORDS:
            self.forget()
        found, count = [self.ids], np.zeros(len(words), np.int64)
        for i in range(0, len(words), self.AT_ONCE):  # the library's results take far more room than the ids
            some = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + self.AT_ONCE], add_special_tokens=False)]
            count[i : i + len(some)] = [len(x) for x in some]
            found.append(np.array([y for x in some for y in x], self.ids.dtype))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate(found)
        at = np.searchsorted(self.known, new)
        self.known, self.first, self.count = (np.insert(a, at, b) for a, b in ((self.known, new), (self.first, first), (self.count, count)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        plain = list(texts)
        for i in whole:
            plain[i] = ""
        ids, sizes = self._encode_plain(plain)
        if whole:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.uint32)
                sizes[i] = len(e.ids)
            ids = np.concatenate(parts)
        return ids, sizes

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(size)])
        starts = word_starts(code, bounds, self.kinds)
        ends = np.append(starts[1:], len(code))
        text_of = np.searchsorted(bounds, starts, "right") - 1
        h = span_hashes(code, starts, ends)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == distinct[seen]
        if not seen.all():
            before = len(self.known)
            fresh = np.flatnonzero(~seen)
            if before + len(fresh) > self.MOST_WORDS:
                self.forget()
                fresh = np.arange(len(distinct))
            self.learn(distinct[fresh], [joined[starts[i] : ends[i]] for i in where[fresh]])
            at = np.searchsorted(self.known, distinct)
        count = self.count[at][back].astype(np.int64)
        first = self.first[at][back].astype(np.int64)
        total = np.cumsum(count)
        pick = np.arange(total[-1]) - np.repeat(total - count, count) + np.repeat(first, count)
        sizes = np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)
        return self.ids[pick].astype(np.uint32), sizes


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """Kind of every code point, by the classes that the vocabulary's splitting pattern uses."""
    import regex

    code = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    every = code.tobytes().decode("utf-32-le")
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[code[m.start() : m.end()]] = kind
    return kinds


#: fixed values: endings that the splitting pattern takes as words of their own after an apostrophe
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def word_starts(code: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words begin: runs of letters, of numbers, of other signs, each with one blank before it; of white
    space that precedes a word the last character stays out of the run; an apostrophe with an ending stands
    alone."""
    n = len(code)
    kind = kinds[code]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    change = first[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    begin = change.copy()
    end = np.append(run[1:], n)  # end of each run
    space = kind[run] == _SPACE
    meets = space & ~first[end]  # white space before a word of the same text
    last = end[meets] - 1
    blank = code[last] == 32
    begin[last] = True  # the last one leaves its run
    begin[last[blank] + 1] = False  # and a blank joins the word
    # an apostrophe at the start of a match, alone in its run, with a known ending after it
    lone = np.flatnonzero((code == 39) & change & begin)
    if len(lone):
        after = np.append(change, True)
        lone = lone[(lone + 1 < n)]
        lone = lone[after[lone + 1] & ~first[lone + 1]]
        for i in lone:
            for e in ENDINGS:
                stop = i + 1 + len(e)
                if stop <= n and not first[i + 1 : stop].any() and all(code[i + 1 + k] == ord(c) for k, c in enumerate(e)):
                    begin[i + 1] = False
                    if stop < n:
                        begin[stop] |= kind[stop] == _LETTER
                    break
    return np.flatnonzero(begin)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- minimal perfect hash -----------------------------------------------------------------------


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys ^ mixed(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sizes and bits of the cascade for distinct 64-bit keys."""
    sizes, bits, left = [], [], keys.astype(np.uint64)
    while len(left):
        size = max(64, len(left) * ROOM // 100)
        at = _level_hash(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, bits


class PerfectHash:
    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits, self.rank = sizes, bits, []
        n = 0
        for b in bits:
            self.rank.append(np.cumsum(b) - b + n)
            n += int(b.sum())
        self.n = n

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 where no array has a bit for it. A strange key may get a slot."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        for level, size in enumerate(self.sizes):
            todo = np.flatnonzero(out < 0)
            at = _level_hash(keys[todo], level, size)
            hit = self.bits[level][at]
            out[todo[hit]] = self.rank[level][at[hit]]
        return out


def key_print(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)


_SLOT = np.dtype([("print", "<u4"), ("n", "<u4"), ("start", "<u8")])


def index_of(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Level sizes, packed level bits and slots for the first place of every key."""
    distinct, first = np.unique(keys, return_index=True)
    sizes, bits = build_hash(distinct)
    h = PerfectHash(sizes, bits)
    slots = np.zeros(h.n, _SLOT)
    at = h.slots(distinct)
    slots["print"][at], slots["n"][at], slots["start"][at] = key_print(distinct), counts[first], starts[first]
    packed = b"".join(np.packbits(b, bitorder="little").tobytes() for b in bits)
    return np.array(sizes, "<u4").tobytes(), packed, slots.tobytes()


def open_index(levels: bytes, packed: bytes, slots: bytes) -> tuple[PerfectHash, np.ndarray]:
    sizes = [int(x) for x in np.frombuffer(levels, "<u4")]
    bits, at = [], 0
    for s in sizes:
        n = -(-s // 8)
        bits.append(np.unpackbits(np.frombuffer(packed, np.uint8, n, at), bitorder="little")[:s].astype(bool))
        at += n
    return PerfectHash(sizes, bits), np.frombuffer(slots, _SLOT)


def find(index: tuple[PerfectHash, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each key is there, its offset in the block and its number of ids."""
    h, slots = index
    at = h.slots(keys)
    there = at >= 0
    there[there] = slots["print"][at[there]] == key_print(keys[there])
    got = slots[np.where(there, at, 0)] if len(slots) else np.zeros(len(keys), _SLOT)
    return there, got["start"].astype(np.int64), got["n"].astype(np.int64)


# --- files --------------------------------------------------------------------------------------


def write(docs: DataFrame, vocabulary: str, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Encodes all documents and writes the shards; ``vocabulary`` is a path that every executor has."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")

    def run(batches):
        enc = encoder(vocabulary)
        shard, block = TaskContext.get().partitionId(), 0
        keys, sizes, ids, held = [], [], [], 0

        def flush():
            k, has = np.array([x or 0 for x in keys], np.int64), np.array([x is not None for x in keys], bool)
            n = np.array(sizes, np.int64)
            levels, bits, slots = index_of(k[has], (np.cumsum(n) - n)[has], n[has])
            low, high = (int(k[has].min()), int(k[has].max())) if has.any() else (None, None)
            row = [shard, block, low, high, len(keys), held, k.tobytes(), n.astype("<i8").tobytes(), levels, bits, slots, np.concatenate(ids).astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            for part in pieces(batch, "text", ENCODE_BYTES):
                found, count = enc.encode(part.column("text").to_pylist())
                cut = np.cumsum(count)
                for key, a, b in zip(part.column("doc_id").to_pylist(), cut - count, cut, strict=True):
                    n = int(b - a) + 1
                    if keys and (held + n > block_ids or (keys[-1] is None) != (key is None)):
                        yield flush()
                        keys, sizes, ids, held, block = [], [], [], 0, block + 1
                    keys.append(key)
                    sizes.append(n)
                    ids += [found[a:b], np.array([END_ID], np.uint32)]
                    held += n
        if keys:
            yield flush()

    # sizes are looked at after every row, as a row has up to some MB
    limits = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "zstd").options(**limits).parquet(path)


_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64())]
    + [(n, pa.binary()) for n in ("keys", "sizes", "levels", "level_bits", "slots", "ids")]
)


def bases(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, base: ids in all blocks before; one row per block, from the files' small columns."""
    b = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "n_ids")
    before = Window.unboundedPreceding, -1
    totals = b.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    totals = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(*before)
    b = b.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return b.join(totals, "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, found_by_key (the perfect hash leads to a
    document of this key)."""

    small = ["shard", "block", "low", "keys", "sizes", "levels", "level_bits", "slots"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time, its ids where the batch has them
                r = {c: v[0].as_py() for c, v in zip(small, batch.select(small).slice(i, 1).columns, strict=True)}
                k, n = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["sizes"], "<i8")
                there, start, count = find(open_index(r["levels"], r["level_bits"], r["slots"]), k)
                own = np.cumsum(n) - n
                first = np.unique(k, return_index=True)[1]
                use_key = np.zeros(len(k), bool)
                use_key[first] = there[first]
                start, count = np.where(use_key, start, own), np.where(use_key, count, n)
                ids = memoryview(batch.column("ids")[i].as_buffer())
                crc = [zlib.crc32(ids[4 * a : 4 * (a + c)]) for a, c in zip(start.tolist(), count.tolist(), strict=True)]
                nulls = np.zeros(len(k), bool) if r["low"] is not None else np.ones(len(k), bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * len(k), pa.int32()), pa.array([r["block"]] * len(k), pa.int32()), pa.array(k, mask=nulls),
                        pa.array(start), pa.array(count), pa.array(crc, pa.int64()), pa.array(there & ~nulls),
                    ],
                    ["shard", "block", "doc_id", "offset", "n_tokens", "ids_crc32", "found_by_key"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "low", "keys", "sizes", "levels", "level_bits", "slots", "ids")
    rows = blocks.mapInArrow(run, "shard int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long, found_by_key boolean")
    return rows.join(bases(spark, path), ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "found_by_key"
    )


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """ids of the asked keys: doc_id, ids. Blocks and keys meet by the blocks' key ranges; a key that the files
    lack has no row."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    near = asked.join(blocks.select("shard", "block", "low", "high"), F.col("doc_id").between(F.col("low"), F.col("high")))
    per_block = near.groupBy("shard", "block").agg(F.collect_list("doc_id").alias("asked"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                k = np.array(r["asked"], np.int64)
                there, start, count = find(open_index(r["levels"], r["level_bits"], r["slots"]), k)
                ids = np.frombuffer(r["ids"], "<u4")
                out = [(int(x), ids[a : a + c].tolist()) for x, t, a, c in zip(k, there, start, count, strict=True) if t]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int64()))], ["doc_id", "ids"]
                )

    wide = blocks.join(per_block, ["shard", "block"]).select("asked", "levels", "level_bits", "slots", "ids")
    return wide.mapInArrow(run, "doc_id long, ids array<long>")


def encoded(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Writes the files and reads every document back from them."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-ids")
    write(docs, vocabulary, path)
    return read(spark, path)
