"""N-gram Jaccard join over a prefix tree.

A document's set holds its distinct 5-word shingles. Shingles have one global order, rare ones first, and sets
are their shingles in that order. Two sets whose Jaccard similarity reaches ``PERCENT`` share a shingle among
the first ``n - ceil(t n) + 1`` of either, so the tree of all ordered sets is cut at those shingles: every
prefix shingle roots a subtree of the sets that hold it, and only sets below one root can be similar. Within a
subtree sizes and the lengths that remain below the root bound the overlap that is still possible and prune
pairs before they are written. What is left is compared below hub sets: the sets that met a hub are stored as
a tree, which is walked with the hub's shingles, overlaps along a shared path are counted once, and a branch
is left as soon as the shingles that remain cannot reach the overlap that is asked for.

Steps. (1) Shingles are counted over all documents in ``2 ** SKETCH_BITS`` hash buckets; the counts only
decide the order, results do not depend on them. (2) Every document gives its size, a hash of its set, its
prefix and an odd sketch (bit h is the parity of the shingles that hash to it; differing bits never exceed
differing shingles). Equal sets are one class from here on. (3) Prefix shingles of one class only are dropped.
(4) In every subtree all sets meet a few hubs picked by hash; the links found label classes that are connected.
(5) Every pair of one subtree whose classes have different labels yet is compared. Pairs pass sizes, remaining
lengths, sketches, and the tree walk on whole sets, in that order; each of them only drops pairs that are
proven not to link. So no link between components is lost, and pairs within a group that is already
connected are not listed.

Defined results: null and empty texts have size 0 and stay alone; repeated rows are answered each and share a
component; a null doc_id is never a component's smallest id unless its component has no other; an empty table
gives no rows; extra columns pass by. Shingles are told apart by 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provloom.llm.batches import flat, lower_ascii, mixed, pieces, shingles, span_hashes, words
from provloom.llm.components import components, nearby
from provloom.llm.shared import written

PERCENT = 75
WIDTH = 5
SKETCH_BITS = 21
#: hubs that a set may meet at first
HUBS = 16
#: sets of one tree; a hub with more has several, and its sets are dealt to this many tasks at most
HUB_SETS, HUB_BLOCKS = 256, 64
#: pairs of rows of one subtree that are looked at in one go, some 50 bytes each
PAIRS = 1 << 18
#: ids that may be broadcast, 8 bytes each
BROADCAST_IDS = 1_000_000

_U = np.uint64


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, bounds = flat(column)
    data = lower_ascii(data)
    s, e, doc = words(data, bounds)
    h, of = shingles(span_hashes(data, s, e), doc, len(column), width)
    cut = np.searchsorted(of, np.arange(len(column) + 1))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        x = np.sort(h[a:b])
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x)
    return out


# --- global order -------------------------------------------------------------------------------

#: tasks that add up the bucket counts of all others
_ADDERS = 8


def bucket_ranks(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Rank of every hash bucket, one byte: 0 for usual buckets, else more the more often its shingles occur.
    Counts of all documents; a task hands on ``2 ** SKETCH_BITS`` numbers, a few tasks add them up, then one, and the
    driver gets as many, whatever the corpus. Counts stop at what 32 bits hold."""
    size = 1 << SKETCH_BITS

    def count(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                counts += np.bincount((np.concatenate(sets) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([handed(counts)], pa.binary())], ["counts"])

    def handed(counts):
        return np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes()

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for b in batch.column("counts"):
                total += np.frombuffer(b.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([handed(total)], pa.binary())], ["counts"])

    found = docs.select("text").mapInArrow(count, "counts binary").repartition(_ADDERS).mapInArrow(add, "counts binary")
    row = found.repartition(1).mapInArrow(add, "counts binary").head()
    counts = np.frombuffer(row.counts, np.uint32).astype(np.int64)
    usual = counts.mean()
    often = counts > usual + 2 * np.sqrt(usual) + 1  # a bucket that is full by chance does no harm
    return np.where(often, np.floor(np.log2(np.maximum(counts - usual, 1))) + 1, 0).astype(np.uint8)


def ordered(x: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set in the global order: rank, then hash."""
    return x[np.argsort(ranks[(x >> _U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


# --- classes and sketches -----------------------------------------------------------------------


def class_of(x: np.ndarray) -> int:
    """Hash of a set."""
    a, b = int(x.sum(dtype=_U)), int(mixed(x ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
    return int(mixed(np.array([a], _U) ^ mixed(np.array([(b + len(x)) & (1 << 64) - 1], _U)))[0].astype(np.int64))


def odd_sketch(x: np.ndarray) -> bytes:
    """Parity bits, twice to four times as many as the set has shingles, a power of two."""
    size = max(64, 1 << (2 * len(x) - 1).bit_length()) if len(x) else 64
    at = (mixed(x) & _U(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(bool), bitorder="little").tobytes()


#: words of 64 bits of the small sketch that goes along with subtrees
SMALL = 8


def small_sketch(x: np.ndarray) -> np.ndarray:
    """The odd sketch of 512 bits, whatever the size of the set."""
    at = (mixed(x) & _U(64 * SMALL - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * SMALL) & 1).astype(bool), bitorder="little").view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def needed(a, b, percent: int = PERCENT):
    """Overlap that two sizes need: the least whole i with 100 i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


_ROW_DDL = "n int, cid long, prefix array<long>, sketch binary, small array<long>"


def identified(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n and class of every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), pa.array([class_of(x) for x in sets], pa.int64())], ["doc_id", "n", "cid"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n int, cid long")


def described(docs: DataFrame, ranks, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n, class, prefix (the upper 48 bits of its shingles, in order) and sketch of every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                prefix = [(ordered(x, ranks.value)[: prefix_size(len(x), percent)] >> _U(16)).astype(np.int64) for x in sets]
                lengths = np.cumsum([0, *map(len, prefix)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), pa.array([class_of(x) for x in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64())),
                        pa.array([odd_sketch(x) for x in sets], pa.binary()), pa.array([small_sketch(x) for x in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "cid", "prefix", "sketch", "small"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_ROW_DDL}")


def among(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id: the ids are broadcast while they are few, joined otherwise."""
    n = ids.count()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id")
    ids = ids.select(F.col("doc_id").alias("id"))
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), how).select("row.*")


def without_copies(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(homes, docs, rows): cid, least doc_id and copies of every class of ``rows`` (doc_id, cid), and documents and
    rows without those of another doc_id than their class's least. Rows that share an id or repeat may be left."""
    homes = rows.groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    gone = rows.join(homes.where("copies > 1"), "cid").where("NOT doc_id <=> least").select("doc_id").distinct()
    least = homes.select("least").distinct()
    gone = written(gone.join(least, F.col("doc_id").eqNullSafe(F.col("least")), "left_anti"), "copies")
    return homes, among(docs, gone, "left_anti"), among(rows, gone, "left_anti")


# --- comparison below hubs ----------------------------------------------------------------------


def walk(hub: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[bool]:
    """Which sets link with the hub. The sets, as paths in the global order, form a tree: in order of their
    paths, each shares the path down to its first difference from the one before, with the overlaps
    counted there; a path is left where the shingles that remain cannot reach the overlap needed."""
    held = set(hub.tolist())
    paths = sorted((x.tolist(), i) for i, x in enumerate(sets))
    out = [False] * len(sets)
    before: list[int] = []
    overlap = [0]  # along the path, as far as it was walked
    for path, i in paths:
        shared = 0
        most = min(len(before), len(path), len(overlap) - 1)
        while shared < most and before[shared] == path[shared]:
            shared += 1
        del overlap[shared + 1 :]
        need = int(needed(len(hub), len(path), percent))
        n, at, count = len(path), shared, overlap[shared]
        while at < n and count + n - at >= need:
            count += path[at] in held
            at += 1
            overlap.append(count)
        out[i] = at == n and count >= need
        before = path
    return out


_PAIR = "a long, b long"


def compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, ranks, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    def close(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = na + nb - 2 * needed(na, nb, percent)
            ok = [least_difference(x, y) <= m for x, y, m in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), most.tolist(), strict=True)]
            yield batch.select(["a", "b", "ia", "ib"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: classes.select(*(F.col(c).alias(d + x) for c, d in (("cid", ""), ("n", "n"), ("sketch", "s"), ("least", "i"))))
    kind = dict(classes.dtypes)["least"]
    near = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(close, f"{_PAIR}, ia {kind}, ib {kind}")
    near = written(near, "ngram-near")
    ids = written(near.select(F.explode(F.array("ia", "ib")).alias("doc_id")).distinct(), "ngram-ids")

    def whole(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [x for x in shingle_sets(part.column("text"), width) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(x) for x in sets], pa.int64()), pa.array([ordered(x, ranks.value).tobytes() for x in sets], pa.binary())], ["cid", "shingles"]
                )

    sets = written(among(docs.select("doc_id", "text"), ids, "left_semi").select("text").mapInArrow(whole, "cid long, shingles binary"), "ngram-sets")
    dealt = near.select("a", F.pmod(F.xxhash64("b"), F.lit(HUB_BLOCKS)).cast("int").alias("block"), "b")
    below = dealt.join(sets.withColumnRenamed("cid", "b"), "b").select("a", "block", F.lit(1).alias("below"), "b", "shingles")
    hubs = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("cid", "a"), "a")
    rows = below.union(hubs.select("a", "block", F.lit(0), "a", "shingles")).repartition("a", "block").sortWithinPartitions("a", "block", "below", "b")

    def compare(batches):
        at, hub, names, held, seen = None, None, [], [], None

        def links():
            ok = walk(hub, held, percent)
            mine = [b for b, o in zip(names, ok, strict=True) if o]
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(mine), pa.int64()), pa.array(mine, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, block, below, b, x in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "below", "b", "shingles")), strict=True):
                if held and ((a, block) != at or len(held) >= HUB_SETS):
                    yield links()
                if (a, block) != at:
                    at, seen = (a, block), None
                if not below:
                    hub = np.frombuffer(x, _U)
                elif b != seen:  # repeated rows give a set more than once
                    seen = b
                    names.append(b)
                    held.append(np.frombuffer(x, _U))
        if held:
            yield links()

    return written(rows.mapInArrow(compare, _PAIR), "ngram-links")


# --- the join -----------------------------------------------------------------------------------


def possible(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Whether two sets can link whose first common shingle is at these places: what remains from there on,
    the shingle included, bounds the overlap."""
    need = F.ceil(F.lit(percent) * (n + m) / (100 + percent))
    return F.least(n - pos, m - at) >= need


_AT = pa.schema([("root", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("label", pa.int64())])


def have_partner(n: np.ndarray, pos: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """For rows of one subtree: whether each has a partner. Rows in blocks against all of the subtree, as many at a
    time as ``PAIRS`` allows."""
    left = n - pos
    out = np.zeros(len(n), bool)
    rows = max(1, PAIRS // len(n))
    for i in range(0, len(n), rows):
        j = slice(i, i + rows)
        need = needed(n[j, None], n[None], percent)
        out[j] = ((np.minimum(left[j, None], left[None]) >= need) & (label[j, None] != label[None])).any(1)
    return out


def with_partners(at: DataFrame, percent: int) -> DataFrame:
    """The rows (root, cid, n, pos, label) that may link with a row of another label in their subtree. Rows of a
    subtree stream by in order; what comes out are rows, not pairs."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            root = table.column("root").to_numpy()
            last = int(np.searchsorted(root, root[-1]))  # the last subtree may go on
            rest = table.slice(last)
            if last:
                yield from kept(table.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from kept(rest)

    def kept(table):
        root, n, pos, label = (table.column(c).to_numpy() for c in ("root", "n", "pos", "label"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
        size = np.diff(np.append(first, len(root)))
        keep = np.zeros(len(root), bool)
        two = first[size == 2]
        ok = (label[two] != label[two + 1]) & (np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]) >= needed(n[two], n[two + 1], percent))
        keep[two[ok]] = keep[two[ok] + 1] = True
        for a, k in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if (label[a : a + k] != label[a]).any():
                keep[a : a + k] = have_partner(n[a : a + k], pos[a : a + k], label[a : a + k], percent)
        yield from table.filter(pa.array(keep)).to_batches()

    rows = at.select(*_AT.names).repartition("root").sortWithinPartitions("root")
    return rows.mapInArrow(run, "root long, cid long, n int, pos int, label long")


def linked(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, labels): doc_id, n, cid per row, cid and least doc_id per class, and (node, label) of the
    linked classes."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranks = spark.sparkContext.broadcast(bucket_ranks(docs, width))  # 2 MB
    rows = written(identified(docs, width), "ngram-rows")
    homes, alone, left = without_copies(docs, rows.where("n > 0").select("doc_id", "cid"))
    classes = described(alone, ranks, percent, width).where("n > 0").withColumnRenamed("doc_id", "least")
    if not left.groupBy("cid").count().where("count > 1").isEmpty():  # repeated rows
        classes = classes.dropDuplicates(["cid"])
    classes = written(classes, "ngram-classes")

    # subtrees: the classes of every prefix shingle, each with a hub of its subtree
    at = F.struct(F.xxhash64("cid", F.pmod("root", F.lit(HUBS))).alias("turn"), F.col("cid").alias("hub"), F.col("n").alias("hn"), F.col("pos").alias("hpos"))
    below = Window.partitionBy("root")
    roots = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "root"))
    roots = roots.select("*", F.count(F.lit(1)).over(below).alias("m"), F.min(at).over(below).alias("h")).where("m > 1")
    roots = written(roots.select("root", "cid", "n", "pos", "h.hub", "h.hn", "h.hpos"), "ngram-roots")

    met = roots.where("cid <> hub").where(possible(F.col("n"), F.col("pos"), F.col("hn"), F.col("hpos"), percent))
    pairs = met.select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    found = compared(pairs, classes, docs, ranks, percent, width)
    labels = nearby(found)

    at = roots.select("root", "cid", "n", "pos").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    open_ = written(with_partners(at.withColumn("label", F.coalesce("label", "cid")), percent), "ngram-open")
    open_ = written(open_.join(classes.select("cid", "small"), "cid"), "ngram-open")
    other = open_.select("root", *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "pos", "label", "small")))
    differ = sum((F.bit_count(F.get("small", F.lit(i)).bitwiseXOR(F.get("small2", F.lit(i)))) for i in range(1, SMALL)), F.bit_count(F.get("small", F.lit(0)).bitwiseXOR(F.get("small2", F.lit(0)))))
    cross = open_.join(
        other,
        (open_["root"] == other["root"]) & (F.col("label") < F.col("label2"))
        & possible(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent)
        & (differ <= F.col("n") + F.col("n2") - 2 * F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / (100 + percent))),
    )
    pairs = cross.select(F.col("cid").alias("a"), F.col("cid2").alias("b")).distinct()
    more = compared(pairs, classes, docs, ranks, percent, width)
    return rows, homes.select("cid", "least"), components(found.union(more))


def row_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n, cid, label and component_id of every row; rows without words have neither label nor component."""
    rows, classes, labels = linked(docs, percent, width)
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = written(named, "ngram-named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("cid", "label", "component_id")
    out = rows.join(named, (rows["cid"] == named["cid"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", "n", rows["cid"], "label", "component_id")


def join_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    out = row_components(docs, percent, width)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, one with the smallest doc_id, and all rows without words. All columns. Rows
    that share their doc_id, or have none, are told apart by their texts."""
    found = written(row_components(docs), "ngram-components")
    twice = written(found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "ngram-twice")
    gone = found.where("n > 0 AND NOT doc_id <=> component_id").select("doc_id")
    if twice.isEmpty():
        return among(docs, gone, "left_anti")
    alone = among(among(docs, twice, "left_anti"), gone.distinct(), "left_anti")
    same = among(docs, twice, "left_semi").select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("key"), "text")
    texts = identified(same.select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"])).withColumnRenamed("doc_id", "key")
    same = same.drop("text").join(texts, "key")
    heads = found.where("n > 0 AND doc_id <=> component_id").select("cid", "label", "component_id").distinct()
    heads = same.where("n > 0").join(heads, "cid").where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("label").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # the first by content stays
    return alone.union(same.where("n = 0").select("row.*")).union(heads.select("row.*"))
