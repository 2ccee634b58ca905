"""All pairs of two sets of vectors, without a copy of a vector per pair of blocks.

:func:`packed` sorts vectors by key and place and writes them as tiles: one row holds a few thousand unit vectors as one
matrix. :func:`met` joins the tiles of two sets by Spark's nested loop over the written partitions: the tiles are
read again, nothing is shuffled or written per pair of tiles, and a task holds two tiles and their product. A left tile's
matrix goes to the worker with the first tile of a right partition only. What a left tile has
found so far goes along the right tiles of a partition, which come in rising order of their keys, so that a task
hands on the best few of a partition and not of every pair of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.session import cut_lineage

TILE_ROWS = 2048
#: rows of a tile that are multiplied at a time, so that the product stays in a core's cache
PIECE_ROWS = 256
#: of the right tiles that a task reads
PART_BYTES = 64 << 20


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.maximum(n, 1e-12)


def _whole(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def matrix(column) -> np.ndarray:
    """Unit vectors of a list column."""
    column = _whole(column)
    n = pc.list_value_length(column)
    if column.null_count or pc.count_distinct(n).as_py() > 1:
        raise ValueError("vectors must be there and have one length")
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def packed(df: DataFrame, key: str, parts: int, rows: int = TILE_ROWS) -> DataFrame:
    """Tiles of (key, v) and, where they are there, pos and text. Rows of one (key, pos) are in one tile."""
    pos = F.col("pos").cast("long") if "pos" in df.columns else F.lit(0).cast("long")
    text = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    flat = df.select(F.col(key).alias("key"), pos.alias("pos"), text.alias("text"), "v")
    flat = flat.repartitionByRange(parts, "key", "pos").sortWithinPartitions("key", "pos")
    flat = flat.withColumn("own", F.xxhash64("key")).withColumn("run", F.xxhash64("key", "pos"))

    def run(batches):
        part, n, before, held = TaskContext.get().partitionId() << 32, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows > rows:
                starts = changes(held.column("run").to_numpy())[1:]
                if not len(starts):
                    break  # rows of one place stay together
                at = int(starts[max(np.searchsorted(starts, rows, "right") - 1, 0)])
                own, after = held.column("own").slice(at - 1, 2).to_pylist()
                yield tile(held.slice(0, at), part + n, before, own == after)
                n, before, held = n + 1, own, held.slice(at)
        if held is not None:
            yield tile(held, part + n, before, True)

    def tile(t, number, before, goes_on):
        own = t.column("own").to_numpy()
        starts = changes(own)
        m = matrix(t.column("v"))
        keys = _whole(t.column("key")).take(pa.array(starts))
        texts = _whole(t.column("text"))
        place = pc.fill_null(_whole(t.column("pos")), -(1 << 63)).to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([number & 0xFFFFFFFF == 0 or before == own[0]]), pa.array([goes_on]),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts),
                *(pa.array([x.tobytes()], pa.binary()) for x in (starts.astype("<i8"), changes(t.column("run").to_numpy()).astype("<i8"), place.astype("<i8"), m.astype("<f8"))),
            ],
            ["tile", "n", "from_before", "goes_on", "keys", "texts", "starts", "runs", "pos", "m"],
        )

    kind = flat.schema["key"].dataType.simpleString()
    ddl = f"tile long, n int, from_before boolean, goes_on boolean, keys array<{kind}>, texts array<string>, starts binary, runs binary, pos binary, m binary"
    return cut_lineage(flat.mapInArrow(run, ddl))


@dataclass
class Tile:
    number: int
    keys: pa.Array  #: one a segment
    starts: np.ndarray  #: of the segments, rows of one key
    runs: np.ndarray  #: starts of the rows of one place
    pos: np.ndarray
    texts: pa.Array
    m: np.ndarray
    cut: np.ndarray  #: segments whose key may have rows in another tile
    half: np.ndarray | None = None  #: the matrix in half the precision, if it was made

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, side: str, keep: bool) -> Tile:
        """A row's tile; ``keep`` copies it out of the batch."""
        get = lambda c: batch.column(side + c)[i]
        arrays = [np.frombuffer(get(c).as_buffer(), "<i8") for c in ("starts", "runs", "pos")]
        m = np.frombuffer(get("m").as_buffer(), "<f8").reshape(get("n").as_py(), -1)
        keys = get("keys").values
        keys = keys.take(pa.array(np.arange(len(keys))))
        texts = get("texts").values
        if keep:
            arrays, m, texts = [a.copy() for a in arrays], m.copy(), texts.take(pa.array(np.arange(len(texts))))
        cut = np.zeros(len(keys), bool)
        cut[0] |= get("from_before").as_py()
        cut[-1] |= get("goes_on").as_py()
        return cls(get("tile").as_py(), keys, *arrays, texts, m, cut)

    def segment(self) -> np.ndarray:
        """The segment of every row."""
        return np.repeat(np.arange(len(self.keys)), np.diff(np.append(self.starts, len(self.m))))


def shapes(left: DataFrame, right: DataFrame, rows: int | None = None, left_rows: int = TILE_ROWS) -> tuple[int, int, int, int]:
    """Partitions and rows of a tile of the left side, and of the right side. The right side goes to the workers once for
    each left tile, so large left tiles (``left_rows``) suit steps that multiply them piece by piece."""
    one = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    a, b = one(left), one(right)
    cores = left.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-b["n"] * b["d"] * 8 // PART_BYTES))
    wanted = max(1, -(-3 * cores // parts))
    lr = rows or min(left_rows, max(64, -(-a["n"] // wanted)))
    more = max(1, min(max(wanted, -(-a["n"] * a["d"] * 8 // PART_BYTES)), -(-a["n"] // lr)))
    return more, lr, parts, rows or TILE_ROWS


def with_wanted(tiles: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """Left tiles with the wanted pairs (id, ref) of their keys; tiles without any go."""
    per_tile = tiles.select("tile", F.explode("keys").alias("id")).distinct().join(pairs.select("id", "ref").distinct(), "id")
    per_tile = per_tile.groupBy("tile").agg(F.collect_list(F.struct("id", "ref")).alias("want"))
    return cut_lineage(tiles.join(per_tile, "tile").repartition(parts))


def met(
    left: DataFrame, right: DataFrame, ddl: str, start: Callable[[Tile], object],
    step: Callable[[Tile, Tile, object, np.ndarray | None], Iterator[pa.RecordBatch]], finish: Callable[[Tile, object], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """Every left tile meets every right tile, or those that hold a key that it wants. ``step`` gets the left tile, the right
    one, the state of the left one, and which segments are wanted of which (none: all)."""
    some = "want" in left.columns
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).hint("shuffle_replicate_nl")
    if some:
        both = a.join(b, F.arrays_overlap(F.col("l_want")["ref"], F.col("r_keys")))
    else:  # a left tile meets all right tiles of a partition, in their order
        first = F.col("r_tile").bitwiseAND(F.lit(0xFFFFFFFF)) == 0
        both = a.crossJoin(b).withColumn("l_m", F.when(first, F.col("l_m")))

    def run(batches):
        tile, state, rows = None, None, {}
        for batch in batches:
            for i, number in enumerate(batch.column("l_tile").to_pylist()):
                if tile is None or number != tile.number:
                    if tile is not None:
                        yield from finish(tile, state)
                    tile = Tile.of(batch, i, "l_", True)
                    state = start(tile)
                    if some:
                        place = {k: j for j, k in enumerate(tile.keys.to_pylist())}
                        rows = {}
                        for w in batch.column("l_want")[i].as_py():
                            rows.setdefault(w["ref"], []).append(place[w["id"]])
                other, ask = Tile.of(batch, i, "r_", False), None
                if some:
                    ask = np.zeros((len(tile.keys), len(other.keys)), bool)
                    for j, ref in enumerate(other.keys.to_pylist()):
                        ask[rows.get(ref, []), j] = True
                yield from step(tile, other, state, ask)
        if tile is not None:
            yield from finish(tile, state)

    return both.mapInArrow(run, ddl)


def segment_max(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest value of every row in every segment of the columns."""
    if len(starts) > 32:
        return np.maximum.reduceat(s, starts, axis=1)
    return np.stack([s[:, a:b].max(axis=1) for a, b in zip(starts, [*starts[1:], s.shape[1]], strict=True)], axis=1)


def raise_max(tile: Tile, other: Tile, best: np.ndarray) -> None:
    """Raises ``best``, a column for each segment of ``other``, to the largest product of each row of ``tile``. Products of
    halved precision, whose error is bounded for unit vectors, tell which ones can be above; these are made in full."""
    d = tile.m.shape[1]
    error = np.float32((d + 8) * 2.0**-23)
    if tile.half is None:
        tile.half = tile.m.astype(np.float32)
    half = other.m.astype(np.float32).T
    ends = [*other.starts[1:].tolist(), len(other.m)]
    for i in range(0, len(tile.m), PIECE_ROWS):
        s = tile.half[i : i + PIECE_ROWS] @ half
        floor = best[i : i + PIECE_ROWS].astype(np.float32) - error
        for j, (a, z) in enumerate(zip(other.starts.tolist(), ends, strict=True)):
            some = np.flatnonzero(s[:, a:z].max(axis=1) > floor[:, j])
            if len(some):
                row, column = np.nonzero(s[some, a:z] > floor[some, j, None])
                row = i + some[row]
                exact = np.einsum("ij,ij->i", tile.m[row], other.m[a + column])
                np.maximum.at(best[:, j], row, exact)


class Best:
    """Best ``k`` columns of every row over blocks of columns; of equal ones the first stays."""

    def __init__(self, n: int, k: int):
        self.k, self.seen = k, 0
        self.score, self.at = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)

    def add(self, s: np.ndarray) -> None:
        k, n = self.k, min(self.k, s.shape[1])
        rows = np.flatnonzero(s.max(axis=1) > self.score[:, -1])
        if len(rows):
            sub, floor = s[rows], self.score[rows, -1:]
            bound = np.partition(sub, -n, axis=1)[:, -n][:, None]
            r, c = np.nonzero((sub >= bound) & (sub > floor))
            row = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
            score = np.concatenate([self.score[rows].ravel(), sub[r, c]])
            at = np.concatenate([self.at[rows].ravel(), self.seen + c])
            order = np.lexsort((at, -score, row))
            first = np.searchsorted(row[order], np.arange(len(rows)))
            pick = order[first[:, None] + np.arange(k)]
            self.score[rows], self.at[rows] = score[pick], at[pick]
        self.seen += s.shape[1]
