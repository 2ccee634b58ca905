"""Prefix trie of conversations, built from adaptive radix trees.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, a big-endian number of fixed width, and a
conversation's key is the ids of its turns behind each other. Distinct keys are sorted over all tasks and cut into
runs of bounded size; each run becomes an adaptive radix tree (nodes of 4, 16, 48 or 256 children that grow, paths
without a branch compressed). Only byte depths that end a turn are nodes of the trie.

In sorted order the conversations below a node are neighbours. A node that holds neither the first nor the last key
of its run is therefore complete and finished there. The others, the two paths at a run's edges, are handed on as
partial sums, two rows per run and depth, and merged in order with a stack. So a first turn that a third of all
conversations share is split over as many runs as its conversations fill.

:func:`rebuilt` gives conversations shared beginnings, as the query asks for it; :func:`trie` takes any sequences.

Defined results: turns are ordered by turn, null first, and equal turns by id; null roles and texts are empty;
repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; a
conversation without turns ends at the root; an empty table gives no rows; other columns do not matter. The key of a
conversation is one value of 16 bytes a turn. The digest of the conversations that end at a node is one SHA-256, so
one task reads their ids, packed beforehand by many."""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.shared import word_count, written

#: bytes of a turn's id
ID_BYTES = 16
#: parameters of the query: conversations whose first turns are shared, and below how many turns
EVERY, SHARED = 20, 4
#: keys and bytes of one tree
RUN_KEYS, RUN_BYTES = 20_000, 8 << 20
#: ids that are packed into one row before they are digested
PACKED = 10_000


# --- sequences ----------------------------------------------------------------------------------


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (id in hex, words of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    t = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.substring(F.sha2(told, 256), 1, 2 * ID_BYTES).alias("id"), word_count(text).alias("words"))
    order = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))  # nulls come first
    return t.groupBy("conv_id").agg(F.transform(order, lambda x: F.struct(x.id.alias("id"), x.words.alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame, every: int = EVERY, shared: int = SHARED) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``every`` in front of its own turns after
    the first h; h is the crc32 of c in decimal modulo ``shared``."""
    heads = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    own = lists.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    front = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(front, rest).alias("turns"))


def keyed(lists: DataFrame) -> DataFrame:
    """conv_id, key, key_id (16 bytes of its SHA-256) and the words of each turn."""
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x.id), ""))
    rows = lists.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x.words).alias("words"))
    return rows.select("conv_id", "key", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("key_id"), "words")


def end_digests(rows: DataFrame) -> DataFrame:
    """key_id and the SHA-256 of the ids of the conversations with that key, ascending, comma-joined."""

    def pack(batches):
        """Runs of ids of one key, as text."""
        key, first, ids = None, None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], ["key_id", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column("key_id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= PACKED):
                    yield row()
                    ids = []
                if not ids:
                    key, first = k, c
                ids.append(str(c))
        if ids:
            yield row()

    def digest(batches):
        key, sha, out = None, None, []

        def handed():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["key_id", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column("key_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            yield handed()
            out = []
        if sha:
            out.append((key, sha.hexdigest()))
        yield handed()

    ids = rows.select("key_id", "conv_id").repartitionByRange("key_id", "conv_id").sortWithinPartitions("key_id", "conv_id")
    packed = ids.mapInArrow(pack, "key_id binary, first long, ids string")
    return packed.repartition("key_id").sortWithinPartitions("key_id", "first").mapInArrow(digest, "key_id binary, ends_sha256 string")


# --- adaptive radix tree ------------------------------------------------------------------------


class Node:
    """A node with up to 4, 16, 48 or 256 children. Up to 16: their bytes in order and the children beside them; 48: a
    place per byte and the children; 256: a child per byte. ``path`` holds the bytes that follow the node's own
    without a branch; ``row`` is the number of the key that ends here."""

    __slots__ = ("kids", "keys", "path", "row", "room")

    def __init__(self, path: bytes, row: int = -1):
        self.path, self.row = path, row
        self.room, self.keys, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            place = self.keys[byte]
            return self.kids[place - 1] if place else None
        place = self.keys.find(byte)
        return self.kids[place] if place >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Adds a child, or exchanges the one that is there."""
        if self.room == 256:
            self.kids[byte] = node
        elif self.room == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.keys[byte] = len(self.kids)
            else:
                self.kids, self.keys, self.room = [self.kids[p - 1] if p else None for p in self.keys], bytearray(), 256
                self.kids[byte] = node
        elif (place := self.keys.find(byte)) >= 0:
            self.kids[place] = node
        elif len(self.kids) < self.room:
            place = sum(k < byte for k in self.keys)
            self.keys.insert(place, byte)
            self.kids.insert(place, node)
        elif self.room == 4:
            self.room = 16
            self.put(byte, node)
        else:
            places = bytearray(256)
            for i, k in enumerate(self.keys):
                places[k] = i + 1
            self.keys, self.room = places, 48
            self.put(byte, node)

    def children(self) -> list[Node]:
        """In order of their bytes."""
        if self.room == 256:
            return [k for k in self.kids if k is not None]
        if self.room == 48:
            return [self.kids[p - 1] for p in self.keys if p]
        return self.kids


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def insert(root: Node, key: bytes, row: int) -> None:
    node, at = root, 0
    while True:
        if not key.startswith(node.path, at):
            same = _common(node.path, key[at : at + len(node.path)])
            low = Node(node.path[same + 1 :], node.row)
            low.room, low.keys, low.kids = node.room, node.keys, node.kids
            byte, node.path, node.row = node.path[same], node.path[:same], -1
            node.room, node.keys, node.kids = 4, bytearray(), []
            node.put(byte, low)
        at += len(node.path)
        if at == len(key):
            node.row = row
            return
        below = node.child(key[at])
        if below is None:
            node.put(key[at], Node(key[at + 1 :], row))
            return
        node, at = below, at + 1


# --- nodes of a run -----------------------------------------------------------------------------

_CLOSED = ["conv_id", "parent_conv_id", "above", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_OPEN = ["task", "run", "place", "id", "words"]
_TYPES = {
    "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "above": pa.binary(), "depth": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "task": pa.int32(), "run": pa.int32(), "place": pa.int64(), "id": pa.binary(), "words": pa.int64(),
}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _ddl(names):
    return ", ".join(f"{c} {_SQL[_TYPES[c]]}" for c in names)


def _batch(rows, names):
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for c, n in zip(columns, names, strict=True)], names)


class _Sums:
    """What is known of the subtree of a radix node: first and last key, members, smallest member; and of the complete
    nodes right below the turn that the node lies in: their number, leaves and saved words."""

    __slots__ = ("first", "last", "n", "least", "tops", "leaves", "saved")


def run_nodes(keys: list[bytes], words: list, n: list[int], least: list[int], ends: list[str], width: int = ID_BYTES):
    """Trie nodes of a sorted run of distinct keys: (closed rows, open rows). An open row has the columns of a closed one
    with sums over complete nodes only, then its place in the run, its id and the words of its last turn."""
    root = Node(keys[0])
    root.row = 0
    for i, key in enumerate(keys[1:], 1):
        insert(root, key, i)

    # from the leaves up
    order, todo = [], [(root, 0)]
    while todo:
        node, above = todo.pop()
        depth = above + len(node.path)
        order.append((node, above, depth))
        todo += [(k, depth + 1) for k in node.children()]
    sums: dict[int, _Sums] = {}

    def turns(node, above, depth):
        """Depths in turns that end within the node's bytes: its own byte is the one before ``above``."""
        start = 0 if node is root else (above - 1) // width + 1
        return range(start, depth // width + 1)

    for node, above, depth in reversed(order):
        s = sums[id(node)] = _Sums()
        below = [sums[id(k)] for k in node.children()]
        rows = [node.row] if node.row >= 0 else []
        s.first = min(rows + [b.first for b in below])
        s.last = max(rows + [b.last for b in below])
        s.n = sum(n[r] for r in rows) + sum(b.n for b in below)
        s.least = min([least[r] for r in rows] + [b.least for b in below])
        s.tops, s.leaves, s.saved = (sum(getattr(b, c) for b in below) for c in ("tops", "leaves", "saved"))
        ended = turns(node, above, depth)
        if len(ended):
            if s.first == 0 or s.last == len(keys) - 1:
                s.tops = s.leaves = s.saved = 0  # handed on by the open rows
            else:
                s.saved += (s.n - 1) * sum(words[s.first][d - 1] for d in ended)
                s.tops, s.leaves = 1, s.leaves or 1

    # from the root down
    closed, opened = [], []
    nothing = hashlib.sha256(b"").hexdigest()
    ids: dict[int, list[bytes]] = {}

    def ids_of(row):
        """Ids of the prefixes of a key at an edge of the run, by depth."""
        if row not in ids:
            sha, out = hashlib.sha256(), []
            for d in range(len(keys[row]) // width + 1):
                out.append(sha.digest()[:16])
                sha.update(keys[row][d * width : (d + 1) * width])
            ids[row] = out
        return ids[row]

    todo = [(root, 0, None, None)]  # node, byte depth above it, parent's smallest member, parent's id if it is open
    while todo:
        node, above, parent, parent_id = todo.pop()
        s = sums[id(node)]
        depth = above + len(node.path)
        ended = turns(node, above, depth)
        below = [sums[id(k)] for k in node.children()]
        if len(ended):
            tops, leaves, saved = (sum(getattr(b, c) for b in below) for c in ("tops", "leaves", "saved"))
            last = ended[-1]
            end = ends[node.row] if node.row >= 0 else None
            if s.first == 0 or s.last == len(keys) - 1:
                edge = 0 if s.first == 0 else len(keys) - 1
                for d in ended:
                    name = ids_of(edge)[d]
                    held = (tops, leaves, saved) if d == last else (0, 0, 0)
                    opened.append((s.least, None, parent_id, d, s.n, *held, end if d == last else None, (0 if edge == 0 else 1 << 40) + d, name, words[s.first][d - 1] if d else 0))
                    parent, parent_id = None, name
            else:
                each = [(s.n - 1) * words[s.first][d - 1] for d in ended]
                from_here = accumulate(reversed(each), initial=saved)  # deepest turn first
                for d, total in zip(ended, list(from_here)[:0:-1], strict=True):
                    deepest = d == last
                    closed.append((s.least, parent, parent_id, d, s.n, tops if deepest else 1, leaves or 1, total, (end or nothing) if deepest else nothing))
                    parent, parent_id = s.least, None
        todo += [(k, depth + 1, parent, parent_id) for k in node.children()]
    opened.sort(key=lambda r: r[9])
    return closed, opened


# --- the trie -----------------------------------------------------------------------------------


def trie(lists: DataFrame, run_keys: int = RUN_KEYS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Nodes of the sequences (conv_id, turns)."""
    spark = lists.sparkSession
    rows = written(keyed(lists), "trie-keys")
    ends = end_digests(rows)
    # a key is told by its id; copies are counted before they meet
    distinct = rows.groupBy("key_id").agg(F.min(F.struct("key", "words")).alias("k"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.join(ends, "key_id").select("k.key", "k.words", "least", "n", "ends_sha256"), "trie-distinct")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // (4 * run_keys)))

    def grow(batches):
        task, held, size, runs = TaskContext.get().partitionId(), [], 0, 0

        def built():
            closed, opened = run_nodes(*(list(c) for c in zip(*held, strict=True)))
            blank = (None,) * len(_OPEN)
            yield _batch([(*r, *blank) for r in closed], _CLOSED + _OPEN)
            yield _batch([(*r[:9], task, runs, *r[9:]) for r in opened], _CLOSED + _OPEN)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "n", "least", "ends_sha256")), strict=True):
                held.append(row)
                size += len(row[0]) * 2
                if len(held) >= run_keys or size >= run_bytes:
                    yield from built()
                    held, size, runs = [], 0, runs + 1
        if held:
            yield from built()

    sorted_keys = distinct.repartitionByRange(parts, "key").sortWithinPartitions("key")
    nodes = written(sorted_keys.mapInArrow(grow, _ddl(_CLOSED + _OPEN)), "trie-nodes")

    def merge(batches):
        """Open rows of all runs in order; each is a node or goes on with the one that is open at its depth."""
        path: list[dict] = []
        out = []

        def close():
            x = path.pop()
            x["n_leaves"] = x["n_leaves"] or 1
            x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
            x["ends_sha256"] = x["ends_sha256"] or hashlib.sha256(b"").hexdigest()
            if path:
                up = path[-1]
                up["n_children"] += 1
                up["n_leaves"] += x["n_leaves"]
                up["saved_tokens"] += x["saved_tokens"]
            out.append(tuple(x[c] for c in (*_CLOSED, "id")))

        for batch in batches:
            for x in batch.to_pylist():
                d = x["depth"]
                if len(path) > d and path[d]["id"] == x["id"]:
                    up = path[d]
                    up["conv_id"] = min(up["conv_id"], x["conv_id"])
                    for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                        up[c] += x[c]
                    up["ends_sha256"] = up["ends_sha256"] or x["ends_sha256"]
                    continue
                while len(path) > d:
                    close()
                path.append(x)
            yield _batch(out, [*_CLOSED, "id"])
            out.clear()
        while path:
            close()
        yield _batch(out, [*_CLOSED, "id"])

    at_edges = nodes.where("id IS NOT NULL").select(*_CLOSED, *_OPEN)  # two rows per run and depth
    merged = at_edges.repartition(1).sortWithinPartitions("task", "run", "place").mapInArrow(merge, _ddl([*_CLOSED, "id"]))
    merged = written(merged, "trie-edges")
    every = nodes.where("id IS NULL").select(*_CLOSED).union(merged.select(*_CLOSED))
    parents = merged.select(F.col("id").alias("above"), F.col("conv_id").alias("up"))
    return every.join(parents, "above", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def prefix_trie(turns: DataFrame, run_keys: int = RUN_KEYS) -> DataFrame:
    return trie(rebuilt(turn_lists(turns)), run_keys)


#: crc32 of the decimal digits of conv_id
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, {_CRC} % {SHARED} AS h,
        list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(concat(length(role), ':', role, text)), 1, {2 * ID_BYTES})) AS s
        FROM t GROUP BY conv_id),
rebuilt AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(list_slice(b.s, 1, o.h), []), list_slice(o.s, o.h + 1, len(o.s))) AS s
            FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {EVERY}),
prefix AS (SELECT conv_id, d, list_slice(s, 1, d) AS p, s[d].text AS last FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(last) AS last FROM prefix GROUP BY p, d),
child AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
own_node AS (SELECT node.*, coalesce(k, 0) AS k, (n - 1) * coalesce(len(regexp_extract_all(last, '[^ 	-]+')), 0) AS saved
             FROM node LEFT JOIN child ON child.p = node.p AND child.d = node.d),
below AS (SELECT list_slice(p, 1, a) AS p, a AS d, count(*) FILTER (k = 0) AS leaves, sum(saved) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own_node) GROUP BY 1, 2),
ends AS (SELECT s AS p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM rebuilt GROUP BY s)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM own_node x JOIN below ON below.p = x.p AND below.d = x.d LEFT JOIN ends ON ends.p = x.p
LEFT JOIN node up ON up.p = list_slice(x.p, 1, x.d - 1) AND up.d = x.d - 1"""
