"""Graph reduction: directory cascade, anchored merge of network edges, similar files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.functions import network as net
from provloom.functions import paths
from provloom.functions.similarity import FEW, Texts, reaches
from provloom.functions.timeid import NS
from provloom.operators import ordered
from provloom.operators.anchored import anchored_windows
from provloom.session import cut_lineage, written

NETFLOW_WINDOW_NS = NS
SIMILAR_WINDOW_NS = 30 * NS
SIMILAR_THRESHOLD = 0.7
#: files of a block that one task compares; answers on pairs of names that it holds
SIMILAR_ROWS = 20_000
HELD_MATCHES = 50_000_000
# Event types that one network window may merge.
MERGE_EVENTS = (
    "EVENT_CONNECT", "EVENT_SENDTO", "EVENT_RECVFROM", "EVENT_SENDMSG", "EVENT_RECVMSG", "EVENT_ACCEPT", "EVENT_BIND",
)
PROCESS = "SUBJECT_PROCESS"


def process_files(nodes: DataFrame, edges: DataFrame, g: Sequence[str] = (), files: DataFrame | None = None) -> DataFrame:
    """Distinct (proc_id, node_id) pairs of processes and the files they touch, either direction; with the columns
    of ``files`` (node_id and more) if they are given. Edges that carry the types of their nodes need no look-up of them."""
    g = list(g)
    sides = (("src", "dst"), ("dst", "src"))
    if {"src_kind", "dst_kind"} <= set(edges.columns):
        pair = {p: F.struct(F.col(f"{p}_id").alias("proc_id"), F.col(f"{f}_id").alias("node_id")) for p, f in sides}
        ends = [
            F.when((F.col(f"{p}_kind") == PROCESS) & (F.col(f"{f}_kind").contains("FILE") if files is None else F.lit(True)), pair[p])
            for p, f in sides
        ]
        pairs = edges.select(*g, F.explode(F.array(*ends)).alias("e")).filter(F.col("e").isNotNull()).select(*g, "e.*")
        # the join deals by node, which is all that the distinct rows need
        return (pairs if files is None else pairs.join(files, [*g, "node_id"])).distinct()
    ends = [F.struct(F.col(f"{p}_id").alias("proc_id"), F.col(f"{f}_id").alias("node_id")) for p, f in sides]
    pairs = edges.select(*g, F.explode(F.array(*ends)).alias("e")).select(*g, "e.*")
    procs = nodes.filter(F.col("type") == PROCESS).select(*g, F.col("node_id").alias("proc_id"))
    pairs = pairs.join(procs, [*g, "proc_id"], "left_semi").distinct()
    if files is not None:
        return pairs.join(files, [*g, "node_id"])
    return pairs.join(nodes.filter(F.col("type").contains("FILE")).select(*g, "node_id"), [*g, "node_id"], "left_semi").select(*g, "proc_id", "node_id")


def path_files(nodes: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """(node_id, ts_ns, path) of the file nodes."""
    return nodes.filter(F.col("type").contains("FILE")).select(*g, "node_id", "ts_ns", paths.strip_trailing_slash("name").alias("path"))


def touched_files(nodes: DataFrame, edges: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """(proc_id, node_id, ts_ns, path): the files that processes touch, written once for all steps of the cascade."""
    return written(process_files(nodes, edges, g, path_files(nodes, g)))


def cascade_candidates(
    nodes: DataFrame, edges: DataFrame, g: Sequence[str] = (), target_rows: int | None = None, touched: DataFrame | None = None
) -> DataFrame:
    """(parent_path, parent_id, via, own, seen, child_id): a file node that directly follows the node of a directory above
    it in some process's time-ordered file list. ``via`` is the path right below the directory on the way to
    the file, ``own`` its node, ``seen`` its place in first-seen order."""
    g = list(g)
    files = path_files(nodes, g)
    touched = touched_files(nodes, edges, g) if touched is None else touched
    follow = (
        ordered.scan(
            touched, [*g, "proc_id"], ["ts_ns", "node_id"], lag={"parent_id": "node_id", "parent_path": "path"}, target_rows=target_rows,
        )
        .filter(F.col("parent_id").isNotNull())
        .select(*g, "parent_id", "parent_path", F.col("node_id").alias("child_id"), F.col("path").alias("child_path"))
        # only a directory right above some ancestor-or-self of the follower can merge into it
        .filter((F.col("parent_path") != "") & F.expr("startswith(child_path, concat(parent_path, '/'))"))
        .distinct()
    )
    # the node of a path is the last file node with it; paths of one depth go in first-seen order
    per_path = (
        files.filter(F.col("path") != "")
        .groupBy(*g, "path")
        .agg(F.max("node_id").alias("own"), F.min("node_id").alias("seen"))
    )
    # all columns and one key, so that both joins read one shuffle of the paths; a difference is not taken for a second key
    parents = per_path.select(*g, F.col("path").alias("parent_path"), F.col("own").alias("_own"), F.col("seen").alias("_seen"))
    # child path of the merge: the follower's ancestor directly below the parent
    via = F.expr(
        "concat(parent_path, '/', substring_index(substring(child_path, length(parent_path) + 2, length(child_path)), '/', 1))"
    )
    return (
        follow.join(parents, [*g, "parent_path"])
        .filter((F.col("_own") - F.col("parent_id") == 0) & F.col("_seen").isNotNull())
        .withColumn("via", via)
        .join(per_path.withColumnRenamed("path", "via"), [*g, "via"])
        .select(*g, "parent_path", "parent_id", "via", "own", "seen", "child_id")
    )


def standing_nodes(candidates: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """(parent_path, parent_id, stands): the node that stands for every directory of ``candidates`` in the end, its own
    one or that of a file below it.

    What stands for a directory is a function of what stands for the paths below it: the first candidate, by
    ``seen``, whose file stands for its ``via``, else the directory's own node. Directories without an open ``via``
    are settled at once. One that waits for a single path is a table of that path's possible nodes (x) and of
    what follows from each (y), with a default for all others; such tables are composed along chains, so the way
    that a chain's end is away halves every round. Settling and composing are done side by side, and a forest of n
    directories is settled in some log n rounds, however deep its paths are. Every round is one written table of
    the open directories and one of the settled ones."""
    g = list(g)
    q = [*g, "path"]
    rows = candidates.select(
        *g, F.col("parent_path").alias("path"), F.col("parent_id").alias("id"), "via", "own", "seen", F.col("child_id").alias("x"),
        F.col("child_id").alias("y"), F.col("parent_id").alias("otherwise"),
    )
    rows = written(rows)
    # paths without candidates are stood for by their own nodes
    waits = rows.select(*g, F.col("path").alias("via")).distinct().withColumn("_waits", F.lit(True))
    told = rows.join(waits, [*g, "via"], "left").withColumn("_v", F.when(F.col("_waits").isNull(), F.col("own"))).drop("own", "_waits")
    done = None
    while True:
        told = written(told)
        best = told.groupBy(*q).agg(
            F.min(F.when(F.col("_v") == F.col("x"), F.struct("seen", "y"))).alias("_b"), F.first("id").alias("_id"), F.first("otherwise").alias("_o"),
        )
        open_ = told.filter(F.col("_v").isNull()).drop("_v").join(best.drop("_id", "_o"), q)
        open_ = open_.filter(F.col("_b").isNull() | (F.col("seen") < F.col("_b.seen"))).withColumn("otherwise", F.coalesce("_b.y", "otherwise")).drop("_b")
        open_ = written(open_)
        new = best.join(open_.select(*q).distinct(), q, "left_anti")
        settled = written(new.select(*q, F.col("_id").alias("id"), F.coalesce("_b.y", "_o").alias("stands")))
        if open_.isEmpty():
            done = settled if done is None else done.unionByName(settled)
            break
        # at first most paths wait for one that is settled now; chains are composed from then on
        rows, done = (open_, settled) if done is None else (written(_composed(open_, g)), done.unionByName(settled))
        known = settled.select(*g, F.col("path").alias("via"), F.col("stands").alias("_v"))
        told = rows.join(known, [*g, "via"], "left")
    return done.select(*g, F.col("path").alias("parent_path"), F.col("id").alias("parent_id"), "stands")


def _composed(rows: DataFrame, g: list[str]) -> DataFrame:
    """Directories that wait for one path only, which itself waits for one path only, wait for that one instead."""
    q = [*g, "path"]
    single = rows.groupBy(*q).agg(
        F.min("via").alias("via"), F.max("via").alias("_last"), F.first("id").alias("id"), F.first("seen").alias("seen"), F.first("otherwise").alias("otherwise")
    )
    single = single.filter(F.col("via") == F.col("_last")).drop("_last")
    lower = single.select(*g, F.col("path").alias("via"), F.col("via").alias("_ref"), F.col("otherwise").alias("_low"))
    pairs = single.join(lower, [*g, "via"])  # path waits for via, via for _ref
    values = rows.filter(F.col("x").isNotNull()).select(*g, F.col("path").alias("via"), F.col("x").alias("_x"), F.col("y").alias("_mid"))
    through = pairs.join(values, [*g, "via"]).select(*q, "id", "seen", "otherwise", "_ref", "_x", "_mid")
    rest = pairs.select(*q, "id", "seen", "otherwise", "_ref", F.lit(None).cast("long").alias("_x"), F.col("_low").alias("_mid"))
    own = rows.select(*q, F.col("x").alias("_mid"), "y")
    out = through.union(rest).join(own, [*q, "_mid"], "left").withColumn("y", F.coalesce("y", "otherwise"))
    default = out.filter(F.col("_x").isNull()).select(*q, F.col("y").alias("_d"))
    out = out.join(default, q).select(*q, "id", F.col("_ref").alias("via"), "seen", F.col("_x").alias("x"), "y", F.col("_d").alias("otherwise"))
    # a table that gives its default only would have no row: one row keeps the directory, and its answer, until it is settled
    kept = out.filter((F.col("x").isNull()) | (F.col("y") != F.col("otherwise")))
    return rows.join(pairs.select(*q), q, "left_anti").select(*kept.columns).union(kept)


def cascade_merges(
    nodes: DataFrame, edges: DataFrame, g: Sequence[str] = (), target_rows: int | None = None, touched: DataFrame | None = None
) -> DataFrame:
    """(parent_id, parent_path, child_id): directory nodes that a file below them absorbs.

    A parent merges into the first qualifying child path (deepest paths first): the node standing
    for the child path directly follows the parent in some process's time-ordered file list and is
    not older. A path that merged is from then on stood for by its child, so chains collapse."""
    stands = standing_nodes(cascade_candidates(nodes, edges, g, target_rows, touched), g)
    return stands.filter(F.col("stands") != F.col("parent_id")).select(*g, "parent_id", "parent_path", F.col("stands").alias("child_id"))


def shared_processes(
    merges: DataFrame, nodes: DataFrame, edges: DataFrame, g: Sequence[str] = (), touched: DataFrame | None = None
) -> DataFrame:
    """(parent_id, child_id, proc_id): processes next to both nodes of a merge."""
    g = list(g)
    pf = process_files(nodes, edges, g) if touched is None else touched.select(*g, "proc_id", "node_id")
    p = pf.withColumnRenamed("node_id", "parent_id")
    c = pf.withColumnRenamed("node_id", "child_id")
    return merges.join(p, [*g, "parent_id"]).join(c, [*g, "child_id", "proc_id"], "left_semi")


def cascade_open_edges(edges: DataFrame, shared: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """Main flavour: EVENT_OPEN edges from shared processes into the merged parent go."""
    g = list(g)
    gone = shared.select(
        *g, F.col("proc_id").alias("src_id"), F.col("parent_id").alias("dst_id"), F.lit("EVENT_OPEN").alias("edge_type")
    ).distinct()
    return edges.join(gone, [*g, "src_id", "dst_id", "edge_type"], "left_anti")


def cascade_strip(
    nodes: DataFrame, edges: DataFrame, shared: DataFrame, g: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Audit flavour: every edge between a shared process and the parent goes, both ways; a parent
    left without edges goes too."""
    g = list(g)
    a = shared.select(*g, F.col("proc_id").alias("src_id"), F.col("parent_id").alias("dst_id")).distinct()
    b = a.select(*g, F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    kept = written(edges.join(a.union(b), [*g, "src_id", "dst_id"], "left_anti"))  # read by the result and by the search for orphans
    alive = kept.select(*g, F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    parents = shared.select(*g, F.col("parent_id").alias("node_id")).distinct()
    orphans = parents.join(alive, [*g, "node_id"], "left_anti")
    return nodes.join(orphans, [*g, "node_id"], "left_anti"), kept


def removed_edges(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of ``before`` whose key no longer occurs."""
    return before.join(after.select(*keys).distinct(), list(keys), "left_anti")


def cascade_report(merges: DataFrame, shared: DataFrame, removed: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """Per merge: removed and kept path, number of shared processes and of edges removed."""
    g = list(g)
    procs = shared.groupBy(*g, "parent_id").agg(F.countDistinct("proc_id").alias("n_processes"))
    gone = (
        removed.select(*g, F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("parent_id"))
        .groupBy(*g, "parent_id")
        .agg(F.count(F.lit(1)).alias("n_edges_removed"))
    )
    return (
        merges.join(procs, [*g, "parent_id"], "left")
        .join(gone, [*g, "parent_id"], "left")
        .fillna(0, ["n_processes", "n_edges_removed"])
    )


#: names and types of both ends, which labelling and sequences need after the merge
ENDS = ("src", "dst", "src_type", "dst_type")


def flow_windows(
    nodes: DataFrame, edges: DataFrame, window_ns: int = NETFLOW_WINDOW_NS, target_rows: int | None = None
) -> DataFrame:
    """Mergeable network edges with their remote address and the anchor of their window."""
    flows = nodes.filter(F.col("type") == "NetFlowObject").select(
        F.col("node_id").alias("dst_id"), F.col("name").alias("flow_name")
    )
    e = edges.filter(F.col("edge_type").isin(*MERGE_EVENTS)).join(flows, "dst_id")
    e = e.withColumn("remote_ip", net.flow_part(F.col("flow_name"), 2))
    order = ["ts_ns", "pair_ts", "pair_line", "line_no"]
    return anchored_windows(e, ["src_id", "remote_ip"], order, window_ns, target_rows=target_rows)


def merge_windows(windows: DataFrame) -> DataFrame:
    """One row per window of more than one event: type joined from the sorted distinct operations,
    time and target of its first event, target renamed with the sorted distinct remote ports."""
    at = F.struct("ts_ns", "pair_ts", "pair_line", "line_no")
    port = net.flow_part(F.col("flow_name"), 3)
    ends = [c for c in ENDS if c in windows.columns]
    w = windows.groupBy("src_id", "remote_ip", "anchor").agg(
        F.count(F.lit(1)).alias("n_events"),
        # operations and ports are small closed vocabularies
        F.array_join(F.array_sort(F.collect_set(F.replace("edge_type", F.lit("EVENT_"), F.lit("")))), "_").alias("edge_type"),
        F.array_join(F.array_sort(F.collect_set(F.when(~port.isin(*net.NO_PORT), port))), "_").alias("_ports"),
        F.min_by(F.struct("dst_id", "flow_name", "line_no", *ends), at).alias("_rep"),
    )
    name = F.concat_ws(
        "_",
        net.flow_part(F.col("_rep.flow_name"), 0),
        net.flow_part(F.col("_rep.flow_name"), 1),
        F.col("remote_ip"),
        F.when(F.col("_ports") != "", F.col("_ports")).otherwise("null"),
    )
    return (
        w.filter("n_events > 1")
        .withColumn("ts_ns", F.col("anchor"))
        .withColumn("dst_id", F.col("_rep.dst_id"))
        .withColumn("line_no", F.col("_rep.line_no"))
        .withColumn("dst_name", name)
        .withColumns({c: F.col(f"_rep.{c}") for c in ends})
        .drop("_ports", "_rep")
    )


def reduce_flows(
    nodes: DataFrame, edges: DataFrame, window_ns: int = NETFLOW_WINDOW_NS, target_rows: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merged windows) after the anchored merge; flow nodes whose edges were all
    merged away go. A node that stands for several windows takes the name of the last one."""
    windows = cut_lineage(flow_windows(nodes, edges, window_ns, target_rows))
    merged = cut_lineage(merge_windows(windows))
    in_merge = windows.join(merged.select("src_id", "remote_ip", "anchor"), ["src_id", "remote_ip", "anchor"], "left_semi")
    kept = edges.join(in_merge.select("line_no", "src_id", "dst_id"), ["line_no", "src_id", "dst_id"], "left_anti")
    columns = ["src_id", "dst_id", "edge_type", "ts_ns", "line_no", *[c for c in ENDS if c in edges.columns]]
    out_edges = kept.select(*columns).unionByName(merged.select(*columns))
    renamed = merged.groupBy(F.col("dst_id").alias("node_id")).agg(
        F.max_by("dst_name", F.struct("src_id", "ts_ns")).alias("_name")
    )
    alive = out_edges.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    away = in_merge.select(F.col("dst_id").alias("node_id")).distinct().join(alive, "node_id", "left_anti")
    out_nodes = (
        nodes.join(away, "node_id", "left_anti")
        .join(renamed, "node_id", "left")
        .withColumn("name", F.coalesce("_name", "name"))
        .drop("_name")
    )
    return out_nodes, out_edges, merged


@lru_cache(maxsize=1 << 16)
def _alike(a: str, b: str, threshold: float) -> bool:
    return reaches(a, b, threshold, strict=True)


def few_parents(ts: list[int], base: list[str], halo: list[bool], window_ns: int, threshold: float) -> list[int]:
    """As :func:`many_parents`, file by file: arrays cost more than they save in a small block."""
    out = [-1] * len(ts)
    low = 0
    for j, name in enumerate(base):
        while ts[low] + window_ns < ts[j]:
            low += 1
        if not halo[j]:
            for i in range(low, j):
                if _alike(base[i], name, threshold):
                    out[j] = i
                    break
    return out


def many_parents(ts: np.ndarray, base: np.ndarray, halo: np.ndarray, window_ns: int, threshold: float) -> np.ndarray:
    """For every file of a block in order the place of the oldest one before it that is in its window and has a name like
    its own, -1 if there is none or the file is of the halo. Files of one name are compared once: the oldest in reach
    stands for the others."""
    code, names = pd.factorize(base)
    texts = Texts(list(names))
    parent = np.full(len(ts), -1)
    left = np.flatnonzero(~halo)
    last = np.searchsorted(ts, ts + window_ns, "right")
    like: dict[int, np.ndarray] = {}  # names that reach a name
    every = np.arange(len(names))
    for i in range(len(ts)):
        if not len(left):
            break
        mine = left[np.searchsorted(left, i, "right") : np.searchsorted(left, last[i], "left")]
        if len(mine):
            if int(code[i]) not in like:
                if len(like) * len(names) > HELD_MATCHES:
                    like.clear()
                like[int(code[i])] = np.isin(every, texts.reaching(int(code[i]), every, threshold, strict=True))
            taken = mine[like[int(code[i])][code[mine]]]
            if len(taken):
                parent[taken] = i
                left = left[parent[left] < 0]
        if len(left) and left[0] <= i:  # no older file is in reach of these any more
            left = left[np.searchsorted(left, i, "right") :]
    return parent


def similar_parents(
    nodes: DataFrame,
    edges: DataFrame,
    threshold: float = SIMILAR_THRESHOLD,
    window_ns: int = SIMILAR_WINDOW_NS,
    target_rows: int | None = None,
) -> DataFrame:
    """(node_id, parent_id): the earliest earlier file a temp/log/cache file merges into — same
    directory, a shared process, at most ``window_ns`` older, name ratio above the threshold.

    Blocks are (directory, process) runs without a gap above the window; a block above the target
    is cut into slices that also see the rows one window before them, so every file finds its
    earliest partner inside its own slice and no pair is ever written out."""
    pf = process_files(nodes, edges)
    files = (
        nodes.filter(F.col("type").contains("FILE") & (F.coalesce("name", F.lit("")) != ""))
        .withColumn("dir", paths.dirname(F.col("name")))
        .filter((F.col("dir") != "") & paths.is_temp_log_cache(F.col("name")))
        .select("node_id", "ts_ns", "dir", paths.basename(F.col("name")).alias("base"))
    )
    touch = files.join(pf, "node_id")
    keys = ["dir", "proc_id"]
    runs = ordered.gap_sessions(touch, keys, ["ts_ns", "node_id"], window_ns, out="run", strict=True, target_rows=target_rows)
    blocks = [*keys, "run"]
    big_enough = runs.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    files_per_task = target_rows or int(runs.sparkSession.conf.get("spark.provloom.targetRows", "0")) or SIMILAR_ROWS
    cut = ordered.with_slices(runs.join(big_enough, blocks).drop("prev_ts"), blocks, ["ts_ns", "node_id"], files_per_task)
    rows = cut.df.withColumn("halo", F.lit(False))
    if cut.hot:
        # the rows at most one window older than a slice's first row are copied into it
        pieces = cut.df.filter(F.col(ordered.SLICE) >= 0)
        starts = pieces.groupBy(*blocks, ordered.SLICE).agg(F.min("ts_ns").alias("_from"))
        starts = starts.groupBy(*blocks).agg(F.sort_array(F.collect_list(F.struct("_from", ordered.SLICE))).alias("_starts"))
        # one row per block; a row goes on to the later slices that begin within its window, and to no others
        reach = F.filter("_starts", lambda x: (x["_from"] <= F.col("ts_ns") + window_ns) & (x[ordered.SLICE] > F.col(ordered.SLICE)))
        halo = (
            pieces.join(cut_lineage(starts), blocks)
            .withColumn("_into", F.explode(reach))
            .withColumn(ordered.SLICE, F.col("_into")[ordered.SLICE])
            .drop("_starts", "_into")
            .withColumn("halo", F.lit(True))
        )
        rows = rows.unionByName(halo)

    by = cut.by

    def earliest(batches):
        """Blocks one after the other; a block may go on in the next batch."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.zeros(len(pdf) - 1, bool)
            for c in by:
                v = pdf[c].to_numpy()
                new |= (v[1:] != v[:-1]).astype(bool)
            first = np.flatnonzero(np.append(True, new))
            yield in_blocks(pdf.iloc[: first[-1]], first)
            rest = pdf.iloc[first[-1] :]
        if rest is not None and len(rest):
            yield in_blocks(rest, np.array([0, len(rest)]))

    def in_blocks(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        ts, base, halo = pdf["ts_ns"].to_numpy(), pdf["base"].to_numpy(), pdf["halo"].to_numpy(dtype=bool)
        parent = np.full(len(pdf), -1)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a < FEW:
                parent[a:z] = few_parents(ts[a:z].tolist(), base[a:z].tolist(), halo[a:z].tolist(), window_ns, threshold)
            else:
                parent[a:z] = many_parents(ts[a:z], base[a:z], halo[a:z], window_ns, threshold)
            parent[a:z][parent[a:z] >= 0] += a
        found = np.flatnonzero(parent >= 0)
        node = pdf["node_id"].to_numpy()
        return pd.DataFrame({"node_id": node[found], "parent_id": node[parent[found]], "parent_ts": ts[parent[found]]})

    per_process = ordered.sorted_stream(cut.with_df(rows), ["ts_ns", "node_id"]).mapInPandas(
        earliest, "node_id long, parent_id long, parent_ts long"
    )
    return per_process.groupBy("node_id").agg(F.min(F.struct("parent_ts", "parent_id")).alias("p")).select(
        "node_id", F.col("p.parent_id").alias("parent_id"), F.col("p.parent_ts").alias("parent_ts")
    )


def representatives(parents: DataFrame) -> DataFrame:
    """(node_id, rep_id, parent_id, parent_ts): chains followed to their root by pointer doubling."""
    state = cut_lineage(parents.select("node_id", F.col("parent_id").alias("rep_id"), "parent_id", "parent_ts"))
    while True:
        up = state.select(F.col("node_id").alias("rep_id"), F.col("rep_id").alias("_up"))
        nxt = cut_lineage(state.join(up, "rep_id", "left"))
        moved = nxt.filter(F.col("_up").isNotNull()).limit(1).count()
        state = nxt.select("node_id", F.coalesce("_up", "rep_id").alias("rep_id"), "parent_id", "parent_ts")
        if not moved:
            return state


def reduce_similar(
    nodes: DataFrame, edges: DataFrame, reps: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Merged files go; their edges move to the representative unless it already has one with the
    same neighbour and type; edges of a file to itself are dropped."""
    node_ts = nodes.select(F.col("node_id").alias("_o"), F.col("ts_ns").alias("_ots"))
    m = reps.join(node_ts, reps.node_id == F.col("_o")).select(
        "node_id", "rep_id", F.struct("parent_ts", "parent_id", "_ots", "node_id").alias("_turn")
    )
    s = m.select(F.col("node_id").alias("src_id"), F.col("rep_id").alias("_s"), F.col("_turn").alias("_st"))
    d = m.select(F.col("node_id").alias("dst_id"), F.col("rep_id").alias("_d"), F.col("_turn").alias("_dt"))
    e = edges.join(s, "src_id", "left").join(d, "dst_id", "left")
    stay = e.filter(F.col("_s").isNull() & F.col("_d").isNull()).drop("_s", "_d", "_st", "_dt")
    moved = (
        e.filter(F.col("_s").isNotNull() | F.col("_d").isNotNull())
        .withColumn("src_id", F.coalesce("_s", "src_id"))
        .withColumn("dst_id", F.coalesce("_d", "dst_id"))
        .filter("src_id <> dst_id")
        .withColumn("_turn", F.coalesce("_st", "_dt"))
        .drop("_s", "_d", "_st", "_dt")
    )
    key = ["src_id", "dst_id", "edge_type"]
    rest = [c for c in edges.columns if c not in key]
    first = (
        moved.join(stay.select(*key).distinct(), key, "left_anti")
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct("_turn", "ts_ns", "line_no")).alias("v"))
        .select(*key, "v.*")
    )
    kept = nodes.join(reps.select("node_id"), "node_id", "left_anti")
    return kept, stay.unionByName(first)


def reduction_summary(stages: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Node and edge counts after each named stage."""
    out = None
    for i, (name, (n, e)) in enumerate(stages.items()):
        row = (
            n.agg(F.count(F.lit(1)).alias("n_nodes"))
            .join(e.agg(F.count(F.lit(1)).alias("n_edges")))
            .select(F.lit(i).cast("long").alias("step"), F.lit(name).alias("stage"), "n_nodes", "n_edges")
        )
        out = row if out is None else out.unionByName(row)
    return out


def reduce_graph(
    nodes: DataFrame, edges: DataFrame, window_ns: int = NETFLOW_WINDOW_NS, target_rows: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three reductions in order; also the summary of counts."""
    touched = touched_files(nodes, edges)
    merges = cascade_merges(nodes, edges, target_rows=target_rows, touched=touched)
    shared = shared_processes(merges, nodes, edges, touched=touched)
    e1 = written(cascade_open_edges(edges, shared))
    n2, e2, _ = reduce_flows(nodes, e1, window_ns, target_rows)
    n2, e2 = written(n2), written(e2)
    reps = representatives(similar_parents(n2, e2, target_rows=target_rows))
    n3, e3 = reduce_similar(n2, e2, reps)
    n3, e3 = written(n3), written(e3)
    summary = reduction_summary(
        {"start": (nodes, edges), "directory cascade": (nodes, e1), "network merge": (n2, e2), "similar files": (n3, e3)}
    )
    return n3, e3, summary
