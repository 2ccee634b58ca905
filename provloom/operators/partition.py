"""Seed components, time segments and subgraph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.functions.timeid import NS
from provloom.operators import ordered
from provloom.session import cut_lineage, shared_folder, written

THETA_NS = 20 * 60 * NS
MIN_NODES, MIN_EDGES, MIN_TYPES = 6, 1, 2


#: rows of one key that a task joins; keys with more are dealt to several
SHARE_ROWS = 1_000_000


def spread_join(many: DataFrame, key: str, few: DataFrame, few_key: str, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Inner join of ``many`` with ``few``, one row per key. A key that many rows have is dealt to as many shares as its rows
    ask for, and its row of ``few`` goes to each of them. Heavy keys are at most rows / share_rows."""
    heavy = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share_rows)
    heavy = cut_lineage(heavy.select(F.col(key).alias("_heavy"), F.ceil(F.col("_n") / share_rows).cast("int").alias("_shares")))
    if heavy.isEmpty():
        return many.join(few, F.col(key) == F.col(few_key))
    salt = F.pmod(F.xxhash64(*many.columns), F.coalesce("_shares", F.lit(1))).cast("int")
    left = many.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_share", salt).drop("_heavy", "_shares")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))
    right = few.join(heavy, F.col(few_key) == F.col("_heavy"), "left").withColumn("_part", each).drop("_heavy", "_shares")
    return left.join(right, (F.col(key) == F.col(few_key)) & (F.col("_share") == F.col("_part"))).drop("_share", "_part")


def owners(nodes: DataFrame, edges: DataFrame, share_rows: int = SHARE_ROWS) -> DataFrame:
    """(node_id, owner): the smallest node id that reaches the node along directed edges, which is
    the seed whose depth-first walk visits it first.

    Labels start as the nodes' own ids and fall. A round takes the nodes whose label fell in the one before: it
    offers their labels along their edges and to the nodes that they label, and takes over the labels of their own
    labels, so that ways halve. Only the labels that fall are written, a table per round below one folder; a node that
    never falls is not written at all, and one whose label is final is not written again."""
    spark = nodes.sparkSession
    hops = written(edges.select("src_id", "dst_id").filter("src_id <> dst_id").distinct())
    folder = shared_folder(spark, "owners")
    fell = hops.groupBy(F.col("dst_id").alias("node_id")).agg(F.min("src_id").alias("owner")).filter("owner < node_id")
    schema = fell.schema
    done = 0
    while True:
        fell.write.parquet(f"{folder}/round={done}")
        fresh = spark.read.schema(schema).parquet(f"{folder}/round={done}")
        if fresh.isEmpty():
            break
        done += 1
        labels = spark.read.schema(schema).parquet(*[f"{folder}/round={i}" for i in range(done)]).groupBy("node_id").agg(F.min("owner").alias("owner"))
        now = fresh.select(F.col("node_id").alias("_at"), F.col("owner").alias("_label"))
        along = hops.join(now, F.col("src_id") == F.col("_at")).select(F.col("dst_id").alias("node_id"), F.col("_label").alias("offer"))
        labelled = spread_join(labels, "owner", now, "_at", share_rows).select("node_id", F.col("_label").alias("offer"))
        above = labels.select(F.col("node_id").alias("_at"), F.col("owner").alias("_label"))
        own = spread_join(fresh, "owner", above, "_at", share_rows).select("node_id", F.col("_label").alias("offer"))
        offers = along.union(labelled).union(own).groupBy("node_id").agg(F.min("offer").alias("offer")).filter("offer < node_id")
        fell = offers.join(labels, "node_id", "left").filter(F.col("owner").isNull() | (F.col("offer") < F.col("owner"))).select("node_id", F.col("offer").alias("owner"))
    if not done:
        return nodes.select("node_id", F.col("node_id").alias("owner"))
    return nodes.select("node_id").join(labels, "node_id", "left").select("node_id", F.coalesce("owner", "node_id").alias("owner"))


def component_edges(nodes: DataFrame, edges: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """Edges per seed component, seed in ``seed``. A component holds the nodes its seed owns and
    their direct successors; its edges are all edges with both ends inside, so an edge between two
    boundary nodes belongs to several components.

    Every edge belongs to the component of its source. The rest join two boundary memberships; each
    edge is expanded from its end with fewer memberships and filtered by the other end."""
    owner = owners(nodes, edges) if owner is None else owner
    own = owner.select(F.col("node_id").alias("src_id"), F.col("owner").alias("seed"))
    dst_own = owner.select(F.col("node_id").alias("dst_id"), F.col("owner").alias("dst_owner"))
    mine = written(edges.join(own, "src_id"))  # read by the result and by the search for boundary nodes
    boundary = written(
        mine.select("seed", "dst_id")
        .distinct()
        .join(dst_own, "dst_id")
        .filter("dst_owner <> seed")
        .select("seed", F.col("dst_id").alias("node_id"))
    )
    load = boundary.groupBy("node_id").agg(F.count(F.lit(1)).alias("load"))
    u = load.select(F.col("node_id").alias("src_id"), F.col("load").alias("src_load"))
    v = load.select(F.col("node_id").alias("dst_id"), F.col("load").alias("dst_load"))
    both = edges.join(u, "src_id").join(v, "dst_id")
    at_src = boundary.withColumnRenamed("node_id", "src_id")
    at_dst = boundary.withColumnRenamed("node_id", "dst_id")
    by_src = both.filter("src_load <= dst_load").join(at_src, "src_id").join(at_dst, ["seed", "dst_id"], "left_semi")
    by_dst = both.filter("src_load > dst_load").join(at_dst, "dst_id").join(at_src, ["seed", "src_id"], "left_semi")
    extra = by_src.unionByName(by_dst).drop("src_load", "dst_load")
    return mine.unionByName(written(extra))


def segment_edges(comp_edges: DataFrame, theta_ns: int = THETA_NS, target_rows: int | None = None) -> DataFrame:
    """Add ``segment``: a component is cut where two consecutive edges lie theta or more apart."""
    return cut_lineage(
        ordered.gap_sessions(comp_edges, ["seed"], ["ts_ns", "line_no"], theta_ns, target_rows=target_rows)
    )


def segment_nodes(seg_edges: DataFrame, keys=("seed", "segment")) -> DataFrame:
    ends = seg_edges.select(*keys, F.explode(F.array("src_id", "dst_id")).alias("node_id"))
    return ends.distinct()


def valid_segments(
    seg_edges: DataFrame,
    nodes: DataFrame,
    min_nodes: int = MIN_NODES,
    min_edges: int = MIN_EDGES,
    min_types: int = MIN_TYPES,
    target_rows: int | None = None,
) -> DataFrame:
    """One row per valid segment: dep_id (dense over components that have one), part_idx,
    total_parts, start_ts, end_ts, n_nodes, n_edges."""
    e = seg_edges.groupBy("seed", "segment").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("ts_ns").alias("start_ts"), F.max("ts_ns").alias("end_ts")
    )
    n = (
        segment_nodes(seg_edges)
        .join(nodes.select("node_id", "type"), "node_id")
        .groupBy("seed", "segment", "type")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("seed", "segment")
        .agg(F.sum("c").alias("n_nodes"), F.count(F.lit(1)).alias("n_types"))
    )
    ok = cut_lineage(
        e.join(n, ["seed", "segment"]).filter(
            (F.col("n_nodes") >= min_nodes) & (F.col("n_edges") >= min_edges) & (F.col("n_types") >= min_types)
        )
    )
    parts = ordered.scan(ok, ["seed"], ["segment"], index="part_idx", target_rows=target_rows)
    totals = ok.groupBy("seed").agg(F.count(F.lit(1)).alias("total_parts"))
    deps = ordered.scan(totals, [], ["seed"], index="dep_id", target_rows=target_rows)
    return (
        parts.join(deps, "seed")
        .withColumn("part_idx", F.col("part_idx") - 1)
        .withColumn("dep_id", F.col("dep_id") - 1)
    )


def subgraph_edges(seg_edges: DataFrame, segments: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Edges of the valid segments with the gap to the edge before, in seconds."""
    keyed = seg_edges.join(segments.select("seed", "segment", "dep_id", "part_idx"), ["seed", "segment"]).drop("prev_ts")
    out = ordered.scan(
        keyed, ["dep_id", "part_idx"], ["ts_ns", "line_no"], lag={"prev_ts": "ts_ns"}, target_rows=target_rows
    )
    gap = F.coalesce(F.col("ts_ns") - F.col("prev_ts"), F.lit(0)) / F.lit(NS)
    return out.withColumn("gap_sec", F.format_string("%.6f", gap.cast("double")))


def subgraph_nodes(seg_edges: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    return (
        segment_nodes(seg_edges)
        .join(segments.select("seed", "segment", "dep_id", "part_idx"), ["seed", "segment"])
        .join(nodes, "node_id")
    )


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node_id, hop): nodes within ``hops`` undirected steps of the start set."""
    und = edges.select("src_id", "dst_id").union(edges.select("dst_id", "src_id"))  # what a step reaches is distinct
    reached = cut_lineage(start.select("node_id").distinct().withColumn("hop", F.lit(0).cast("long")))
    for h in range(1, hops + 1):
        frontier = reached.filter(F.col("hop") == h - 1).select(F.col("node_id").alias("src_id"))
        nxt = und.join(frontier, "src_id", "left_semi").select(F.col("dst_id").alias("node_id")).distinct()
        fresh = nxt.join(reached, "node_id", "left_anti").withColumn("hop", F.lit(h).cast("long"))
        reached = cut_lineage(reached.unionByName(fresh))
    return reached


def _closure(hops: DataFrame, start: DataFrame) -> DataFrame:
    seen = cut_lineage(start.select("node_id").distinct())
    frontier = seen
    while frontier.limit(1).count():
        nxt = hops.join(frontier, hops.a == frontier.node_id, "left_semi").select(F.col("b").alias("node_id")).distinct()
        frontier = cut_lineage(nxt.join(seen, "node_id", "left_anti"))
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def lineage_nodes(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The start nodes with all their ancestors and descendants."""
    e = edges.select("src_id", "dst_id").distinct()
    down = _closure(e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")), start)
    up = _closure(e.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b")), start)
    return down.union(up).distinct()


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members."""
    s = members.select(F.col("node_id").alias("src_id")).distinct()
    d = members.select(F.col("node_id").alias("dst_id")).distinct()
    return edges.join(s, "src_id", "left_semi").join(d, "dst_id", "left_semi")


def cap_flow_neighbours(
    edges: DataFrame, nodes: DataFrame, cap: int, flow_type: str = "NetFlowObject", target_rows: int | None = None
) -> DataFrame:
    """Drop edges to network neighbours beyond the first ``cap`` a node meets, in edge order."""
    flows = nodes.filter(F.col("type") == flow_type).select(F.col("node_id").alias("flow"))
    touch = (
        edges.select(F.col("src_id").alias("node"), F.col("dst_id").alias("flow"), "ts_ns", "line_no")
        .union(edges.select("dst_id", "src_id", "ts_ns", "line_no"))
        .join(flows, "flow", "left_semi")
        .groupBy("node", "flow")
        .agg(F.min(F.struct("ts_ns", "line_no")).alias("f"))
        .select("node", "flow", "f.*")
    )
    over = ordered.scan(touch, ["node"], ["ts_ns", "line_no", "flow"], index="i", target_rows=target_rows).filter(F.col("i") > cap)
    a = over.select(F.col("node").alias("src_id"), F.col("flow").alias("dst_id"))
    b = over.select(F.col("flow").alias("src_id"), F.col("node").alias("dst_id"))
    return edges.join(a, ["src_id", "dst_id"], "left_anti").join(b, ["src_id", "dst_id"], "left_anti")
