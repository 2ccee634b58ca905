"""Graph construction, partitioning and reach over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from provloom.functions.timeid import NS
from provloom.operators import build, label, ordered, partition
from provloom.plans.registry import named
from provloom.plans.views import query, view
from provloom.session import written

HOUR = 3600 * NS
THETA = 12 * HOUR


def _nodes_sql(edge: str) -> str:
    return f"""ends AS (
      SELECT src AS uuid, src_type AS type, ts_ns, line_no, 0 AS role FROM {edge}
      UNION ALL SELECT dst, dst_type, ts_ns, line_no, 1 FROM {edge}),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts_ns, line_no, role) AS rn FROM ends),
    nodes AS MATERIALIZED (SELECT uuid, type, ts_ns, row_number() OVER (ORDER BY ts_ns, line_no, role) - 1 AS node_id
              FROM firsts WHERE rn = 1)"""


def _kept_sql(edge: str) -> str:
    return f"""ranked AS (
      SELECT *, first_value(edge_type) OVER w AS first_type, row_number() OVER w AS rn FROM {edge}
      WINDOW w AS (PARTITION BY src, dst ORDER BY ts_ns, line_no)),
    kept AS MATERIALIZED (SELECT src, dst, src_type, dst_type, edge_type, ts_ns, line_no,
                    row_number() OVER (PARTITION BY src, dst ORDER BY ts_ns, line_no) - 1 AS edge_key
             FROM ranked WHERE rn = 1 OR NOT contains(first_type, edge_type))"""


_SEGMENTS_SQL = f"""{_nodes_sql('host_edge')}, {_kept_sql('host_edge')},
    gapped AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY src ORDER BY ts_ns, line_no) AS gap FROM kept),
    cut AS (SELECT *, sum(CASE WHEN gap >= {THETA} THEN 1 ELSE 0 END)
                      OVER (PARTITION BY src ORDER BY ts_ns, line_no ROWS UNBOUNDED PRECEDING) AS segment FROM gapped),
    seg AS (SELECT src, segment, min(ts_ns) AS start_ts, max(ts_ns) AS end_ts, count(*) AS n_edges,
                   1 + count(DISTINCT dst) AS n_nodes, 1 + count(DISTINCT dst_type) AS n_types
            FROM cut GROUP BY src, segment),
    valid AS (SELECT * FROM seg WHERE n_nodes >= 6 AND n_edges >= 1 AND n_types >= 2),
    part AS (SELECT v.*, n.node_id AS seed, dense_rank() OVER (ORDER BY n.node_id) - 1 AS dep_id,
                    row_number() OVER (PARTITION BY v.src ORDER BY v.segment) - 1 AS part_idx,
                    count(*) OVER (PARTITION BY v.src) AS total_parts
             FROM valid v JOIN nodes n ON n.uuid = v.src)"""


def host_graph(spark, sf):
    return build.build_graph(view(spark, sf, "host_edge"))


def host_segments(spark, sf):
    """(nodes, segment edges, segments) of the user graph."""
    nodes, edges = host_graph(spark, sf)
    seg = partition.segment_edges(partition.component_edges(nodes, edges), THETA)
    return nodes, seg, partition.valid_segments(seg, nodes)


@named(
    "subgraph_summary",
    f"""WITH {_SEGMENTS_SQL}
    SELECT dep_id, part_idx, total_parts, src AS seed_uuid, start_ts, end_ts, n_nodes, n_edges FROM part""",
)
def subgraph_summary(spark, sf):
    """End to end: edges, parallel-edge rule, seed components, time segments, numbering, summary."""
    nodes, _, segments = host_segments(spark, sf)
    seed = nodes.select(F.col("node_id").alias("seed"), F.col("uuid").alias("seed_uuid"))
    return segments.join(seed, "seed").select(
        "dep_id", "part_idx", "total_parts", "seed_uuid", "start_ts", "end_ts", "n_nodes", "n_edges"
    )


@named(
    "subgraph_edges_with_gaps",
    f"""WITH {_SEGMENTS_SQL}
    SELECT p.dep_id, p.part_idx, c.src, c.dst, c.edge_type, c.ts_ns, c.line_no,
           printf('%.6f', coalesce(c.ts_ns - lag(c.ts_ns) OVER (PARTITION BY p.dep_id, p.part_idx ORDER BY c.ts_ns, c.line_no), 0)
                  / 1000000000.0) AS gap_sec
    FROM cut c JOIN part p ON c.src = p.src AND c.segment = p.segment""",
)
def subgraph_edges_with_gaps(spark, sf):
    _, seg, segments = host_segments(spark, sf)
    return partition.subgraph_edges(seg, segments).select(
        "dep_id", "part_idx", "src", "dst", "edge_type", "ts_ns", "line_no", "gap_sec"
    )


@named(
    "subgraph_nodes",
    f"""WITH {_SEGMENTS_SQL},
    members AS (SELECT DISTINCT p.dep_id, p.part_idx, e.uuid FROM part p
                JOIN (SELECT src, segment, src AS uuid FROM cut UNION ALL SELECT src, segment, dst FROM cut) e
                ON e.src = p.src AND e.segment = p.segment)
    SELECT m.dep_id, m.part_idx, n.node_id, n.uuid, n.type, n.ts_ns FROM members m JOIN nodes n ON n.uuid = m.uuid""",
)
def subgraph_nodes(spark, sf):
    nodes, seg, segments = host_segments(spark, sf)
    return partition.subgraph_nodes(seg, segments, nodes).select(
        "dep_id", "part_idx", "node_id", "uuid", "type", "ts_ns"
    )


@named("node_numbering", f"WITH {_nodes_sql('trade_edge')} SELECT uuid, type, ts_ns, node_id FROM nodes")
def node_numbering(spark, sf):
    return build.number_nodes(view(spark, sf, "trade_edge"))


@named("parallel_edge_rule", f"WITH {_kept_sql('host_edge')} SELECT src, dst, edge_type, ts_ns, line_no, edge_key FROM kept")
def parallel_edge_rule(spark, sf):
    return build.parallel_edges(view(spark, sf, "host_edge")).select(
        "src", "dst", "edge_type", "ts_ns", "line_no", "edge_key"
    )


@named(
    "earliest_edge_per_type",
    "SELECT src, dst, edge_type, min(ts_ns) AS ts_ns FROM host_edge GROUP BY src, dst, edge_type",
)
def earliest_edge_per_type(spark, sf):
    return build.earliest_edges(view(spark, sf, "host_edge"))


@named(
    "gap_sessions",
    f"""WITH g AS (SELECT src, line_no, ts_ns, lag(ts_ns) OVER (PARTITION BY src ORDER BY ts_ns, line_no) AS prev_ts FROM host_edge)
    SELECT src, line_no, ts_ns, prev_ts,
           CAST(sum(CASE WHEN ts_ns - prev_ts >= {6 * HOUR} THEN 1 ELSE 0 END)
                OVER (PARTITION BY src ORDER BY ts_ns, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g""",
)
def gap_sessions(spark, sf):
    e = view(spark, sf, "host_edge").select("src", "line_no", "ts_ns")
    return ordered.gap_sessions(e, ["src"], ["ts_ns", "line_no"], 6 * HOUR)


@named(
    "gap_to_previous_seconds",
    """SELECT src, line_no, coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY src ORDER BY ts_ns, line_no), 0) / 1000000000.0 AS gap_sec
    FROM host_edge""",
)
def gap_to_previous_seconds(spark, sf):
    e = ordered.scan(view(spark, sf, "host_edge").select("src", "line_no", "ts_ns"), ["src"], ["ts_ns", "line_no"], lag={"p": "ts_ns"})
    return e.select("src", "line_no", (F.coalesce(F.col("ts_ns") - F.col("p"), F.lit(0)) / F.lit(1e9)).alias("gap_sec"))


@named(
    "endpoint_names",
    """SELECT e.line_no, e.src, e.dst, coalesce(s.name, 'UNKNOWN') AS src_name, coalesce(d.name, 'UNKNOWN') AS dst_name
    FROM trade_edge e
    LEFT JOIN (SELECT concat('c', CAST(c_custkey AS STRING)) AS uuid, c_name AS name FROM customer) s ON s.uuid = e.src
    LEFT JOIN (SELECT concat('f', CAST(p_partkey AS STRING)) AS uuid, p_name AS name FROM part) d ON d.uuid = e.dst""",
)
def endpoint_names(spark, sf):
    names = query(
        spark, sf,
        """SELECT concat('c', CAST(c_custkey AS STRING)) AS uuid, c_name AS name FROM customer
        UNION ALL SELECT concat('f', CAST(p_partkey AS STRING)) AS uuid, p_name AS name FROM part""",
    )
    return build.endpoint_names(view(spark, sf, "trade_edge"), names).select("line_no", "src", "dst", "src_name", "dst_name")


@named(
    "second_name_source",
    """WITH a AS (SELECT concat(uuid, 'x') AS uuid, name FROM host_name WHERE type <> 'SUBJECT_PROCESS' UNION ALL SELECT concat('p', CAST(CAST(substr(uuid, 2) AS BIGINT) * 2 AS VARCHAR)), name FROM host_name WHERE type = 'SUBJECT_PROCESS'),
    b AS (SELECT DISTINCT concat('p', CAST(user_id AS STRING)) AS uuid,
                 CASE WHEN user_id % 5 = 0 THEN 'N/A' WHEN user_id % 7 = 0 THEN '' ELSE concat('extra', CAST(user_id AS STRING)) END AS name
          FROM host_event)
    SELECT uuid, name FROM a UNION ALL
    SELECT uuid, name FROM b WHERE name <> '' AND name <> 'N/A' AND uuid NOT IN (SELECT uuid FROM a)""",
)
def second_name_source(spark, sf):
    # the second source has ids that the first lacks, and the other way round
    a = query(
        spark, sf,
        """SELECT concat(uuid, 'x') AS uuid, name FROM host_name WHERE type <> 'SUBJECT_PROCESS'
        UNION ALL SELECT concat('p', CAST(CAST(substr(uuid, 2) AS BIGINT) * 2 AS STRING)), name FROM host_name WHERE type = 'SUBJECT_PROCESS'""",
    )
    b = query(
        spark, sf,
        """SELECT DISTINCT concat('p', CAST(user_id AS STRING)) AS uuid,
        CASE WHEN user_id % 5 = 0 THEN 'N/A' WHEN user_id % 7 = 0 THEN '' ELSE concat('extra', CAST(user_id AS STRING)) END AS name
        FROM host_event""",
    )
    return build.merge_names(a, b)


_REACH_SQL = f"""{_nodes_sql('trade_edge')},
    hop AS (SELECT DISTINCT s.node_id AS a, d.node_id AS b FROM trade_edge e
            JOIN nodes s ON s.uuid = e.src JOIN nodes d ON d.uuid = e.dst),
    reach AS (SELECT node_id AS v, node_id AS r FROM nodes
              UNION ALL SELECT b, a FROM hop
              UNION ALL SELECT h2.b, h1.a FROM hop h1 JOIN hop h2 ON h1.b = h2.a),
    owner AS (SELECT v AS node_id, min(r) AS owner FROM reach GROUP BY v)"""


def trade_graph(spark, sf, *keep):
    """The graph; its edges have the ids of their ends and the columns named."""
    return build.build_graph(written(view(spark, sf, "trade_edge")), keep=keep)


@named("seed_owners", f"WITH {_REACH_SQL} SELECT node_id, owner FROM owner")
def seed_owners(spark, sf):
    """Smallest node id that reaches each node (customer -> order -> part / supplier)."""
    return partition.owners(*trade_graph(spark, sf))


@named(
    "component_sizes",
    f"""WITH {_REACH_SQL}, {_kept_sql('trade_edge')},
    e AS (SELECT k.line_no, s.node_id AS a, d.node_id AS b, k.ts_ns FROM kept k
          JOIN nodes s ON s.uuid = k.src JOIN nodes d ON d.uuid = k.dst),
    member AS (SELECT owner AS seed, node_id FROM owner
               UNION SELECT o.owner, h.b FROM hop h JOIN owner o ON o.node_id = h.a),
    ce AS (SELECT m.seed, e.line_no, e.ts_ns FROM e JOIN member m ON m.node_id = e.a
           JOIN member m2 ON m2.seed = m.seed AND m2.node_id = e.b)
    SELECT seed, count(*) AS n_edges, min(ts_ns) AS start_ts, max(ts_ns) AS end_ts FROM ce GROUP BY seed""",
)
def component_sizes(spark, sf):
    """Edges per seed component; an edge between two boundary nodes counts in every component."""
    e = partition.component_edges(*trade_graph(spark, sf, "ts_ns"))
    return e.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("ts_ns").alias("start_ts"), F.max("ts_ns").alias("end_ts")
    )


@named(
    "component_boundary",
    f"""WITH {_REACH_SQL},
    member AS (SELECT owner AS seed, node_id FROM owner
               UNION SELECT o.owner, h.b FROM hop h JOIN owner o ON o.node_id = h.a)
    SELECT seed, count(*) AS n_members, count(CASE WHEN o.owner <> m.seed THEN 1 END) AS n_boundary
    FROM member m JOIN owner o ON o.node_id = m.node_id GROUP BY seed""",
)
def component_boundary(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    own = partition.owners(nodes, edges)
    src = own.select(F.col("node_id").alias("src_id"), F.col("owner").alias("seed"))
    members = own.select(F.col("owner").alias("seed"), "node_id").union(
        edges.join(src, "src_id").select("seed", F.col("dst_id").alias("node_id"))
    ).distinct()
    return members.join(own, "node_id").groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("owner") != F.col("seed")).alias("n_boundary")
    )


@named(
    "neighbourhood_two_hops",
    f"""WITH {_nodes_sql('trade_edge')},
    hop AS (SELECT s.node_id AS a, d.node_id AS b FROM trade_edge e JOIN nodes s ON s.uuid = e.src JOIN nodes d ON d.uuid = e.dst),
    und AS (SELECT a, b FROM hop UNION SELECT b, a FROM hop),
    h0 AS (SELECT node_id AS v FROM nodes WHERE uuid LIKE 'c7%'),
    h1 AS (SELECT DISTINCT b AS v FROM und WHERE a IN (SELECT v FROM h0) AND b NOT IN (SELECT v FROM h0)),
    h2 AS (SELECT DISTINCT b AS v FROM und WHERE a IN (SELECT v FROM h1) AND b NOT IN (SELECT v FROM h0) AND b NOT IN (SELECT v FROM h1))
    SELECT v AS node_id, CAST(0 AS BIGINT) AS hop FROM h0 UNION ALL SELECT v, 1 FROM h1 UNION ALL SELECT v, 2 FROM h2""",
)
def neighbourhood_two_hops(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    return partition.neighbourhood(edges, nodes.filter("uuid like 'c7%'"), 2)


@named(
    "lineage_induced_edges",
    f"""WITH {_nodes_sql('trade_edge')}, {_kept_sql('trade_edge')},
    e AS MATERIALIZED (SELECT k.line_no, k.edge_type, s.node_id AS a, d.node_id AS b FROM kept k
          JOIN nodes s ON s.uuid = k.src JOIN nodes d ON d.uuid = k.dst),
    start AS (SELECT node_id AS v FROM nodes WHERE uuid = 'f11'),
    up1 AS MATERIALIZED (SELECT DISTINCT a AS v FROM e WHERE b IN (SELECT v FROM start)),
    up2 AS MATERIALIZED (SELECT DISTINCT a AS v FROM e WHERE b IN (SELECT v FROM up1)),
    member AS MATERIALIZED (SELECT v FROM start UNION SELECT v FROM up1 UNION SELECT v FROM up2)
    SELECT line_no, edge_type, a AS src_id, b AS dst_id FROM e JOIN member x ON x.v = e.a JOIN member y ON y.v = e.b""",
)
def lineage_induced_edges(spark, sf):
    """Ancestors and descendants of one part, and the edges among them."""
    nodes, edges = trade_graph(spark, sf, "line_no", "edge_type")
    members = partition.lineage_nodes(edges, nodes.filter("uuid = 'f11'"))
    return partition.induced_edges(edges, members).select("line_no", "edge_type", "src_id", "dst_id")


@named(
    "flow_neighbour_cap",
    f"""WITH {_nodes_sql('host_edge')}, {_kept_sql('host_edge')},
    touch AS (SELECT src, dst, ts_ns, line_no, row_number() OVER (PARTITION BY src, dst ORDER BY ts_ns, line_no) AS rn
              FROM kept WHERE dst_type = 'NetFlowObject'),
    o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ts_ns, line_no) AS i FROM touch WHERE rn = 1)
    SELECT k.src, k.dst, k.edge_type, k.ts_ns, k.line_no FROM kept k
    WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.src = k.src AND o.dst = k.dst AND o.i > 10)""",
)
def flow_neighbour_cap(spark, sf):
    nodes, edges = host_graph(spark, sf)
    return partition.cap_flow_neighbours(edges, nodes, 10).select("src", "dst", "edge_type", "ts_ns", "line_no")


@named(
    "operation_sets",
    """SELECT src, dst, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS ops, count(*) AS n_edges
    FROM host_edge GROUP BY src, dst""",
)
def operation_sets(spark, sf):
    return build.op_sets(view(spark, sf, "host_edge"))


@named(
    "repeat_edge_counts",
    "SELECT src, edge_type, dst, count(*) AS n_events, min(ts_ns) AS ts_ns FROM host_edge GROUP BY src, edge_type, dst",
)
def repeat_edge_counts(spark, sf):
    return build.repeat_edges(view(spark, sf, "host_edge"))


@named(
    "repeat_edge_event_ids",
    """SELECT src, edge_type, dst, count(*) AS n_ids,
              string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY ts_ns, line_no) AS event_ids
    FROM host_edge GROUP BY src, edge_type, dst""",
)
def repeat_edge_event_ids(spark, sf):
    return build.event_id_lists(view(spark, sf, "host_edge").withColumn("event_id", F.col("line_no")))


@named(
    "graph_totals_per_sample",
    """WITH e AS (SELECT *, edge_type AS tag FROM host_edge),
    ranked AS (SELECT *, first_value(edge_type) OVER w AS ft, row_number() OVER w AS rn FROM e
               WINDOW w AS (PARTITION BY tag, src, dst ORDER BY ts_ns, line_no)),
    kept AS (SELECT * FROM ranked WHERE rn = 1 OR NOT contains(ft, edge_type)),
    n AS (SELECT tag, count(DISTINCT u) AS n_nodes FROM (SELECT tag, src AS u FROM e UNION ALL SELECT tag, dst FROM e) GROUP BY tag)
    SELECT n.tag, n.n_nodes, count(*) AS n_edges FROM n JOIN kept k ON k.tag = n.tag GROUP BY n.tag, n.n_nodes""",
)
def graph_totals_per_sample(spark, sf):
    """One graph per sample tag in one job, with its totals."""
    e = view(spark, sf, "host_edge").withColumn("tag", F.col("edge_type"))
    return build.graph_totals(*build.build_graph(e, ["tag"]), ["tag"])


@named(
    "first_last_seen",
    """SELECT uuid, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts
    FROM (SELECT src AS uuid, ts_ns FROM host_edge UNION ALL SELECT dst, ts_ns FROM host_edge) GROUP BY uuid""",
)
def first_last_seen(spark, sf):
    return build.seen_times(view(spark, sf, "host_edge"))


@named(
    "time_coverage",
    """WITH seen AS (SELECT DISTINCT uuid FROM (SELECT src AS uuid FROM trade_edge UNION ALL SELECT dst FROM trade_edge)),
    ent AS (SELECT concat('c', CAST(c_custkey AS STRING)) AS uuid FROM customer
            UNION ALL SELECT concat('x', CAST(s_suppkey AS STRING)) FROM supplier)
    SELECT count(*) AS n_entities, count(s.uuid) AS n_with_time, round(100.0 * count(s.uuid) / count(*), 1) AS pct
    FROM ent LEFT JOIN seen s ON s.uuid = ent.uuid""",
)
def time_coverage(spark, sf):
    ent = query(
        spark, sf,
        """SELECT concat('c', CAST(c_custkey AS STRING)) AS uuid FROM customer
        UNION ALL SELECT concat('x', CAST(s_suppkey AS STRING)) AS uuid FROM supplier""",
    )
    return build.time_coverage(ent, build.seen_times(view(spark, sf, "trade_edge")))


@named(
    "dictionary_in_first_sight_order",
    """WITH f AS (SELECT edge_type, min(line_no) AS l FROM host_edge WHERE edge_type <> 'EVENT_READ' GROUP BY edge_type)
    SELECT 'EVENT_READ' AS edge_type, CAST(0 AS BIGINT) AS code
    UNION ALL SELECT edge_type, row_number() OVER (ORDER BY l) FROM f""",
)
def dictionary_in_first_sight_order(spark, sf):
    """A saved dictionary extended with the new edge types in order of first sight."""
    e = view(spark, sf, "host_edge")
    saved = e.filter("edge_type = 'EVENT_READ'").select("edge_type", F.lit(0).cast("long").alias("code")).distinct()
    return build.encode_in_order(e, "edge_type", ["line_no"], saved)


@named(
    "map_update_last_wins",
    """SELECT dst, line_no, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ts_ns DESC, line_no DESC) AS rn
    FROM host_edge) WHERE rn = 1""",
)
def map_update_last_wins(spark, sf):
    e = view(spark, sf, "host_edge").select("dst", "ts_ns", "line_no", "edge_type")
    return build.last_value(e, "dst", ["ts_ns", "line_no"]).select("dst", "line_no", "edge_type")


@named(
    "induced_component_edges",
    """WITH m AS (SELECT DISTINCT dst AS uuid FROM host_edge WHERE edge_type = 'EVENT_OPEN'
                  UNION SELECT DISTINCT src FROM host_edge WHERE edge_type = 'EVENT_OPEN' AND ts_ns % 3 = 0)
    SELECT line_no, src, dst FROM host_edge WHERE src IN (SELECT uuid FROM m) AND dst IN (SELECT uuid FROM m)""",
)
def induced_component_edges(spark, sf):
    e = view(spark, sf, "host_edge")
    m = e.filter("edge_type = 'EVENT_OPEN'").select(F.col("dst").alias("node_id")).union(
        e.filter("edge_type = 'EVENT_OPEN' and ts_ns % 3 = 0").select("src")
    )
    ids = e.withColumn("src_id", F.col("src")).withColumn("dst_id", F.col("dst"))
    return partition.induced_edges(ids, m).select("line_no", "src", "dst")
