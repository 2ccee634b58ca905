"""Graph reduction over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from provloom.functions.timeid import NS
from provloom.operators import build, ordered, partition, reduce, sequences
from provloom.operators.anchored import anchored_windows
from provloom.plans.graph_queries import _kept_sql, _nodes_sql
from provloom.plans.registry import named
from provloom.plans.views import view
from provloom.session import cut_lineage, written

# --- directory cascade -------------------------------------------------------------------------

_CASCADE_SQL = f"""{_nodes_sql('walk_edge')}, {_kept_sql('walk_edge')},
    edge AS MATERIALIZED (SELECT k.edge_type, k.ts_ns, k.line_no, s.node_id AS src_id, d.node_id AS dst_id FROM kept k
             JOIN nodes s ON s.uuid = k.src JOIN nodes d ON d.uuid = k.dst),
    pf AS (SELECT DISTINCT e.src_id AS proc, n.node_id, n.ts_ns, n.uuid AS path FROM edge e JOIN nodes n ON n.node_id = e.dst_id
           WHERE n.type = 'FILE'),
    nx AS (SELECT *, lead(node_id) OVER w AS next_id, lead(path) OVER w AS next_path FROM pf
           WINDOW w AS (PARTITION BY proc ORDER BY ts_ns, node_id)),
    cand AS (SELECT *, len(path) - len(replace(path, '/', '')) AS depth FROM nx WHERE starts_with(next_path, concat(path, '/'))),
    low AS (SELECT node_id AS parent_id, path AS parent_path, next_id AS child_id, proc FROM cand WHERE depth = 3),
    high AS (SELECT c.node_id AS parent_id, c.path AS parent_path, c.next_id AS child_id, c.proc
             FROM cand c
             JOIN nodes v ON v.uuid = concat(c.path, '/', split_part(substr(c.next_path, len(c.path) + 2), '/', 1))
             LEFT JOIN low l ON l.parent_path = v.uuid
             WHERE c.depth = 2 AND coalesce(l.child_id, v.node_id) = c.next_id),
    merges AS MATERIALIZED (SELECT * FROM low UNION ALL SELECT * FROM high)"""


def walk_graph(spark, sf, more=()):
    """Nodes and edges of the walks; ``more`` names columns of the edges that are read beside their type and place."""
    keep = ["edge_type", "ts_ns", "line_no", *more]
    nodes, edges = build.build_graph(written(view(spark, sf, "walk_edge")), kinds=True, keep=keep)
    return nodes.withColumn("name", F.col("uuid")), edges


def walk_merges(spark, sf, more=()):
    nodes, edges = walk_graph(spark, sf, more)
    touched = reduce.touched_files(nodes, edges)
    merges = reduce.cascade_merges(nodes, edges, touched=touched)
    return nodes, edges, merges, written(reduce.shared_processes(merges, nodes, edges, touched=touched))


@named("cascade_merges", f"WITH {_CASCADE_SQL} SELECT parent_id, parent_path, child_id FROM merges")
def cascade_merges(spark, sf):
    """Directory nodes absorbed by the file below them, chains included."""
    return walk_merges(spark, sf)[2]


@named(
    "cascade_shared_processes",
    f"WITH {_CASCADE_SQL} SELECT parent_id, child_id, proc AS proc_id FROM merges",
)
def cascade_shared_processes(spark, sf):
    return walk_merges(spark, sf)[3].select("parent_id", "child_id", "proc_id")


@named(
    "cascade_open_edges_dropped",
    f"""WITH {_CASCADE_SQL} SELECT line_no, src_id, dst_id, edge_type FROM edge e
    LEFT JOIN (SELECT DISTINCT parent_id, proc FROM merges) m ON m.parent_id = e.dst_id AND m.proc = e.src_id
    WHERE m.parent_id IS NULL OR edge_type <> 'EVENT_OPEN'""",
)
def cascade_open_edges_dropped(spark, sf):
    _, edges, _, shared = walk_merges(spark, sf)
    return reduce.cascade_open_edges(edges, shared).select("line_no", "src_id", "dst_id", "edge_type")


@named(
    "cascade_strip_nodes",
    f"""WITH {_CASCADE_SQL}, left_edges AS (SELECT * FROM edge e WHERE NOT EXISTS
      (SELECT 1 FROM merges m WHERE m.parent_id = e.dst_id AND m.proc = e.src_id))
    SELECT node_id, uuid FROM nodes WHERE node_id NOT IN (
      SELECT parent_id FROM merges WHERE parent_id NOT IN (SELECT src_id FROM left_edges UNION SELECT dst_id FROM left_edges))""",
)
def cascade_strip_nodes(spark, sf):
    nodes, edges, _, shared = walk_merges(spark, sf)
    return reduce.cascade_strip(nodes, edges, shared)[0].select("node_id", "uuid")


@named(
    "cascade_removed_edges",
    f"""WITH {_CASCADE_SQL} SELECT src_id, dst_id, edge_type, line_no FROM edge e WHERE EXISTS
    (SELECT 1 FROM merges m WHERE m.parent_id = e.dst_id AND m.proc = e.src_id)""",
)
def cascade_removed_edges(spark, sf):
    nodes, edges, _, shared = walk_merges(spark, sf)
    after = reduce.cascade_strip(nodes, edges, shared)[1]
    keys = ["src_id", "dst_id", "edge_type", "line_no"]
    return reduce.removed_edges(edges, after, keys).select(*keys)


@named(
    "cascade_report",
    f"""WITH {_CASCADE_SQL}
    SELECT m.parent_path, c.uuid AS kept_path, CAST(1 AS BIGINT) AS n_processes, count(e.line_no) AS n_edges_removed
    FROM merges m JOIN nodes c ON c.node_id = m.child_id LEFT JOIN edge e ON e.dst_id = m.parent_id AND e.src_id = m.proc
    GROUP BY ALL""",
)
def cascade_report(spark, sf):
    nodes, edges, merges, shared = walk_merges(spark, sf)
    after = reduce.cascade_strip(nodes, edges, shared)[1]
    gone = reduce.removed_edges(edges, after, ["src_id", "dst_id", "edge_type", "line_no"])
    kept = nodes.select(F.col("node_id").alias("child_id"), F.col("uuid").alias("kept_path"))
    return reduce.cascade_report(merges, shared, gone).join(kept, "child_id").select(
        "parent_path", "kept_path", "n_processes", "n_edges_removed"
    )


@named(
    "consecutive_files",
    f"WITH {_CASCADE_SQL} SELECT proc AS proc_id, node_id, next_id FROM nx WHERE next_id IS NOT NULL",
)
def consecutive_files(spark, sf):
    """Files next to each other in a process's time-ordered list."""
    nodes, edges = walk_graph(spark, sf)
    files = nodes.filter(F.col("type").contains("FILE")).select("node_id", "ts_ns")
    pf = written(reduce.process_files(nodes, edges, files=files))  # read by the search for hot processes and by the scan
    n = ordered.scan(pf, ["proc_id"], ["ts_ns", "node_id"], lag={"before": "node_id"})
    return n.filter("before is not null").select("proc_id", F.col("before").alias("node_id"), F.col("node_id").alias("next_id"))


# --- anchored merge of network edges -----------------------------------------------------------

def _flow_sql(edge: str) -> str:
    return f"""RECURSIVE {_nodes_sql(edge)}, {_kept_sql(edge)},
    edge AS (SELECT k.edge_type, k.ts_ns, k.line_no, s.node_id AS src_id, d.node_id AS dst_id, k.src, k.dst AS flow,
                    min(k.ts_ns) OVER (PARTITION BY k.src, k.dst) AS pair_ts,
                    first_value(k.line_no) OVER (PARTITION BY k.src, k.dst ORDER BY k.ts_ns, k.line_no) AS pair_line
             FROM kept k JOIN nodes s ON s.uuid = k.src JOIN nodes d ON d.uuid = k.dst),
    ev AS (SELECT *, split_part(flow, '_', 3) AS remote_ip, split_part(flow, '_', 4) AS port FROM edge
           WHERE edge_type IN ('EVENT_CONNECT', 'EVENT_SENDTO', 'EVENT_RECVFROM', 'EVENT_SENDMSG')),
    anchors AS (
      SELECT src_id, remote_ip, min(ts_ns) AS anchor FROM ev GROUP BY src_id, remote_ip
      UNION ALL
      SELECT src_id, remote_ip, nxt FROM (
        SELECT a.src_id, a.remote_ip,
               (SELECT min(e.ts_ns) FROM ev e WHERE e.src_id = a.src_id AND e.remote_ip = a.remote_ip
                AND e.ts_ns > a.anchor + {NS}) AS nxt FROM anchors a) WHERE nxt IS NOT NULL),
    wins AS (SELECT e.*, a.anchor FROM ev e JOIN anchors a ON a.src_id = e.src_id AND a.remote_ip = e.remote_ip
             AND e.ts_ns >= a.anchor AND e.ts_ns <= a.anchor + {NS}),
    rep AS (SELECT *, row_number() OVER (PARTITION BY src_id, remote_ip, anchor ORDER BY ts_ns, pair_ts, pair_line, line_no) AS rn
            FROM wins),
    merged AS (SELECT src_id, remote_ip, anchor, count(*) AS n_events,
                      string_agg(DISTINCT replace(edge_type, 'EVENT_', ''), '_' ORDER BY replace(edge_type, 'EVENT_', '')) AS edge_type,
                      max(CASE WHEN rn = 1 THEN dst_id END) AS dst_id, max(CASE WHEN rn = 1 THEN line_no END) AS line_no,
                      concat(max(CASE WHEN rn = 1 THEN concat(split_part(flow, '_', 1), '_', split_part(flow, '_', 2)) END), '_',
                             remote_ip, '_', coalesce(string_agg(DISTINCT CASE WHEN port <> '0' THEN port END, '_'
                                                      ORDER BY CASE WHEN port <> '0' THEN port END), 'null')) AS dst_name
               FROM rep GROUP BY src_id, remote_ip, anchor HAVING count(*) > 1),
    kept_edges AS (
      SELECT src_id, dst_id, edge_type, ts_ns, line_no FROM edge WHERE line_no NOT IN (
        SELECT w.line_no FROM wins w JOIN merged m ON m.src_id = w.src_id AND m.remote_ip = w.remote_ip AND m.anchor = w.anchor)
      UNION ALL SELECT src_id, dst_id, edge_type, anchor, line_no FROM merged)"""


_FLOW_SQL = _flow_sql("burst_edge")


def burst_graph(spark, sf):
    nodes, edges = build.build_graph(cut_lineage(view(spark, sf, "burst_edge")))
    return nodes.withColumn("name", F.col("uuid")), edges


@named("flow_anchored_windows", f"WITH {_FLOW_SQL} SELECT src_id, remote_ip, line_no, ts_ns, anchor FROM wins")
def flow_anchored_windows(spark, sf):
    """Anchor of the one-second window of every mergeable network edge."""
    return reduce.flow_windows(*burst_graph(spark, sf)).select("src_id", "remote_ip", "line_no", "ts_ns", "anchor")


@named("flow_merged_windows", f"WITH {_FLOW_SQL} SELECT src_id, remote_ip, anchor, n_events, edge_type, dst_id, dst_name FROM merged")
def flow_merged_windows(spark, sf):
    w = reduce.flow_windows(*burst_graph(spark, sf))
    return reduce.merge_windows(w).select("src_id", "remote_ip", "anchor", "n_events", "edge_type", "dst_id", "dst_name")


def filed_graph(spark, sf):
    nodes, edges = build.build_graph(cut_lineage(view(spark, sf, "filed_edge")))
    return nodes.withColumn("name", F.col("uuid")), edges


@named("files_node_numbering", f"WITH {_nodes_sql('filed_order')} SELECT uuid, type, ts_ns, node_id FROM nodes")
def files_node_numbering(spark, sf):
    """Numbering over several files: equal times are ordered by file, then by line."""
    return build.number_nodes(view(spark, sf, "filed_edge"))


@named("files_parallel_edges", f"WITH {_kept_sql('filed_order')} SELECT src, dst, edge_type, ts_ns, edge_key FROM kept")
def files_parallel_edges(spark, sf):
    """Parallel-edge rule where a time and a line number occur in several files."""
    return build.parallel_edges(view(spark, sf, "filed_edge")).select("src", "dst", "edge_type", "ts_ns", "edge_key")


@named("files_merged_windows", f"WITH {_flow_sql('filed_order')} SELECT src_id, remote_ip, anchor, n_events, edge_type, dst_id, dst_name FROM merged")
def files_merged_windows(spark, sf):
    w = reduce.flow_windows(*filed_graph(spark, sf))
    return reduce.merge_windows(w).select("src_id", "remote_ip", "anchor", "n_events", "edge_type", "dst_id", "dst_name")


@named("files_reduced_edges", f"WITH {_flow_sql('filed_order')} SELECT src_id, dst_id, edge_type, ts_ns FROM kept_edges")
def files_reduced_edges(spark, sf):
    """Network merge over several files: no edge of another file goes with a merged one."""
    return reduce.reduce_flows(*filed_graph(spark, sf))[1].select("src_id", "dst_id", "edge_type", "ts_ns")


# --- from log files to sequences ---------------------------------------------------------------

QUIET = 20 * NS

_CHAIN_SQL = f"""{_flow_sql('filed_order')},
    renamed AS (SELECT dst_id, arg_max(dst_name, (src_id, anchor)) AS name FROM merged GROUP BY dst_id),
    named AS (SELECT n.node_id, n.uuid, n.type, coalesce(r.name, n.uuid) AS name FROM nodes n LEFT JOIN renamed r ON r.dst_id = n.node_id),
    gapped AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY src_id ORDER BY ts_ns, line_no) AS gap FROM kept_edges),
    cut AS (SELECT *, sum(CASE WHEN gap >= {QUIET} THEN 1 ELSE 0 END)
                      OVER (PARTITION BY src_id ORDER BY ts_ns, line_no ROWS UNBOUNDED PRECEDING) AS segment FROM gapped),
    seg AS (SELECT src_id, segment, min(ts_ns) AS start_ts, max(ts_ns) AS end_ts, count(*) AS n_edges, 1 + count(DISTINCT dst_id) AS n_nodes
            FROM cut GROUP BY src_id, segment),
    valid AS (SELECT * FROM seg WHERE n_nodes >= 6),
    part AS (SELECT *, dense_rank() OVER (ORDER BY src_id) - 1 AS dep_id, row_number() OVER (PARTITION BY src_id ORDER BY segment) - 1 AS part_idx,
                    count(*) OVER (PARTITION BY src_id) AS total_parts FROM valid)"""


def reduced_segments(spark, sf):
    """(nodes, segment edges, segments): logs of several files, built, merged, split and cut."""
    nodes, edges, _ = reduce.reduce_flows(*filed_graph(spark, sf))
    nodes = cut_lineage(nodes)
    seg = partition.segment_edges(partition.component_edges(nodes, cut_lineage(edges)), QUIET)
    return nodes, seg, partition.valid_segments(seg, nodes)


@named("pipeline_segments", f"WITH {_CHAIN_SQL} SELECT dep_id, part_idx, total_parts, start_ts, end_ts, n_nodes, n_edges FROM part")
def pipeline_segments(spark, sf):
    """Valid segments of the reduced graph of several log files."""
    return reduced_segments(spark, sf)[2].select("dep_id", "part_idx", "total_parts", "start_ts", "end_ts", "n_nodes", "n_edges")


@named(
    "pipeline_sequences",
    f"""WITH {_CHAIN_SQL}
    SELECT p.dep_id, p.part_idx, row_number() OVER (PARTITION BY p.dep_id, p.part_idx ORDER BY c.ts_ns, c.line_no) AS pos,
           concat(s.name, ' ', lower(replace(c.edge_type, 'EVENT_', '')), ' ', d.name, '.') AS text
    FROM cut c JOIN part p ON p.src_id = c.src_id AND p.segment = c.segment
    JOIN named s ON s.node_id = c.src_id JOIN named d ON d.node_id = c.dst_id""",
)
def pipeline_sequences(spark, sf):
    """Sentences of every valid segment, from the log files to the text."""
    nodes, seg, segments = reduced_segments(spark, sf)
    e = partition.subgraph_edges(seg, segments)
    s = nodes.select(F.col("node_id").alias("src_id"), F.col("name").alias("src_name"))
    d = nodes.select(F.col("node_id").alias("dst_id"), F.col("name").alias("dst_name"))
    return sequences.sentences(e.join(s, "src_id").join(d, "dst_id"), ["dep_id", "part_idx"])


@named(
    "flow_reduced_edges",
    f"""WITH {_FLOW_SQL} SELECT e.src_id, e.dst_id, e.edge_type, e.ts_ns, e.line_no, s.uuid AS src, d.uuid AS dst, s.type AS src_type, d.type AS dst_type
    FROM kept_edges e JOIN nodes s ON s.node_id = e.src_id JOIN nodes d ON d.node_id = e.dst_id""",
)
def flow_reduced_edges(spark, sf):
    return reduce.reduce_flows(*burst_graph(spark, sf))[1]


@named(
    "flow_reduced_nodes",
    f"""WITH {_FLOW_SQL},
    gone AS (SELECT DISTINCT w.dst_id FROM wins w JOIN merged m ON m.src_id = w.src_id AND m.remote_ip = w.remote_ip AND m.anchor = w.anchor
             WHERE w.dst_id NOT IN (SELECT src_id FROM kept_edges UNION SELECT dst_id FROM kept_edges)),
    new_name AS (SELECT dst_id, arg_max(dst_name, (src_id, anchor)) AS name FROM merged GROUP BY dst_id)
    SELECT n.node_id, n.type, coalesce(r.name, n.uuid) AS name FROM nodes n LEFT JOIN new_name r ON r.dst_id = n.node_id
    WHERE n.node_id NOT IN (SELECT dst_id FROM gone)""",
)
def flow_reduced_nodes(spark, sf):
    return reduce.reduce_flows(*burst_graph(spark, sf))[0].select("node_id", "type", "name")


@named(
    "anchored_windows_by_user",
    f"""WITH RECURSIVE ev AS (SELECT user_id, event_id, ts_ns FROM host_event),
    a AS (SELECT user_id, min(ts_ns) AS anchor FROM ev GROUP BY user_id
          UNION ALL SELECT user_id, nxt FROM (SELECT a.user_id,
            (SELECT min(e.ts_ns) FROM ev e WHERE e.user_id = a.user_id AND e.ts_ns > a.anchor + {24 * 3600 * NS}) AS nxt FROM a)
          WHERE nxt IS NOT NULL)
    SELECT e.user_id, e.event_id, a.anchor FROM ev e JOIN a ON a.user_id = e.user_id AND e.ts_ns >= a.anchor
    AND e.ts_ns <= a.anchor + {24 * 3600 * NS}""",
)
def anchored_windows_by_user(spark, sf):
    """One-day windows anchored at their first event."""
    e = view(spark, sf, "host_event").select("user_id", "event_id", "ts_ns")
    return anchored_windows(e, ["user_id"], ["ts_ns", "event_id"], 24 * 3600 * NS).select("user_id", "event_id", "anchor")


# --- similar files -----------------------------------------------------------------------------

# bit-parallel longest common subsequence of short names
_RATIO_SQL = """2.0 * (len({a}) - bit_count(list_reduce(list_transform(string_split({b}, ''),
        lambda c: list_sum(list_transform(generate_series(1, len({a})), lambda i: CASE WHEN {a}[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT),
        lambda r, m: ((r + (r & m)) | (r & ~m)) & ((1::BIGINT << len({a})) - 1), (1::BIGINT << len({a})) - 1)))
        / (len({a}) + len({b}))"""

_SIMILAR_SQL = f"""RECURSIVE {_nodes_sql('temp_edge')}, {_kept_sql('temp_edge')},
    edge AS MATERIALIZED (SELECT k.edge_type, k.ts_ns, k.line_no, s.node_id AS src_id, d.node_id AS dst_id FROM kept k
             JOIN nodes s ON s.uuid = k.src JOIN nodes d ON d.uuid = k.dst),
    f AS (SELECT node_id, ts_ns, regexp_extract(uuid, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(uuid, '([^/]*)$', 1) AS base
          FROM nodes WHERE type = 'FILE' AND (contains(uuid, '/tmp/') OR contains(uuid, '/var/log/') OR uuid LIKE '%.lock')),
    fp AS (SELECT DISTINCT f.*, e.src_id AS proc FROM f JOIN edge e ON e.dst_id = f.node_id),
    pair AS (SELECT DISTINCT i.node_id AS i, i.ts_ns AS its, i.base AS ib, j.node_id AS j, j.base AS jb
             FROM fp i JOIN fp j ON i.dir = j.dir AND i.proc = j.proc AND (i.ts_ns, i.node_id) < (j.ts_ns, j.node_id)
             AND j.ts_ns - i.ts_ns <= {30 * NS}),
    scored AS (SELECT *, {_RATIO_SQL.format(a='ib', b='jb')} AS sim FROM pair),
    parent AS (SELECT j AS node_id, arg_min(i, (its, i)) AS parent_id, min(its) AS parent_ts FROM scored WHERE sim > 0.7 GROUP BY j),
    chain AS (SELECT node_id, parent_id AS rep_id FROM parent
              UNION ALL SELECT c.node_id, p.parent_id FROM chain c JOIN parent p ON p.node_id = c.rep_id),
    rep AS (SELECT node_id, rep_id FROM chain WHERE rep_id NOT IN (SELECT node_id FROM parent))"""


def temp_graph(spark, sf):
    keep = ["edge_type", "ts_ns", "line_no", "pair_ts", "pair_line"]
    nodes, edges = build.build_graph(written(view(spark, sf, "temp_edge")), kinds=True, keep=keep)
    return nodes.withColumn("name", F.col("uuid")), edges


@named("similar_file_parents", f"WITH {_SIMILAR_SQL} SELECT node_id, parent_id FROM parent")
def similar_file_parents(spark, sf):
    """Earliest earlier file each temp, log or cache file merges into."""
    return reduce.similar_parents(*temp_graph(spark, sf)).select("node_id", "parent_id")


@named("similar_file_representatives", f"WITH {_SIMILAR_SQL} SELECT node_id, rep_id FROM rep")
def similar_file_representatives(spark, sf):
    return reduce.representatives(reduce.similar_parents(*temp_graph(spark, sf))).select("node_id", "rep_id")


@named(
    "similar_file_rewired_edges",
    f"""WITH {_SIMILAR_SQL},
    mapped AS (SELECT e.edge_type, e.ts_ns, e.line_no, e.src_id, coalesce(r.rep_id, e.dst_id) AS dst_id, r.rep_id IS NOT NULL AS moved,
                      p.parent_ts, p.parent_id, n.ts_ns AS old_ts, n.node_id AS old_id
               FROM edge e LEFT JOIN rep r ON r.node_id = e.dst_id LEFT JOIN parent p ON p.node_id = e.dst_id
               JOIN nodes n ON n.node_id = e.dst_id),
    stay AS (SELECT src_id, dst_id, edge_type, ts_ns, line_no FROM mapped WHERE NOT moved),
    go AS (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id, edge_type ORDER BY parent_ts, parent_id, old_ts, old_id, ts_ns, line_no) AS rn
           FROM mapped m WHERE moved AND NOT EXISTS (SELECT 1 FROM stay s WHERE s.src_id = m.src_id AND s.dst_id = m.dst_id AND s.edge_type = m.edge_type))
    SELECT * FROM stay UNION ALL SELECT src_id, dst_id, edge_type, ts_ns, line_no FROM go WHERE rn = 1""",
)
def similar_file_rewired_edges(spark, sf):
    nodes, edges = temp_graph(spark, sf)
    reps = reduce.representatives(reduce.similar_parents(nodes, edges))
    return reduce.reduce_similar(nodes, edges, reps)[1].select("src_id", "dst_id", "edge_type", "ts_ns", "line_no")


@named(
    "temp_log_cache_paths",
    """SELECT path_id, path FROM path_list WHERE contains(path, '/tmp/') OR contains(path, '/var/tmp/') OR contains(path, '/var/log/')
    OR contains(path, '/var/cache/') OR lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]*)$', 1)) IN
    ('.log', '.tmp', '.temp', '.cache', '.lock', '.pid')""",
)
def temp_log_cache_paths(spark, sf):
    from provloom.functions import paths

    return view(spark, sf, "path_list").filter(paths.is_temp_log_cache(F.col("path")))


@named(
    "reduction_summary",
    f"""WITH {_SIMILAR_SQL}
    SELECT * FROM (SELECT CAST(0 AS BIGINT) AS step, 'start' AS stage, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges
    UNION ALL SELECT 1, 'directory cascade', (SELECT count(*) FROM nodes), (SELECT count(*) FROM edge)
    UNION ALL SELECT 2, 'network merge', (SELECT count(*) FROM nodes), (SELECT count(*) FROM edge)
    UNION ALL SELECT 3, 'similar files', (SELECT count(*) FROM nodes) - (SELECT count(*) FROM rep),
      (SELECT count(*) FROM edge) - (SELECT count(*) FROM edge e JOIN rep r ON r.node_id = e.dst_id)
      + (SELECT count(DISTINCT (e.src_id, r.rep_id, e.edge_type)) FROM edge e JOIN rep r ON r.node_id = e.dst_id
         WHERE NOT EXISTS (SELECT 1 FROM edge s WHERE s.src_id = e.src_id AND s.dst_id = r.rep_id AND s.edge_type = e.edge_type)))""",
)
def reduction_summary(spark, sf):
    """All three reductions in order, node and edge counts after each."""
    return reduce.reduce_graph(*temp_graph(spark, sf))[2]
