"""Log and knowledge sources: inputs in the logs' own formats are derived from the supplied tables,
parsed by the sources, and checked against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from provloom.functions import text as tx
from provloom.operators import build
from provloom.plans.registry import named
from provloom.plans.views import query, view
from provloom.session import cut_lineage
from provloom.sources import audit, cdm, etw, knowledge, lines, reports

NS = cdm.NS



def as_log(derived, spark):
    """Derived lines stand for log files: spread as file splits are, and made once."""
    return cut_lineage(derived.repartition(spark.sparkContext.defaultParallelism))


# --- edge files and id lists -------------------------------------------------------------------

_EDGE_LINE = """SELECT line_no, CASE line_no % 10 WHEN 3 THEN concat(src, chr(9), src_type, chr(9), dst, chr(9), dst_type, chr(9), edge_type)
    WHEN 5 THEN concat(src, chr(9), src_type, chr(9), dst, chr(9), dst_type, chr(9), edge_type, chr(9), 'soon')
    WHEN 7 THEN concat(src, chr(9), src_type, chr(9), dst, chr(0), chr(9), dst_type, chr(9), edge_type, chr(9), CAST(ts_ns AS STRING))
    ELSE concat(src, chr(9), src_type, chr(9), dst, chr(9), dst_type, chr(9), edge_type, chr(9), CAST(ts_ns AS STRING)) END AS value FROM host_edge"""


@named(
    "edge_file_rows",
    "SELECT src, src_type, dst, dst_type, edge_type, ts_ns, line_no FROM host_edge WHERE line_no % 10 NOT IN (3, 5, 7)",
)
def edge_file_rows(spark, sf):
    """Six-field edge lines; others are rejected."""
    return lines.parse_edge_lines(query(spark, sf, _EDGE_LINE))[0]


@named(
    "edge_file_rejects",
    """SELECT CASE line_no % 10 WHEN 3 THEN 'field count' WHEN 5 THEN 'time' ELSE 'nul byte' END AS reason, count(*) AS n FROM host_edge
    WHERE line_no % 10 IN (3, 5, 7) GROUP BY ALL""",
)
def edge_file_rejects(spark, sf):
    r = lines.parse_edge_lines(query(spark, sf, _EDGE_LINE))[1]
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@named(
    "id_list",
    """SELECT concat('U', CAST(o_orderkey AS STRING)) AS uuid, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(o_orderpriority, ',', o_orderstatus) END AS info
    FROM orders WHERE o_orderkey % 5 <> 0""",
)
def id_list(spark, sf):
    """'uuid[,free text]' lines, blank ones dropped."""
    v = query(
        spark, sf,
        """SELECT CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 3 = 0 THEN concat(' U', CAST(o_orderkey AS STRING))
        ELSE concat('U', CAST(o_orderkey AS STRING), ' , ', o_orderpriority, ',', o_orderstatus) END AS value FROM orders""",
    )
    return lines.parse_id_list(v)


_SUBGRAPH = """SELECT user_id, event_id, CASE event_id % 3
      WHEN 0 THEN concat('["p', CAST(user_id AS STRING), '","', CAST(k AS STRING), '",0,{"edge_type":"EVENT_READ","ts":', CAST(ts_ns AS STRING), '}]')
      WHEN 1 THEN concat('["p', CAST(user_id AS STRING), '","', CAST(k AS STRING), '",{"edge_type":"EVENT_WRITE","ts":', CAST(ts_ns AS STRING), '}]')
      ELSE concat('{"source":"p', CAST(user_id AS STRING), '","target":"', CAST(k AS STRING), '","edge_type":"EVENT_OPEN","ts":', CAST(ts_ns AS STRING), '}') END AS edge,
    CASE event_id % 2 WHEN 0 THEN concat('["', CAST(k AS STRING), '",{"uuid":"o', CAST(k AS STRING), '","name":"obj', CAST(k AS STRING), '","type":"FILE","ts":1}]')
      ELSE concat('{"id":"', CAST(k AS STRING), '","uuid":"o', CAST(k AS STRING), '","name":"obj', CAST(k AS STRING), '","type":"FILE","ts":1}') END AS node
    FROM host_event"""


def _rebuilt(spark, sf):
    """One JSON subgraph per user: nodes and edges in every layout the reader accepts."""
    e = query(spark, sf, _SUBGRAPH)
    docs = e.groupBy("user_id").agg(
        F.concat(
            F.lit('{"dep_id":'), F.first("user_id").cast("string"), F.lit(',"nodes":['),
            F.array_join(F.array_sort(F.collect_set("node")), ","), F.lit('],"edges":['),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "edge"))), lambda x: x["edge"]), ","), F.lit("]}"),
        ).alias("value")
    )
    return lines.rebuild_graph(lines.parse_subgraphs(docs.select("value")), ["dep_id"])


@named(
    "subgraph_rebuilt_edges",
    """SELECT user_id AS dep_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no, concat('p', CAST(user_id AS STRING)) AS src,
    concat('p', CAST(user_id AS STRING)) AS src_name, CAST(k AS STRING) AS dst, concat('obj', CAST(k AS STRING)) AS dst_name,
    CASE event_id % 3 WHEN 0 THEN 'EVENT_READ' WHEN 1 THEN 'EVENT_WRITE' ELSE 'EVENT_OPEN' END AS edge_type, ts_ns FROM host_event""",
)
def subgraph_rebuilt_edges(spark, sf):
    """Edges of tolerant subgraph documents with names found by id or uuid."""
    return _rebuilt(spark, sf)[1].select("dep_id", "line_no", "src", "src_name", "dst", "dst_name", "edge_type", "ts_ns")


@named(
    "subgraph_rebuilt_nodes",
    "SELECT DISTINCT user_id AS dep_id, CAST(k AS STRING) AS id, concat('o', CAST(k AS STRING)) AS uuid, concat('obj', CAST(k AS STRING)) AS name FROM host_event",
)
def subgraph_rebuilt_nodes(spark, sf):
    return _rebuilt(spark, sf)[0].select("dep_id", "id", "uuid", "name").distinct()


# --- provenance log ----------------------------------------------------------------------------

_U, _K = "CAST(user_id AS STRING)", "CAST(k AS STRING)"
_CDM = f"""SELECT user_id AS line_no, 'ta1-e.json' AS file_name,
      concat('{{"datum":{{"{NS}Subject":{{"uuid":"p', {_U}, '","type":"SUBJECT_PROCESS",',
             CASE user_id % 3 WHEN 0 THEN concat('"cmdLine":{{"string":"cmd ', {_U}, '"}},') WHEN 1 THEN concat('"cmdLine":"cmd ', {_U}, '",') ELSE '' END,
             '"localPrincipal":"w', CAST(user_id % 4 AS STRING), '","startTimestampNanos":', {_U}, ',"properties":{{"map":{{"path":"/bin/p', {_U}, '"}}}}}}}}}}') AS value
    FROM (SELECT DISTINCT user_id FROM host_event WHERE user_id % 17 <> 0)
    UNION ALL SELECT 100000 + user_id, 'ta1-e.json',
      concat('{{"datum":{{"{NS}Subject":{{"uuid":"p', {_U}, '","type":"SUBJECT_PROCESS","cmdLine":"second ', {_U}, '"}}}}}}')
    FROM (SELECT DISTINCT user_id FROM host_event WHERE user_id % 17 <> 0) WHERE user_id % 5 = 0
    UNION ALL SELECT 200000 + k, 'ta1-e.json',
      concat('{{"datum":{{"{NS}FileObject":{{"uuid":"o', {_K}, '","type":"FILE_OBJECT_BLOCK","baseObject":{{',
             CASE k % 4 WHEN 0 THEN concat('"filename":"/base/name', {_K}, '"') WHEN 1 THEN concat('"path":"/base/path', {_K}, '"')
             WHEN 2 THEN concat('"path":"/base/path', {_K}, '","properties":{{"map":{{"filename":"/props/name', {_K}, '"}}}}') ELSE '"filename":"null"' END, '}}}}}}}}')
    FROM (SELECT DISTINCT k FROM host_event) WHERE k % 3 = 1
    UNION ALL SELECT 300000 + k, 'ta1-e.json',
      concat('{{"datum":{{"{NS}NetFlowObject":{{"uuid":"o', {_K}, '","localAddress":', CASE k % 2 WHEN 0 THEN '{{"string":"10.0.0.1"}}' ELSE '"10.0.0.2"' END,
             ',"localPort":{{"int":', {_K}, '}},"remoteAddress":"8.8.8.', {_K}, '"', CASE WHEN k % 4 = 0 THEN '' ELSE ',"remotePort":443' END, '}}}}}}')
    FROM (SELECT DISTINCT k FROM host_event) WHERE k % 3 = 0
    UNION ALL SELECT 400000 + user_id, 'ta1-e.json', concat('{{"datum":{{"{NS}Subject":{{"uuid":"unit', {_U}, '","type":"SUBJECT_UNIT"}}}}}}')
    FROM (SELECT DISTINCT user_id FROM host_event)
    UNION ALL SELECT 500000 + user_id, 'ta1-e.json', concat('{{"datum":{{"{NS}MemoryObject":{{"uuid":"mem', {_U}, '"}}}}}}')
    FROM (SELECT DISTINCT user_id FROM host_event)
    UNION ALL SELECT 600000 + user_id, 'ta1-e.json', concat('{{"datum":{{"{NS}Principal":{{"uuid":"w', {_U}, '","userId":"', CAST(1000 + user_id AS STRING), '"}}}}}}')
    FROM (SELECT DISTINCT user_id FROM host_event) WHERE user_id < 3
    UNION ALL SELECT event_id, concat('ta1-e.json.', CAST(event_id % 12 AS STRING)),
      concat(CASE WHEN event_id % 50 = 0 THEN chr(0) ELSE '' END, '{{"datum":{{"{NS}Event":{{"uuid":"e', CAST(event_id AS STRING), '","type":"',
             CASE event_type WHEN 'signup' THEN 'EVENT_MMAP' WHEN 'error' THEN 'EVENT_OPEN' WHEN 'view' THEN 'EVENT_READ' WHEN 'click' THEN 'EVENT_WRITE' ELSE 'EVENT_SENDTO' END,
             '","timestampNanos":', CASE WHEN event_id % 70 = 1 THEN 'later' ELSE CAST(ts_ns AS STRING) END,
             ',"subject":{{"{NS}UUID":"p', {_U}, '"}},"predicateObject":{{"{NS}UUID":"o', {_K}, '"}}',
             CASE WHEN event_id % 5 = 0 THEN concat(',"predicateObject2":{{"{NS}UUID":"o', CAST((k + 1) % 100 AS STRING), '"}}')
                  WHEN event_id % 7 = 0 THEN ',"predicateObject2":{{"{NS}UUID":"{cdm.NIL}"}}' ELSE '' END, '}}}}}}')
    FROM host_event"""
_CDM_CAT = "CASE event_type WHEN 'signup' THEN 'EVENT_MMAP' WHEN 'error' THEN 'EVENT_OPEN' WHEN 'view' THEN 'EVENT_READ' WHEN 'click' THEN 'EVENT_WRITE' ELSE 'EVENT_SENDTO' END"
_CDM_ENT = f"""ent AS MATERIALIZED (
      SELECT DISTINCT concat('p', {_U}) AS uuid, 'SUBJECT_PROCESS' AS type, CASE WHEN user_id % 5 = 0 THEN concat('second ', {_U})
        WHEN user_id % 3 < 2 THEN concat('cmd ', {_U}) ELSE concat('/bin/p', {_U}) END AS name FROM host_event WHERE user_id % 17 <> 0
      UNION ALL SELECT DISTINCT concat('o', {_K}), 'FILE_OBJECT_BLOCK', CASE k % 4 WHEN 0 THEN concat('/base/name', {_K}) WHEN 1 THEN concat('/base/path', {_K})
        WHEN 2 THEN concat('/props/name', {_K}) END FROM host_event WHERE k % 3 = 1
      UNION ALL SELECT DISTINCT concat('o', {_K}), 'NetFlowObject', concat(CASE k % 2 WHEN 0 THEN '10.0.0.1' ELSE '10.0.0.2' END, '_', {_K}, '_8.8.8.', {_K}, '_',
        CASE WHEN k % 4 = 0 THEN 'null' ELSE '443' END) FROM host_event WHERE k % 3 = 0)"""


def cdm_lines(spark, sf):
    return as_log(query(spark, sf, _CDM), spark).withColumn("file_key", lines.natural_key(F.col("file_name")))


@named("log_entities", f"WITH {_CDM_ENT} SELECT uuid, type, name FROM ent")
def log_entities(spark, sf):
    """Entity scan of the record log; the last record of an id wins."""
    return cdm.entities(cdm_lines(spark, sf)).select("uuid", "type", "name")


@named(
    "log_event_edges",
    f"""WITH {_CDM_ENT}, ev AS (SELECT *, {_CDM_CAT} AS et FROM host_event WHERE event_id % 50 <> 0 AND event_id % 70 <> 1),
    o AS (SELECT event_id, user_id, et, ts_ns, concat('o', {_K}) AS dst FROM ev
          UNION ALL SELECT event_id, user_id, et, ts_ns, concat('o', CAST((k + 1) % 100 AS STRING)) FROM ev WHERE event_id % 5 = 0)
    SELECT s.uuid AS src, s.type AS src_type, o.dst, coalesce(d.type, 'UNKNOWN') AS dst_type, o.et AS edge_type, o.ts_ns FROM o
    JOIN ent s ON s.uuid = concat('p', CAST(o.user_id AS STRING)) LEFT JOIN ent d ON d.uuid = o.dst WHERE o.et NOT IN ('EVENT_MMAP', 'EVENT_OPEN')""",
)
def log_event_edges(spark, sf):
    """Event scan: unknown subjects drop the event, unknown objects become UNKNOWN."""
    ls = cdm_lines(spark, sf)
    return cdm.event_edges(ls, cdm.entities(ls)).select("src", "src_type", "dst", "dst_type", "edge_type", "ts_ns")


@named(
    "log_edge_order",
    f"""WITH {_CDM_ENT}, ev AS (SELECT *, {_CDM_CAT} AS et FROM host_event WHERE event_id % 50 <> 0 AND event_id % 70 <> 1 AND user_id % 17 <> 0),
    o AS (SELECT event_id, ts_ns, et, 0 AS w FROM ev UNION ALL SELECT event_id, ts_ns, et, 1 FROM ev WHERE event_id % 5 = 0)
    SELECT event_id * 2 + w AS line_no, row_number() OVER (PARTITION BY event_id % 12 ORDER BY ts_ns, event_id, w) AS pos FROM o
    WHERE et NOT IN ('EVENT_MMAP', 'EVENT_OPEN')""",
)
def log_edge_order(spark, sf):
    """Edges of a file by time, ties by line; files in the natural order of their names."""
    from provloom.operators import ordered

    ls = cdm_lines(spark, sf)
    e = cdm.event_edges(ls, cdm.entities(ls))
    return ordered.scan(e, ["file_key"], ["ts_ns", "line_no"], index="pos").select("line_no", "pos")


@named(
    "log_skip_counts",
    f"""WITH ev AS (SELECT *, {_CDM_CAT} AS et FROM host_event),
    r AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'nul byte' WHEN event_id % 70 = 1 THEN 'time' WHEN et IN ('EVENT_MMAP', 'EVENT_OPEN') THEN et END AS reason FROM ev)
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
)
def log_skip_counts(spark, sf):
    return cdm.event_skips(cdm_lines(spark, sf))


@named(
    "log_file_order",
    "SELECT concat('ta1-e.json.', CAST(f AS STRING)) AS file_name, f AS ord FROM (SELECT DISTINCT event_id % 12 AS f FROM host_event)",
)
def log_file_order(spark, sf):
    """Numbered log files in natural order, foreign files left out."""
    from provloom.operators import ordered

    names = query(
        spark, sf,
        """SELECT DISTINCT concat('ta1-e.json.', CAST(event_id % 12 AS STRING)) AS file_name FROM host_event
        UNION ALL SELECT DISTINCT concat('._ta1-e.json.', CAST(event_id % 3 AS STRING)) AS file_name FROM host_event
        UNION ALL SELECT DISTINCT concat('notes', CAST(event_id % 3 AS STRING), '.txt') AS file_name FROM host_event""",
    ).filter(lines.is_provenance_log(F.col("file_name")))
    keyed = names.withColumn("k", lines.natural_key(F.col("file_name"))).withColumn("one", F.lit(0))
    return ordered.scan(keyed, [], ["one", "k"], index="ord").select("file_name", (F.col("ord") - 1).alias("ord"))


@named(
    "tactic_log_entities",
    f"""SELECT DISTINCT concat('p', {_U}) AS uuid, 'SUBJECT_PROCESS' AS type, CASE WHEN user_id % 5 = 0 THEN concat('second ', {_U})
        WHEN user_id % 3 < 2 THEN concat('cmd ', {_U}) ELSE concat('/bin/p', {_U}) END AS name,
        CASE WHEN user_id % 5 <> 0 AND user_id % 4 < 3 THEN CAST(1000 + user_id % 4 AS STRING) ELSE '?' END AS user_id FROM host_event WHERE user_id % 17 <> 0
    UNION ALL SELECT DISTINCT concat('unit', {_U}), 'SUBJECT_PROCESS', '', '?' FROM host_event
    UNION ALL SELECT DISTINCT concat('o', {_K}), 'FILE_OBJECT_BLOCK', CASE k % 4 WHEN 0 THEN concat('/base/name', {_K}) WHEN 1 THEN concat('/base/path', {_K})
        WHEN 2 THEN concat('/base/path', {_K}) ELSE 'null' END, NULL FROM host_event WHERE k % 3 = 1
    UNION ALL SELECT DISTINCT concat('o', {_K}), 'NetFlowObject', concat(CASE k % 2 WHEN 0 THEN '10.0.0.1' ELSE '10.0.0.2' END, '_', {_K}, '_8.8.8.', {_K}, '_',
        CASE WHEN k % 4 = 0 THEN 'null' ELSE '443' END), NULL FROM host_event WHERE k % 3 = 0""",
)
def tactic_log_entities(spark, sf):
    """Entity table of the tactic job with the user of each process."""
    return cdm.tactic_entities(cdm_lines(spark, sf)).select("uuid", "type", "name", "user_id")


@named(
    "tactic_log_edges",
    f"""WITH ev AS (SELECT concat('p', {_U}) AS src, concat('o', {_K}) AS dst, {_CDM_CAT} AS edge_type, ts_ns FROM host_event WHERE event_id % 50 <> 0 AND event_id % 70 <> 1)
    SELECT src, dst, edge_type, min(ts_ns) AS ts_ns FROM ev WHERE edge_type <> 'EVENT_MMAP'
    AND (src IN (SELECT uuid FROM flagged) OR dst IN (SELECT uuid FROM flagged)) GROUP BY ALL""",
)
def tactic_log_edges(spark, sf):
    """Earliest edge per pair and type of events with a flagged end."""
    ls = cdm_lines(spark, sf).filter(~F.col("value").contains("\x00"))
    return cdm.tactic_edges(ls, view(spark, sf, "flagged"))


# --- kernel event log --------------------------------------------------------------------------

_ETW_KIND = "event_id % 12"
_ETW = f"""SELECT event_id AS line_no, concat('/in/x/sample', CAST(user_id % 20 AS STRING), '.json') AS file, CASE WHEN event_id % 97 = 0 THEN '{{"Event": oops' ELSE
    concat('{{"Event":"', CASE {_ETW_KIND} WHEN 0 THEN 'FileIOCreate' WHEN 1 THEN 'FileIORead' WHEN 2 THEN 'FileIOWrite' WHEN 3 THEN 'FileIOClose' WHEN 4 THEN 'RegistryQuery'
      WHEN 5 THEN 'RegistrySetValue' WHEN 6 THEN 'TcpIpSendIPV4' WHEN 7 THEN 'TcpIpConnectIPV6' WHEN 8 THEN 'ProcessStart' WHEN 9 THEN 'ThreadStart' WHEN 10 THEN 'RegistryClose' ELSE 'FileIODelete' END,
      '","PID":', {_U}, ',"PName":"name', {_U}, '.exe","TimeStamp":', CASE WHEN event_id % 31 = 0 THEN 'null' ELSE CAST(ts_ns // 100 AS STRING) END, ',"args":{{',
      CASE {_ETW_KIND} WHEN 0 THEN concat('"OpenPath":"C:/a/', {_K}, '.txt","FileName":"wrong"') WHEN 1 THEN concat('"FileName":"C:/b/', {_K}, '"')
        WHEN 2 THEN concat('"FileKey":"0x', {_K}, '","FileObject":"0xf"') WHEN 3 THEN '"FileKey":"0x1"' WHEN 4 THEN concat('"KeyName":"HKLM/Run/K', {_K}, '"')
        WHEN 6 THEN concat('"saddr":"10.0.0.1","sport":', {_K}, ',"daddr":"8.8.8.8","dport":53') WHEN 7 THEN '"saddr":"::1","sport":1,"daddr":"::2"'
        WHEN 8 THEN concat('"ProcessId":', {_K}) WHEN 11 THEN '"FileName":""' ELSE '' END, '}}}}') END AS value FROM host_event"""
_ETW_SQL = f"""raw AS (SELECT *, concat('sample', CAST(user_id % 20 AS STRING)) AS tag, event_id % 12 AS m FROM host_event),
    ok AS (SELECT *, CASE WHEN m IN (5, 10) THEN row_number() OVER (PARTITION BY tag, m IN (5, 10) ORDER BY event_id) END AS i FROM raw WHERE event_id % 97 <> 0 AND m <> 9),
    e AS (SELECT tag, event_id AS line_no, concat('proc:', {_U}) AS src, CASE m WHEN 0 THEN concat('file:C:/a/', {_K}, '.txt') WHEN 1 THEN concat('file:C:/b/', {_K})
        WHEN 2 THEN concat('file:unresolved:', tag, ':0x', {_K}, ':0xf') WHEN 3 THEN concat('file:unknown:', tag) WHEN 11 THEN concat('file:unknown:', tag)
        WHEN 4 THEN concat('reg:hklm/run/k', {_K}) WHEN 6 THEN concat('sock:10.0.0.1:', {_K}, '->8.8.8.8:53') WHEN 7 THEN 'sock:::1:1->::2:None'
        WHEN 8 THEN concat('proc:', {_K}) ELSE concat('reg:unresolved:', tag, ':', CAST(i AS STRING)) END AS dst,
      CASE m WHEN 0 THEN 'file_create' WHEN 1 THEN 'file_read' WHEN 2 THEN 'file_write' WHEN 3 THEN 'file_close' WHEN 4 THEN 'registry_query' WHEN 5 THEN 'registry_modify'
        WHEN 6 THEN 'socket_send' WHEN 7 THEN 'socket_connect' WHEN 8 THEN 'process_launch' WHEN 10 THEN 'registry_close' ELSE 'file_delete' END AS edge_type,
      CASE WHEN event_id % 31 <> 0 THEN ts_ns // 100 END AS ts_ns, m NOT IN (2, 3, 5, 10, 11) AS resolved, concat('name', {_U}, '.exe') AS pname FROM ok)"""


def etw_scan(spark, sf):
    return etw.scan(etw.with_tag(as_log(query(spark, sf, _ETW), spark)))


@named("kernel_event_edges", f"WITH {_ETW_SQL} SELECT tag, line_no, src, dst, edge_type, ts_ns, resolved FROM e")
def kernel_event_edges(spark, sf):
    """Mapped kernel events as edges, unresolved targets with placeholder ids."""
    return etw.edges(etw_scan(spark, sf)).select("tag", "line_no", "src", "dst", "edge_type", "ts_ns", "resolved")


@named(
    "kernel_event_order",
    f"WITH {_ETW_SQL} SELECT tag, line_no, row_number() OVER (PARTITION BY tag ORDER BY coalesce(ts_ns, 0), line_no) AS pos FROM e",
)
def kernel_event_order(spark, sf):
    """Time order per sample; a missing time counts as zero."""
    return etw.in_time_order(etw.edges(etw_scan(spark, sf))).select("tag", "line_no", "pos")


@named(
    "kernel_event_totals",
    f"""WITH {_ETW_SQL} SELECT tag, count(*) AS n_events, count(CASE WHEN event_id % 97 <> 0 AND m <> 9 THEN 1 END) AS n_kept,
    count(CASE WHEN event_id % 97 = 0 THEN 1 END) AS n_bad_json, count(CASE WHEN event_id % 97 <> 0 AND m = 9 THEN 1 END) AS n_unmapped,
    (SELECT count(*) FROM e WHERE e.tag = raw.tag AND NOT resolved) AS n_unresolved,
    round(100.0 * count(CASE WHEN event_id % 97 <> 0 AND m <> 9 THEN 1 END) / count(*), 1) AS pct_kept FROM raw GROUP BY tag""",
)
def kernel_event_totals(spark, sf):
    s = etw_scan(spark, sf)
    return etw.totals(s, etw.edges(s), ["tag"])


@named(
    "kernel_node_details",
    f"""WITH {_ETW_SQL}, ends AS (SELECT tag, line_no, 0 AS role, src AS uuid, pname AS name FROM e
      UNION ALL SELECT tag, line_no, 1, dst, CASE WHEN dst LIKE 'proc:%' THEN pname WHEN NOT resolved THEN NULL
        ELSE regexp_replace(dst, '^(file|reg|sock):', '') END FROM e)
    SELECT uuid, arg_max(coalesce(name, '-'), (tag, line_no, role)) AS name FROM ends GROUP BY uuid""",
)
def kernel_node_details(spark, sf):
    """Names over all samples, the last sighting wins."""
    return etw.node_details(etw.edges(etw_scan(spark, sf))).select("uuid", F.coalesce("name", F.lit("-")).alias("name"))


@named(
    "kernel_graph_totals",
    f"""WITH {_ETW_SQL}, t AS (SELECT * FROM e WHERE ts_ns IS NOT NULL),
    r AS (SELECT *, first_value(edge_type) OVER w AS ft, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY tag, src, dst ORDER BY ts_ns, line_no)),
    n AS (SELECT tag, count(DISTINCT u) AS n_nodes FROM (SELECT tag, src AS u FROM t UNION ALL SELECT tag, dst FROM t) GROUP BY tag)
    SELECT n.tag, n.n_nodes, count(*) AS n_edges FROM r JOIN n ON n.tag = r.tag WHERE rn = 1 OR NOT contains(ft, edge_type) GROUP BY n.tag, n.n_nodes""",
)
def kernel_graph_totals(spark, sf):
    """One graph per sample; rows without a time are skipped."""
    e = etw.edges(etw_scan(spark, sf)).filter("ts_ns is not null")
    nodes, edges = build.build_graph(e, ["tag"])
    return build.graph_totals(nodes, edges, ["tag"])


# --- audit log ---------------------------------------------------------------------------------

_FILE = "concat('/in/', CASE user_id % 2 WHEN 0 THEN 'impact' ELSE 'discovery' END, '/T10', CAST(user_id % 3 AS STRING), '-000/step', CAST(user_id % 5 AS STRING), '/', CASE user_id % 4 WHEN 0 THEN 'client' WHEN 1 THEN 'docker' WHEN 2 THEN 'zebra' ELSE 'client2' END, '/logs/', CASE WHEN user_id % 7 = 0 THEN 'audit' ELSE 'auditd' END, '/audit.log')"
_MSG = "concat(' msg=audit(', CAST(ts_ns // 1000000000 AS STRING), '.', lpad(CAST(ts_ns // 1000000 % 1000 AS STRING), 3, '0'), ':', CAST(event_id AS STRING), '):')"
_PIDS = "concat(' ppid=', CAST(100 + user_id % 11 AS STRING), ' pid=', CAST(100 + (user_id + event_id) % 11 AS STRING))"
_SYS = f"""concat('type=SYSCALL', {_MSG}, ' arch=c000003e success=', CASE WHEN event_id % 10 IN (1, 9) THEN 'no' ELSE 'yes' END, ' exit=-2 a0=7f', {_PIDS},
    ' comm="c', CAST(event_id % 4 AS STRING), '" exe="/usr/bin/x', CAST(event_id % 4 AS STRING), '" subj=unconfined key="k"ARCH=x86_64 SYSCALL=',
    CASE event_id % 10 WHEN 0 THEN 'execve' WHEN 1 THEN 'execve' WHEN 2 THEN 'connect' WHEN 3 THEN 'openat' WHEN 7 THEN 'open' ELSE 'close' END)"""
_AUDIT = f"""SELECT {_FILE} AS file, event_id * 10 AS line_no, CASE
      WHEN event_id % 10 IN (0, 1, 2, 3, 7, 9) THEN {_SYS}
      WHEN event_id % 10 = 4 THEN concat('type=USER_AUTH', {_MSG}, {_PIDS}, ' subj=u op=PAM:auth ', CASE WHEN event_id % 3 = 0 THEN 'acct=726f6f7431' ELSE 'acct="admin"' END,
        ' exe="/usr/sbin/sshd" hostname=? addr=', CASE WHEN event_id % 4 = 0 THEN '?' ELSE concat('10.1.1.', {_K}) END, ' terminal=ssh res=failed')
      WHEN event_id % 10 = 5 THEN concat('type=USER_START', {_MSG}, {_PIDS}, ' subj=u msg=op=PAM:session acct="root" exe="/usr/sbin/cron" res=success')
      WHEN event_id % 10 = 6 THEN concat('type=SERVICE_START', {_MSG}, {_PIDS}, ' unit=svc', {_K}, ' comm="systemd" exe="/lib/systemd/systemd" res=success')
      ELSE concat('type=USER_CMD', {_MSG}, {_PIDS}, ' cwd="/root" cmd=6C73202D6C61 exe="/usr/bin/sudo" res=success UID="bob"') END AS value FROM host_event
    UNION ALL SELECT {_FILE}, event_id * 10 + 1, concat('type=EXECVE', {_MSG}, ' argc=2 a0="ls" a1=2D6C61') FROM host_event WHERE event_id % 10 = 0
    UNION ALL SELECT {_FILE}, event_id * 10 + 1, concat('type=PATH', {_MSG}, ' item=0 name="/missing/', {_K}, '" nametype=UNKNOWN') FROM host_event WHERE event_id % 10 = 1
    UNION ALL SELECT {_FILE}, event_id * 10 + 1, CASE WHEN event_id % 3 = 0 THEN concat('type=SOCKADDR', {_MSG}, ' saddr={{ fam=local path=/run/s', {_K}, ' }}')
        ELSE concat('type=SOCKADDR', {_MSG}, ' saddr={{ fam=inet laddr=8.8.8.8 lport=', {_K}, ' }}') END FROM host_event WHERE event_id % 10 = 2
    UNION ALL SELECT {_FILE}, event_id * 10 + 1, concat('type=PATH', {_MSG}, ' item=0 name="/etc/f', {_K}, '" nametype=NORMAL') FROM host_event WHERE event_id % 10 = 3
    UNION ALL SELECT {_FILE}, event_id * 10 + 2, concat('type=PATH', {_MSG}, ' item=1 name="/etc" nametype=PARENT') FROM host_event WHERE event_id % 10 = 3
    UNION ALL SELECT {_FILE}, event_id * 10 + 1, concat('type=AVC', {_MSG}, ' apparmor="DENIED" operation="open" profile="prof" name="/avc/', {_K}, '"', {_PIDS}, ' comm="avc"') FROM host_event WHERE event_id % 10 = 7
    UNION ALL SELECT {_FILE}, event_id * 10 + 5, 'no message here' FROM host_event"""
_PID, _PPID = "CAST(100 + (user_id + event_id) % 11 AS STRING)", "CAST(100 + user_id % 11 AS STRING)"
_AUDIT_SQL = f"""a AS (SELECT *, {_FILE} AS file, event_id % 10 AS m, {_PID} AS pid, CASE WHEN event_id % 10 IN (0, 1, 2, 3, 7, 9) THEN {_PPID} END AS ppid,
      CASE event_id % 10 WHEN 4 THEN '/usr/sbin/sshd' WHEN 5 THEN '/usr/sbin/cron' WHEN 6 THEN '/lib/systemd/systemd' WHEN 8 THEN '/usr/bin/sudo' ELSE concat('/usr/bin/x', CAST(event_id % 4 AS STRING)) END AS exe FROM host_event),
    x AS (SELECT file, pid, arg_max(exe, event_id) AS exe FROM a GROUP BY file, pid),
    ev AS (SELECT a.*, x.exe AS parent_exe,
      CASE m WHEN 4 THEN 'USER_AUTH' WHEN 5 THEN 'USER_START' WHEN 6 THEN 'SERVICE_START' WHEN 7 THEN 'AVC' WHEN 8 THEN 'USER_CMD' ELSE 'SYSCALL' END AS type,
      CASE m WHEN 0 THEN coalesce(x.exe, concat('pid:', ppid)) WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN a.exe ELSE concat('10.1.1.', {_K}) END
        WHEN 7 THEN 'avc' WHEN 8 THEN 'acct:bob' ELSE a.exe END AS src,
      CASE m WHEN 0 THEN a.exe WHEN 1 THEN concat('/missing/', {_K}, ' [not found]') WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN concat('/run/s', {_K}) ELSE concat('8.8.8.8:', {_K}) END
        WHEN 3 THEN concat('/etc/f', {_K}) WHEN 4 THEN concat('acct:', CASE WHEN event_id % 3 = 0 THEN 'root1' ELSE 'admin' END, ':USER_AUTH')
        WHEN 5 THEN 'pam:root:USER_START' WHEN 6 THEN concat('unit:svc', {_K}) WHEN 7 THEN concat('/avc/', {_K}) WHEN 8 THEN 'ls -la' END AS dest
      FROM a LEFT JOIN x ON x.file = a.file AND x.pid = a.ppid)"""


def audit_lines(spark, sf):
    return as_log(query(spark, sf, _AUDIT), spark)


@named(
    "audit_events",
    f"""WITH {_AUDIT_SQL} SELECT file, CAST(event_id AS STRING) AS event_id, type, pid, src, dest, CASE WHEN m = 0 THEN 'ls -la' END AS command,
    concat(CAST(ts_ns // 1000000000 AS STRING), '.', lpad(CAST(ts_ns // 1000000 % 1000 AS STRING), 3, '0')) AS timestamp FROM ev""",
)
def audit_events(spark, sf):
    """Multi-record audit events with their family's source and target names."""
    return audit.parse_events(audit_lines(spark, sf)).select("file", "event_id", "type", "pid", "src", "dest", "command", "timestamp")


@named(
    "audit_type_breakdown",
    f"WITH {_AUDIT_SQL} SELECT type, count(*) AS n FROM ev GROUP BY type",
)
def audit_type_breakdown(spark, sf):
    return audit.type_breakdown(audit.parse_events(audit_lines(spark, sf)))


_AUDIT_EDGE = f"""{_AUDIT_SQL}, ge AS (SELECT file, event_id, (ts_ns // 1000000) * 1000000 AS ts_ns,
      CASE m WHEN 0 THEN 'EVENT_EXECVE' WHEN 1 THEN 'EVENT_EXECVE_FAIL' WHEN 2 THEN 'EVENT_CONNECT' WHEN 3 THEN 'EVENT_OPENAT' WHEN 7 THEN 'EVENT_AVC_DENIED'
        WHEN 8 THEN 'EVENT_SUDO_CMD' WHEN 9 THEN 'EVENT_CLOSE_FAIL' ELSE concat('EVENT_', type) END AS edge_type,
      CASE m WHEN 0 THEN coalesce(parent_exe, concat('pid:', ppid)) WHEN 4 THEN src WHEN 7 THEN 'avc' WHEN 8 THEN 'acct:bob' ELSE exe END AS src_name,
      CASE WHEN m = 4 AND event_id % 4 <> 0 THEN 'NetFlowObject' WHEN m = 8 THEN 'PRINCIPAL_LOCAL' ELSE 'SUBJECT_PROCESS' END AS src_type,
      CASE m WHEN 4 THEN replace(dest, ':USER_AUTH', '') WHEN 5 THEN 'acct:root' WHEN 9 THEN 'syscall:close' ELSE dest END AS dst_name,
      CASE WHEN m IN (0, 6, 8, 9) THEN 'SUBJECT_PROCESS' WHEN m IN (4, 5) THEN 'PRINCIPAL_LOCAL' WHEN m = 2 AND event_id % 3 <> 0 THEN 'NetFlowObject' ELSE 'FileObject' END AS dst_type FROM ev)"""


@named(
    "audit_graph_edges",
    f"WITH {_AUDIT_EDGE} SELECT file, CAST(event_id AS STRING) AS event_id, ts_ns, edge_type, src_name, src_type, dst_name, dst_type FROM ge",
)
def audit_graph_edges(spark, sf):
    """One graph edge per event, ends named by family."""
    e = audit.event_edges(audit.parse_events(audit_lines(spark, sf)))
    return e.select("file", "event_id", "ts_ns", "edge_type", "src_name", "src_type", "dst_name", "dst_type")


@named(
    "audit_graph_totals",
    f"""WITH {_AUDIT_EDGE}, k AS (SELECT file, CASE WHEN src_type = 'SUBJECT_PROCESS' THEN concat(CASE WHEN m = 0 THEN ppid ELSE pid END, '|', src_name) ELSE src_name END AS s,
      CASE WHEN m IN (0, 8) THEN concat(pid, '|', dst_name) ELSE dst_name END AS d FROM ge JOIN ev USING (file, event_id)),
    n AS (SELECT file, count(DISTINCT u) AS n_nodes FROM (SELECT file, s AS u FROM k UNION ALL SELECT file, d FROM k) GROUP BY file)
    SELECT n.file, n.n_nodes, (SELECT count(*) FROM k WHERE k.file = n.file) AS n_edges FROM n""",
)
def audit_graph_totals(spark, sf):
    """Nodes and edges of the graph of every log."""
    e = audit.event_edges(audit.parse_events(audit_lines(spark, sf)))
    return build.graph_totals(audit.event_nodes(e), e, ["file"])


_MERGED = f"""{_AUDIT_SQL}, me AS (SELECT file, src AS src_name, dest AS dst_name, upper(CASE m WHEN 4 THEN type WHEN 5 THEN type WHEN 6 THEN type WHEN 8 THEN type
        WHEN 0 THEN 'execve' WHEN 1 THEN 'execve' WHEN 2 THEN 'connect' WHEN 3 THEN 'openat' ELSE 'open' END) AS edge_type,
      min((ts_ns // 1000000) * 1000000) AS ts_ns, count(*) AS n_events FROM ev WHERE dest IS NOT NULL GROUP BY ALL),
    mn AS (SELECT file, name, min(ts_ns) AS ts_ns, bool_or(s) AS s FROM (SELECT file, src_name AS name, ts_ns, TRUE AS s FROM me
      UNION ALL SELECT file, dst_name, ts_ns, FALSE FROM me) GROUP BY file, name)"""


@named("audit_merged_edges", f"WITH {_MERGED} SELECT file, src_name, dst_name, edge_type, ts_ns, n_events FROM me")
def audit_merged_edges(spark, sf):
    """Repeats of (source, operation, target) as one edge with a count."""
    _, _, e = audit.merged_graph(audit.parse_events(audit_lines(spark, sf)), ["file"], ["file"])
    return e.select("file", "src_name", "dst_name", "edge_type", "ts_ns", "n_events")


@named(
    "audit_merged_event_ids",
    f"""WITH {_AUDIT_SQL}, op AS (SELECT *, upper(CASE m WHEN 4 THEN type WHEN 5 THEN type WHEN 6 THEN type WHEN 8 THEN type
        WHEN 0 THEN 'execve' WHEN 1 THEN 'execve' WHEN 2 THEN 'connect' WHEN 3 THEN 'openat' ELSE 'open' END) AS edge_type FROM ev WHERE dest IS NOT NULL)
    SELECT file, src AS src_name, dest AS dst_name, edge_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS event_ids
    FROM op GROUP BY ALL""",
)
def audit_merged_event_ids(spark, sf):
    """Ids of the events that a merged edge stands for."""
    return audit.merged_event_ids(audit.parse_events(audit_lines(spark, sf)), ["file"])


@named(
    "audit_triplets",
    f"""WITH {_MERGED}, fl AS (SELECT file, src AS src_name, dest AS dst_name, upper(CASE m WHEN 4 THEN type WHEN 5 THEN type WHEN 6 THEN type WHEN 8 THEN type
        WHEN 0 THEN 'execve' WHEN 1 THEN 'execve' WHEN 2 THEN 'connect' WHEN 3 THEN 'openat' ELSE 'open' END) AS edge_type,
        min(event_id) AS first_id FROM ev WHERE dest IS NOT NULL GROUP BY ALL)
    SELECT me.file, row_number() OVER (PARTITION BY me.file ORDER BY me.ts_ns, fl.first_id, me.src_name, me.edge_type, me.dst_name) AS pos,
      me.src_name, me.edge_type, me.dst_name FROM me JOIN fl USING (file, src_name, dst_name, edge_type)""",
)
def audit_triplets(spark, sf):
    """Merged edges of every graph as triplets in time order."""
    _, _, e = audit.merged_graph(audit.parse_events(audit_lines(spark, sf)), ["file"], ["file"])
    return audit.triplets(e, ["file"])


@named(
    "audit_batch_counters",
    f"""WITH {_MERGED}, l AS (SELECT DISTINCT file FROM ev), n AS (SELECT l.file, count(me.src_name) AS n FROM l LEFT JOIN me ON me.file = l.file GROUP BY l.file)
    SELECT count(CASE WHEN n > 0 THEN 1 END) AS n_ok, count(CASE WHEN n = 0 THEN 1 END) AS n_empty, CAST(sum(n) AS BIGINT) AS n_triples FROM n""",
)
def audit_batch_counters(spark, sf):
    """Logs that gave triplets and logs that gave none."""
    ev = audit.parse_events(audit_lines(spark, sf))
    _, _, e = audit.merged_graph(ev, ["file"], ["file"])
    return audit.batch_counters(ev, audit.triplets(e, ["file"]), ["file"])


@named(
    "audit_merged_nodes",
    f"""WITH {_MERGED} SELECT file, name, ts_ns, CASE WHEN name LIKE 'pam:%' OR name LIKE 'acct:%' THEN 'PRINCIPAL_LOCAL'
    WHEN regexp_matches(name, '^(unit|bpf|pid):') OR s THEN 'SUBJECT_PROCESS' WHEN contains(name, '/') THEN 'FileObject'
    WHEN regexp_matches(name, ':[0-9]+$') THEN 'NetFlowObject' ELSE 'SUBJECT_PROCESS' END AS type FROM mn""",
)
def audit_merged_nodes(spark, sf):
    """Node type from name and roles, time from the incident edges."""
    _, n, _ = audit.merged_graph(audit.parse_events(audit_lines(spark, sf)), ["file"], ["file"])
    return n.select("file", "name", "ts_ns", "type")


@named(
    "audit_merged_graphs",
    f"""WITH {_MERGED} SELECT file, min(ts_ns) AS start_ts, max(ts_ns) AS end_ts, count(*) AS n_nodes,
    (SELECT count(*) FROM me WHERE me.file = mn.file) AS n_edges FROM mn GROUP BY file""",
)
def audit_merged_graphs(spark, sf):
    g, _, _ = audit.merged_graph(audit.parse_events(audit_lines(spark, sf)), ["file"], ["file"])
    return g.select("file", "start_ts", "end_ts", "n_nodes", "n_edges")


_HOST_SQL = f"""l AS (SELECT {_FILE} AS file, count(*) AS n_events, min(event_id) AS f FROM host_event GROUP BY ALL),
    p AS (SELECT *, split_part(file, '/', 3) AS tactic, split_part(file, '/', 4) AS technique, split_part(file, '/', 5) AS step, split_part(file, '/', 6) AS host,
          split_part(file, '/', 8) AS logdir FROM l),
    tg AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY tactic, technique, step, host) > 1 THEN concat(host, '-', logdir) ELSE host END AS host_tag FROM p),
    h AS (SELECT *, CASE WHEN host_tag = 'client' OR starts_with(host_tag, 'client-') THEN 1 WHEN host_tag = 'docker' OR starts_with(host_tag, 'docker-') THEN 3 END AS pr,
          count(*) OVER (PARTITION BY tactic, technique, step) AS hosts FROM tg)"""


@named("audit_log_locations", f"WITH {_HOST_SQL} SELECT file, tactic, technique, step, host, logdir, host_tag FROM tg")
def audit_log_locations(spark, sf):
    """Path columns of every log and its host tag."""
    files = query(spark, sf, f"SELECT DISTINCT {_FILE} AS file FROM host_event")
    return audit.host_tags(audit.path_columns(files))


@named(
    "audit_primary_hosts",
    f"""WITH {_HOST_SQL}, s AS (SELECT tactic, technique, step, max(hosts) AS hosts, arg_min(host_tag, (pr, host_tag)) FILTER (pr IS NOT NULL) AS pick,
      arg_min(n_events, (pr, host_tag)) FILTER (pr IS NOT NULL) AS pick_n, arg_min(host_tag, (-n_events, f)) AS rich, max(n_events) AS rich_n, min(host_tag) AS lone FROM h GROUP BY ALL)
    SELECT * FROM (SELECT tactic, technique, step, CASE WHEN hosts = 1 THEN lone WHEN pick_n < 5 AND rich_n > pick_n THEN rich ELSE pick END AS host_tag FROM s)
    WHERE host_tag IS NOT NULL""",
)
def audit_primary_hosts(spark, sf):
    """The log to read per step: preferred host, or the richest when that one is too poor."""
    n = audit.parse_events(audit_lines(spark, sf)).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("event_no").alias("first")
    )
    return audit.primary_hosts(audit.host_tags(audit.path_columns(n)))


@named(
    "decoded_arguments",
    """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN concat('part ', CAST(partkey AS STRING))
    WHEN 1 THEN concat('hex ', CAST(suppkey AS STRING)) ELSE concat('raw', CAST(suppkey AS STRING), 'z') END AS arg FROM ship_line""",
)
def decoded_arguments(spark, sf):
    """Quoted, hex and plain arguments."""
    v = query(
        spark, sf,
        """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN concat('"part ', CAST(partkey AS STRING), '"')
        WHEN 1 THEN hex(concat('hex ', CAST(suppkey AS STRING))) ELSE concat('raw', CAST(suppkey AS STRING), 'z') END AS v FROM ship_line""",
    )
    return v.select("id", audit.decode_argument(F.col("v")).alias("arg"))


# --- knowledge base ----------------------------------------------------------------------------

_OBJECTS = """SELECT 1000000 + r_regionkey AS pos, concat('tac-', CAST(r_regionkey AS STRING)) AS id, 'x-mitre-tactic' AS type, r_name AS name, CAST(NULL AS STRING) AS description,
      concat('phase-', CAST(r_regionkey AS STRING)) AS x_mitre_shortname, false AS x_mitre_is_subtechnique, false AS x_mitre_deprecated, false AS revoked,
      concat('TA000', CAST(r_regionkey AS STRING)) AS ext, CAST(NULL AS STRING) AS phase, CAST(NULL AS STRING) AS phase2, CAST(NULL AS STRING) AS relationship_type,
      CAST(NULL AS STRING) AS source_ref, CAST(NULL AS STRING) AS target_ref, CAST(NULL AS STRING) AS ref1, CAST(NULL AS STRING) AS ref2, CAST(NULL AS STRING) AS platform FROM region
    UNION ALL SELECT s_suppkey, concat('att-', CAST(s_suppkey AS STRING)), 'attack-pattern', s_name, NULL, NULL, s_suppkey % 4 = 1, s_suppkey % 11 = 0, s_suppkey % 13 = 0,
      CASE WHEN s_suppkey % 4 = 1 THEN concat('T', CAST(s_suppkey - 1 AS STRING), '.001') ELSE concat('T', CAST(s_suppkey AS STRING)) END,
      concat('phase-', CAST(s_suppkey % 5 AS STRING)), CASE WHEN s_suppkey % 3 = 0 THEN concat('phase-', CAST((s_suppkey + 1) % 5 AS STRING)) END, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 2000000 + p_partkey, concat('an-', CAST(p_partkey AS STRING)), 'x-mitre-analytic', p_name, concat(' ', p_name, ' ', p_type, ' '), NULL, false, false, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      CASE WHEN p_partkey % 3 = 0 THEN 'Windows' ELSE 'Linux' END FROM part
    UNION ALL SELECT 3000000 + c_custkey, concat('str-', CAST(c_custkey AS STRING)), 'x-mitre-strategy', c_name, NULL, NULL, false, false, false, NULL, NULL, NULL, NULL, NULL, NULL,
      concat('an-', CAST(c_custkey % 150 AS STRING)), concat('an-', CAST(c_custkey * 7 % 150 AS STRING)), NULL FROM customer
    UNION ALL SELECT 4000000 + c_custkey, concat('rel-', CAST(c_custkey AS STRING)), 'relationship', NULL, NULL, NULL, false, false, false, NULL, NULL, NULL,
      CASE WHEN c_custkey % 6 = 0 THEN 'uses' ELSE 'detects' END, concat('str-', CAST(c_custkey AS STRING)), concat('att-', CAST(c_custkey % 80 AS STRING)), NULL, NULL, NULL FROM customer"""
_KB_SQL = """ana AS (SELECT p_partkey, trim(concat(p_name, ' ', p_type)) AS d FROM part WHERE p_partkey % 3 <> 0),
    ref AS (SELECT c_custkey, c_custkey % 80 AS tech, c_custkey % 150 AS an, 0 AS rp FROM customer WHERE c_custkey % 6 <> 0
            UNION ALL SELECT c_custkey, c_custkey % 80, c_custkey * 7 % 150, 1 FROM customer WHERE c_custkey % 6 <> 0),
    chain AS (SELECT r.tech, r.c_custkey, r.rp, a.d FROM ref r JOIN ana a ON a.p_partkey = r.an),
    tech AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 1 THEN concat('T', CAST(s_suppkey - 1 AS STRING), '.001') ELSE concat('T', CAST(s_suppkey AS STRING)) END AS tid,
             s_suppkey % 4 = 1 AS sub, s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 AS old FROM supplier),
    ph AS (SELECT s_suppkey, s_suppkey % 5 AS ph FROM supplier UNION SELECT s_suppkey, (s_suppkey + 1) % 5 FROM supplier WHERE s_suppkey % 3 = 0)"""


def knowledge_objects(spark, sf):
    o = query(spark, sf, _OBJECTS)
    phase = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.col(c).alias("phase_name")))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    return o.select(
        "pos", "id", "type", "name", "description", "x_mitre_shortname", "x_mitre_is_subtechnique", "x_mitre_deprecated", "revoked",
        some(F.array(F.when(F.col("ext").isNotNull(), F.struct(F.lit("mitre-attack").alias("source_name"), F.col("ext").alias("external_id"))))).alias("external_references"),
        some(F.array(phase("phase"), phase("phase2"))).alias("kill_chain_phases"),
        "relationship_type", "source_ref", "target_ref",
        some(F.array("ref1", "ref2")).alias("x_mitre_analytic_refs"), some(F.array("platform")).alias("x_mitre_platforms"),
    )


@named(
    "platform_analytics",
    f"WITH {_KB_SQL} SELECT concat('att-', CAST(tech AS STRING)) AS technique_ref, d AS description, count(*) AS n FROM chain GROUP BY ALL",
)
def platform_analytics(spark, sf):
    """Technique <- detects - strategy -> analytics of the platform."""
    a = knowledge.platform_analytics(knowledge_objects(spark, sf))
    return a.groupBy("technique_ref", "description").agg(F.count(F.lit(1)).alias("n"))


@named(
    "tactics_with_parent_fallback",
    f"""WITH {_KB_SQL}, w AS (SELECT DISTINCT concat('T', CAST(suppkey AS STRING), CASE WHEN partkey % 2 = 0 THEN '.001' ELSE '' END) AS tid FROM ship_line),
    v AS (SELECT w.tid, CASE WHEN w.tid IN (SELECT tid FROM tech) THEN w.tid ELSE split_part(w.tid, '.', 1) END AS via FROM w)
    SELECT DISTINCT v.tid, concat('phase-', CAST(ph.ph AS STRING)) AS tactic FROM v JOIN tech t ON t.tid = v.via JOIN ph ON ph.s_suppkey = t.s_suppkey""",
)
def tactics_with_parent_fallback(spark, sf):
    """Tactics of a technique, or of its parent technique."""
    wanted = query(spark, sf, "SELECT DISTINCT concat('T', CAST(suppkey AS STRING), CASE WHEN partkey % 2 = 0 THEN '.001' ELSE '' END) AS tid FROM ship_line")
    return knowledge.tactics_with_fallback(wanted, knowledge.technique_tactics(knowledge_objects(spark, sf)))


_FOLDERS = "SELECT DISTINCT concat('T', CAST(suppkey AS STRING), '-', CASE WHEN partkey % 2 = 0 THEN '001' ELSE '000' END) AS folder FROM ship_line"


@named(
    "technique_placements",
    f"""WITH {_KB_SQL}, f AS ({_FOLDERS}), w AS (SELECT folder, CASE WHEN folder LIKE '%-000' THEN split_part(folder, '-', 1) ELSE replace(folder, '-', '.') END AS tid FROM f),
    v AS (SELECT folder, CASE WHEN tid IN (SELECT tid FROM tech) THEN tid ELSE split_part(tid, '.', 1) END AS via FROM w)
    SELECT concat('phase_', CAST(ph.ph AS STRING)) AS tactic, count(DISTINCT folder) AS n_techniques FROM v JOIN tech t ON t.tid = v.via JOIN ph ON ph.s_suppkey = t.s_suppkey GROUP BY ALL""",
)
def technique_placements(spark, sf):
    folders = query(spark, sf, _FOLDERS).withColumn("tid", tx.technique_id(F.col("folder")))
    return knowledge.placements(folders, knowledge.technique_tactics(knowledge_objects(spark, sf)))


@named(
    "tactic_templates",
    f"""WITH {_KB_SQL}, c AS (SELECT tech, d, min((c_custkey, rp)) AS p FROM chain GROUP BY tech, d)
    SELECT r.r_name AS tactic, concat('TA000', CAST(r.r_regionkey AS STRING)) AS tactic_id, t.tid, t.s_name AS technique, c.d AS description
    FROM region r JOIN ph ON ph.ph = r.r_regionkey JOIN tech t ON t.s_suppkey = ph.s_suppkey LEFT JOIN c ON c.tech = t.s_suppkey WHERE NOT t.sub AND NOT t.old""",
)
def tactic_templates(spark, sf):
    """Current top-level techniques of each tactic with their distinct platform descriptions."""
    return knowledge.tactic_templates(knowledge_objects(spark, sf)).select("tactic", "tactic_id", "tid", "technique", "description")


_DS = "SELECT DISTINCT CASE WHEN suppkey % 2 = 0 THEN 'impact' ELSE 'discovery' END AS tactic, concat('T', CAST(suppkey AS STRING), '-', CASE WHEN partkey % 2 = 0 THEN '001' ELSE '000' END) AS folder FROM ship_line"


@named(
    "dataset_templates",
    f"""WITH {_KB_SQL}, f AS ({_DS}), w AS (SELECT tactic, folder, CASE WHEN folder LIKE '%-000' THEN split_part(folder, '-', 1) ELSE replace(folder, '-', '.') END AS tid FROM f),
    r AS (SELECT w.tactic, c.d, min((w.folder, c.c_custkey, c.rp)) AS p FROM w JOIN tech t ON t.tid = w.tid JOIN chain c ON c.tech = t.s_suppkey GROUP BY w.tactic, c.d)
    SELECT tactic, d AS description, row_number() OVER (PARTITION BY tactic ORDER BY p) AS pos FROM r""",
)
def dataset_templates(spark, sf):
    """Distinct descriptions of the techniques a dataset has, in folder order."""
    return _numbered(knowledge.dataset_templates(query(spark, sf, _DS), knowledge_objects(spark, sf)))


@named(
    "dataset_templates_base_techniques",
    f"""WITH {_KB_SQL}, f AS ({_DS}), w AS (SELECT tactic, min(folder) AS folder, split_part(folder, '-', 1) AS tid FROM f GROUP BY tactic, split_part(folder, '-', 1)),
    r AS (SELECT w.tactic, c.d, min((w.folder, c.c_custkey, c.rp)) AS p FROM w JOIN tech t ON t.tid = w.tid JOIN chain c ON c.tech = t.s_suppkey GROUP BY w.tactic, c.d)
    SELECT tactic, d AS description, row_number() OVER (PARTITION BY tactic ORDER BY p) AS pos FROM r""",
)
def dataset_templates_base_techniques(spark, sf):
    return _numbered(knowledge.dataset_templates(query(spark, sf, _DS), knowledge_objects(spark, sf), base_only=True))


def _numbered(t):
    from provloom.operators import ordered

    keyed = t.withColumn("one", F.lit(0)).select("tactic", "description", "one", F.col("pos").alias("at"))
    return ordered.scan(keyed, ["tactic"], ["one", "at"], index="pos").select("tactic", "description", "pos")


@named(
    "technique_gaps",
    f"""WITH {_KB_SQL}, f AS ({_DS}), w AS (SELECT DISTINCT CASE WHEN folder LIKE '%-000' THEN split_part(folder, '-', 1) ELSE replace(folder, '-', '.') END AS tid FROM f)
    SELECT w.tid, t.tid IS NOT NULL AS found, (SELECT count(*) FROM chain c WHERE c.tech = t.s_suppkey) AS n_descriptions FROM w LEFT JOIN tech t ON t.tid = w.tid""",
)
def technique_gaps(spark, sf):
    """Wanted techniques the knowledge base lacks, or has no platform description for."""
    tid = query(spark, sf, _DS).select(tx.technique_id(F.col("folder")).alias("tid"))
    return knowledge.technique_gaps(tid, knowledge_objects(spark, sf))


@named(
    "tactic_description_parts",
    """SELECT p_partkey, part, CASE part WHEN 'objective' THEN concat(p_name, ' steals data, ', p_brand, ', ', p_type, '.') WHEN 'outcome' THEN concat('Their Goal is ', p_name, '.')
    WHEN 'relationship' THEN 'See Impact techniques.' ELSE concat('They use ', p_brand, '!') END AS sentence
    FROM part, (SELECT unnest(['objective', 'outcome', 'relationship', 'technique use']) AS part)""",
)
def tactic_description_parts(spark, sf):
    """Objective, outcome, relationship and technique-use sentences of a description."""
    d = query(
        spark, sf,
        """SELECT p_partkey, concat(p_name, ' steals data', chr(10), ' * ', p_brand, chr(10), ' * ', p_type, chr(10), 'Their Goal is ', p_name, '. See Impact', chr(10),
        'techniques. They use ', p_brand, '!') AS text FROM part""",
    )
    parts = d.select("p_partkey", F.explode(knowledge.describe_tactic(F.col("text"), F.lit("Collection"))).alias("p"))
    return parts.select("p_partkey", "p.part", "p.sentence")


# --- text folders ------------------------------------------------------------------------------

_FILES = """SELECT concat(CASE WHEN doc_id % 9 = 4 THEN '.' ELSE '' END, 'report', CAST(doc_id // 2 AS STRING), CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN '_abstracted' WHEN doc_id % 2 = 1 THEN '_b' ELSE '' END,
    CASE WHEN doc_id % 10 = 7 THEN '.md' ELSE '.txt' END) AS file_name, text AS value FROM documents"""


@named(
    "preferred_reports",
    f"""WITH f AS (SELECT regexp_replace(file_name, '[.]txt$', '') AS key, trim(value) AS text FROM ({_FILES}) WHERE file_name LIKE '%.txt' AND NOT starts_with(file_name, '.') AND trim(value) <> ''),
    s AS (SELECT *, regexp_replace(key, '_abstracted$', '') AS stem, CASE WHEN key LIKE '%\\_abstracted' ESCAPE '\\' THEN 0 ELSE 1 END AS v FROM f)
    SELECT stem, arg_min(key, v) AS key, md5(arg_min(text, v)) AS digest FROM s GROUP BY stem""",
)
def preferred_reports(spark, sf):
    """Reports of a folder, the abstracted variant where there is one."""
    t = reports.prefer_variant(reports.keyed_texts(query(spark, sf, _FILES)))
    return t.select("stem", "key", F.md5("text").alias("digest"))


_TMPL = """SELECT p_partkey, concat('TA', lpad(CAST(p_partkey % 12 AS STRING), 4, '0'), '_', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 3 = 0 THEN concat('_aug', CAST(p_partkey AS STRING)) ELSE concat('_', CAST(p_partkey AS STRING)) END, '.txt') AS file_name,
    concat('ID : x', chr(10), 'OBJECTIVE  : ', p_brand, ' tries', chr(10), 'TECHNIQUES USE', chr(10), '------------', chr(10), chr(10), p_name, chr(10), '  ', p_type, chr(10), chr(10), '------------', chr(10),
    'LINUX DETECTION STRATEGIES', chr(10), '============', chr(10), 'watch ', p_name, chr(10), 'and ', p_type, chr(10), '============', chr(10), 'tail') AS value FROM part"""


def _templates(spark, sf, focus):
    labels = spark.createDataFrame([(f"tactic{i}", f"TA{i:04d}", i) for i in range(10)], "label string, tactic_id string, pos int")
    return reports.label_templates(reports.keyed_texts(query(spark, sf, _TMPL)), labels, focus)


@named(
    "labelled_template_sections",
    f"""SELECT regexp_replace(file_name, '[.]txt$', '') AS key, concat('tactic', CAST(p_partkey % 12 AS STRING)) AS label, concat(p_brand, ' tries ', p_name, ' ', p_type) AS text
    FROM ({_TMPL}) t JOIN part USING (p_partkey) WHERE p_partkey % 12 < 10 AND p_partkey % 3 <> 0""",
)
def labelled_template_sections(spark, sf):
    """Original templates with their label and the objective and technique sections."""
    return reports.originals(_templates(spark, sf, "sections")).select("key", "label", "text")


@named(
    "template_linux_sections",
    f"""SELECT regexp_replace(file_name, '[.]txt$', '') AS key, p_partkey % 3 = 0 AS is_augmented, concat('watch ', p_name, chr(10), 'and ', p_type) AS text
    FROM ({_TMPL}) t JOIN part USING (p_partkey) WHERE p_partkey % 12 < 10""",
)
def template_linux_sections(spark, sf):
    return _templates(spark, sf, "linux").select("key", "is_augmented", "text")


_SEQ = """SELECT concat('step', CAST(l_orderkey % 700 AS STRING)) AS step, CASE l_returnflag WHEN 'A' THEN 'impact' WHEN 'N' THEN 'discovery' ELSE 'other' END AS folder,
    concat('/seq/', l_returnflag, '/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS path, CAST(l_quantity AS INT) % 6 AS n FROM lineitem"""


@named(
    "first_sequence_per_step",
    f"""WITH s AS (SELECT *, CASE folder WHEN 'discovery' THEN 1 WHEN 'impact' THEN 2 END AS r FROM ({_SEQ}))
    SELECT step, arg_min(path, (r, path)) AS path, CAST(arg_min(n, (r, path)) AS BIGINT) AS n_events, arg_min(n, (r, path)) < 3 AS dropped FROM s WHERE r IS NOT NULL GROUP BY step""",
)
def first_sequence_per_step(spark, sf):
    """First sequence of a step over folders in order; short ones are marked as dropped."""
    s = query(spark, sf, _SEQ).withColumn("sequence", F.array_repeat(F.lit("a b c."), F.col("n"))).drop("n")
    return reports.first_per_step(s, ["discovery", "impact"], 3).select("step", "path", "n_events", "dropped")


@named(
    "sequence_file_split",
    """SELECT concat(lang, '_', CAST(doc_id AS STRING), '.json') AS file_name, concat(lang, '_and_Control') AS label, CASE WHEN doc_id = 3 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 7 <> 0""",
)
def sequence_file_split(spark, sf):
    """Sequences labelled by tactic, one file held out; documents without a tactic are left out."""
    d = query(spark, sf, "SELECT doc_id, lang, text FROM documents")
    s = d.select(
        F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.when(F.col("doc_id") % 7 != 0, F.concat("lang", F.lit(" & Control — x"))).otherwise("").alias("tactic"),
        F.split("text", r"\. ").alias("sequence"),
    )
    held = s.filter("file_name like '%\\_3.json'").first()["file_name"]
    return reports.file_split(s, held).select("file_name", "label", "split")


@named(
    "run_log_metrics",
    """SELECT o_orderkey, round(o_totalprice / 1000, 2) AS loss_ep1, least(round(o_totalprice / 1000, 2), round(o_custkey / 7, 2)) AS loss_best, 'Execution' AS true_label,
    round(o_custkey / 1000, 3) AS true_score, 'Impact' AS top1, 'Execution' AS top2, 'Discovery' AS top3, o_orderkey % 2 = 0 AS correct FROM orders""",
)
def run_log_metrics(spark, sf):
    """Losses, scores and correctness out of run logs."""
    t = query(
        spark, sf,
        """SELECT o_orderkey, concat('Ep=1  Loss=', format_string('%.2f', o_totalprice / 1000), chr(10), 'Ep=2  Loss=', format_string('%.2f', round(o_custkey / 7, 2)), chr(10), 'Stage 7', chr(10),
        '  a_b.json  Execution  +', format_string('%.3f', round(o_custkey / 1000, 3)), '  Impact  +0.900', chr(10), 'All scores: Execution=+0.500 Discovery=-0.100 Impact=+0.900 Stealth=-0.500', chr(10),
        'Accuracy: ', CASE WHEN o_orderkey % 2 = 0 THEN '1/1' ELSE '0/1' END) AS text FROM orders""",
    )
    m = reports.run_metrics(F.col("text"))
    return t.select("o_orderkey", *[m[c].alias(c) for c in ("loss_ep1", "loss_best", "true_label", "true_score", "top1", "top2", "top3", "correct")])


@named(
    "template_paragraphs",
    """SELECT p_partkey, concat('They often use ', p_name, ' and ', p_brand, ' together') AS paragraph FROM part""",
)
def template_paragraphs(spark, sf):
    """Template paragraphs without rules, headers and short fragments."""
    t = query(
        spark, sf,
        """SELECT p_partkey, concat('ID : T1', chr(10), chr(10), '========', chr(10), chr(10), 'short', chr(10), chr(10), 'They often use ', p_name, chr(10), 'and ', p_brand, ' together', chr(10), '--------',
        chr(10), chr(10), 'MITRE reference paragraph that is long') AS text FROM part""",
    )
    return t.select("p_partkey", F.explode(tx.split_paragraphs(F.col("text"))).alias("paragraph"))
