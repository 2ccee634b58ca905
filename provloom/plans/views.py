"""Canonical relations derived from the supplied tables.

Each relation is one SELECT that reads the same in Spark SQL and in the checking engine; the mark
``{TS_NS:column}`` (epoch nanoseconds) and whole-number division stand for the dialect differences. Relations name
each other, so ``with_views`` builds the WITH clause in dependency order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SPARK = {"TS_NS": "(unix_micros(cast({0} as timestamp)) * 1000)", "DIV": "DIV"}
DUCK = {"TS_NS": "(epoch_us({0}) * 1000)", "DIV": "//"}

VIEWS: dict[str, str] = {
    # users act on keyed objects: a bipartite, timed edge list
    "host_event": """
        SELECT event_id, user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, event_type, value,
               {TS_NS:ts} AS ts_ns
        FROM events""",
    "host_edge": """
        SELECT concat('p', CAST(user_id AS STRING)) AS src, 'SUBJECT_PROCESS' AS src_type,
               concat('o', CAST(k AS STRING)) AS dst,
               CASE WHEN k % 3 = 0 THEN 'NetFlowObject' ELSE 'FILE_OBJECT_BLOCK' END AS dst_type,
               CASE event_type WHEN 'view' THEN 'EVENT_READ' WHEN 'click' THEN 'EVENT_READ_SOCKET_PARAMS'
                    WHEN 'error' THEN 'EVENT_OPEN' WHEN 'purchase' THEN 'EVENT_SENDTO'
                    ELSE 'EVENT_CONNECT' END AS edge_type,
               ts_ns, event_id AS line_no
        FROM host_event""",
    "host_name": """
        SELECT DISTINCT concat('p', CAST(user_id AS STRING)) AS uuid, 'SUBJECT_PROCESS' AS type,
               CASE user_id % 14
                    WHEN 0 THEN concat('/usr/lib/firefox/firefox -P ', CAST(user_id AS STRING))
                    WHEN 1 THEN 'thunderbird'
                    WHEN 2 THEN '/usr/sbin/sshd -D'
                    WHEN 3 THEN '-bash'
                    WHEN 4 THEN concat('./implant ', CAST(user_id AS STRING))
                    WHEN 5 THEN concat('/home/admin/clean ', CAST(user_id AS STRING))
                    WHEN 6 THEN 'fluxbox'
                    WHEN 7 THEN '/bin/cat /etc/passwd'
                    WHEN 8 THEN concat('/opt/tool/run', CAST(user_id AS STRING))
                    WHEN 9 THEN 'gnome-terminal'
                    WHEN 10 THEN concat('/tmp/drop', CAST(user_id AS STRING))
                    WHEN 11 THEN concat('Worker:', CAST(user_id AS STRING))
                    WHEN 12 THEN '/etc/init.d/rcS start'
                    ELSE '/usr/bin/wget http://host' END AS name
        FROM host_event
        UNION ALL
        SELECT DISTINCT concat('o', CAST(k AS STRING)) AS uuid,
               CASE WHEN k % 3 = 0 THEN 'NetFlowObject' ELSE 'FILE_OBJECT_BLOCK' END AS type,
               CASE WHEN k % 3 = 0 THEN
                    CASE (k // 3) % 6
                         WHEN 0 THEN concat('128.55.12.110_4', CAST(k AS STRING), '_161.116.88.', CAST(k AS STRING), '_443')
                         WHEN 1 THEN concat('10.0.0.5_5000_192.168.1.', CAST(k AS STRING), '_80')
                         WHEN 2 THEN concat('128.55.12.110_4', CAST(k AS STRING), '_161.116.88.7_', CAST(k AS STRING))
                         WHEN 3 THEN concat('LOCAL_', CAST(k AS STRING))
                         WHEN 4 THEN 'NETLINK:route'
                         ELSE concat('128.55.12.1_', CAST(k AS STRING), '_NA_null') END
               ELSE CASE k % 10
                         WHEN 0 THEN concat('/tmp/cache/item_', CAST(k AS STRING), '.tmp')
                         WHEN 1 THEN concat('/var/log/app', CAST(k AS STRING), '.log')
                         WHEN 2 THEN concat('/etc/conf.d/svc', CAST(k AS STRING), '.conf')
                         WHEN 3 THEN concat('/home/admin/.mozilla/prof', CAST(k AS STRING))
                         WHEN 4 THEN concat('/usr/lib/x86/lib', CAST(k AS STRING), '.so.6')
                         WHEN 5 THEN '/etc'
                         WHEN 6 THEN concat('/proc/', CAST(k AS STRING), '/stat')
                         WHEN 7 THEN concat('/home/admin/Downloads/Doc', CAST(k AS STRING), '.bin')
                         WHEN 8 THEN concat('HKLM/Run/', CAST(k AS STRING))
                         ELSE concat('data', CAST(k AS STRING)) END END AS name
        FROM host_event""",
    # customer -> order -> part and order -> supplier: deep and acyclic
    "ship_line": """
        SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey,
               {TS_NS:min(l_shipdate)} AS ts_ns, min(l_quantity) AS quantity
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "trade_edge": """
        SELECT concat('c', CAST(o_custkey AS STRING)) AS src, 'SUBJECT_PROCESS' AS src_type,
               concat('d', CAST(o_orderkey AS STRING)) AS dst, 'SUBJECT_PROCESS' AS dst_type,
               'EVENT_CLONE' AS edge_type, {TS_NS:o_orderdate} AS ts_ns, o_orderkey * 20 AS line_no
        FROM orders
        UNION ALL
        SELECT concat('d', CAST(l_orderkey AS STRING)) AS src, 'SUBJECT_PROCESS' AS src_type,
               concat('f', CAST(partkey AS STRING)) AS dst, 'FILE_OBJECT_BLOCK' AS dst_type,
               'EVENT_WRITE' AS edge_type, ts_ns, l_orderkey * 20 + 2 * l_linenumber AS line_no
        FROM ship_line
        UNION ALL
        SELECT concat('d', CAST(l_orderkey AS STRING)) AS src, 'SUBJECT_PROCESS' AS src_type,
               concat('n', CAST(suppkey AS STRING)) AS dst, 'NetFlowObject' AS dst_type,
               'EVENT_SENDTO' AS edge_type, ts_ns, l_orderkey * 20 + 2 * l_linenumber + 1 AS line_no
        FROM ship_line""",
    # absolute and relative paths of every shape the rules know
    "path_list": """
        SELECT l_orderkey * 10 + l_linenumber AS path_id,
               CASE (l_orderkey + l_linenumber) % 16
                    WHEN 0 THEN concat('/etc/apache', CAST(suppkey AS STRING), '/site.d/host.conf')
                    WHEN 1 THEN concat('/var/log/app', CAST(suppkey AS STRING), '.log')
                    WHEN 2 THEN '/etc/passwd'
                    WHEN 3 THEN concat('/usr/bin/tool', CAST(partkey AS STRING), '.sh')
                    WHEN 4 THEN concat('/home/admin/docs/note', CAST(partkey AS STRING), '.tar.gz')
                    WHEN 5 THEN concat('/root/work/run', CAST(suppkey AS STRING), '.py')
                    WHEN 6 THEN concat('/usr/lib/python', CAST(suppkey AS STRING), '/mod.so')
                    WHEN 7 THEN concat('/srv/data/blob', CAST(partkey AS STRING), '.bin')
                    WHEN 8 THEN concat('/home/u', CAST(suppkey AS STRING))
                    WHEN 9 THEN concat('/opt/lib64/', CAST(partkey AS STRING), '.so')
                    WHEN 10 THEN concat('relative/', CAST(partkey AS STRING), '.txt')
                    WHEN 11 THEN concat('/tmp//a/./b', CAST(suppkey AS STRING), '.Temp')
                    WHEN 12 THEN concat('/home/admin/.bashrc', CAST(suppkey AS STRING))
                    WHEN 13 THEN concat('/proc/', CAST(suppkey AS STRING), '/')
                    WHEN 14 THEN concat('/home/a/b/c/d', CAST(partkey AS STRING), '.x')
                    ELSE concat('/var/www', CAST(suppkey AS STRING)) END AS path
        FROM ship_line""",
    # one process per customer walks /data/<customer>, then an order folder, then its lines
    "walk_edge": """
        SELECT concat('c', CAST(o_custkey AS STRING)) AS src, 'SUBJECT_PROCESS' AS src_type,
               concat('/data/', CAST(o_custkey AS STRING)) AS dst, 'FILE' AS dst_type,
               'EVENT_OPEN' AS edge_type, min({TS_NS:o_orderdate}) AS ts_ns, min(o_orderkey) * 40 AS line_no
        FROM orders GROUP BY o_custkey
        UNION ALL
        SELECT concat('c', CAST(o_custkey AS STRING)), 'SUBJECT_PROCESS',
               concat('/data/', CAST(o_custkey AS STRING), '/', CAST(o_orderkey AS STRING)), 'FILE',
               CASE WHEN o_orderkey % 4 = 0 THEN 'EVENT_READ' ELSE 'EVENT_OPEN' END,
               {TS_NS:o_orderdate}, o_orderkey * 40 + 1
        FROM orders
        UNION ALL
        SELECT concat('c', CAST(o_custkey AS STRING)), 'SUBJECT_PROCESS',
               concat('/data/', CAST(o_custkey AS STRING), '/', CAST(o_orderkey AS STRING), '/',
                      CAST(l_linenumber AS STRING)), 'FILE', 'EVENT_WRITE',
               {TS_NS:o_orderdate} + 1000 * l_linenumber + 5, o_orderkey * 40 + 2 + l_linenumber
        FROM ship_line JOIN orders ON l_orderkey = o_orderkey""",
    # flows of processes: short bursts, so that anchored windows merge
    "burst_edge": """
        SELECT concat('p', CAST(user_id % 20 AS STRING)) AS src, 'SUBJECT_PROCESS' AS src_type,
               concat('10.0.0.1_', CAST(50000 + event_id % 7 AS STRING), '_161.116.8.', CAST(k % 3 AS STRING), '_',
                      CAST(k AS STRING)) AS dst, 'NetFlowObject' AS dst_type,
               CASE event_type WHEN 'view' THEN 'EVENT_CONNECT' WHEN 'click' THEN 'EVENT_SENDTO'
                    WHEN 'error' THEN 'EVENT_RECVFROM' WHEN 'purchase' THEN 'EVENT_SENDMSG'
                    ELSE 'EVENT_READ' END AS edge_type,
               ts_ns // 3600 AS ts_ns, event_id AS line_no
        FROM host_event""",
    # the same flows logged to three files: lines count anew in each, and times are whole seconds, equal across files
    "filed_edge": """
        SELECT src, src_type, dst, dst_type, edge_type, (ts_ns // 1000000000) * 1000000000 AS ts_ns,
               concat('log.', CAST(line_no % 3 AS STRING)) AS file_key, line_no // 3 AS line_no
        FROM burst_edge""",
    "filed_order": """
        SELECT src, src_type, dst, dst_type, edge_type, ts_ns, concat(file_key, ':', lpad(CAST(line_no AS STRING), 20, '0')) AS line_no
        FROM filed_edge""",
    # temporary, log and cache files of a few directories, touched by a few processes
    "temp_edge": """
        SELECT concat('s', CAST(suppkey % 40 AS STRING)) AS src, 'SUBJECT_PROCESS' AS src_type,
               CASE l_linenumber % 4
                    WHEN 0 THEN concat('/tmp/w', CAST(partkey % 3 AS STRING), '/item_', CAST(partkey AS STRING), '.tmp')
                    WHEN 1 THEN concat('/var/log/', 'daemon', CAST(l_orderkey % 400 AS STRING), '.log')
                    WHEN 2 THEN concat('/srv/x/', CAST(partkey AS STRING), '.lock')
                    ELSE concat('/srv/x/notes-', CAST(partkey AS STRING), '.md') END AS dst, 'FILE' AS dst_type,
               CASE WHEN l_orderkey % 2 = 0 THEN 'EVENT_WRITE' ELSE 'EVENT_READ' END AS edge_type,
               l_orderkey * 7000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 AS ts_ns, l_orderkey * 10 + l_linenumber AS line_no
        FROM ship_line""",
    # flagged ids: users with an error on a key divisible by nine
    "flagged": """
        SELECT DISTINCT concat('p', CAST(user_id AS STRING)) AS uuid FROM host_event
        WHERE event_type = 'error' AND k % 9 = 0
        UNION ALL
        SELECT DISTINCT concat('o', CAST(k AS STRING)) AS uuid FROM host_event WHERE k % 8 = 0
        UNION ALL
        SELECT DISTINCT concat('missing', CAST(k AS STRING)) AS uuid FROM host_event WHERE k % 25 = 0""",
}

_MARK = re.compile(r"\{(\w+):([^{}]*)\}")


def _dialect(sql: str, names: dict[str, str]) -> str:
    sql = _MARK.sub(lambda m: names[m.group(1)].format(m.group(2)), sql)
    return sql.replace(" // ", f" {names['DIV']} ")


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


def duck(sql: str) -> str:
    """The checking SQL with the WITH clause of the relations it names."""
    need = _needed(sql)
    body = _dialect(sql, DUCK).strip()
    if not need:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_dialect(VIEWS[n], DUCK)})" for n in need)
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        rec = ""
        if rest[:9].upper() == "RECURSIVE":
            rec, rest = "RECURSIVE ", rest[9:]
        return f"WITH {rec}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables of ``sf_dir``."""
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    need = _needed(sql)
    text = sql + " " + " ".join(VIEWS[n] for n in need)
    args = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    for n in need:
        body = _dialect(VIEWS[n], SPARK)
        args[n] = spark.sql(_named(body, args), **args)
    return spark.sql(_named(_dialect(sql, SPARK), args), **args)


def _named(sql: str, args: dict) -> str:
    """Mark the relation names of a FROM or JOIN as parameters; other braces are literal."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m.group(1)} {{{m.group(2)}}}" if m.group(2) in args else m.group(0), sql)
