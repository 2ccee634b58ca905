"""Kernel event logs: one JSON object per line, one file per sample (``tag``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators import ordered

# Mapped events by target kind and operation; the source is always the process.
OPERATIONS = {
    ("process", "launch"): ["ProcessStart"],
    ("file", "create"): ["FileIOCreate", "FileIOFileCreate"],
    ("file", "read"): ["FileIORead"],
    ("file", "write"): ["FileIOWrite"],
    ("file", "close"): ["FileIOClose", "FileIOCleanup"],
    ("file", "delete"): ["FileIODelete", "FileIOFileDelete"],
    ("file", "enum"): ["FileIODirEnum"],
    ("registry", "open"): ["RegistryKCBCreate"],
    ("registry", "query"): ["RegistryQuery", "RegistryQueryValue", "RegistryQueryMultipleValue"],
    ("registry", "enumerate"): ["RegistryEnumerateKey", "RegistryEnumerateValueKey"],
    ("registry", "modify"): ["RegistrySetValue", "RegistrySetInformation"],
    ("registry", "close"): ["RegistryKCBDelete", "RegistryClose"],
    ("registry", "delete"): ["RegistryDeleteValue", "RegistryDelete"],
    ("socket", "send"): ["TcpIpSendIPV4", "TcpIpSendIPV6"],
    ("socket", "receive"): ["TcpIpRecvIPV4", "TcpIpRecvIPV6"],
    ("socket", "retransmit"): ["TcpIpRetransmitIPV4"],
    ("socket", "connect"): ["TcpIpConnectIPV4", "TcpIpConnectIPV6"],
    ("socket", "disconnect"): ["TcpIpDisconnectIPV4", "TcpIpDisconnectIPV6"],
    ("socket", "accept"): ["TcpIpAcceptIPV4", "TcpIpAcceptIPV6"],
    ("socket", "reconnect"): ["TcpIpReconnectIPV4", "TcpIpReconnectIPV6"],
}
OPEN_PATH_EVENT = "FileIOCreate"

_ARGS = "OpenPath FileName FileKey FileObject KeyName KeyHandle Status saddr sport daddr dport connid ProcessId".split()
SCHEMA = f"struct<Event:string,PID:string,PName:string,TimeStamp:string,args:struct<{','.join(a + ':string' for a in _ARGS)}>>"


def event_map(spark: SparkSession) -> DataFrame:
    rows = [(e, kind, op) for (kind, op), events in OPERATIONS.items() for e in events]
    return spark.createDataFrame(rows, "event string, kind string, op string")


def with_tag(lines: DataFrame) -> DataFrame:
    """The sample tag is the file stem."""
    base = F.substring_index("file", "/", -1)
    return lines.withColumn("tag", F.regexp_replace(base, r"\.[^.]*$", ""))


def scan(lines: DataFrame) -> DataFrame:
    """Every non-blank line with its parsed fields and status: bad_json, unmapped or kept."""
    spark = lines.sparkSession
    j = F.from_json("value", SCHEMA)
    parsed = (
        lines.filter(F.trim("value") != "")
        .select("tag", "line_no", F.col("value"), j.alias("j"))
        .withColumn("bad", F.expr("try_parse_json(value) is null"))
    )
    # the map has 35 rows
    mapped = parsed.join(F.broadcast(event_map(spark)), F.col("j.Event") == F.col("event"), "left")
    status = F.when(F.col("bad"), "bad_json").when(F.col("kind").isNull(), "unmapped").otherwise("kept")
    return mapped.withColumn("status", status)


def edges(scanned: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Edge rows of the kept lines with target ids, names and whether the target was resolved. A
    registry event without a key name gets a running number per sample."""
    a = F.col("j.args")
    nameless = (F.col("kind") == "registry") & (F.coalesce(a["KeyName"], F.lit("")) == "")
    kept = scanned.filter("status = 'kept'").withColumn("_one", F.when(nameless, 1).otherwise(0))
    e = ordered.running_sum(kept, ["tag"], ["line_no"], "_one", "_i", target_rows)
    pid = F.coalesce("j.PID", F.lit("None"))
    path = F.nullif(F.when(F.col("event") == OPEN_PATH_EVENT, a["OpenPath"]).otherwise(a["FileName"]), F.lit(""))
    key, obj = F.nullif(a["FileKey"], F.lit("")), F.nullif(a["FileObject"], F.lit(""))
    file_id = F.coalesce(
        F.concat(F.lit("file:"), path),
        F.concat(F.lit("file:unresolved:"), F.col("tag"), F.lit(":"), key, F.lit(":"), obj),
        F.concat(F.lit("file:unknown:"), F.col("tag")),
    )
    reg_name = F.nullif(F.lower(a["KeyName"]), F.lit(""))
    reg_id = F.coalesce(
        F.concat(F.lit("reg:"), reg_name),
        F.concat(F.lit("reg:unresolved:"), F.col("tag"), F.lit(":"), F.col("_i").cast("string")),
    )
    none = F.lit("None")
    flow = F.concat(
        F.coalesce(a["saddr"], none), F.lit(":"), F.coalesce(a["sport"], none), F.lit("->"),
        F.coalesce(a["daddr"], none), F.lit(":"), F.coalesce(a["dport"], none),
    )
    kind = F.col("kind")
    dst = (
        F.when(kind == "process", F.concat(F.lit("proc:"), F.coalesce(a["ProcessId"], pid)))
        .when(kind == "file", file_id)
        .when(kind == "registry", reg_id)
        .otherwise(F.concat(F.lit("sock:"), flow))
    )
    dst_name = (
        F.when(kind == "process", F.col("j.PName")).when(kind == "file", path).when(kind == "registry", reg_name).otherwise(flow)
    )
    return e.select(
        "tag", "line_no",
        F.concat(F.lit("proc:"), pid).alias("src"), F.lit("process").alias("src_type"),
        dst.alias("dst"), kind.alias("dst_type"),
        F.concat(kind, F.lit("_"), F.col("op")).alias("edge_type"),
        F.col("j.TimeStamp").try_cast("long").alias("ts_ns"),
        F.col("j.PName").alias("src_name"), dst_name.alias("dst_name"),
        F.when(kind == "file", path.isNotNull()).when(kind == "registry", reg_name.isNotNull()).otherwise(F.lit(True)).alias("resolved"),
    )


def in_time_order(edge_rows: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Position per sample; a missing time counts as 0, ties keep the order of the lines."""
    e = edge_rows.withColumn("_t", F.coalesce("ts_ns", F.lit(0)))
    return ordered.scan(e, ["tag"], ["_t", "line_no"], index="pos", target_rows=target_rows).drop("_t")


def node_details(edge_rows: DataFrame) -> DataFrame:
    """(uuid, type, name) over all samples; the last sighting wins, target after source."""
    ends = edge_rows.select(
        "tag", "line_no",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("role"), F.col("src").alias("uuid"), F.col("src_type").alias("type"), F.col("src_name").alias("name")),
                F.struct(F.lit(1).alias("role"), F.col("dst").alias("uuid"), F.col("dst_type").alias("type"), F.col("dst_name").alias("name")),
            )
        ).alias("e"),
    ).select("tag", "line_no", "e.*")
    return ends.groupBy("uuid").agg(
        F.max_by(F.struct("type", "name"), F.struct("tag", "line_no", "role")).alias("v")
    ).select("uuid", "v.type", "v.name")


def totals(scanned: DataFrame, edge_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scan counters, per ``by`` columns or overall."""
    by = by or []
    s = scanned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("status") == "kept").alias("n_kept"),
        F.count_if(F.col("status") == "bad_json").alias("n_bad_json"),
        F.count_if(F.col("status") == "unmapped").alias("n_unmapped"),
    )
    u = edge_rows.groupBy(*by).agg(F.count_if(~F.col("resolved")).alias("n_unresolved"))
    out = s.join(u, by, "left") if by else s.join(u)
    return out.fillna(0, ["n_unresolved"]).withColumn(
        "pct_kept", F.round(100.0 * F.col("n_kept") / F.greatest("n_events", F.lit(1)), 1)
    )
