"""Provenance logs of JSON records: entity scan, event scan and skip counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the log format.
NS = "com.bbn.tc.schema.avro.cdm18."
SKIP_KINDS = tuple(NS + k for k in ("Event", "Host", "TimeMarker", "StartMarker", "UnitDependency", "EndMarker"))
SKIP_EVENTS = ("EVENT_MPROTECT", "EVENT_MMAP", "EVENT_SHM", "EVENT_OPEN")
TACTIC_SKIP_EVENTS = ("EVENT_MPROTECT", "EVENT_MMAP", "EVENT_SHM")
NIL = "00000000-0000-0000-0000-000000000000"
UUID_RX = r'uuid":\s*"(.*?)"'
TYPE_RX = r'type":\s*"(.*?)"'
TIME_RX = r'timestampNanos":(.*?),'

_S = T.StringType()
_UUID = T.StructType([T.StructField(NS + "UUID", _S)])
_MAP = T.StructType([T.StructField("map", T.MapType(_S, _S))])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RECORD = _struct(
    datum=T.StructType(
        [
            T.StructField(NS + "Subject", _struct(uuid=_S, type=_S, cmdLine=_S, properties=_MAP, localPrincipal=_S, startTimestampNanos=_S)),
            T.StructField(NS + "FileObject", _struct(uuid=_S, type=_S, baseObject=_struct(filename=_S, path=_S, properties=_MAP))),
            T.StructField(NS + "NetFlowObject", _struct(uuid=_S, localAddress=_S, localPort=_S, remoteAddress=_S, remotePort=_S)),
            T.StructField(NS + "Principal", _struct(uuid=_S, userId=_S)),
            T.StructField(
                NS + "Event",
                _struct(uuid=_S, type=_S, timestampNanos=T.LongType(), subject=_UUID, predicateObject=_UUID, predicateObject2=_UUID),
            ),
        ]
    )
)


def _first(rx: str) -> Column:
    return F.nullif(F.regexp_extract("value", rx, 1), F.lit(""))


def _either(c: Column, member: str) -> Column:
    """A scalar, or the member of a one-field union object."""
    return F.when(c.startswith("{"), F.get_json_object(c, f"$.{member}")).otherwise(c)


def _record(kind: str) -> Column:
    return F.col("r")["datum"].getField(NS + kind)


def _flow_names(net: Column) -> dict[str, Column]:
    null = F.lit("null")
    return {
        "local_addr": F.coalesce(_either(net["localAddress"], "string"), null),
        "local_port": F.coalesce(_either(net["localPort"], "int"), null),
        "remote_addr": F.coalesce(_either(net["remoteAddress"], "string"), null),
        "remote_port": F.coalesce(_either(net["remotePort"], "int"), null),
    }


def entity_records(lines: DataFrame) -> DataFrame:
    """One row per entity record, in the input's order columns (file_key, line_no)."""
    skip = F.lit(False)
    for k in SKIP_KINDS:
        skip = skip | F.col("value").contains(k)
    typed = (
        lines.filter(~skip)
        .select("value", "file_key", "line_no", _first(UUID_RX).alias("uuid"), _first(TYPE_RX).alias("type"))
        .filter(F.col("uuid").isNotNull() & (F.col("uuid") != NIL))
        .withColumn(
            "type",
            F.when(F.col("type").isNotNull(), F.col("type")).when(
                F.col("value").contains(NS + "NetFlowObject") & ~F.col("value").contains(NS + "MemoryObject"), "NetFlowObject"
            ),
        )
        .filter(F.col("type").isNotNull() & (F.col("type") != "SUBJECT_UNIT"))
        .withColumn("r", F.from_json("value", RECORD))
    )
    base = _record("FileObject")["baseObject"]
    props = base["properties"]["map"]
    file_name = F.coalesce(
        F.try_element_at(props, F.lit("filename")), F.try_element_at(props, F.lit("path")), base["filename"], base["path"]
    )
    subject = _record("Subject")
    cmd = F.nullif(_either(subject["cmdLine"], "string"), F.lit(""))
    exe = F.nullif(F.try_element_at(subject["properties"]["map"], F.lit("path")), F.lit(""))
    flow = _flow_names(_record("NetFlowObject"))
    is_file = F.col("type").contains("FILE")
    is_proc = F.col("type") == "SUBJECT_PROCESS"
    is_flow = F.col("type") == "NetFlowObject"
    name = (
        F.when(is_file, F.when(~file_name.isin("", "null"), file_name))
        .when(is_proc, F.coalesce(cmd, exe))
        .when(is_flow, F.concat_ws("_", *flow.values()))
    )

    def known(c: Column) -> Column:
        return F.when(is_flow & ~c.isin("", "null"), c)

    return typed.select(
        "file_key", "line_no", "uuid", "type", name.alias("name"),
        F.when(is_proc, cmd).alias("cmdline"), F.when(is_proc, exe).alias("exe"),
        known(flow["remote_port"]).alias("remote_port"), known(flow["local_addr"]).alias("local_addr"),
        known(flow["local_port"]).alias("local_port"),
    )


def entities(lines: DataFrame) -> DataFrame:
    """One row per uuid; for every attribute the last record that has it wins."""
    r = entity_records(lines)
    at = F.struct("file_key", "line_no")
    attrs = [c for c in r.columns if c not in ("uuid", "file_key", "line_no")]
    return r.groupBy("uuid").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in attrs])


def _event_fields(lines: DataFrame) -> DataFrame:
    ev = F.col("value").contains(NS + "Event") & ~F.col("value").contains("\x00")

    def ref(name: str) -> Column:
        rx = name + r'":\{"com.bbn.tc.schema.avro.cdm18.UUID":"(.*?)"\}'
        return _first(rx)

    return lines.filter(ev).select(
        "file_key", "line_no", _first(TYPE_RX).alias("edge_type"), F.trim(_first(TIME_RX)).alias("t"),
        ref("subject").alias("src"), ref("predicateObject").alias("dst1"), ref("predicateObject2").alias("dst2"),
    )


def event_edges(lines: DataFrame, entity: DataFrame) -> DataFrame:
    """Edge rows: one per present, non-nil object of an event whose subject is a known entity.

    Files keep their order; inside a file edges are by time, ties by line (``line_no`` has room for
    the two objects of an event)."""
    e = _event_fields(lines).filter(F.col("edge_type").isNotNull() & F.col("t").isNotNull())
    e = (
        e.withColumn("ts_ns", F.col("t").try_cast("long"))
        .filter(F.col("ts_ns").isNotNull() & ~F.col("edge_type").isin(*SKIP_EVENTS) & F.col("src").isNotNull())
        .select(
            "file_key", "line_no", "edge_type", "ts_ns", "src",
            F.posexplode(F.array("dst1", "dst2")).alias("which", "dst"),
        )
        .filter(F.col("dst").isNotNull() & ~F.col("dst").isin("null", NIL))
        .withColumn("line_no", F.col("line_no") * 2 + F.col("which"))
    )
    types = entity.select("uuid", "type")
    s = types.select(F.col("uuid").alias("src"), F.col("type").alias("src_type"))
    d = types.select(F.col("uuid").alias("dst"), F.col("type").alias("dst_type"))
    return (
        e.join(s, "src")
        .join(d, "dst", "left")
        .fillna("UNKNOWN", ["dst_type"])
        .select("src", "src_type", "dst", "dst_type", "edge_type", "ts_ns", "file_key", "line_no")
    )


def event_skips(lines: DataFrame) -> DataFrame:
    """(reason, n): lines the event scan leaves out — NUL bytes, times that are no integer, and each
    skipped event type."""
    nul = lines.filter(F.col("value").contains("\x00")).select(F.lit("nul byte").alias("reason"))
    e = _event_fields(lines).filter(F.col("edge_type").isNotNull() & F.col("t").isNotNull())
    reason = F.when(F.col("t").try_cast("long").isNull(), "time").when(
        F.col("edge_type").isin(*SKIP_EVENTS), F.col("edge_type")
    )
    rest = e.select(reason.alias("reason")).filter("reason is not null")
    return nul.unionByName(rest).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def tactic_entities(lines: DataFrame) -> DataFrame:
    """Entity table of the tactic job: four record kinds by JSON path, last record per uuid wins,
    processes with the user id of their principal ('?' when unknown)."""
    marks = F.lit(False)
    for k in ("Subject", "FileObject", "NetFlowObject", "Principal"):
        marks = marks | F.col("value").contains(k)
    r = lines.filter(marks).withColumn("r", F.from_json("value", RECORD)).filter(F.col("r").isNotNull())
    subject, fobj, net, who = (_record(k) for k in ("Subject", "FileObject", "NetFlowObject", "Principal"))
    base = fobj["baseObject"]
    props = base["properties"]["map"]

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    file_name = F.coalesce(
        given(base["filename"]), given(base["path"]), given(F.try_element_at(props, F.lit("filename"))),
        given(F.try_element_at(props, F.lit("path"))), F.lit(""),
    )
    proc_name = F.coalesce(
        given(_either(subject["cmdLine"], "string")), F.try_element_at(subject["properties"]["map"], F.lit("path")), F.lit("")
    )
    rows = r.select(
        "file_key", "line_no",
        F.coalesce(subject["uuid"], fobj["uuid"], net["uuid"]).alias("uuid"),
        F.when(subject.isNotNull(), "SUBJECT_PROCESS").when(fobj.isNotNull(), "FILE_OBJECT_BLOCK").when(net.isNotNull(), "NetFlowObject").alias("type"),
        F.when(subject.isNotNull(), proc_name).when(fobj.isNotNull(), file_name).when(net.isNotNull(), F.concat_ws("_", *_flow_names(net).values())).alias("name"),
        subject["localPrincipal"].alias("principal"),
        F.coalesce(subject["startTimestampNanos"].try_cast("long"), F.lit(0)).alias("ts_ns"),
        who["uuid"].alias("who"), who["userId"].alias("user_id"),
    )
    at = F.struct("file_key", "line_no")
    ents = rows.filter("uuid is not null and type is not null").groupBy("uuid").agg(
        F.max_by(F.struct("type", "name", "principal", "ts_ns"), at).alias("v")
    ).select("uuid", "v.*")
    people = rows.filter("who is not null").groupBy("who").agg(F.max_by("user_id", at).alias("user_id"))
    return (
        ents.join(people, ents.principal == people.who, "left")
        .withColumn("user_id", F.when(F.col("type") == "SUBJECT_PROCESS", F.coalesce("user_id", F.lit("?"))))
        .drop("who", "principal")
    )


def tactic_edges(lines: DataFrame, flagged: DataFrame) -> DataFrame:
    """Earliest edge per (src, dst, type) of events with a flagged end, by JSON path; events without
    a subject or with a nil or missing object are left out before the join."""
    ev = _record("Event")
    e = (
        lines.filter(F.col("value").contains("Event"))
        .withColumn("r", F.from_json("value", RECORD))
        .select(
            ev["type"].alias("edge_type"), F.coalesce(ev["timestampNanos"], F.lit(0)).alias("ts_ns"),
            ev["subject"].getField(NS + "UUID").alias("src"), ev["predicateObject"].getField(NS + "UUID").alias("dst"),
        )
        .filter("src is not null and src <> '' and dst is not null and dst <> ''")
        .filter((F.col("dst") != NIL) & ~F.coalesce("edge_type", F.lit("")).isin(*TACTIC_SKIP_EVENTS))
    )
    from provloom.operators.build import earliest_edges
    from provloom.operators.label import touching

    return earliest_edges(touching(e, flagged))
