"""Text lines with their place in the input, edge files, id lists and subgraph documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src string, src_type string, dst string, dst_type string, edge_type string, ts_ns bigint"


def natural_key(name: Column) -> Column:
    """Sort key of a file name with its digit groups compared as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(value, file, file_key, line_no): ``line_no`` grows with the place of the line in its file.

    A split starts at its byte offset and holds fewer lines than bytes, so offset plus row number
    orders lines across the splits of a file without a shuffle."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        natural_key(F.col("_metadata.file_name")).alias("file_key"),
        (F.col("_metadata.file_block_start") * 4 + row).alias("line_no"),
    )


def in_order(edges: DataFrame) -> DataFrame:
    """Edges of several files in one order: ``line_no`` becomes the place over all files, by file, then by
    line, which also tells edges of different files apart. Edges without ``file_key`` stay as they are."""
    if "file_key" not in edges.columns:
        return edges
    place = F.concat(F.coalesce("file_key", F.lit("")), F.lit("\x00"), F.lpad(F.col("line_no").cast("string"), 20, "0"))
    return edges.withColumn("line_no", place).drop("file_key")


def is_provenance_log(file_name: Column) -> Column:
    """``*.json`` and ``*.json.N``, but not the ``._*`` companions."""
    return ~file_name.startswith("._") & file_name.rlike(r"\.json(\.\d+)?$")


def parse_edge_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects) of six-field tab-separated lines; lines with a NUL, another field count or a
    time that is no integer are rejected with a reason."""
    f = F.split("value", "\t")
    ts = F.trim(F.get(f, F.lit(5)))
    number = F.when(ts.rlike(r"^[+-]?\d+$"), ts.try_cast("long"))
    reason = (
        F.when(F.col("value").contains("\x00"), "nul byte")
        .when(F.size(f) != 6, "field count")
        .when(number.isNull(), "time")
    )
    place = [c for c in ("file", "file_key", "line_no") if c in lines.columns]
    marked = lines.select(*place, "value", f.alias("f"), number.alias("ts_ns"), reason.alias("reason"))
    names = ("src", "src_type", "dst", "dst_type", "edge_type")
    edges = marked.filter("reason is null").select(
        *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)], "ts_ns", *place
    )
    return edges, marked.filter("reason is not null").select(*place, "value", "reason")


def write_edges(edges: DataFrame, path: str, by: str = "file_key") -> None:
    """Edge table partitioned by input file; reading the folder concatenates the files."""
    edges.write.mode("overwrite").partitionBy(by).parquet(path)


def parse_id_list(lines: DataFrame) -> DataFrame:
    """(uuid, info) of 'uuid[,free text]' lines, blank lines dropped."""
    v = F.trim("value")
    parts = F.split(v, ",", 2)
    return lines.filter(v != "").select(
        F.trim(F.get(parts, F.lit(0))).alias("uuid"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("info")
    )


_NODE = "struct<id:string,type:string,ts:bigint,name:string,uuid:string>"
_EDGE = (
    "struct<src:string,source:string,dst:string,dest:string,target:string,key:string,edge_type:string,ts:bigint,"
    "gap_sec:string,count:bigint,event_ids:string,event_id:string>"
)
SUBGRAPH_HEADER = (
    "dep_id bigint, part_idx bigint, total_parts bigint, seed string, seed_uuid string, seed_name string, start_ts bigint, "
    "end_ts bigint, n_nodes bigint, n_edges bigint, tactic string, technique string, attack string, step string, "
    "host string, description string"
)


def parse_subgraphs(docs: DataFrame, value: str = "value", max_subgraphs: int | None = None) -> DataFrame:
    """Subgraph documents to rows (header fields, nodes array<string>, edges array<string>), at most
    ``max_subgraphs`` of a document when that is given.

    ``docs`` holds one JSON document a row: one subgraph, a list of them, or {'subgraphs': [...]}."""
    schema = f"struct<{', '.join(c.strip().replace(' ', ':') for c in SUBGRAPH_HEADER.split(','))}, nodes:array<string>, edges:array<string>>"
    one = F.from_json(F.col(value), schema)
    many = F.from_json(F.col(value), f"struct<subgraphs:array<{schema}>>")["subgraphs"]
    listed = F.when(F.ltrim(value).startswith("["), F.from_json(F.col(value), f"array<{schema}>"))
    rest = [c for c in docs.columns if c != value]
    found = F.coalesce(listed, many, F.array(one))
    found = found if max_subgraphs is None else F.slice(found, 1, max_subgraphs)
    return docs.select(*rest, F.posexplode(found).alias("idx", "sg")).select(
        *rest, F.col("idx").cast("long").alias("idx"), "sg.*"
    )


def rebuild_graph(subgraphs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of subgraph rows, whatever layout they use: nodes as [id, {attrs}], {id, ...} or
    a bare id; edges as 4- or 3-tuples or objects with src/source and dst/dest/target. Edge ends name
    a node by id or uuid, so nodes are found by either."""
    n = F.col("n")
    attrs = F.when(n.startswith("["), F.get_json_object(n, "$[1]")).when(n.startswith("{"), n)
    a = F.from_json(attrs, _NODE)
    bare = F.when(n.startswith("["), F.get_json_object(n, "$[0]")).when(n.startswith("{"), a["id"]).otherwise(n)
    nodes = subgraphs.select(*keys, F.posexplode("nodes").alias("pos", "n")).select(
        *keys, F.col("pos").cast("long").alias("pos"), bare.alias("id"), a["uuid"].alias("uuid"), a["type"].alias("type"),
        a["name"].alias("name"), a["ts"].alias("ts_ns"),
    )
    e = F.col("e")
    tuple4 = F.from_json(F.get_json_object(e, "$[3]"), _EDGE)
    tuple3 = F.from_json(F.get_json_object(e, "$[2]"), _EDGE)
    obj = F.from_json(e, _EDGE)
    is_list = e.startswith("[")

    def field(name: str) -> Column:
        return F.when(is_list, F.coalesce(tuple4[name], tuple3[name])).otherwise(obj[name])

    edges = subgraphs.select(*keys, F.posexplode("edges").alias("pos", "e")).select(
        *keys,
        F.col("pos").cast("long").alias("line_no"),
        F.when(is_list, F.get_json_object(e, "$[0]")).otherwise(F.coalesce(obj["src"], obj["source"], F.lit(""))).alias("src"),
        F.when(is_list, F.get_json_object(e, "$[1]")).otherwise(F.coalesce(obj["dst"], obj["dest"], obj["target"], F.lit(""))).alias("dst"),
        field("edge_type").alias("edge_type"),
        F.coalesce(field("ts"), F.lit(0)).alias("ts_ns"),
        field("count").alias("n_events"),
        field("event_ids").alias("event_ids"),
    )
    # a node answers to its uuid and to its id
    alias = (
        nodes.select(*keys, F.explode(F.array_distinct(F.array("id", "uuid"))).alias("at"), "name", "type")
        .filter(F.coalesce("at", F.lit("")) != "")
        .dropDuplicates([*keys, "at"])
    )
    s = alias.select(*keys, F.col("at").alias("src"), F.col("name").alias("src_name"), F.col("type").alias("src_type"))
    d = alias.select(*keys, F.col("at").alias("dst"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    # documents are estimated by the size of a short string, so without the hint all names of all graphs would be broadcast
    named = edges.join(s.hint("merge"), [*keys, "src"], "left").join(d.hint("merge"), [*keys, "dst"], "left")
    return nodes, named.withColumn("src_name", F.coalesce("src_name", "src")).withColumn(
        "dst_name", F.coalesce("dst_name", "dst")
    )


def audit_graph_attributes(subgraphs: DataFrame) -> DataFrame:
    """Graph attributes of parsed audit graphs: step and host come out of the description."""
    rx = r"step=(\S+)\s+host=(\S+)"
    return (
        subgraphs.withColumn("technique", F.coalesce("attack", "technique"))
        .withColumn("step", F.coalesce(F.nullif(F.regexp_extract("description", rx, 1), F.lit("")), "step"))
        .withColumn("host", F.coalesce(F.nullif(F.regexp_extract("description", rx, 2), F.lit("")), "host"))
    )


def retype_files(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("type", F.when(F.col("type") == "FileObject", "FILE").otherwise(F.col("type")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graph sink: JSON-lines node and edge tables; edge ends are written as uuids."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.drop("src_id", "dst_id").write.mode("overwrite").json(f"{path}/edges")
