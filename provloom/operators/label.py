"""Labelling and filtering of subgraphs against known identifiers and time windows.

Relations: ``segments`` (dep_id, part_idx, seed, start_ts, end_ts, n_nodes, n_edges, total_parts),
``sub_nodes`` (dep_id, part_idx, node_id, uuid, ...), ``sub_edges`` (dep_id, part_idx, src, dst,
edge_type, ts_ns, ...), ``flagged`` (uuid)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.operators import ordered
from provloom.session import cut_lineage

PART = ["dep_id", "part_idx"]
MIN_FLAGGED = 2


def flagged_nodes(sub_nodes: DataFrame, flagged: DataFrame) -> DataFrame:
    return sub_nodes.join(flagged.select("uuid").distinct(), "uuid", "left_semi")


def label_segments(
    segments: DataFrame, sub_nodes: DataFrame, flagged: DataFrame, min_flagged: int = MIN_FLAGGED
) -> DataFrame:
    """Segments with at least ``min_flagged`` flagged nodes, ranked by their number (ties keep the
    order of the segments)."""
    n = flagged_nodes(sub_nodes, flagged).groupBy(*PART).agg(F.count(F.lit(1)).alias("n_flagged"))
    hit = segments.join(n.filter(F.col("n_flagged") >= min_flagged), PART)
    ranked = ordered.scan(hit.withColumn("_o", -F.col("n_flagged")), [], ["_o", *PART], index="rank")
    return ranked.drop("_o")


def coverage(flagged: DataFrame, sub_nodes: DataFrame) -> DataFrame:
    """How many of the listed ids occur in some subgraph."""
    ids = flagged.select("uuid").distinct()
    found = ids.join(sub_nodes.select("uuid"), "uuid", "left_semi").withColumn("hit", F.lit(1))
    return ids.join(found, "uuid", "left").agg(
        F.count(F.lit(1)).alias("n_listed"),
        F.count("hit").alias("n_found"),
        (F.count(F.lit(1)) - F.count("hit")).alias("n_missing"),
    )


def found_ids(flagged: DataFrame, sub_nodes: DataFrame) -> DataFrame:
    return flagged.select("uuid").intersect(sub_nodes.select("uuid"))


def missing_ids(flagged: DataFrame, sub_nodes: DataFrame) -> DataFrame:
    return flagged.select("uuid").subtract(sub_nodes.select("uuid"))


def in_window(edges: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Edges inside the window, both ends inclusive."""
    return edges.filter(F.col("ts_ns").between(start_ns, end_ns))


def flag_ends(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Add ``src_flag`` and ``dst_flag``."""
    f = flagged.select("uuid").distinct()
    s = f.select(F.col("uuid").alias("src"), F.lit(True).alias("src_flag"))
    d = f.select(F.col("uuid").alias("dst"), F.lit(True).alias("dst_flag"))
    return edges.join(s, "src", "left").join(d, "dst", "left").fillna(False, ["src_flag", "dst_flag"])


def touching(edges: DataFrame, flagged: DataFrame, both: bool = False) -> DataFrame:
    """Edges with a flagged end, or with two."""
    e = flag_ends(edges, flagged)
    keep = (F.col("src_flag") & F.col("dst_flag")) if both else (F.col("src_flag") | F.col("dst_flag"))
    return e.filter(keep).drop("src_flag", "dst_flag")


def by_names(edges: DataFrame, exclude: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Drop edges with an excluded name at either end; keep only listed source names."""
    if exclude:
        src, dst = F.coalesce("src_name", F.lit("")), F.coalesce("dst_name", F.lit(""))
        edges = edges.filter(~src.isin(*exclude) & ~dst.isin(*exclude))
    return edges.filter(F.col("src_name").isin(*sources)) if sources else edges


def focus_edges(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges among the focus ids, without self loops."""
    s = focus.select(F.col("uuid").alias("src")).distinct()
    d = focus.select(F.col("uuid").alias("dst")).distinct()
    return edges.filter("src <> dst").join(s, "src", "left_semi").join(d, "dst", "left_semi")


def select_segments(sub_nodes: DataFrame, uuids: list[str]) -> DataFrame:
    """Segments that contain any of the given ids, whatever the case they are written in."""
    return sub_nodes.filter(F.upper("uuid").isin(*[u.upper() for u in uuids])).select(*PART).distinct()


def select_components(sub_nodes: DataFrame, components: list[int]) -> DataFrame:
    """Segments of the given components."""
    return sub_nodes.filter(F.col("dep_id").isin(*components)).select(*PART).distinct()


def tactic_window(
    edges: DataFrame,
    flagged: DataFrame,
    start_ns: int,
    end_ns: int,
    both: bool = False,
    exclude: list[str] | None = None,
    sources: list[str] | None = None,
) -> DataFrame:
    """Edge list of one phase: time window, flagged ends, name lists."""
    return by_names(touching(in_window(edges, start_ns, end_ns), flagged, both), exclude, sources)


def window_summary(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Edge count, node count and flagged coverage of an edge list."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uuid")).distinct()
    ids = flagged.select("uuid").distinct().withColumn("f", F.lit(1))
    nodes = ends.join(ids, "uuid", "left").agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count("f").alias("flagged_nodes")
    )
    return edges.agg(F.count(F.lit(1)).alias("total_edges")).join(nodes)


def filter_segments(
    segments: DataFrame,
    sub_edges: DataFrame,
    sub_nodes: DataFrame,
    flagged: DataFrame,
    start_ns: int,
    end_ns: int,
    seed_name: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, nodes, edges) of the labelled segments restricted to a time window.

    Nodes stay when an edge that stayed touches them or when they are flagged in some part of their
    component; listed ids inside the segment always stay. For segments whose seed has ``seed_name``
    only edges that touch a listed id stay."""
    labelled = cut_lineage(label_segments(segments, sub_nodes, flagged).select(*PART))
    own = cut_lineage(sub_nodes.join(labelled, PART, "left_semi"))
    mal = flagged_nodes(own, flagged).select("dep_id", "uuid").distinct()
    edges = in_window(sub_edges.join(labelled, PART, "left_semi"), start_ns, end_ns)
    if seed_name is not None:
        named = segments.select(*PART, (F.coalesce("seed_name", F.lit("")) == seed_name).alias("_special"))
        e = flag_ends(edges.join(named, PART), flagged)
        edges = e.filter(~F.col("_special") | F.col("src_flag") | F.col("dst_flag")).drop(
            "_special", "src_flag", "dst_flag"
        )
    edges = cut_lineage(edges)
    live = edges.select(*PART).distinct()
    touched = edges.select(*PART, F.explode(F.array("src", "dst")).alias("uuid"))
    listed = own.join(flagged.select("uuid").distinct(), "uuid", "left_semi").select(*PART, "uuid")
    of_dep = own.join(mal, ["dep_id", "uuid"], "left_semi").select(*PART, "uuid")
    keep = touched.unionByName(listed).unionByName(of_dep).distinct().join(live, PART, "left_semi")
    nodes = cut_lineage(own.join(keep, [*PART, "uuid"], "left_semi"))
    n_mal = nodes.join(mal, ["dep_id", "uuid"], "left_semi").groupBy(*PART).agg(
        F.countDistinct("uuid").alias("n_flagged")
    )
    times = edges.groupBy(*PART).agg(
        F.min(F.when(F.col("ts_ns") > 0, F.col("ts_ns"))).alias("_s"),
        F.max(F.when(F.col("ts_ns") > 0, F.col("ts_ns"))).alias("_e"),
        F.count(F.lit(1)).alias("n_edges"),
    )
    n_nodes = nodes.groupBy(*PART).agg(F.count(F.lit(1)).alias("n_nodes"))
    out = (
        segments.drop("n_nodes", "n_edges")
        .join(times, PART)
        .join(n_nodes, PART, "left")
        .join(n_mal, PART, "left")
        .withColumn("start_ts", F.coalesce("_s", "start_ts"))
        .withColumn("end_ts", F.coalesce("_e", "end_ts"))
        .drop("_s", "_e")
        .fillna(0, ["n_nodes", "n_flagged"])
    )
    return out, nodes, edges


def benign_segments(segments: DataFrame, start_ns: int, end_ns: int, max_nodes: int = 50) -> DataFrame:
    """Segments that start and end inside [start, end), with ``oversize`` marking those too large."""
    inside = (
        (F.col("start_ts") >= start_ns)
        & (F.col("start_ts") < end_ns)
        & (F.col("end_ts") >= start_ns)
        & (F.col("end_ts") < end_ns)
    )
    return segments.filter(inside).withColumn("oversize", F.col("n_nodes") > max_nodes)


def positional_split(segments: DataFrame, n_train: int = 10_000, n_test: int = 2_000) -> DataFrame:
    """First ``n_train`` segments train, the next ``n_test`` test, the rest unused (dropped)."""
    pos = ordered.scan(segments, [], PART, index="pos")
    split = F.when(F.col("pos") <= n_train, "train").when(F.col("pos") <= n_train + n_test, "test")
    return pos.withColumn("split", split).filter(F.col("split").isNotNull())
