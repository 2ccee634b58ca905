"""Graph construction from edge rows (src, src_type, dst, dst_type, edge_type, ts_ns, line_no[, file_key]).

Edges are ordered by time, then file, then line; ``line_no`` of the results names an edge over all files.

``g`` names the columns that tell graphs apart (empty for one graph), so many sample graphs are
built by one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.operators import ordered
from provloom.session import written
from provloom.sources import lines


def merge_names(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """(uuid, name): the second source only fills gaps, and never with an empty or 'N/A' name."""
    fill = extra.filter((F.col("name") != "") & (F.col("name") != "N/A")).join(primary, "uuid", "left_anti")
    return primary.select("uuid", "name").unionByName(fill.select("uuid", "name"))


def endpoint_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Names of both ends, 'UNKNOWN' where there is none."""
    s = names.select(F.col("uuid").alias("src"), F.col("name").alias("src_name"))
    d = names.select(F.col("uuid").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(s, "src", "left").join(d, "dst", "left").fillna("UNKNOWN", ["src_name", "dst_name"])


def first_appearance(
    edges: DataFrame,
    g: Sequence[str],
    order: Sequence[str],
    src: dict[str, str],
    dst: dict[str, str],
    target_rows: int | None = None,
) -> DataFrame:
    """Nodes numbered by first appearance over ordered edges, source before target. ``src`` and
    ``dst`` map node columns (``uuid`` first) to the edge columns of that end; the values are those of
    the first appearance."""
    g = list(g)
    at = [f"_at{i}" for i in range(len(order))]
    ends = edges.select(
        *g,
        *[F.col(c).alias(a) for c, a in zip(order, at)],
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("_role"), *[F.col(c).alias(n) for n, c in src.items()]),
                F.struct(F.lit(1).alias("_role"), *[F.col(c).alias(n) for n, c in dst.items()]),
            )
        ).alias("e"),
    ).select(*g, *at, "e.*")
    known = {n: a for a, c in zip(at, order) for n in src if src[n] == c == dst[n]}  # values that are places in the order
    at = [*at, "_role"]
    rest = [n for n in src if n != "uuid" and n not in known]
    firsts = ends.groupBy(*g, "uuid").agg(F.min(F.struct(*at, *rest)).alias("f")).select(*g, "uuid", "f.*")
    if g:  # the search for hot graphs reads the nodes too, the edges are aggregated once
        firsts = written(firsts)
    numbered = ordered.scan(firsts, g, at, index="node_id", target_rows=target_rows)
    return numbered.select(*g, "uuid", *[F.col(known.get(n, n)).alias(n) for n in src if n != "uuid"], (F.col("node_id") - 1).alias("node_id"))


def number_nodes(edges: DataFrame, g: Sequence[str] = (), target_rows: int | None = None) -> DataFrame:
    """(uuid, type, ts_ns, node_id): ids by first appearance over time-ordered edges; type and time
    are those of the first appearance."""
    return first_appearance(
        lines.in_order(edges),
        g,
        ["ts_ns", "line_no"],
        {"uuid": "src", "type": "src_type", "ts_ns": "ts_ns"},
        {"uuid": "dst", "type": "dst_type", "ts_ns": "ts_ns"},
        target_rows,
    )


def parallel_edges(edges: DataFrame, g: Sequence[str] = (), target_rows: int | None = None) -> DataFrame:
    """Parallel-edge rule per (src, dst): keep the first edge, and every later one whose type is not
    a substring of the first edge's type. ``edge_key`` is the running index of the kept edges;
    ``pair_ts``/``pair_line`` locate the pair's first edge."""
    return _first_of_pairs(ordered.with_slices(lines.in_order(edges), [*g, "src", "dst"], _PLACE, target_rows))


_PLACE = ["ts_ns", "line_no"]


def _first_of_pairs(rows: ordered.Sliced) -> DataFrame:
    seen = ordered.scan_sliced(
        rows, _PLACE, first={"first_type": "edge_type", "pair_ts": "ts_ns", "pair_line": "line_no"}
    )
    is_first = (F.col("ts_ns") == F.col("pair_ts")) & (F.col("line_no") == F.col("pair_line"))
    kept = seen.with_df(seen.df.filter(is_first | ~F.col("first_type").contains(F.col("edge_type"))))
    out = ordered.scan_sliced(kept, _PLACE, index="edge_key").plain()
    return out.withColumn("edge_key", F.col("edge_key") - 1).drop("first_type")


def build_graph(
    edges: DataFrame, g: Sequence[str] = (), target_rows: int | None = None, stage: bool = True, kinds: bool = False,
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the property multigraph; edges carry the node ids of both ends and, with ``kinds``, the types of
    their nodes in ``src_kind`` and ``dst_kind``. Reductions, partitioning and reach all read both tables several times,
    so ``stage`` writes them once. ``keep`` names the other columns of the edges that are read later, all by default.

    Edges meet their source, then their target, and the parallel-edge rule runs on the rows as the targets have dealt
    them, so they travel twice. A target above the size of a slice would put too much into one task: then the rule
    goes first, by pairs."""
    g = list(g)
    nodes = number_nodes(edges, g, target_rows)
    nodes = written(nodes) if stage and g else nodes  # without g the numbering has written them
    ends = [
        nodes.select(*g, F.col("uuid").alias(e), F.col("node_id").alias(f"{e}_id"), *([F.col("type").alias(f"{e}_kind")] if kinds else []))
        for e in ("src", "dst")
    ]
    if ordered.any_hot(edges, [*g, "dst"], target_rows):
        kept = parallel_edges(edges, g, target_rows)
        joined = kept.join(ends[0], [*g, "src"]).join(ends[1], [*g, "dst"])
    else:
        placed = lines.in_order(edges).join(ends[0], [*g, "src"]).join(ends[1], [*g, "dst"])
        # ids first, they are sorted faster than names; ``dst`` is what the rows are dealt by
        joined = _first_of_pairs(ordered.Sliced(placed, (*g, "src_id", "dst_id", "dst"), False))
    if keep is not None:
        joined = joined.select(*g, *keep, "src_id", "dst_id", *(["src_kind", "dst_kind"] if kinds else []))
    return nodes, written(joined) if stage else joined


def earliest_edges(edges: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """Earliest time per (src, dst, type)."""
    return edges.groupBy(*g, "src", "dst", "edge_type").agg(F.min("ts_ns").alias("ts_ns"))


def repeat_edges(edges: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """Repeats of (src, type, dst) as one edge with a count and its first time. Event ids stay in
    the long table; :func:`event_id_lists` renders them for the sink."""
    return edges.groupBy(*g, "src", "edge_type", "dst").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts_ns").alias("ts_ns")
    )


def event_id_lists(edges: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """Comma-joined event ids per (src, type, dst) in time order: one row, however many there are. The list is
    the result that is asked for; where it would be too long to hold, :func:`repeat_edges` counts and the
    edges themselves keep the ids."""
    ids = F.array_sort(F.collect_list(F.struct("ts_ns", "line_no", F.col("event_id").cast("string").alias("id"))))
    return lines.in_order(edges).groupBy(*g, "src", "edge_type", "dst").agg(
        F.count(F.lit(1)).alias("n_ids"), F.array_join(F.transform(ids, lambda x: x["id"]), ",").alias("event_ids")
    )


def op_sets(edges: DataFrame, g: Sequence[str] = ()) -> DataFrame:
    """Distinct operations per (src, dst), sorted and joined (the vocabulary of types is small)."""
    return edges.groupBy(*g, "src", "dst").agg(
        F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("ops"), F.count(F.lit(1)).alias("n_edges")
    )


def seen_times(edges: DataFrame) -> DataFrame:
    """First and last time an entity is seen, as source or target."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uuid"), "ts_ns")
    return ends.groupBy("uuid").agg(F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


def time_coverage(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """Share of entities that have a time."""
    j = entities.select("uuid").join(seen, "uuid", "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count("first_ts").alias("n_with_time"),
        F.round(100.0 * F.count("first_ts") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("pct"),
    )


def encode_in_order(values: DataFrame, value: str, order: Sequence[str], saved: DataFrame | None = None) -> DataFrame:
    """Dictionary (value, code) in order of first sight, extending a saved one."""
    at = values.groupBy(value).agg(F.min(F.struct(*order)).alias("f")).select(value, "f.*")
    if saved is None:
        return ordered.scan(at, [], order, index="code").select(value, (F.col("code") - 1).alias("code"))
    fresh = ordered.scan(at.join(saved, value, "left_anti"), [], order, index="code")
    top = saved.agg((F.coalesce(F.max("code"), F.lit(-1))).alias("top"))
    fresh = fresh.join(F.broadcast(top)).select(value, (F.col("code") + F.col("top")).alias("code"))
    return saved.select(value, F.col("code").cast("long")).unionByName(fresh)


def graph_totals(nodes: DataFrame, edges: DataFrame, g: Sequence[str]) -> DataFrame:
    """Node and edge counts per graph."""
    n = nodes.groupBy(*g).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy(*g).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, list(g), "left").fillna(0, ["n_edges"])


def last_value(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Map update: the last row per key wins."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(key, "v.*")
