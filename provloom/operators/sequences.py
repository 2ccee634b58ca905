"""Triples, sentences and sequences. A sequence is the long table (keys, pos, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.functions import naming, network
from provloom.functions import text as tx
from provloom.operators import ordered


def sentences(
    edges: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("ts_ns", "line_no"),
    op: Column | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Sentences 'src op dst.' of edges with names, 1-based position in time order."""
    verb = naming.verb(F.col("edge_type")) if op is None else op
    s = edges.withColumn("text", naming.sentence(F.col("src_name"), verb, F.col("dst_name")))
    return ordered.scan(
        s.select(*keys, *order, "text"), list(keys), list(order), index="pos", target_rows=target_rows
    ).select(*keys, "pos", "text")


def adjacency_sentences(edges: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Audit flavour: sentences in graph adjacency order, which is by source node, then by the
    first edge of the (source, target) pair, then by the edge itself; not by time."""
    order = ["src_id", "pair_ts", "pair_line", "ts_ns", "line_no"]
    return sentences(edges, keys, order, F.lower("edge_type"), target_rows)


def drop_marked(sents: DataFrame, marker: str = "unreachable_host local:0") -> DataFrame:
    return sents.filter(~F.col("text").contains(marker))


def number_public_flows(sub_nodes: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """(keys, ip, label): public addresses of a subgraph numbered by first sight, unnumbered when
    there is only one. ``sub_nodes`` carries ``pos``, the order of its nodes."""
    ip = network.public_destination(F.col("name"))
    firsts = (
        sub_nodes.filter(naming.is_flow_type(F.col("type")))
        .withColumn("ip", ip)
        .filter(F.col("ip").isNotNull())
        .groupBy(*keys, "ip")
        .agg(F.min("pos").alias("pos"))
    )
    n = firsts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    idx = ordered.scan(firsts, list(keys), ["pos"], index="_i", target_rows=target_rows).join(n, list(keys))
    label = F.when(F.col("_n") == 1, "public_netflow").otherwise(
        F.concat(F.lit("public_netflow_"), F.col("_i").cast("string"))
    )
    return idx.select(*keys, "ip", label.alias("label"))


def abstract_nodes(sub_nodes: DataFrame, keys: Sequence[str], numbered: bool = True) -> DataFrame:
    """Subgraph nodes with ``label``, the abstract name."""
    if not numbered:
        return sub_nodes.withColumn("label", naming.node_label(F.col("name"), F.col("type")))
    labels = number_public_flows(sub_nodes, keys).withColumnRenamed("label", "_flow")
    n = sub_nodes.withColumn(
        "ip", F.when(naming.is_flow_type(F.col("type")), network.public_destination(F.col("name")))
    ).join(labels, [*keys, "ip"], "left")
    return n.withColumn("label", naming.node_label(F.col("name"), F.col("type"), F.col("_flow"))).drop("_flow", "ip")


def _without_repeats(rows: ordered.Sliced) -> ordered.Sliced:
    s = ordered.scan_sliced(rows, ["pos"], lag={"_before": "text"})
    return s.with_df(s.df.filter(F.col("_before").isNull() | (F.col("text") != F.col("_before"))).drop("_before"))


def _without_alternations(rows: ordered.Sliced) -> ordered.Sliced:
    s = ordered.scan_sliced(rows, ["pos"], index="_i", lag={"_p1": "text"})
    s = ordered.scan_sliced(s, ["pos"], lag={"_p2": "_p1"})
    alternates = F.coalesce(F.col("text") == F.col("_p2"), F.lit(False))
    # a stretch ends where the next sentence does not go on; its length is the way from the last one before it
    s = s.with_df(s.df.withColumn("_alt", alternates).withColumn("_brk", F.when(~alternates, F.col("_i"))))
    s = ordered.running_sliced(ordered.scan_sliced(s, ["pos"], lead={"_goes_on": "_alt"}), ["pos"], "_brk", "_start", "max")
    odd_last = ~F.coalesce("_goes_on", F.lit(False)) & ((F.col("_i") - F.col("_start")) % 2 == 1)
    return s.with_df(s.df.filter(~F.col("_alt") | odd_last).select(*s.by, "pos", "text"))


def drop_adjacent_repeats(sents: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Sentences that differ from the one before, positions kept."""
    return _without_repeats(ordered.with_slices(sents, list(keys), ["pos"], target_rows)).plain()


def drop_alternating_pairs(sents: DataFrame, keys: Sequence[str], target_rows: int | None = None, repeats: bool = False) -> DataFrame:
    """A B A B -> A B, from the left, to a fix point, on sentences without adjacent repeats (``repeats``: they are dropped
    first). One shuffle and one sort for all rules.

    A sentence equal to the one two places before it continues an alternation. In every maximal
    stretch of such sentences all whole pairs go and an odd last one stays, which is what deleting
    pairs from the left ends with."""
    rows = ordered.with_slices(sents.select(*keys, "pos", "text"), list(keys), ["pos"], target_rows)
    return _without_alternations(_without_repeats(rows) if repeats else rows).plain()


def formatted_sentences(sents: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Template sentences of the triples that parse, repeats and alternations removed, renumbered:
    one row per line of the document ('1. ...')."""
    t = (
        sents.withColumn("text", tx.template_sentence(tx.parse_triple(F.col("text"))))
        .filter(F.col("text").isNotNull())
        .select(*keys, "pos", "text")
    )
    rows = _without_alternations(_without_repeats(ordered.with_slices(t, list(keys), ["pos"], target_rows)))
    n = ordered.scan_sliced(rows, ["pos"], index="line").plain()
    return n.withColumn("text", F.concat(F.col("line").cast("string"), F.lit(". "), F.col("text"))).drop("pos")


def narrative_issues(sents: DataFrame, narratives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Triples whose target or operation a narrative does not mention."""
    t = sents.withColumn("t", tx.parse_triple(F.col("text"))).filter(F.col("t").isNotNull())
    j = t.join(narratives.withColumn("_low", F.lower("narrative")), list(keys))
    dst, op = F.col("t.dst_name"), F.col("t.operation")
    missing = (dst != "") & ~F.col("_low").contains(dst)
    unsaid = (dst != "") & ~F.coalesce(tx.operation_reflected(op, F.col("_low")), F.lit(True))
    issues = F.filter(
        F.array(
            F.when(missing, F.concat(F.lit("Missing target '"), dst, F.lit("' for operation '"), op, F.lit("'"))),
            F.when(unsaid, F.concat(F.lit("Operation '"), op, F.lit("' not reflected in narrative"))),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(*keys, "pos", F.explode(issues).alias("issue"))


def abstract_triples(triples: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(subject, verb, object) rows in the abstract vocabulary, first of equal triples kept."""
    t = triples.select(
        *keys,
        *order,
        F.concat_ws(
            " ",
            tx.first_contained(F.col("subject"), tx.SUBJECT_VOCABULARY),
            tx.map_verb(F.col("verb")),
            tx.first_contained(F.col("object"), tx.OBJECT_VOCABULARY),
        ).alias("text"),
    )
    firsts = t.groupBy(*keys, "text").agg(F.min(F.struct(*order)).alias("f")).select(*keys, "text", "f.*")
    return ordered.scan(firsts, list(keys), list(order), index="pos").select(*keys, "pos", "text")


def sequence_text(sents: DataFrame, keys: Sequence[str], sep: str = " ") -> DataFrame:
    """One text per sequence for the sink, however long. The text is the result that is asked for; the
    operators before it work on the sentence rows."""
    return sents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_triples"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), sep).alias("sequence"),
    )


def report_changes(reports: DataFrame) -> DataFrame:
    """(key, line_no, before, after) for the lines the report abstraction changed."""
    r = reports.withColumn("after", tx.abstract_report(F.col("text")))
    lines = r.filter(F.col("after") != F.col("text")).select(
        "key",
        F.posexplode(F.arrays_zip(F.split("text", "\r\n|\n|\r").alias("b"), F.split("after", "\r\n|\n|\r").alias("a"))).alias(
            "line_no", "z"
        ),
    )
    return lines.filter(F.col("z.b") != F.col("z.a")).select(
        "key", F.col("line_no").cast("long").alias("line_no"), F.trim("z.b").alias("before"), F.trim("z.a").alias("after")
    )
