"""Labelling, window filters, coverage, splits and counts over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from provloom.functions import paths
from provloom.functions.timeid import NS
from provloom.operators import catalog, label, ordered, partition, sequences, splits
from provloom.plans.graph_queries import _SEGMENTS_SQL, host_graph, host_segments
from provloom.plans.registry import named
from provloom.plans.views import query, view

DAY = 24 * 3600 * NS
T0 = 1_704_067_200 * NS  # the first day of the event table

_MEMBERS = f"""{_SEGMENTS_SQL},
    sub_edge AS (SELECT p.dep_id, p.part_idx, c.src, c.dst, c.edge_type, c.ts_ns, c.line_no
                 FROM cut c JOIN part p ON c.src = p.src AND c.segment = p.segment),
    sub_node AS (SELECT DISTINCT dep_id, part_idx, uuid FROM (
                 SELECT dep_id, part_idx, src AS uuid FROM sub_edge UNION ALL SELECT dep_id, part_idx, dst FROM sub_edge)),
    hit AS (SELECT dep_id, part_idx, count(*) AS n_flagged FROM sub_node WHERE uuid IN (SELECT uuid FROM flagged)
            GROUP BY dep_id, part_idx HAVING count(*) >= 2)"""


def subgraphs(spark, sf):
    """(segments, sub_nodes, sub_edges, flagged) with seed names."""
    nodes, seg, segments = host_segments(spark, sf)
    sub_nodes = partition.subgraph_nodes(seg, segments, nodes).join(view(spark, sf, "host_name").select("uuid", "name"), "uuid")
    sub_edges = partition.subgraph_edges(seg, segments)
    seeds = nodes.join(view(spark, sf, "host_name").select("uuid", "name"), "uuid").select(
        F.col("node_id").alias("seed"), F.col("uuid").alias("seed_uuid"), F.col("name").alias("seed_name")
    )
    return segments.join(seeds, "seed"), sub_nodes, sub_edges, view(spark, sf, "flagged")


@named(
    "labelled_segments",
    f"""WITH {_MEMBERS} SELECT p.dep_id, p.part_idx, p.n_nodes, h.n_flagged,
    row_number() OVER (ORDER BY h.n_flagged DESC, p.dep_id, p.part_idx) AS rank
    FROM part p JOIN hit h ON h.dep_id = p.dep_id AND h.part_idx = p.part_idx""",
)
def labelled_segments(spark, sf):
    """Segments with two flagged nodes or more, most first."""
    segments, sub_nodes, _, flagged = subgraphs(spark, sf)
    return label.label_segments(segments, sub_nodes, flagged).select("dep_id", "part_idx", "n_nodes", "n_flagged", "rank")


@named(
    "top_labelled_segments",
    f"""WITH {_MEMBERS} SELECT p.dep_id, p.part_idx, h.n_flagged,
    strftime(make_timestamp((p.start_ts - 14400000000000) // 1000), '%Y-%m-%d %H:%M:%S') AS start_time
    FROM part p JOIN hit h ON h.dep_id = p.dep_id AND h.part_idx = p.part_idx
    ORDER BY h.n_flagged DESC, p.dep_id, p.part_idx LIMIT 5""",
)
def top_labelled_segments(spark, sf):
    """The five segments with most flagged nodes and their local start time."""
    from provloom.functions import timeid

    segments, sub_nodes, _, flagged = subgraphs(spark, sf)
    top = label.label_segments(segments, sub_nodes, flagged).filter("rank <= 5")
    return top.select("dep_id", "part_idx", "n_flagged", timeid.eastern(F.col("start_ts")).alias("start_time"))


@named(
    "flagged_subgraph_nodes",
    f"WITH {_MEMBERS} SELECT dep_id, part_idx, uuid FROM sub_node WHERE uuid IN (SELECT uuid FROM flagged)",
)
def flagged_subgraph_nodes(spark, sf):
    _, sub_nodes, _, flagged = subgraphs(spark, sf)
    return label.flagged_nodes(sub_nodes, flagged).select("dep_id", "part_idx", "uuid")


@named(
    "flagged_coverage",
    f"""WITH {_MEMBERS}, f AS (SELECT DISTINCT uuid FROM flagged)
    SELECT count(*) AS n_listed, count(CASE WHEN uuid IN (SELECT uuid FROM sub_node) THEN 1 END) AS n_found,
           count(CASE WHEN uuid NOT IN (SELECT uuid FROM sub_node) THEN 1 END) AS n_missing FROM f""",
)
def flagged_coverage(spark, sf):
    _, sub_nodes, _, flagged = subgraphs(spark, sf)
    return label.coverage(flagged, sub_nodes)


@named(
    "flagged_found_and_missing",
    """SELECT uuid, 'found' AS state FROM (SELECT uuid FROM flagged INTERSECT SELECT dst FROM host_edge)
    UNION ALL SELECT uuid, 'missing' FROM (SELECT uuid FROM flagged EXCEPT SELECT dst FROM host_edge)""",
)
def flagged_found_and_missing(spark, sf):
    flagged = view(spark, sf, "flagged")
    seen = view(spark, sf, "host_edge").select(F.col("dst").alias("uuid"))
    return label.found_ids(flagged, seen).withColumn("state", F.lit("found")).unionByName(
        label.missing_ids(flagged, seen).withColumn("state", F.lit("missing"))
    )


_FILTERED = f"""{_MEMBERS},
    lab AS (SELECT dep_id, part_idx FROM hit),
    mal AS (SELECT DISTINCT s.dep_id, s.uuid FROM sub_node s JOIN lab USING (dep_id, part_idx) WHERE s.uuid IN (SELECT uuid FROM flagged)),
    pn AS (SELECT p.dep_id, p.part_idx, n.name AS seed_name, p.start_ts, p.end_ts FROM part p JOIN host_name n ON n.uuid = p.src),
    fe AS (SELECT e.* FROM sub_edge e JOIN lab USING (dep_id, part_idx) JOIN pn USING (dep_id, part_idx)
           WHERE e.ts_ns BETWEEN {T0 + 5 * DAY} AND {T0 + 20 * DAY}
           AND (pn.seed_name <> 'fluxbox' OR e.src IN (SELECT uuid FROM flagged) OR e.dst IN (SELECT uuid FROM flagged))),
    fn AS (SELECT s.* FROM sub_node s JOIN lab USING (dep_id, part_idx)
           WHERE EXISTS (SELECT 1 FROM fe WHERE fe.dep_id = s.dep_id AND fe.part_idx = s.part_idx)
           AND (s.uuid IN (SELECT uuid FROM flagged)
                OR EXISTS (SELECT 1 FROM fe WHERE fe.dep_id = s.dep_id AND fe.part_idx = s.part_idx AND (fe.src = s.uuid OR fe.dst = s.uuid))
                OR EXISTS (SELECT 1 FROM mal m WHERE m.dep_id = s.dep_id AND m.uuid = s.uuid)))"""


@named(
    "filtered_attack_segments",
    f"""WITH {_FILTERED}
    SELECT dep_id, part_idx, min(fe.ts_ns) AS start_ts, max(fe.ts_ns) AS end_ts, count(*) AS n_edges,
      (SELECT count(*) FROM fn WHERE fn.dep_id = fe.dep_id AND fn.part_idx = fe.part_idx) AS n_nodes,
      (SELECT count(*) FROM fn JOIN mal m ON m.dep_id = fn.dep_id AND m.uuid = fn.uuid
       WHERE fn.dep_id = fe.dep_id AND fn.part_idx = fe.part_idx) AS n_flagged
    FROM fe GROUP BY dep_id, part_idx""",
)
def filtered_attack_segments(spark, sf):
    """Labelled segments restricted to a window, with a special rule for one seed name."""
    seg, sub_nodes, sub_edges, flagged = subgraphs(spark, sf)
    out, _, _ = label.filter_segments(seg, sub_edges, sub_nodes, flagged, T0 + 5 * DAY, T0 + 20 * DAY, "fluxbox")
    return out.select("dep_id", "part_idx", "start_ts", "end_ts", "n_edges", "n_nodes", "n_flagged")


@named("filtered_attack_nodes", f"WITH {_FILTERED} SELECT dep_id, part_idx, uuid FROM fn")
def filtered_attack_nodes(spark, sf):
    seg, sub_nodes, sub_edges, flagged = subgraphs(spark, sf)
    _, nodes, _ = label.filter_segments(seg, sub_edges, sub_nodes, flagged, T0 + 5 * DAY, T0 + 20 * DAY, "fluxbox")
    return nodes.select("dep_id", "part_idx", "uuid")


@named(
    "segments_holding_ids",
    f"WITH {_MEMBERS} SELECT DISTINCT dep_id, part_idx FROM sub_node WHERE upper(uuid) IN ('P11', 'O24')",
)
def segments_holding_ids(spark, sf):
    """Segments that contain a wanted id, whatever its case."""
    _, sub_nodes, _, _ = subgraphs(spark, sf)
    return label.select_segments(sub_nodes, ["P11", "o24"])


@named("segments_of_components", f"WITH {_MEMBERS} SELECT DISTINCT dep_id, part_idx FROM sub_node WHERE dep_id IN (1, 3, 4)")
def segments_of_components(spark, sf):
    """Segments of wanted components."""
    _, sub_nodes, _, _ = subgraphs(spark, sf)
    return label.select_components(sub_nodes, [1, 3, 4])


@named(
    "benign_segments",
    f"""WITH {_SEGMENTS_SQL} SELECT dep_id, part_idx, n_nodes, n_nodes > 7 AS oversize FROM part
    WHERE start_ts >= {T0 + 2 * DAY} AND start_ts < {T0 + 25 * DAY} AND end_ts >= {T0 + 2 * DAY} AND end_ts < {T0 + 25 * DAY}""",
)
def benign_segments(spark, sf):
    seg = host_segments(spark, sf)[2]
    return label.benign_segments(seg, T0 + 2 * DAY, T0 + 25 * DAY, max_nodes=7).select("dep_id", "part_idx", "n_nodes", "oversize")


@named(
    "positional_train_test",
    f"""WITH {_SEGMENTS_SQL}, n AS (SELECT dep_id, part_idx, row_number() OVER (ORDER BY dep_id, part_idx) AS pos FROM part)
    SELECT dep_id, part_idx, pos, CASE WHEN pos <= 100 THEN 'train' ELSE 'test' END AS split FROM n WHERE pos <= 120""",
)
def positional_train_test(spark, sf):
    seg = host_segments(spark, sf)[2]
    return label.positional_split(seg, 100, 20).select("dep_id", "part_idx", "pos", "split")


@named(
    "edges_in_window",
    f"SELECT line_no, src, dst, ts_ns FROM host_edge WHERE ts_ns BETWEEN {T0 + 3 * DAY} AND {T0 + 9 * DAY}",
)
def edges_in_window(spark, sf):
    return label.in_window(view(spark, sf, "host_edge"), T0 + 3 * DAY, T0 + 9 * DAY).select("line_no", "src", "dst", "ts_ns")


@named(
    "edges_touching_flagged",
    "SELECT line_no, src, dst FROM host_edge WHERE src IN (SELECT uuid FROM flagged) OR dst IN (SELECT uuid FROM flagged)",
)
def edges_touching_flagged(spark, sf):
    return label.touching(view(spark, sf, "host_edge"), view(spark, sf, "flagged")).select("line_no", "src", "dst")


_TACTIC = f"""win AS (SELECT e.*, s.name AS src_name, d.name AS dst_name FROM host_edge e
      LEFT JOIN host_name s ON s.uuid = e.src LEFT JOIN host_name d ON d.uuid = e.dst
      WHERE e.ts_ns BETWEEN {T0 + DAY} AND {T0 + 12 * DAY}),
    tac AS (SELECT * FROM win WHERE (src IN (SELECT uuid FROM flagged) OR dst IN (SELECT uuid FROM flagged))
      AND src_name NOT IN ('thunderbird') AND dst_name NOT IN ('thunderbird', 'NETLINK:route'))"""


def _tactic_edges(spark, sf, both=False, sources=None):
    names = view(spark, sf, "host_name").select("uuid", "name")
    from provloom.operators import build

    e = build.endpoint_names(view(spark, sf, "host_edge"), names)
    return label.tactic_window(
        e, view(spark, sf, "flagged"), T0 + DAY, T0 + 12 * DAY, both, ["thunderbird", "NETLINK:route"], sources
    )


@named("tactic_window_any_end", f"WITH {_TACTIC} SELECT line_no, src, dst, src_name, dst_name, edge_type FROM tac")
def tactic_window_any_end(spark, sf):
    return _tactic_edges(spark, sf).select("line_no", "src", "dst", "src_name", "dst_name", "edge_type")


@named(
    "tactic_window_both_ends",
    f"""WITH {_TACTIC} SELECT line_no, src, dst, src_name FROM tac WHERE src IN (SELECT uuid FROM flagged)
    AND dst IN (SELECT uuid FROM flagged) AND src_name IN ('fluxbox', '-bash', 'gnome-terminal')""",
)
def tactic_window_both_ends(spark, sf):
    return _tactic_edges(spark, sf, True, ["fluxbox", "-bash", "gnome-terminal"]).select("line_no", "src", "dst", "src_name")


@named(
    "tactic_window_summary",
    f"""WITH {_TACTIC}, n AS (SELECT src AS u FROM tac UNION SELECT dst FROM tac)
    SELECT (SELECT count(*) FROM tac) AS total_edges, (SELECT count(*) FROM n) AS total_nodes,
           (SELECT count(*) FROM n WHERE u IN (SELECT uuid FROM flagged)) AS flagged_nodes""",
)
def tactic_window_summary(spark, sf):
    return label.window_summary(_tactic_edges(spark, sf), view(spark, sf, "flagged"))


@named(
    "focus_edge_operations",
    """WITH f AS (SELECT uuid FROM flagged), e AS (SELECT * FROM host_edge WHERE src IN (SELECT uuid FROM f) AND dst IN (SELECT uuid FROM f) AND src <> dst)
    SELECT src, dst, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS ops, count(*) AS n_edges FROM e GROUP BY src, dst""",
)
def focus_edge_operations(spark, sf):
    from provloom.operators import build

    return build.op_sets(label.focus_edges(view(spark, sf, "host_edge"), view(spark, sf, "flagged")))


# --- splits ------------------------------------------------------------------------------------


@named(
    "random_split_sizes",
    """SELECT 'test' AS split, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS n FROM labels
    UNION ALL SELECT 'train', count(*) - greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM labels""",
)
def random_split_sizes(spark, sf):
    """Sizes of the seeded split; the split itself is checked in the tests."""
    d = query(spark, sf, "SELECT doc_id AS id, quality FROM labels")
    return splits.random_split(d, "id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@named(
    "leave_out_split",
    """SELECT doc_id, CASE WHEN contains(source, 'src1') OR contains(source, '7') THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def leave_out_split(spark, sf):
    d = query(spark, sf, "SELECT doc_id, source FROM documents")
    return splits.leave_out_split(d, "source", ["src1", "7"]).select("doc_id", "split")


_MEMBER = """SELECT doc_id AS id, 'quality' AS label FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1
    UNION ALL SELECT doc_id, concat('lang_', lang) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""


@named(
    "stratified_split_sizes",
    """SELECT 'test' AS split, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS n FROM labels
    UNION ALL SELECT 'train', count(*) - greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM labels""",
)
def stratified_split_sizes(spark, sf):
    member = query(spark, sf, _MEMBER)
    s = splits.stratified_split(query(spark, sf, "SELECT doc_id AS id FROM labels"), member)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@named(
    "stratified_split_keeps_labels",
    f"""SELECT label, count(*) >= 2 AS in_test, TRUE AS in_train FROM ({_MEMBER}) GROUP BY label""",
)
def stratified_split_keeps_labels(spark, sf):
    """Every label with two rows or more is on both sides."""
    member = query(spark, sf, _MEMBER)
    s = splits.stratified_split(query(spark, sf, "SELECT doc_id AS id FROM labels"), member)
    return member.join(s, "id").groupBy("label").agg(
        F.bool_or(F.col("split") == "test").alias("in_test"), F.bool_or(F.col("split") == "train").alias("in_train")
    )


@named(
    "stratified_batch_size",
    f"""WITH m AS ({_MEMBER}) SELECT label, least(count(*), 5) AS n_at_least FROM m GROUP BY label""",
)
def stratified_batch_size(spark, sf):
    """Rows of a batch per label: at least k, or all the label has."""
    m = query(spark, sf, _MEMBER)
    batch = splits.stratified_batch(m, 5)
    return m.join(batch, "id", "left_semi").groupBy("label").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("n_at_least"))


@named(
    "positive_negative_batches",
    """WITH n AS (SELECT doc_id AS id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM labels WHERE toxic = 0),
    b AS (SELECT DISTINCT batch FROM n)
    SELECT batch, id, 'negative' AS role FROM n
    UNION ALL SELECT b.batch, l.doc_id, 'positive' FROM b, labels l WHERE l.toxic = 1""",
)
def positive_negative_batches(spark, sf):
    pos = query(spark, sf, "SELECT doc_id AS id FROM labels WHERE toxic = 1")
    neg = query(spark, sf, "SELECT doc_id AS id FROM labels WHERE toxic = 0")
    return splits.batches(pos, neg, 64)


@named(
    "label_template_pairs",
    """SELECT d.doc_id AS id, d.lang AS label, b.item_id AS template_id FROM documents d
    JOIN benchmark b ON CASE b.item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END = d.lang""",
)
def label_template_pairs(spark, sf):
    t = query(spark, sf, "SELECT doc_id AS id, lang AS label FROM documents")
    b = query(
        spark, sf,
        "SELECT CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS label, item_id AS template_id FROM benchmark",
    )
    return splits.label_pairs(t, b).select("id", "label", "template_id")


@named(
    "random_positive_per_text",
    """SELECT lang AS label, count(*) AS n_texts FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY lang""",
)
def random_positive_per_text(spark, sf):
    """One template of its own label for every text, drawn by a seeded hash."""
    t = query(spark, sf, "SELECT doc_id AS id, lang AS label FROM documents")
    b = query(
        spark, sf,
        "SELECT CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS label, item_id AS template_id FROM benchmark",
    )
    return splits.random_positive(t, b, epoch=1).groupBy("label").agg(F.countDistinct("id").alias("n_texts"))


@named(
    "report_pair_misses",
    """WITH m AS (SELECT doc_id AS dep_id, CAST(0 AS BIGINT) AS part_idx, concat('r', CAST(quality * 3 + toxic AS STRING)) AS report_key FROM labels),
    s AS (SELECT doc_id AS dep_id, CAST(doc_id % 7 // 6 AS BIGINT) AS part_idx FROM documents)
    SELECT m.dep_id, m.report_key FROM m LEFT JOIN s ON s.dep_id = m.dep_id AND s.part_idx = m.part_idx
    WHERE s.dep_id IS NULL OR m.report_key NOT IN ('r0', 'r3')""",
)
def report_pair_misses(spark, sf):
    seqs = query(spark, sf, "SELECT doc_id AS dep_id, CAST((doc_id % 7) DIV 6 AS BIGINT) AS part_idx, text FROM documents")
    mapping = query(
        spark, sf,
        "SELECT doc_id AS dep_id, CAST(0 AS BIGINT) AS part_idx, concat('r', CAST(quality * 3 + toxic AS STRING)) AS report_key FROM labels",
    )
    reports = query(spark, sf, "SELECT DISTINCT concat('r', CAST(quality * 3 AS STRING)) AS report_key FROM labels")
    return splits.report_pairs(seqs, mapping, reports)[1].select("dep_id", "report_key")


# --- counts and set reports --------------------------------------------------------------------


@named(
    "label_sets_per_document",
    f"""SELECT id AS step, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(DISTINCT label) AS n_labels
    FROM ({_MEMBER}) GROUP BY id""",
)
def label_sets_per_document(spark, sf):
    return catalog.label_sets(query(spark, sf, _MEMBER).withColumnRenamed("id", "step"))


@named(
    "single_and_multi_label_counts",
    f"""WITH s AS (SELECT id, count(DISTINCT label) AS n FROM ({_MEMBER}) GROUP BY id)
    SELECT count(*) AS n_total, count(CASE WHEN n = 1 THEN 1 END) AS n_single, count(CASE WHEN n > 1 THEN 1 END) AS n_multi FROM s""",
)
def single_and_multi_label_counts(spark, sf):
    return catalog.single_multi(catalog.label_sets(query(spark, sf, _MEMBER).withColumnRenamed("id", "step")))


_STEP = "SELECT DISTINCT concat('step', CAST(l_suppkey AS STRING)) AS step, concat('T', CAST(l_partkey % 50 AS STRING)) AS technique FROM lineitem"
_TECH = "SELECT DISTINCT concat('T', CAST(p_partkey % 50 AS STRING)) AS technique, p_type AS label FROM part"


@named(
    "step_labels",
    f"""SELECT s.step, string_agg(DISTINCT t.label, ',' ORDER BY t.label) AS labels, count(DISTINCT t.label) AS n_labels
    FROM ({_STEP}) s JOIN ({_TECH}) t ON t.technique = s.technique GROUP BY s.step""",
)
def step_labels(spark, sf):
    return catalog.step_labels(query(spark, sf, _STEP), query(spark, sf, _TECH))


@named(
    "step_occurrences",
    f"""SELECT s.step, s.technique, coalesce((SELECT string_agg(DISTINCT t.label, ',' ORDER BY t.label) FROM ({_TECH}) t
    WHERE t.technique = s.technique), '') AS labels FROM ({_STEP}) s""",
)
def step_occurrences(spark, sf):
    return catalog.step_occurrences(query(spark, sf, _STEP), query(spark, sf, _TECH))


_VARIANT = "SELECT l_returnflag AS tactic, l_linenumber AS technique, concat('run', CAST(l_orderkey AS STRING), CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('-', CAST(l_suppkey % 40 AS STRING)) END) AS name FROM lineitem"
_VARIANT_SQL = f"""v AS (SELECT *, CASE WHEN regexp_extract(name, '^.*-([0-9]+)$', 1) <> '' THEN regexp_extract(name, '^.*-([0-9]+)$', 1) ELSE name END AS suffix
    FROM (SELECT DISTINCT * FROM ({_VARIANT}))),
    k AS (SELECT *, name = min(name) OVER (PARTITION BY tactic, technique, suffix) AS kept FROM v)"""


@named("variants_kept", f"WITH {_VARIANT_SQL} SELECT tactic, technique, name, kept FROM k")
def variants_kept(spark, sf):
    """Of entries that share a numeric suffix the first by name stays."""
    return catalog.drop_variants(query(spark, sf, _VARIANT).distinct(), ["tactic", "technique"])


@named(
    "variant_report",
    f"""WITH {_VARIANT_SQL} SELECT coalesce(tactic, 'TOTAL') AS tactic, count(*) AS n_before, count(CASE WHEN kept THEN 1 END) AS n_kept,
    count(CASE WHEN NOT kept THEN 1 END) AS n_moved FROM k GROUP BY ROLLUP (tactic)""",
)
def variant_report(spark, sf):
    return catalog.variant_report(variants_kept(spark, sf), "tactic")


_CONTENT = """SELECT concat('step', CAST(l_partkey % 300 AS STRING)) AS name, l_linestatus AS grp, l_returnflag AS part,
    concat('v', CAST(l_partkey % 2 AS STRING), CASE WHEN l_suppkey % 50 = 0 THEN 'x' ELSE '' END) AS content FROM lineitem"""


@named(
    "content_comparison",
    f"""WITH h AS (SELECT DISTINCT name, grp, part, content FROM ({_CONTENT})),
    g AS (SELECT name, count(DISTINCT grp) AS n_groups FROM h GROUP BY name HAVING count(DISTINCT grp) > 1),
    c AS (SELECT h.name, g.n_groups, part, content, count(*) AS c FROM h JOIN g ON g.name = h.name GROUP BY ALL)
    SELECT name, n_groups, count(*) AS n_union, count(CASE WHEN c = n_groups THEN 1 END) AS n_common,
    CASE WHEN count(*) = count(CASE WHEN c = n_groups THEN 1 END) THEN 'identical'
         WHEN count(CASE WHEN c = n_groups THEN 1 END) > 0 THEN 'partial' ELSE 'different' END AS verdict
    FROM c GROUP BY name, n_groups""",
)
def content_comparison(spark, sf):
    """Same-named steps of several groups compared by content hash."""
    return catalog.compare_content(query(spark, sf, _CONTENT))


@named(
    "file_path_frequency",
    """SELECT n.name AS path, count(*) AS n FROM host_edge e JOIN host_name n ON n.uuid = e.dst
    WHERE e.dst_type = 'FILE_OBJECT_BLOCK' GROUP BY n.name""",
)
def file_path_frequency(spark, sf):
    from provloom.operators import build

    e = build.endpoint_names(view(spark, sf, "host_edge"), view(spark, sf, "host_name").select("uuid", "name"))
    return catalog.file_path_counts(e, "FILE_OBJECT_BLOCK")


@named(
    "file_path_totals",
    """SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_unique FROM (SELECT n.name, count(*) AS n FROM host_edge e JOIN host_name n ON n.uuid = e.dst
    WHERE e.dst_type = 'FILE_OBJECT_BLOCK' GROUP BY n.name)""",
)
def file_path_totals(spark, sf):
    return catalog.count_totals(file_path_frequency(spark, sf))


@named(
    "event_type_breakdown",
    "SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type",
)
def event_type_breakdown(spark, sf):
    from provloom.sources import audit

    return audit.type_breakdown(query(spark, sf, "SELECT event_type AS type FROM events"))


@named(
    "sentence_reduction_report",
    """SELECT coalesce(source, 'TOTAL') AS source, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after,
    round(100.0 * (sum(b) - sum(a)) / greatest(sum(b), 1), 1) AS pct
    FROM (SELECT source, len(string_split(text, '. ')) AS b, len(list_distinct(string_split(text, '. '))) AS a FROM documents) GROUP BY ROLLUP (source)""",
)
def sentence_reduction_report(spark, sf):
    """Sentences before and after exact deduplication per source, with a grand total."""
    d = query(spark, sf, "SELECT source, text FROM documents").select(
        "source", F.size(F.split("text", r"\. ")).alias("n_before"), F.size(F.array_distinct(F.split("text", r"\. "))).alias("n_after")
    )
    return catalog.reduction_report(d, "source")


@named(
    "numbered_public_flows",
    f"""WITH {_MEMBERS},
    a AS (SELECT s.dep_id, s.part_idx, n.ts_ns, n.node_id, regexp_extract_all(h.name, '(?:^|_)([0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}})', 1) AS ips
          FROM sub_node s JOIN nodes n ON n.uuid = s.uuid JOIN host_name h ON h.uuid = s.uuid WHERE h.type = 'NetFlowObject'),
    p AS (SELECT dep_id, part_idx, ips[len(ips)] AS ip, min((ts_ns, node_id)) AS pos FROM a WHERE len(ips) >= 2 AND NOT starts_with(ips[len(ips)], '192.168.')
          GROUP BY ALL)
    SELECT dep_id, part_idx, ip, CASE WHEN count(*) OVER w = 1 THEN 'public_netflow'
      ELSE concat('public_netflow_', CAST(row_number() OVER (PARTITION BY dep_id, part_idx ORDER BY pos) AS STRING)) END AS label
    FROM p WINDOW w AS (PARTITION BY dep_id, part_idx)""",
)
def numbered_public_flows(spark, sf):
    """Distinct public addresses of a subgraph numbered by first sight."""
    _, sub_nodes, _, _ = subgraphs(spark, sf)
    return sequences.number_public_flows(sub_nodes.withColumn("pos", F.col("node_id")), ["dep_id", "part_idx"])
