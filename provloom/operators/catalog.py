"""Counts and set reports over steps, techniques, tactics, files and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provloom.functions import network, paths
from provloom.operators import ordered


def label_sets(membership: DataFrame, key: str = "step", label: str = "label") -> DataFrame:
    """(key, labels, n_labels): the sorted label set of each key (labels are a small vocabulary)."""
    return membership.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.countDistinct(label).alias("n_labels")
    )


def single_multi(sets: DataFrame) -> DataFrame:
    return sets.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("n_labels") == 1).alias("n_single"),
        F.count_if(F.col("n_labels") > 1).alias("n_multi"),
    )


def step_occurrences(steps: DataFrame, technique_labels: DataFrame) -> DataFrame:
    """(step, technique, labels): the techniques a step occurs under with the labels of each."""
    t = label_sets(technique_labels, "technique")
    return (
        steps.select("step", "technique").distinct().join(t, "technique", "left")
        .select("step", "technique", F.coalesce("labels", F.lit("")).alias("labels"))
    )


def step_labels(steps: DataFrame, technique_labels: DataFrame) -> DataFrame:
    """Step -> techniques -> labels, as a label set per step."""
    return label_sets(steps.select("step", "technique").distinct().join(technique_labels.distinct(), "technique"), "step")


def drop_variants(entries: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Add ``kept``: of the entries of a group that share a numeric name suffix the first by name
    stays; an entry without a suffix is its own group."""
    suffix = F.regexp_extract(name, r"^.*-(\d+)$", 1)
    e = entries.withColumn("_suffix", F.when(suffix != "", suffix).otherwise(F.col(name)))
    first = e.groupBy(*keys, "_suffix").agg(F.min(name).alias("_first"))
    return e.join(first, [*keys, "_suffix"]).withColumn("kept", F.col(name) == F.col("_first")).drop("_suffix", "_first")


def variant_report(marked: DataFrame, by: str) -> DataFrame:
    """Before, kept and moved per group, and a TOTAL row."""
    return (
        marked.rollup(by)
        .agg(
            F.count(F.lit(1)).alias("n_before"),
            F.count_if("kept").alias("n_kept"),
            F.count_if(~F.col("kept")).alias("n_moved"),
        )
        .withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("TOTAL")))
    )


def compare_content(items: DataFrame) -> DataFrame:
    """(name, verdict) for names that occur in two groups or more. ``items``: name, grp, part,
    content. A group holds a set of (part, content hash); 'identical' when every group holds all of
    them, 'partial' when some are held by all, else 'different'."""
    h = items.select("name", "grp", "part", F.sha2("content", 256).alias("h")).distinct()
    groups = h.select("name", "grp").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_groups"))
    held = h.groupBy("name", "part", "h").agg(F.count(F.lit(1)).alias("c"))
    per = held.join(groups.filter("n_groups > 1"), "name").groupBy("name", "n_groups").agg(
        F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("c") == F.col("n_groups")).alias("n_common")
    )
    verdict = F.when(F.col("n_common") == F.col("n_union"), "identical").when(F.col("n_common") > 0, "partial").otherwise("different")
    return per.withColumn("verdict", verdict)


def file_path_counts(edges: DataFrame, file_type: str = "FileObject") -> DataFrame:
    """(path, n): how often a file is a target."""
    return (
        edges.filter((F.col("dst_type") == file_type) & (F.coalesce("dst_name", F.lit("")) != ""))
        .groupBy(F.col("dst_name").alias("path"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count(F.lit(1)).alias("n_unique"))


def unresolved_paths(nodes: DataFrame, file_type: str = "FILE") -> DataFrame:
    """(path, n): file nodes no lifting rule changes. Names are counted first, so the rules run once per name."""
    names = nodes.filter((F.col("type") == file_type) & F.col("name").isNotNull()).groupBy(F.col("name").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    unchanged = F.coalesce(paths.lift_path(F.col("path")), F.col("path")) == F.col("path")
    # names the count, always above 0, so that the rules stay behind the aggregate
    return names.filter(F.when(F.col("n") > 0, unchanged))


def most_frequent(counts: DataFrame, k: int = 30) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc("path")).limit(k)


def generalize_nodes(nodes: DataFrame, file_type: str = "FILE") -> DataFrame:
    """Node names with addresses replaced by their class and file paths lifted; ``ip`` and ``lifted``
    say what happened."""
    ip = network.address_of(F.col("name"))
    lift = F.when(F.col("type") == file_type, paths.lift_path(F.col("name")))
    new = F.when(F.col("ip").isNotNull(), network.address_class(F.col("ip"))).otherwise(F.coalesce(lift, F.col("name")))
    return (
        nodes.withColumn("ip", ip)
        .withColumn("new_name", new)
        .withColumn("lifted", F.col("ip").isNull() & (F.col("new_name") != F.col("name")))
    )


def generalization_counts(generalized: DataFrame, file_type: str = "FILE") -> DataFrame:
    is_file = F.col("type") == file_type
    return generalized.agg(
        F.count("ip").alias("n_addresses"),
        F.count_if(F.col("ip").isNotNull() & F.col("new_name").contains("internal")).alias("n_internal"),
        F.count_if(F.col("ip").isNotNull() & ~F.col("new_name").contains("internal")).alias("n_external"),
        F.countDistinct("ip").alias("n_unique_addresses"),
        F.count_if("lifted").alias("n_lifted"),
        F.countDistinct(F.when(F.col("lifted"), F.col("name"))).alias("n_unique_lifted"),
        F.count_if(is_file & ~F.col("lifted")).alias("n_unchanged"),
        F.countDistinct(F.when(is_file & ~F.col("lifted"), F.col("name"))).alias("n_unique_unchanged"),
    )


def verb_counts(edges: DataFrame) -> DataFrame:
    """Edge types that lose their prefix, with the bare verb."""
    return (
        edges.filter(F.col("edge_type").startswith("EVENT_"))
        .groupBy("edge_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("verb", F.expr("substring(edge_type, 7, length(edge_type))"))
    )


def reduction_report(counts: DataFrame, by: str) -> DataFrame:
    """n_before, n_after and percentage per group with a grand total; ``counts``: by, n_before, n_after."""
    return (
        counts.rollup(by)
        .agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
        .withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("TOTAL")))
        .withColumn("pct", F.round(100.0 * (F.col("n_before") - F.col("n_after")) / F.greatest("n_before", F.lit(1)), 1))
    )


def group_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return ordered.scan(df, list(keys), list(order), index="pos")


def best_two(scores: DataFrame) -> DataFrame:
    """Best and second match per row on one line."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("ref"))
    top = scores.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
    return top.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("ref"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_score"),
        F.max(F.when(F.col("rank") == 2, F.col("ref"))).alias("second"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
    )
