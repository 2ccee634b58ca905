"""Train/test splits and batches. Order is a hash of the key and the seed, so a split is the same on
every run; sizes, per-label minima and disjointness are what is promised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provloom.operators import ordered
from provloom.session import cut_lineage

SEED = 42


def hashed(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Add ``_h``: the row's place in a seeded shuffle."""
    return df.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))


def random_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``split``: the first max(1, int(n * test_size)) rows of the shuffle are the test set."""
    at = ordered.scan(hashed(df, key, seed), [], ["_h", key], index="_i")
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * test_size)).alias("_t"))
    return (
        at.join(F.broadcast(n))
        .withColumn("split", F.when(F.col("_i") <= F.col("_t"), "test").otherwise("train"))
        .drop("_h", "_i", "_t")
    )


def leave_out_split(df: DataFrame, name: str, marks: Sequence[str]) -> DataFrame:
    """Rows whose name contains any of the marks are the test set."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.col(name).contains(m)
    return df.withColumn("split", F.when(hit, "test").otherwise("train"))


def stratified_split(
    entries: DataFrame, membership: DataFrame, test_size: float = 0.2, seed: int = SEED, min_test: int = 1
) -> DataFrame:
    """(id, split): every label gets ``min_test`` test rows but never its last train row; then the
    shuffle fills the test set to size.

    Labels are credited in order: a label takes from the front of the shuffle as many rows as it
    still lacks after the labels before it, and a row counts for all its labels. What a label takes is always among the
    first rows that it wanted at the start, so only those rows are looked at. In a round all labels act at once that
    share no front row, their own or the other's, with an earlier label that still lacks rows; the first label always
    acts."""
    h = hashed(entries.select("id").distinct(), "id", seed)
    m = membership.select("id", "label").distinct().join(h, "id")
    wants = m.groupBy("label").agg(F.least(F.lit(min_test), F.count(F.lit(1)) - 1).alias("want")).filter("want > 0")
    wants = cut_lineage(wants)
    front = ordered.top_k(m, ["label"], [F.asc("_h"), F.asc("id")], max(1, min_test), "_r").join(wants, "label")
    front = front.filter("_r <= want").select("id").distinct()
    held = cut_lineage(m.join(front, "id", "left_semi").join(wants.select("label"), "label", "left_semi"))
    picked = held.select("id").limit(0)
    while True:
        got = held.join(picked, "id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("got"))
        lacks = wants.join(got, "label", "left").select("label", (F.col("want") - F.coalesce("got", F.lit(0))).alias("lack")).filter("lack > 0")
        # the labels' own front rows are few: at most ``min_test`` for every label
        w = Window.partitionBy("label").orderBy("_h", "id")
        asked = held.join(picked, "id", "left_anti").join(lacks, "label").withColumn("_r", F.row_number().over(w)).filter("_r <= lack")
        asked = cut_lineage(asked.select("id", F.col("label").alias("asks")))
        if asked.isEmpty():
            break
        shared = asked.join(held.join(lacks.select("label"), "label", "left_semi").select("id", "label"), "id").filter("label <> asks")
        waits = shared.select(F.greatest("asks", "label").alias("asks")).distinct()
        chosen = asked.join(waits, "asks", "left_anti").select("id")
        picked = cut_lineage(picked.union(chosen).distinct())
    forced = picked.withColumn("_p", F.lit(True))
    ranked = ordered.scan(
        h.join(forced, "id", "left").select("id", "_h", F.when(F.col("_p"), 0).otherwise(1).alias("_f")), [], ["_f", "_h", "id"], index="_i"
    )
    n = h.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * test_size)).alias("_t"))
    is_test = (F.col("_f") == 0) | (F.col("_i") <= F.col("_t"))
    return ranked.join(F.broadcast(n)).select("id", F.when(is_test, "test").otherwise("train").alias("split"))


def stratified_batch(membership: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Distinct ids of a batch: k rows per label by a seeded shuffle, all of them when the label is
    short (drawing with replacement adds no new id)."""
    m = membership.select("id", "label").distinct().withColumn(
        "_h", F.xxhash64(F.col("id").cast("string"), F.col("label").cast("string"), F.lit(seed))
    )
    return ordered.top_k(m, ["label"], [F.asc("_h"), F.asc("id")], k).select("id").distinct()


def random_positive(texts: DataFrame, templates: DataFrame, epoch: int, buckets: int = 1) -> DataFrame:
    """(id, label, template_id): one template of the text's label, drawn anew each epoch. Templates of
    a label are numbered once and each text draws a number, so no pair beyond its own is built."""
    w = Window.partitionBy("label").orderBy("template_id")  # a label's few templates
    numbered = templates.select("label", "template_id").withColumn("_i", F.row_number().over(w) - 1)
    n = templates.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    draw = texts.select("id", "label").join(n, "label").withColumn(
        "_i", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(epoch)), F.col("_n")).cast("int")
    )
    return draw.join(numbered, ["label", "_i"]).select("id", "label", "template_id")


def label_pairs(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """Training pairs: every text with every template of its label (templates are few per label)."""
    return texts.join(templates, "label")


def report_pairs(sequences: DataFrame, mapping: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, misses): sequences joined to their reports by the key map; mapped sequences or reports
    that do not exist are returned as misses."""
    mapped = mapping.join(sequences, ["dep_id", "part_idx"], "left").join(
        reports.withColumn("_r", F.lit(1)), "report_key", "left"
    )
    ok = F.col("text").isNotNull() & F.col("_r").isNotNull()
    return mapped.filter(ok).drop("_r"), mapped.filter(~ok).select("dep_id", "part_idx", "report_key")


def batches(positives: DataFrame, negatives: DataFrame, size: int) -> DataFrame:
    """(batch, id, role): every batch holds all positives and the next slice of negatives. Positives
    are repeated per batch by exploding the batch numbers."""
    neg = ordered.scan(negatives.select("id"), [], ["id"], index="_i").withColumn(
        "batch", F.floor((F.col("_i") - 1) / F.lit(size)).cast("long")
    )
    n = negatives.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.lit(1)).alias("_b"))
    pos = positives.select("id").join(F.broadcast(n)).withColumn(
        "batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1))
    )
    return pos.select("batch", "id", F.lit("positive").alias("role")).unionByName(
        neg.select("batch", "id", F.lit("negative").alias("role"))
    )


def folds(df: DataFrame, file_col: str, files: Sequence[str]) -> DataFrame:
    """Leave-one-file-out folds: each row once per fold, ``split`` says which side it is on."""
    return df.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in files]))).withColumn(
        "split", F.when(F.col(file_col) == F.col("fold"), "test").otherwise("train")
    )
