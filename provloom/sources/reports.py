"""Text folders: reports, templates, sequence documents and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.functions import text as tx

VARIANT = "_abstracted"


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(key, text) of the non-hidden, non-empty ``.txt`` files of a folder."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return keyed_texts(raw.select(F.col("_metadata.file_name").alias("file_name"), "value"))


def keyed_texts(files: DataFrame) -> DataFrame:
    name = F.col("file_name")
    return (
        files.filter(name.endswith(".txt") & ~name.startswith("."))
        .select(F.regexp_replace(name, r"\.txt$", "").alias("key"), F.trim("value").alias("text"))
        .filter("text <> ''")
    )


def prefer_variant(texts: DataFrame, suffix: str = VARIANT) -> DataFrame:
    """The abstracted variant of a text where there is one, else the raw one."""
    stem = F.when(F.col("key").endswith(suffix), F.expr(f"substring(key, 1, length(key) - {len(suffix)})")).otherwise(F.col("key"))
    is_raw = F.when(F.col("key").endswith(suffix), 0).otherwise(1)
    rest = [c for c in texts.columns]
    return (
        texts.groupBy(stem.alias("stem"))
        .agg(F.min_by(F.struct(*rest), is_raw).alias("v"))
        .select("stem", "v.*")
    )


def label_templates(files: DataFrame, labels: DataFrame, focus: str | None = None) -> DataFrame:
    """Templates with the label whose id or name their file name holds (first of the label list).
    ``labels``: label, tactic_id, pos (a fixed list of tactics). ``focus`` is None, 'sections' or
    'linux' and picks the part of the text."""
    low = F.lower("key")
    hit = F.col("key").contains(F.col("tactic_id")) | low.contains(F.lower("label"))
    j = files.join(F.broadcast(labels), hit)
    first = j.groupBy("key").agg(
        F.min_by(F.struct("label", "text"), "pos").alias("v")
    ).select("key", "v.label", "v.text")
    body = {None: F.col("text"), "sections": tx.template_focus(F.col("text")), "linux": tx.linux_section(F.col("text"))}[focus]
    return first.withColumn("text", body).withColumn("is_augmented", F.col("key").rlike(r"_aug\d*$"))


def originals(templates: DataFrame) -> DataFrame:
    return templates.filter("not is_augmented")


SEQUENCE_SCHEMA = (
    "tactic string, technique string, step string, host string, n_triples bigint, sequence array<string>, attack string, "
    "mitre string, date string, filter string, window_start string, window_end string"
)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequence documents with the folder (tactic) and file they come from."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        .schema(SEQUENCE_SCHEMA).json(path, multiLine=True)
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("file_name", F.col("_metadata.file_name"))
        .withColumn("folder", F.element_at(F.split("path", "/"), -3))
    )


def first_per_step(sequences: DataFrame, folders: list[str], min_events: int | None = 3) -> DataFrame:
    """One sequence per step: the first by folder order, then path; ``dropped`` marks those with too
    few events (a drop report needs them)."""
    rank = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder"))
    rest = [c for c in sequences.columns if c != "step"]
    one = (
        sequences.withColumn("_r", rank)
        .filter("_r > 0")
        .groupBy("step")
        .agg(F.min_by(F.struct(*rest), F.struct("_r", "path")).alias("v"))
        .select("step", "v.*")
    )
    n = F.size("sequence")
    return one.withColumn("n_events", n.cast("long")).withColumn(
        "dropped", F.lit(False) if min_events is None else n < min_events
    )


def file_split(sequences: DataFrame, test_file: str) -> DataFrame:
    """Tactic sequences: label from the tactic name, the named file is the test set; documents
    without a tactic and the combined file are left out."""
    return (
        sequences.filter(F.col("file_name") != "sequences_tactics_all.json")
        .withColumn("label", tx.tactic_label(F.col("tactic")))
        .filter(F.coalesce("label", F.lit("")) != "")
        .withColumn("text", F.array_join("sequence", " "))
        .withColumn("split", F.when(F.col("file_name") == test_file, "test").otherwise("train"))
    )


def read_step_tactics(spark: SparkSession, path: str) -> DataFrame:
    """(step, label) of a step report: array of {step, occurrences: [{technique, tactics}]}."""
    rows = spark.read.schema(
        "step string, occurrences array<struct<technique:string,tactics:array<string>>>"
    ).json(path, multiLine=True)
    return rows.select("step", F.explode("occurrences").alias("o")).select("step", F.explode("o.tactics").alias("label")).distinct()


def run_metrics(text: Column) -> dict[str, Column]:
    """Metrics of a training run log, by pattern."""
    def num(rx: str, c: Column = text) -> Column:
        return F.nullif(F.regexp_extract(c, rx, 1), F.lit("")).try_cast("double")

    losses = F.transform(F.regexp_extract_all(text, F.lit(r"Ep=\d+\s+Loss=([\d.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    stage = F.when(text.contains("Stage 7"), F.get(F.split(text, "Stage 7"), F.lit(1))).otherwise(text)
    row = r"([\w_]+\.json)\s+([\w_]+)\s+([+\-][\d.]+)\s+([\w_]+)\s+([+\-][\d.]+)"

    def cell(i: int) -> Column:
        return F.nullif(F.regexp_extract(stage, row, i), F.lit(""))

    line = F.regexp_extract(stage, r"All scores: (.+)", 1)
    names = F.regexp_extract_all(line, F.lit(r"(\w+)=[+\-][\d.]+"), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(r"\w+=([+\-][\d.]+)"), F.lit(1))
    pairs = F.transform(
        F.arrays_zip(names.alias("n"), values.alias("v")),
        lambda p, i: F.struct((-p["v"].cast("double")).alias("s"), i.alias("i"), p["n"].alias("label"), p["v"].cast("double").alias("v")),
    )
    others = F.filter(F.array_sort(pairs), lambda p: p["label"] != F.coalesce(cell(4), F.lit("")))
    return {
        "loss_ep1": num(r"Ep=1\s+Loss=([\d.]+)"),
        "loss_best": F.array_min(losses),
        "true_label": cell(2),
        "true_score": cell(3).try_cast("double"),
        "top1": cell(4),
        "top1_score": cell(5).try_cast("double"),
        "top2": F.get(others, F.lit(0))["label"],
        "top2_score": F.get(others, F.lit(0))["v"],
        "top3": F.get(others, F.lit(1))["label"],
        "top3_score": F.get(others, F.lit(1))["v"],
        "correct": text.contains("Accuracy: 1/1"),
    }
