"""Run reports: ranking and explaining reports per sequence, and report texts as numbered lines.

A report is a table first; its text is the long table (keys, line_no, line), so that a report of any length is built
and written by many tasks. :func:`write_lines` writes it as text files in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators import ordered, score
from provloom.session import cut_lineage
from provloom.sources import lines

RULE = 100


def ranked_reports(rows: DataFrame, columns: DataFrame, top: int = 2, pool: int = 10, pairs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(ranking, explanations). ``rows`` (id, pos, text, v) are the sentences of the sequences, ``columns`` (ref, pos, text, v)
    those of the reports. Every report is ranked for every sequence by its late-interaction score, compared to 6 places,
    ties by key; only the ``top`` reports of a sequence are explained by their best sentence pairs.

    ranking: id, ref, score, rank. explanations: id, ref, report_rank, rank, row_text, ref_text, score."""
    scored = score.late_interaction(rows, columns).withColumn("_worst", -F.round("score", 6))
    ranking = cut_lineage(ordered.scan(cut_lineage(scored), ["id"], ["_worst", "ref"], index="rank").drop("_worst"))
    best = ranking.filter(F.col("rank") <= top).select("id", "ref", F.col("rank").alias("report_rank"))
    found = score.best_sentence_pairs(rows, columns, best, pool, pairs, digits=9)
    return ranking, found.join(best, ["id", "ref"]).select("id", "ref", "report_rank", "rank", "row_text", "ref_text", "score")


def _numbered(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Parts with (keys, order columns o1.., text) as one text per key; a text of several lines is one line."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = sorted(c for c in every.columns if c.startswith("_o"))
    flat = every.withColumn("line", F.regexp_replace("line", r"[\r\n]+", " "))
    return ordered.scan(flat, keys, order, index="line_no").select(*keys, "line_no", "line")


def _part(df: DataFrame, keys: Sequence[str], at: Sequence[Column | int], line: Column) -> DataFrame:
    at = [a if isinstance(a, Column) else F.lit(a) for a in at]
    return df.select(*keys, *[a.cast("long").alias(f"_o{i}") for i, a in enumerate(at)], line.alias("line"))


def match_report(ranking: DataFrame, explanations: DataFrame) -> DataFrame:
    """(id, line_no, line): per sequence its key, all reports with their scores, and the explained ones."""
    keys = ["id"]
    rank, report = F.col("rank"), F.col("report_rank")
    head = _part(ranking.select("id").distinct(), keys, (0, 0, 0, 0), F.format_string("    %s", F.col("id").cast("string")))
    scores = _part(ranking, keys, (1, rank, 0, 0), F.format_string("      %-40s %.4f", F.col("ref").cast("string"), F.col("score")))
    titles = explanations.select("id", "ref", "report_rank").distinct()
    titles = _part(titles, keys, (2, report, 0, 0), F.format_string("    Top matching sentences for [%s]:", F.col("ref").cast("string")))
    told = [
        ("      [%s] Score : %.4f", [rank.cast("string"), F.col("score")]),
        ("          LOG : %s", [F.col("row_text")]),
        ("          CTI : %s", [F.col("ref_text")]),
    ]
    found = [_part(explanations, keys, (2, report, rank, i + 1), F.format_string(f, *args)) for i, (f, args) in enumerate(told)]
    return _numbered([head, scores, titles, *found], keys)


def reduction_report(deduped: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """(keys, line_no, line): per sequence the counts, the kept sentences and the removed ones with what they match."""
    keys = list(keys)
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    n = deduped.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"), F.count_if("kept").alias("after"))
    gone = F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 1)
    head = [
        F.lit("=" * RULE), F.format_string("  Sequence: %s   Threshold: %s", name, F.lit(str(threshold))),
        F.format_string("  Before : %d sentences", F.col("before")), F.format_string("  After  : %d sentences  (%.1f%% removed)", F.col("after"), gone),
        F.lit("-" * RULE), F.lit("  KEPT SENTENCES:"),
    ]
    parts = [_part(n, keys, (0, i, 0), line) for i, line in enumerate(head)]
    parts.append(_part(n, keys, (2, 0, 0), F.lit("  REMOVED SENTENCES  (removed, matched kept sentence, similarity):")))
    at = ordered.scan(deduped, [*keys, "kept"], ["pos"], index="_i")
    kept, removed = at.filter("kept"), at.filter("NOT kept")
    parts.append(_part(kept, keys, (1, F.col("_i"), 0), F.format_string("    %4d. %s", F.col("_i"), F.col("text"))))
    parts.append(_part(removed, keys, (3, F.col("_i"), 0), F.format_string("    %4d.  REMOVED : %s", F.col("_i"), F.col("text"))))
    parts.append(_part(removed, keys, (3, F.col("_i"), 1), F.format_string("           MATCHED : %s  (sim=%s)", F.col("matched"), F.col("similarity").cast("string"))))
    return _numbered(parts, keys)


def evaluation_report(scores: DataFrame) -> DataFrame:
    """(name, line_no, line): one block per checkpoint of (name, metric, value), metrics in order."""
    head = _part(scores.select("name").distinct(), ["name"], (0, 0), F.format_string("  === %s ===", F.col("name")))
    rank = ordered.scan(scores, ["name"], ["metric"], index="_i")
    body = _part(rank, ["name"], (1, F.col("_i")), F.format_string("    %-30s %.4f", F.col("metric"), F.col("value")))
    return _numbered([head, body], ["name"])


def write_lines(report: DataFrame, keys: Sequence[str], path: str) -> None:
    """The report's lines as text files whose order is that of the keys."""
    order = [*keys, "line_no"]
    report.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a written report, numbered over all its files."""
    read = lines.read_lines(spark, path)
    return ordered.scan(read, [], ["file_key", "line_no"], index="_n").select(F.col("_n").alias("line_no"), F.col("value").alias("line"))
