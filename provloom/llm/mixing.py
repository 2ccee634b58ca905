"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over the training time 0..1, a straight line through its weight at
half time. The integral of the schedule, scaled to the source's target, is the number of words that the
mix has asked of the source up to a time. Documents of a source stand in a fixed pseudo-random order;
the running total of their words, put through the inverse of that integral, is their training position,
and documents are range-sorted by position.

A source whose target is above its size is read again from the start, at most ``passes`` times.

Defined results: a null text has size 0 and takes nothing, a null source is a source of its own and the
last one, repeated rows are rows of their own, an empty table gives no rows. Only the named columns are
read, so that any other columns may be there. Sources are numbered in one window over one row per source;
documents are never gathered: running totals go per slice of the order, slices hold ``slice_rows`` rows
about, and a hot source has many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provloom.llm.shared import word_count, written

#: documents whose readings may be broadcast, about 60 bytes each
BROADCAST_ROWS = 1_000_000
#: bits of the pseudo-random order key
ORDER_BITS = 60


def measured(docs: DataFrame) -> DataFrame:
    """Row id, source key, size and order key of every document. ``sk`` is never null."""
    return docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("sk"),
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10)
        .cast("long").alias("place"),
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...], slopes: tuple[float, ...], share: float, passes: int) -> DataFrame:
    """Target of every source: ``share`` of all words by weight, at most ``passes`` times its own size,
    the excess shared again by weight. Closed form: in the order of (most words / weight) the sources that
    stop at their most come first, so the level per weight follows from two running totals."""
    by_name = Window.orderBy(F.col("sk").startswith("n"), "sk")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sk")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    n = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    s = sized.groupBy("sk").agg(F.sum("size").alias("source_size"))
    s = s.select("*", pick(weights).alias("weight"), pick(slopes).alias("slope"))
    s = s.select(
        "*", F.row_number().over(by_ratio).alias("turn"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("all_size"), F.sum("weight").over(everything).alias("all_weight"),
    )
    s = s.withColumn(
        "level", (share * F.col("all_size") - passes * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before")).cast("double")
    )
    open_level = F.when(F.col("level") * F.col("weight") < passes * F.col("source_size"), F.col("level"))
    s = s.withColumn("lambda", F.min_by(open_level, F.when(open_level.isNotNull(), F.col("turn"))).over(everything))
    most = (passes * F.col("source_size")).cast("double")
    return s.select(
        "sk", "source_size", "slope", F.least(most, F.coalesce(F.col("lambda") * F.col("weight"), most)).alias("target")
    )


def position(done, target, slope) -> F.Column:
    """Training time at which the source has been asked for ``done`` words: the inverse of
    ``target * ((1 - slope) * t + slope * t * t)``."""
    u = done / target
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope)
    return F.round(F.when(slope == 0, u).otherwise(root), 6)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), slopes: tuple[float, ...] = (0.5, 0.0, -0.5), share: float = 1.5,
    passes: int = 2, slice_rows: int = 4_000,
) -> DataFrame:
    """One row per document: size, source_size, target, taken (words, all passes) and the training
    positions of its first and second reading (null where it is not read)."""
    sized = written(measured(docs), "mix-sizes")
    bits = max(0, (sized.count() // slice_rows).bit_length())
    sized = sized.withColumn("slice", F.shiftright("place", ORDER_BITS - bits))
    ordered = Window.partitionBy("sk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sized.groupBy("sk", "slice").agg(F.sum("size").alias("n"))
        .select("sk", "slice", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("start"))
        .join(source_targets(sized, weights, slopes, share, passes), "sk")
    )
    inside = Window.partitionBy("sk", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = sized.join(starts, ["sk", "slice"]).withColumn(
        "before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    goal = F.floor("target").cast("long")
    of_pass = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), goal - k * F.col("source_size") - F.col("before")))
    taken = sum((of_pass(k) for k in range(1, passes)), of_pass(0))
    at = lambda k: F.when(
        of_pass(k) > 0, position(k * F.col("source_size") + F.col("before") + of_pass(k) / 2, F.col("target"), F.col("slope"))
    )
    return d.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), at(0).alias("position"), at(1).alias("position_again")
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents that are not read come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order, one row per reading. A document is read whole or not at
    all: the one that a source's target cuts is read when at least half of it is wanted."""
    mixed = written(mix(docs, **options), "mix-readings")
    repeated = mixed.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    readings = mixed.select(
        F.col("doc_id").alias("id"), F.round(F.try_divide("taken", "size")).cast("int").alias("copies"),
        F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "position")).alias("mth"),
        F.array("position", "position_again").alias("positions"),
    ).where("copies > 0")
    same_id = F.col("doc_id").eqNullSafe(F.col("id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    once = readings.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_anti").drop("mth")
    few = mixed.count() <= BROADCAST_ROWS  # else the texts are shuffled for the join
    joined = rows.join(F.broadcast(once) if few else once, same_id).select("row", "doc_id", "copies", "positions")
    if not repeated.isEmpty():  # rows that share an id meet their readings in order
        own = Window.partitionBy("doc_id").orderBy("size", "source_key", "text_key")
        keyed = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi").select(
            "row", "doc_id", word_count(F.col("text")).alias("size"), F.coalesce("source", F.lit("")).alias("source_key"), F.xxhash64("text").alias("text_key"),
        ).select("row", "doc_id", F.row_number().over(own).alias("nth"))
        more = keyed.join(readings, same_id & (F.col("nth") == F.col("mth")))
        joined = joined.union(more.select("row", "doc_id", "copies", "positions"))
    out = joined.select("row", "doc_id", F.explode(F.slice("positions", F.lit(1), F.col("copies"))).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("row.*")


SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][n % 3 + 1] AS weight, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][n % 3 + 1] AS slope FROM named),
run AS (SELECT *, row_number() OVER w AS turn, coalesce(sum(source_size) OVER b, 0) AS size_before, coalesce(sum(weight) OVER b, 0) AS weight_before,
    sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM weighed
    WINDOW w AS (ORDER BY source_size / weight, source NULLS FIRST),
    b AS (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5::DOUBLE * all_size::DOUBLE - 2 * size_before::DOUBLE) / (all_weight - weight_before)::DOUBLE AS level FROM run),
chosen AS (SELECT min_by(level, turn) AS lam FROM levels WHERE level * weight < 2 * source_size),
targets AS (SELECT source, source_size, slope, least(2.0::DOUBLE * source_size, coalesce(lam * weight, 2.0::DOUBLE * source_size)) AS target FROM levels, chosen),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, greatest(0, least(size, goal - before)) AS a, greatest(0, least(size, goal - source_size - before)) AS b FROM placed),
done AS (SELECT *, (before + a / 2) / target AS u, (source_size + before + b / 2) / target AS v FROM passes)
SELECT doc_id, size, source_size, target, CAST(a + b AS BIGINT) AS taken,
    CASE WHEN a > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 6) END AS position,
    CASE WHEN b > 0 THEN round(CASE WHEN slope = 0 THEN v ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * v) - (1 - slope)) / (2 * slope) END, 6) END AS position_again
FROM done
"""
