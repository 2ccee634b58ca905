"""Ordered scans that stay distributed when one key holds a large share of the rows.

A plain window sends a whole key to one task. Here a key with more than ``target_rows`` rows is cut into
slices; windows run inside (key, slice), and a summary with one row per slice of the hot keys carries the
running state across slices.

Hot keys are found by counting a sample of the keys, about 200 rows of a key at the target, so the search
shuffles next to nothing. Only if there are any, the rows are dealt by Spark's range partitioning of (keys,
order) and written: a slice of a hot key is what one of those partitions holds of it. Whatever the values are,
outliers, hashes, a flag in front, slices hold about as many rows each, and no task or row holds the places of
a cut. Where a slice starts does not matter for the result, only for balance. With no hot key the plan is the
plain window. A chain of scans of one order cuts once: :func:`with_slices`, then the functions on
:class:`Sliced` rows, which share one shuffle and one sort. ``spark.provloom.targetRows`` sets the target for
all scans of a session.

Working columns begin with ``__ordered_``; an input that has such a column is refused."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provloom.session import cut_lineage, written

TARGET_ROWS = 1_000_000
SAMPLE_PER_TARGET = 200
#: slices that the rows of one target are dealt to, so that a slice is below the target for sure
SLICES_PER_TARGET = 2
SLICE = "_slice"
OWN = "__ordered_"


@dataclass(frozen=True)
class Sliced:
    """Rows with their slice; ``hot`` says whether any key is cut at all."""

    df: DataFrame
    keys: tuple[str, ...]
    hot: bool

    def with_df(self, df: DataFrame) -> Sliced:
        return replace(self, df=df)

    @property
    def by(self) -> list[str]:
        return [*self.keys, SLICE] if self.hot else list(self.keys)

    def plain(self) -> DataFrame:
        return self.df.drop(SLICE) if self.hot else self.df


def target_of(df: DataFrame, keys: Sequence[str], target_rows: int | None) -> int:
    """Rows of a key above which it is cut."""
    if target_rows is None:
        target_rows = int(df.sparkSession.conf.get("spark.provloom.targetRows", "0"))
    # without keys everything is one key, so smaller pieces keep more than one task busy
    return target_rows or (TARGET_ROWS if keys else TARGET_ROWS // 8)


def _same(keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(prefix + k))
    return cond


def _hot_keys(df: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """Keys above the target with their rows in a sample; at most rows / target keys."""
    share = min(1.0, SAMPLE_PER_TARGET / target)
    sampled = df.select(*keys) if share == 1.0 else df.select(*keys).sample(share, seed=17)
    # half the target in the sample: a key above the target is all but sure to be seen
    limit = target if share == 1.0 else SAMPLE_PER_TARGET // 2
    counts = sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{OWN}n")).filter(F.col(f"{OWN}n") > limit)
    return counts.select(*[F.col(k).alias(f"{OWN}{k}") for k in keys], f"{OWN}n")


def any_hot(df: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> bool:
    """Whether a key is above the target, so that rows should not be dealt by these keys alone."""
    return not _hot_keys(df, keys, target_of(df, keys, target_rows)).isEmpty()


def with_slices(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], target_rows: int | None = None) -> Sliced:
    """Cut the keys above the target: ``_slice`` numbers the slices of ``order``, -1 elsewhere."""
    order = [order] if isinstance(order, str) else list(order)
    if taken := [c for c in df.columns if c.startswith(OWN) or c == SLICE]:
        raise ValueError(f"columns {taken} have names that scans use")
    target = target_of(df, keys, target_rows)
    share = min(1.0, SAMPLE_PER_TARGET / target)
    hot = cut_lineage(_hot_keys(df, keys, target))
    rows = hot.agg(F.sum(f"{OWN}n")).first()[0]
    if rows is None:
        return Sliced(df, tuple(keys), False)
    flag = F.col(f"{OWN}n").isNotNull()
    flagged = df.join(hot, _same(keys, OWN), "left").withColumn(f"{OWN}hot", flag).drop(f"{OWN}n", *[f"{OWN}{k}" for k in keys])
    pieces = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(SLICES_PER_TARGET * rows / share) // target))
    dealt = flagged.repartitionByRange(pieces, f"{OWN}hot", *keys, *order)
    # written, since another run of the plan would draw other bounds
    cut = written(dealt.withColumn(SLICE, F.when(F.col(f"{OWN}hot"), F.spark_partition_id()).otherwise(-1).cast("long")).drop(f"{OWN}hot"))
    return Sliced(cut, tuple(keys), True)


def _attach_carry(out: DataFrame, rows: Sliced, aggs: dict[str, Column], carried: dict) -> DataFrame:
    """Join to each row what the other slices of its key say (null for keys in one piece)."""
    keys = list(rows.keys)
    per_slice = rows.df.filter(F.col(SLICE) >= 0).groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in aggs.items()])
    w = Window.partitionBy(*keys).orderBy(SLICE)
    right = cut_lineage(
        per_slice.select(
            *[F.col(k).alias(f"{OWN}{k}") for k in keys], F.col(SLICE).alias(f"{OWN}slice"), *[c(w).alias(n) for n, c in carried.items()]
        )
    )
    cond = _same(keys, OWN) & (F.col(SLICE) == F.col(f"{OWN}slice"))
    return out.join(right, cond, "left").drop(f"{OWN}slice", *[f"{OWN}{k}" for k in keys])


def _before(column: str, combine: Callable[[Column], Column]):
    return lambda w: combine(F.col(column)).over(w.rowsBetween(Window.unboundedPreceding, -1))


def scan_sliced(
    rows: Sliced,
    order: Sequence[str],
    *,
    index: str | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    first: dict[str, str] | None = None,
) -> Sliced:
    """As :func:`scan` on sliced rows; the result keeps the slices, and with them the partitioning."""
    order, lag, lead, first = list(order), lag or {}, lead or {}, first or {}
    w = Window.partitionBy(*rows.by).orderBy(*order)
    new = {name: F.lag(source).over(w) for name, source in lag.items()}
    new |= {name: F.lead(source).over(w) for name, source in lead.items()}
    new |= {name: F.first(source).over(w) for name, source in first.items()}
    if not rows.hot:
        if index:
            new[index] = F.row_number().over(w).cast("long")
        return rows.with_df(rows.df.withColumns(new))
    rn, size, earlier = f"{OWN}rn", f"{OWN}size", f"{OWN}earlier"
    new[rn] = F.row_number().over(w).cast("long")
    at = F.struct(*[F.col(c) for c in order])
    aggs: dict[str, Column] = {f"{OWN}m": F.count(F.lit(1))}
    carried = {earlier: _before(f"{OWN}m", F.sum), size: lambda w: F.col(f"{OWN}m")}
    for name, source in lag.items():
        aggs[f"{OWN}last_{name}"] = F.max_by(F.struct(F.col(source).alias("v")), at)
        carried[f"{OWN}lag_{name}"] = lambda w, n=name: F.lag(f"{OWN}last_{n}").over(w)
    for name, source in {**lead, **first}.items():
        aggs[f"{OWN}head_{name}"] = F.min_by(F.struct(F.col(source).alias("v")), at)
    for name in lead:
        carried[f"{OWN}lead_{name}"] = lambda w, n=name: F.lead(f"{OWN}head_{n}").over(w)
    for name in first:
        carried[f"{OWN}first_{name}"] = lambda w, n=name: F.first(f"{OWN}head_{n}").over(w)
    out = _attach_carry(rows.df.withColumns(new), rows, aggs, carried)
    final = {}
    for how, names, here in (("lag", lag, F.col(rn) == 1), ("lead", lead, F.col(rn) == F.col(size)), ("first", first, F.lit(True))):
        for name in names:
            other = F.col(f"{OWN}{how}_{name}")
            final[name] = F.when(here & other.isNotNull(), other["v"]).otherwise(F.col(name))
    if index:
        final[index] = F.col(rn) + F.coalesce(F.col(earlier), F.lit(0))
    return rows.with_df(out.withColumns(final).drop(rn, *carried))


def number_rows(df: DataFrame, order: Sequence[str], index: str) -> DataFrame:
    """A 1-based number over all rows in a total ``order``: one range partitioning, sorted and written, and a sum over
    the sizes of the partitions."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{OWN}at", F.monotonically_increasing_id()))
    part, within = F.shiftright(f"{OWN}at", 33), F.col(f"{OWN}at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias(f"{OWN}part")).agg(F.count(F.lit(1)).alias(f"{OWN}n"))  # a row per partition
    total = F.sum(f"{OWN}n").over(Window.orderBy(f"{OWN}part").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut_lineage(sizes.select(f"{OWN}part", F.coalesce(total, F.lit(0)).alias(f"{OWN}n")))  # counted once for all readers
    out = placed.withColumn(f"{OWN}p", part).join(F.broadcast(starts), F.col(f"{OWN}p") == F.col(f"{OWN}part"))
    return out.withColumn(index, within + F.col(f"{OWN}n") + 1).drop(f"{OWN}p", f"{OWN}part", f"{OWN}n", f"{OWN}at")


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, target_rows: int | None = None, **wanted) -> DataFrame:
    """Per key in ``order``: a 1-based row number (``index``), values of the row before (``lag``), of the next one
    (``lead``) and of the first row (``first``); the last three map an output column to its source column.

    ``order`` must be total."""
    if not keys and list(wanted) == ["index"]:
        return number_rows(df, list(order), wanted["index"])
    return scan_sliced(with_slices(df, keys, order, target_rows), order, **wanted).plain()


def running_sliced(rows: Sliced, order: Sequence[str], value: str, out: str, how: str = "sum") -> Sliced:
    """Inclusive running sum or max of a long ``value``."""
    combine = {"sum": F.sum, "max": F.max}[how]
    w = Window.partitionBy(*rows.by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.df.withColumn(out, combine(value).over(w).cast("long"))
    if rows.hot:
        held = f"{OWN}m"
        total = _attach_carry(total, rows, {held: combine(F.col(value))}, {f"{OWN}earlier": _before(held, combine)})
        earlier = F.col(f"{OWN}earlier")
        both = F.col(out) + F.coalesce(earlier, F.lit(0)) if how == "sum" else F.greatest(out, earlier)  # null does not count
        total = total.withColumn(out, both.cast("long")).drop(f"{OWN}earlier")
    return rows.with_df(total)


def running_sum_sliced(rows: Sliced, order: Sequence[str], value: str, out: str) -> Sliced:
    return running_sliced(rows, order, value, out)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, target_rows: int | None = None
) -> DataFrame:
    """Inclusive running total of ``value`` per key."""
    return running_sum_sliced(with_slices(df, keys, order, target_rows), order, value, out).plain()


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    theta: int,
    out: str = "segment",
    strict: bool = False,
    target_rows: int | None = None,
) -> DataFrame:
    """0-based session per key: a new one starts where the gap reaches ``theta`` (``strict``: exceeds
    it). Also leaves ``prev_ts``. ``session_window`` would merge a gap of exactly theta."""
    ts = order[0]
    gap = F.col(ts) - F.col("prev_ts")
    rows = scan_sliced(with_slices(df, keys, order, target_rows), order, lag={"prev_ts": ts})
    flagged = rows.with_df(
        rows.df.withColumn("_new", F.when(gap > theta if strict else gap >= theta, 1).otherwise(0))
    )
    return running_sum_sliced(flagged, order, "_new", out).plain().drop("_new")


def sorted_stream(rows: Sliced, order: Sequence[str]) -> DataFrame:
    """Rows of a (key, slice) together and in order, for a ``mapInPandas`` that folds batch after
    batch. One Python call serves many small groups, and a long one streams through in batches."""
    return rows.df.repartition(*rows.by).sortWithinPartitions(*rows.by, *order)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank. Spark puts a group limit below the shuffle, so at
    most ``k`` rows per key and map task travel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(w))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.col(rank).cast("long"))
    )
