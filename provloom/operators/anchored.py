"""Anchored greedy windows: a window opens at its first event (the anchor) and takes every event up
to ``width`` after it, inclusive; the next event opens the next window.

Exact and distributed: a gap above the width always opens a window, so the series is first cut into
runs there. Most runs span at most one width and need no fold. The others are folded slice by slice;
when a run is cut into slices, each slice first reports where it would end for every anchor that may
still be open at its start (a short step function), those are chained per run, and then every slice
is folded on its own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provloom.operators import ordered
from provloom.session import cut_lineage


def end_steps(ts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, last): when the open window ends before event time ``upper`` (and not before the
    previous step's), the slice leaves the anchor ``last`` open."""
    t = np.unique(ts)
    n = len(t)
    nxt = np.searchsorted(t, t + width, side="right")
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    entries = min(n, int(np.searchsorted(t, t[0] + width, side="right")) + 1)
    ends = t[last[:entries]]
    keep = np.append(ends[1:] != ends[:-1], True)
    return t[:entries][keep], ends[keep]


def anchored_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: int,
    out: str = "anchor",
    target_rows: int | None = None,
) -> DataFrame:
    """Add the anchor time of each row's window per key."""
    keys, ts = list(keys), order[0]
    runs = ordered.gap_sessions(df, keys, order, width, out="_run", strict=True, target_rows=target_rows)
    rk = [*keys, "_run"]
    span = runs.groupBy(*rk).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    # one row per run; the join shuffles on the run, which a hot key has many of
    marked = runs.join(span, rk)
    cols = [*df.columns, out]
    short = marked.filter(F.col("_hi") - F.col("_lo") <= width).withColumn(out, F.col("_lo")).select(*cols)
    long_ = marked.filter(F.col("_hi") - F.col("_lo") > width).select(*df.columns, "_run")
    rows = ordered.with_slices(long_, rk, order, target_rows)
    if rows.hot:
        rows = rows.with_df(
            rows.df.join(_open_anchors(rows, rk, ts, width), [*rk, ordered.SLICE], "left")
        )
    else:
        rows = rows.with_df(rows.df.withColumn("_open", F.lit(None).cast("long")))
    by = rows.by

    def assign(batches):
        key = anchor = None
        for pdf in batches:
            anchors = []
            for k, t, o in zip(zip(*(pdf[c] for c in by)), pdf[ts], pdf["_open"]):
                if k != key:
                    key, anchor = k, None if pd.isna(o) else int(o)
                if anchor is None or t > anchor + width:
                    anchor = t
                anchors.append(anchor)
            yield pdf[df_columns].assign(**{out: anchors})

    df_columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    folded = ordered.sorted_stream(rows, order).mapInPandas(assign, schema)
    return short.unionByName(folded)


def _open_anchors(rows: ordered.Sliced, rk: list[str], ts: str, width: int) -> DataFrame:
    """(run, slice, _open): the anchor still open when a slice of a cut run starts."""
    sl = ordered.SLICE
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.df.select(*rk, sl).schema)
    times = rows.df.filter(F.col(sl) >= 0).select(*rk, sl, F.col(ts).cast("long").alias("_t")).distinct()

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        upper, last = end_steps(np.sort(pdf["_t"].to_numpy()), width)
        res = pd.concat([pdf[[*rk, sl]].iloc[:1]] * len(upper), ignore_index=True)
        return res.assign(_upper=upper, _last=last)

    table = times.groupBy(*rk, sl).applyInPandas(steps, schema + ", _upper long, _last long")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        found, anchor = [], None
        for s, part in pdf.sort_values([sl, "_upper"]).groupby(sl, sort=True):
            if anchor is not None:
                found.append((s, anchor))
            hit = part if anchor is None else part[part["_upper"] > anchor + width]
            if len(hit):
                anchor = int(hit["_last"].iloc[0])
            # otherwise the open window swallows the whole slice
        res = pd.DataFrame(found, columns=[sl, "_open"])
        for c in rk:
            res[c] = pdf[c].iloc[0]
        return res[[*rk, sl, "_open"]]

    # rows here: slices of cut runs times the few steps each has
    return cut_lineage(table.groupBy(*rk).applyInPandas(chain, schema + ", _open long"))
