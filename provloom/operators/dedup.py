"""Greedy near-duplicate removal inside sequences.

A sentence stays iff its ratio to every sentence kept before it is below the threshold. Exact copies
are collapsed first (a copy of a kept sentence goes, a copy of a removed one goes too, so the kept
list is unchanged) with a partial aggregate. A sequence with at most ``block`` distinct sentences is
folded in one task: a kept sentence is compared with all that are left at once, on arrays, bounded by
lengths and character counts before their longest common subsequences are counted. Longer sequences go
round by round: the first ``block`` sentences left are folded, then the later ones, dealt to as many tasks
as their number asks for, are compared with what that round kept. What is left is unlike all that was kept, so
rounds follow the number of kept sentences, not that of all. No pair is ever written out and no task holds
more than a block and its share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.functions.similarity import Texts, ratio
from provloom.operators import ordered
from provloom.session import cut_lineage, no_rows, own_columns

THRESHOLD = 0.7


def deduplicate(
    sents: DataFrame,
    keys: Sequence[str],
    threshold: float = THRESHOLD,
    block: int = 5_000,
    share: int = 10_000,
) -> DataFrame:
    """(keys, pos, text, kept, matched, similarity) for every sentence of ``sents`` (keys, pos, text). ``share``: sentences
    that one task compares with the kept ones of a round."""
    keys = list(keys)
    distinct = sents.groupBy(*keys, "text").agg(F.min("pos").alias("pos"))
    kt = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sents.select(*keys).schema)
    schema = f"{kt}, pos long, text string, matched string, similarity double"
    columns = [*keys, "pos", "text", "matched", "similarity"]

    def answered(rows: pd.DataFrame, texts: list[str], match: np.ndarray) -> pd.DataFrame:
        """``rows`` with what they match; ``match`` numbers ``texts``."""
        hits = [None if m < 0 else texts[m] for m in match.tolist()]
        sims = [None if h is None else round(ratio(t, h), 3) for t, h in zip(rows["text"], hits, strict=True)]
        return rows.assign(matched=pd.Series(hits, index=rows.index, dtype=object), similarity=pd.array(sims, dtype="float64"))[columns]

    def fold(batches):
        """Groups one after the other, in order; a group may go on in the next batch."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            here, before = pdf[keys].iloc[1:].to_numpy(dtype=object), pdf[keys].iloc[:-1].to_numpy(dtype=object)
            differs = (here != before) & ~(pd.isna(here) & pd.isna(before))
            first = np.flatnonzero(np.append(True, differs.any(1)))
            for a, z in zip(first[:-1], first[1:], strict=True):
                yield one(pdf.iloc[a:z])
            rest = pdf.iloc[first[-1] :]
        if rest is not None and len(rest):
            yield one(rest)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows["text"].tolist()
        return answered(rows, texts, Texts(texts).first_matches(threshold))

    def folded(rows: DataFrame) -> DataFrame:
        whole = ordered.Sliced(rows.select(*keys, "pos", "text"), tuple(keys), False)
        return ordered.sorted_stream(whole, ["pos"]).mapInPandas(fold, schema)

    sizes = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long_keys = cut_lineage(sizes.filter(F.col("_n") > block).select(*keys))
    if long_keys.isEmpty():
        done = folded(distinct)
    else:
        done = folded(distinct.join(long_keys, keys, "left_anti"))
        left = cut_lineage(distinct.join(long_keys, keys, "left_semi").select(*keys, "pos", "text"))
        while not left.isEmpty():
            # where the front block of each sequence ends
            front_rows = cut_lineage(ordered.scan(left, keys, ["pos"], index="i"))
            front = cut_lineage(folded(front_rows.filter(F.col("i") <= block)))
            done = done.unionByName(front)
            shares = front_rows.groupBy(*keys).agg(F.ceil((F.max("i") - block) / share).cast("int").alias("_shares")).filter("_shares > 0")
            later = (
                front_rows.filter(F.col("i") > block)
                .join(shares, keys)
                .select(*keys, "pos", "text", F.pmod(F.xxhash64("pos"), F.col("_shares")).cast("int").alias("_share"))
            )
            kept = (
                front.filter(F.col("matched").isNull())
                .join(shares, keys)
                .select(*keys, "pos", "text", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
            )

            def against(lp: pd.DataFrame, kp: pd.DataFrame) -> pd.DataFrame:
                if not len(lp):
                    return no_rows(*columns)
                texts = [*kp.sort_values("pos")["text"], *lp["text"]]
                match = Texts(texts).first_matches(threshold, len(kp))
                return answered(lp, texts, match[len(kp) :])

            checked = cut_lineage(
                own_columns(later).groupBy(*keys, "_share")
                .cogroup(own_columns(kept).groupBy(*keys, "_share"))
                .applyInPandas(against, schema)
            )
            done = done.unionByName(checked.filter(F.col("matched").isNotNull()))
            left = checked.filter(F.col("matched").isNull()).select(*keys, "pos", "text")

    firsts = done.select(*keys, "text", F.col("pos").alias("_first"), "matched", "similarity")
    joined = sents.select(*keys, "pos", "text").join(firsts, [*keys, "text"])
    is_first = F.col("pos") == F.col("_first")
    kept_here = is_first & F.col("matched").isNull()
    return joined.select(
        *keys,
        "pos",
        "text",
        kept_here.alias("kept"),
        # a copy of a kept sentence matches it with ratio 1; a copy of a removed one its match
        F.when(~kept_here, F.coalesce("matched", "text")).alias("matched"),
        F.when(~kept_here, F.coalesce(F.col("similarity"), F.lit(1.0))).alias("similarity"),
    )


def reduction(deduped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sentences before and after per key, with a TOTAL row (null keys)."""
    return (
        deduped.rollup(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_before"),
            F.sum(F.col("kept").cast("long")).alias("n_after"),
        )
        .withColumn("pct", F.round(100.0 * (F.col("n_before") - F.col("n_after")) / F.col("n_before"), 1))
    )
