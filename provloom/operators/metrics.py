"""Ranking metrics and losses over score tables (id, label, score[, truth])."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provloom.functions import vectors as vec
from provloom.operators import ordered
from provloom.session import cut_lineage, no_rows, own_columns


def truth_table(scores: DataFrame, membership: DataFrame) -> DataFrame:
    """Add ``truth`` (0/1): whether (id, label) is in the membership."""
    m = membership.select("id", "label").distinct().withColumn("_t", F.lit(1))
    return scores.join(m, ["id", "label"], "left").withColumn("truth", F.coalesce("_t", F.lit(0))).drop("_t")


def label_matrix(ids: DataFrame, labels: DataFrame, membership: DataFrame) -> DataFrame:
    """Long 0/1 matrix with every label present for every id; the labels are one array value."""
    names = labels.select("label").distinct().agg(F.sort_array(F.collect_list("label")).alias("_labels"))
    dense = ids.select("id").join(names).select("id", F.explode("_labels").alias("label"))
    return truth_table(dense, membership)


def lrap_rows(scored: DataFrame) -> DataFrame:
    """(id, lrap): rank of a score = number of scores at least as large; texts with no or only true
    labels count 1."""
    all_ = Window.partitionBy("id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)  # labels of a text
    r = scored.withColumn("_rank", F.count(F.lit(1)).over(all_)).withColumn("_above", F.sum("truth").over(all_))
    per = r.groupBy("id").agg(
        F.sum("truth").alias("_k"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.col("truth") == 1, F.col("_above") / F.col("_rank"))).alias("_v"),
    )
    plain = (F.col("_k") == 0) | (F.col("_k") == F.col("_n"))
    return per.select("id", F.when(plain, F.lit(1.0)).otherwise(F.col("_v")).alias("lrap"))


def lrap(scored: DataFrame) -> DataFrame:
    return lrap_rows(scored).agg(F.coalesce(F.avg("lrap"), F.lit(0.0)).alias("lrap"))


def average_precision(scored: DataFrame, target_rows: int | None = None) -> DataFrame:
    """(label, ap) for labels with a positive: precision times recall step over the distinct
    thresholds. Rows collapse to thresholds before the running totals, which are sliced."""
    th = scored.groupBy("label", "score").agg(F.sum("truth").alias("tp"), F.count(F.lit(1)).alias("n"))
    th = th.withColumn("_o", -F.col("score"))
    rows = ordered.with_slices(th, ["label"], ["_o"], target_rows)
    run = ordered.running_sum_sliced(rows, ["_o"], "tp", "ctp")
    run = ordered.running_sum_sliced(run, ["_o"], "n", "cn").plain()
    pos = th.groupBy("label").agg(F.sum("tp").alias("p")).filter("p > 0")
    return (
        run.join(pos, "label")
        .groupBy("label")
        .agg(F.sum(F.col("tp") / F.col("p") * F.col("ctp") / F.col("cn")).alias("ap"))
    )


def macro_average_precision(scored: DataFrame) -> DataFrame:
    return average_precision(scored).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("aupr"))


def wrong_at(ranked: DataFrame, k: int) -> DataFrame:
    """How many texts have no true label among their first ``k``. ``ranked`` has rank and truth."""
    best = ranked.groupBy("id").agg(F.min(F.when(F.col("truth") == 1, F.col("rank"))).alias("r"))
    wrong = F.coalesce(F.col("r") > k, F.lit(True))
    return best.agg(F.count(F.lit(1)).alias("n_total"), F.sum(wrong.cast("long")).alias("n_wrong"))


def collapse(pred: DataFrame, share: float = 0.9, min_results: int = 3) -> DataFrame:
    """Whether one predicted label makes up ``share`` of at least ``min_results`` results."""
    n = pred.groupBy("predicted").agg(F.count(F.lit(1)).alias("c"))
    top = n.agg(
        F.sum("c").alias("n_results"),
        F.max("c").alias("n_top"),
        F.min(F.struct((-F.col("c")).alias("c"), "predicted"))["predicted"].alias("top_label"),
    )
    return top.withColumn("top_share", F.col("n_top") / F.col("n_results")).withColumn(
        "collapsed", (F.col("n_results") >= min_results) & (F.col("top_share") >= share)
    )


def info_nce(pairs: DataFrame) -> DataFrame:
    """Symmetric InfoNCE of a scored square pair table (row, col, sim), sim already scaled: mean of
    the row-wise and the column-wise cross entropy of the diagonal. Scaled similarities stay within
    +-100, so the exponentials fit a double."""
    def side(key: str) -> DataFrame:
        return pairs.groupBy(key).agg(
            F.log(F.sum(F.exp("sim"))).alias("lse"),
            F.max(F.when(F.col("row") == F.col("col"), F.col("sim"))).alias("pos"),
        ).agg(F.avg(F.col("lse") - F.col("pos")).alias(f"loss_{key}"))

    return side("row").join(side("col")).select(((F.col("loss_row") + F.col("loss_col")) / 2).alias("loss"))


def prototype_loss(scored: DataFrame, scale: float, weights: DataFrame | None = None) -> DataFrame:
    """Multi-label prototype loss: per text the weighted mean over its true labels of log-sum-exp of
    the false labels minus the label's own similarity, clamped at 0; mean over texts with a label."""
    s = scored.withColumn("_s", F.col("score") * F.lit(scale))
    s = s.join(weights.select("label", "weight"), "label", "left") if weights is not None else s.withColumn("weight", F.lit(1.0))
    neg = F.log(F.sum(F.when(F.col("truth") == 0, F.exp("_s"))))
    per = s.groupBy("id").agg(
        neg.alias("_neg"),
        F.sum("truth").alias("_k"),
        F.sum(F.when(F.col("truth") == 1, F.col("weight"))).alias("_w"),
        F.sum(F.when(F.col("truth") == 1, F.col("weight") * F.col("_s"))).alias("_ws"),
    )
    loss = F.greatest((F.col("_neg") * F.col("_w") - F.col("_ws")) / F.col("_k"), F.lit(0.0))
    # without false labels the log-sum-exp is minus infinity and the loss clamps to 0
    return per.filter("_k > 0").agg(F.avg(F.coalesce(loss, F.lit(0.0))).alias("loss"))


def uniformity(vectors: DataFrame, t: float = 2.0, rows_per_block: int = 4_000) -> DataFrame:
    """log of the mean over all pairs of exp(-t * squared distance) of unit vectors. Blocks meet
    blocks; each block pair leaves one partial sum, never its pairs."""
    import pandas as pd

    from provloom.operators.score import _matrix

    n_blocks = max(1, -(-vectors.count() // rows_per_block))
    b = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b"))
    left = b.withColumn("o", F.explode(F.sequence(F.col("b"), F.lit(n_blocks - 1).cast("long"))))
    right = b.withColumn("o", F.col("b")).drop("b").withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o")))
    )

    def meet(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return no_rows("s", "n")
        e = np.exp(-t * np.maximum(2.0 - 2.0 * (_matrix(lp["v"]) @ _matrix(rp["v"]).T), 0.0))
        if lp["b"].iloc[0] == lp["o"].iloc[0]:
            n = len(lp)
            return pd.DataFrame({"s": [(e.sum() - np.trace(e)) / 2.0], "n": [n * (n - 1) // 2]})
        return pd.DataFrame({"s": [e.sum()], "n": [e.size]})

    met = own_columns(left).groupBy("b", "o").cogroup(own_columns(right).groupBy("b", "o"))
    parts = met.applyInPandas(meet, "s double, n long")
    return parts.agg(F.log(F.sum("s") / F.sum("n")).alias("uniformity"))


def _array_sums(df: DataFrame, keys: list[str], value: Column, size: int, out: str) -> DataFrame:
    """Entry-wise sum of the array ``value`` per key; a task hands on one row per key."""
    sums = df.withColumn("_a", value).groupBy(*keys).agg(*[F.sum(F.get("_a", F.lit(i))).alias(f"_s{i}") for i in range(size)])
    return sums.select(*keys, F.array(*[F.col(f"_s{i}") for i in range(size)]).alias(out))


#: numbers of a system of equations that one task may hold
DENSE_CELLS = 4_000_000


def _dense_solution(co: DataFrame, sums: DataFrame, eps: float, size: int) -> DataFrame:
    """(label, v) from the counts (label, other, n) and the sums (label, r), in one task."""
    import pandas as pd

    def solve(counts: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        labels = pd.Index(counts["label"].unique())
        a, b = eps * np.eye(len(labels)), np.zeros((len(labels), size))
        a[labels.get_indexer(counts["label"]), labels.get_indexer(counts["other"])] += counts["n"]
        if len(right):
            b[labels.get_indexer(right["label"])] = np.stack(right["r"].to_numpy())
        return pd.DataFrame({"label": labels, "v": list(np.linalg.solve(a, b))})

    one = F.lit(0).alias("k")
    met = co.select(one, "*").groupBy("k").cogroup(own_columns(sums).select(one, "*").groupBy("k"))
    return met.applyInPandas(solve, f"label {co.schema['label'].dataType.simpleString()}, v array<double>")


def ridge_solution(vectors: DataFrame, membership: DataFrame, eps: float = 1e-3, tolerance: float = 1e-12) -> DataFrame | None:
    """(label, v): the solution of (L'L + eps I) V = L'Z, or None without members that have a vector.

    A system of at most ``DENSE_CELLS`` numbers, which are counted first, is solved densely in one task. A larger one by
    conjugate gradients on the table of co-membership counts, scaled by its diagonal; every entry of the vectors is
    a right-hand side with a step length of its own. A step is one join with the counts and one row of sums, and
    nothing but those, four per entry, comes to the driver. It ends when no residual is above ``tolerance`` of its first,
    at the latest after two steps per label, which exact arithmetic would not need."""
    m = membership.select("id", "label").distinct()
    z = m.join(vectors.filter(F.col("v").isNotNull()).select("id", "v"), "id")
    first = z.select(F.size("v").alias("n")).first()
    if first is None:
        return None
    size = first["n"]
    # labels of one text are few
    per_id = m.groupBy("id").agg(F.collect_set("label").alias("ls"))
    pairs = per_id.select(F.explode("ls").alias("label"), "ls").select("label", F.explode("ls").alias("other"))
    co = cut_lineage(pairs.groupBy("label", "other").agg(F.count(F.lit(1)).alias("n")))
    zeros = F.array_repeat(F.lit(0.0), size)
    sums = _array_sums(z, ["label"], F.col("v"), size, "r")
    n_labels = co.filter("label = other").count()
    if n_labels * (n_labels + size) <= DENSE_CELLS:
        return _dense_solution(co, sums, eps, size)
    state = co.filter("label = other").select("label", (F.col("n") + F.lit(eps)).alias("d")).join(sums, "label", "left")
    state = state.select("label", "d", zeros.alias("x"), F.coalesce("r", zeros).alias("r"))
    state = cut_lineage(state.withColumn("p", F.transform("r", lambda y: y / F.col("d"))))

    def per_entry(a: str, b: str, over) -> list[Column]:
        return [F.sum(F.get(a, F.lit(i)) * F.get(b, F.lit(i)) / over) for i in range(size)]

    def plus(a: Column, times: np.ndarray, b: str) -> Column:
        return F.zip_with(a, F.zip_with(F.array(*map(F.lit, times.tolist())), b, lambda f, y: f * y), lambda x, y: x + y)

    at_first = None
    for _ in range(2 * n_labels):
        met = co.join(state.select(F.col("label").alias("other"), "p"), "other")
        product = _array_sums(met, ["label"], F.transform("p", lambda y: y * F.col("n")), size, "q")
        state = cut_lineage(state.join(product, "label").withColumn("q", F.zip_with("q", "p", lambda y, w: y + F.lit(eps) * w)))
        d, one = F.col("d"), F.lit(1.0)
        row = state.agg(*per_entry("r", "r", d), *per_entry("p", "q", one), *per_entry("r", "q", d), *per_entry("q", "q", d)).first()
        rr, pq, rq, qq = np.array(row, float).reshape(4, size)
        at_first = rr if at_first is None else at_first
        if np.all(rr <= tolerance**2 * at_first):
            break
        step = np.divide(rr, pq, out=np.zeros(size), where=pq != 0)
        left = np.maximum(rr - 2 * step * rq + step * step * qq, 0.0)
        turn = np.divide(left, rr, out=np.zeros(size), where=rr != 0)
        state = state.select("label", "d", plus(F.col("x"), step, "p").alias("x"), plus(F.col("r"), -step, "q").alias("r"), "p")
        state = state.withColumn("p", plus(F.transform("r", lambda y: y / F.col("d")), turn, "p"))
    return state.select("label", F.col("x").alias("v"))


def ridge_prototypes(
    vectors: DataFrame,
    membership: DataFrame,
    eps: float = 1e-3,
    previous: DataFrame | None = None,
    beta: float = 0.999,
) -> DataFrame:
    """(label, v): class prototypes (L'L + eps I)^-1 L'Z, normalised, optionally as a moving average
    with the previous ones. Labels without rows keep theirs."""
    solution = ridge_solution(vectors, membership, eps)
    if solution is None:
        solution = membership.select("label", F.array().cast("array<double>").alias("v")).limit(0)
    star = solution.select("label", vec.unit(F.col("v")).alias("v"))
    if previous is None:
        return star
    both = star.withColumnRenamed("v", "new").join(previous.select("label", F.col("v").alias("old")), "label", "full")
    moved = F.zip_with("old", "new", lambda x, y: F.lit(beta) * x + F.lit(1 - beta) * y)
    v = F.when(F.col("old").isNull(), F.col("new")).otherwise(vec.unit(F.coalesce(moved, F.col("old"))))
    return both.select("label", v.alias("v"))


def train_counts(membership: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per label, zero for labels without any."""
    n = membership.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.select("label").distinct().join(n, "label", "left").fillna(0, ["n"])


def class_weights(counts: DataFrame, cap: float = 3.0) -> DataFrame:
    """Mean count over count (at least 1), capped."""
    mean = counts.agg(F.avg(F.greatest("n", F.lit(1))).alias("mean"))
    return counts.join(F.broadcast(mean)).select(
        "label", "n", F.least(F.col("mean") / F.greatest("n", F.lit(1)), F.lit(cap)).alias("weight")
    )
