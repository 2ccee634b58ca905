"""Scoring, metrics and splits against NumPy and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provloom.operators import metrics, score, splits


def unit(a):
    return a / np.linalg.norm(a, axis=-1, keepdims=True)


def frame(spark, z, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(z)], f"{name} long, v array<double>")


@pytest.fixture(scope="module")
def z():
    return np.random.default_rng(0).normal(size=(40, 6))


def test_block_retrieval_equals_broadcast_retrieval(spark, z, monkeypatch):
    texts, refs = frame(spark, z[:25]), frame(spark, z[25:], "ref")
    small = {(r["id"], r["rank"]): r["ref"] for r in score.top_references(texts, refs, 3).collect()}
    monkeypatch.setattr(score, "MAX_BROADCAST_FLOATS", 10)
    best = score._block_best(texts, refs, "long", False, 3, rows_per_block=7)
    from provloom.operators.ordered import top_k

    large = {(r["id"], r["rank"]): r["ref"] for r in top_k(best, ["id"], [F.desc("score"), F.asc("ref")], 3).collect()}
    sims = unit(z[:25]) @ unit(z[25:]).T
    want = {(i, k + 1): int(j) for i in range(25) for k, j in enumerate(np.argsort(-sims[i])[:3])}
    assert small == large == want
    labelled = refs.withColumn("label", (F.col("ref") % 4).cast("int"))
    got = {(r["id"], r["label"]): r["score"] for r in score.score_labels(texts, labelled).collect()}
    for i in range(25):
        for lab in range(4):
            assert got[(i, lab)] == pytest.approx(sims[i, lab::4].max())


def test_late_interaction_over_chunks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(9, 4)), rng.normal(size=(1100, 4))
    rows = spark.createDataFrame([(0, i, [float(x) for x in v]) for i, v in enumerate(a)], "id long, pos long, v array<double>")
    cols = spark.createDataFrame([("r", i, [float(x) for x in v]) for i, v in enumerate(b)], "ref string, pos long, v array<double>")
    pairs = spark.createDataFrame([(0, "r")], "id long, ref string")
    got = score.late_interaction(rows, cols, pairs).collect()
    assert len(got) == 1 and got[0]["score"] == pytest.approx((unit(a) @ unit(b).T).max(axis=1).mean())


def test_uniformity_over_blocks(spark, z):
    u = unit(z)
    d = ((u[:, None] - u[None]) ** 2).sum(-1)[np.triu_indices(len(u), 1)]
    got = metrics.uniformity(frame(spark, z), rows_per_block=9).first()["uniformity"]
    assert got == pytest.approx(np.log(np.exp(-2 * d).mean()))


def test_ridge_prototypes_with_several_labels(spark, z):
    mask = np.random.default_rng(2).integers(0, 2, size=(40, 3))
    mask[:, 2] = 0
    m = spark.createDataFrame([(i, j) for i in range(40) for j in range(3) if mask[i, j]], "id long, label int")
    old = spark.createDataFrame([(0, [1.0] + [0.0] * 5), (2, [0.0, 1.0] + [0.0] * 4)], "label int, v array<double>")
    got = {r["label"]: np.array(r["v"]) for r in metrics.ridge_prototypes(frame(spark, z), m, previous=old, beta=0.9).collect()}
    L = mask[:, :2].astype(float)
    star = unit(np.linalg.pinv(L.T @ L + 1e-3 * np.eye(2)) @ L.T @ z)
    assert got[0] == pytest.approx(unit(0.9 * np.eye(6)[0] + 0.1 * star[0]))
    assert got[1] == pytest.approx(star[1])
    assert got[2] == pytest.approx(np.eye(6)[1])


@pytest.mark.parametrize("cells", [0, 1000])
def test_ridge_prototypes_of_many_coupled_labels(spark, monkeypatch, cells):
    monkeypatch.setattr(metrics, "DENSE_CELLS", cells)
    rng = np.random.default_rng(5)
    z, mask = rng.normal(size=(300, 5)), rng.random((300, 9)) < 0.25
    mask[:, 8] = mask[:, 7]  # two labels on the same rows: only eps tells them apart
    m = spark.createDataFrame([(int(i), f"c{j:02}") for i, j in zip(*np.nonzero(mask))] * 2 + [(999, "c00")], "id long, label string")
    L = mask.astype(float)
    a = L.T @ L + 1e-3 * np.eye(9)
    a[0, 0] += 1  # a member without a vector counts as a row of its label
    want = np.linalg.solve(a, L.T @ z)
    got = {r["label"]: r["v"] for r in metrics.ridge_solution(frame(spark, z), m).collect()}
    assert sorted(got) == [f"c{j:02}" for j in range(9)]
    assert np.array([got[k] for k in sorted(got)]) == pytest.approx(want, abs=1e-8)
    assert metrics.ridge_solution(frame(spark, z), m.limit(0)) is None
    old = spark.createDataFrame([("x", [3.0, 4.0])], "label string, v array<double>")
    assert [tuple(r) for r in metrics.ridge_prototypes(frame(spark, z), m.limit(0), previous=old).collect()] == [("x", [0.6, 0.8])]
    assert metrics.ridge_prototypes(frame(spark, z), m.limit(0)).collect() == []


def test_folds_fitted_without_their_file(spark):
    rng = np.random.default_rng(6)
    z, label, file = rng.normal(size=(60, 4)), rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    label[:3], file[:3] = 7, 2  # label 7 is in one file only
    rows = [(i, f"f{file[i]}", int(label[i]), [float(x) for x in z[i]]) for i in range(60)] + [(60, "f0", 1, None)]
    df = spark.createDataFrame(rows, "id long, file string, label int, v array<double>")
    proto = score.fold_prototypes(df)
    got = {(r["fold"], r["label"]): r["v"] for r in proto.collect()}
    want = {(f"f{f}", int(k)): z[(file != f) & (label == k)].mean(axis=0) for f in range(3) for k in set(label) if ((file != f) & (label == k)).any()}
    assert sorted(got) == sorted(want) and ("f2", 7) not in got
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    hits = {f: [0, 0] for f in range(3)}
    for i in range(60):
        mine = {k: float(unit(z[i]) @ unit(v)) for (f, k), v in want.items() if f == f"f{file[i]}"}
        hits[file[i]][0] += 1
        hits[file[i]][1] += max(mine, key=mine.get) == label[i]
    acc = score.fold_accuracy(score.score_folds(df.filter("v IS NOT NULL"), proto), df).collect()
    assert {r["fold"]: [r["n"], r["n_correct"]] for r in acc} == {f"f{f}": n for f, n in hits.items()}
    assert score.fold_prototypes(df.limit(0)).collect() == []


SCORES = [("a", "x", 0.9, 1), ("a", "y", 0.9, 0), ("a", "w", 0.1, 1), ("b", "x", 0.2, 0), ("b", "y", 0.3, 0), ("b", "w", 0.4, 0), ("c", "x", 0.2, 1), ("c", "y", 0.3, 1), ("c", "w", 0.4, 1)]


def scored(spark):
    return spark.createDataFrame(SCORES, "id string, label string, score double, truth int")


def test_lrap_ties_and_plain_rows(spark):
    got = {r["id"]: r["lrap"] for r in metrics.lrap_rows(scored(spark)).collect()}
    assert got == {"a": pytest.approx((1 / 2 + 2 / 3) / 2), "b": 1.0, "c": 1.0}


@pytest.mark.parametrize("target", [None, 2])
def test_average_precision(spark, target):
    got = {r["label"]: r["ap"] for r in metrics.average_precision(scored(spark), target).collect()}
    # x: thresholds 0.9 (1 of 1), 0.2 (2 of 3); y: 0.9 (0 of 1), 0.3 (1 of 3); w: 0.4 (1 of 2), 0.1 (2 of 3)
    assert got == {"x": pytest.approx(0.5 + 0.5 * 2 / 3), "y": pytest.approx(1 / 3), "w": pytest.approx(0.25 + 0.5 * 2 / 3)}


def test_prototype_loss_cases(spark):
    s = scored(spark)
    w = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("w", 1.0)], "label string, weight double")
    a = max((2 * (0.9 - 0.9) + 1 * (0.9 - 0.1)) / 2, 0)  # one false label: the log-sum-exp is its score
    got = metrics.prototype_loss(s, 1.0, w).first()["loss"]
    assert got == pytest.approx((a + 0.0) / 2)  # 'b' has no label, 'c' no false label


def test_collapse_and_wrong(spark):
    p = spark.createDataFrame([(i, "x") for i in range(9)] + [(9, "y")], "id long, predicted string")
    assert metrics.collapse(p).first()["collapsed"] and not metrics.collapse(p.limit(2)).first()["collapsed"]
    ranked = score.rank_labels(scored(spark))
    assert tuple(metrics.wrong_at(ranked, 1).first()) == (3, 1)


def entries(spark, n=50):
    m = [(i, f"t{i % 4}") for i in range(n)] + [(i, "rare") for i in (3, 7)] + [(11, "single")]
    return spark.range(n), spark.createDataFrame(m, "id long, label string")


def test_random_split(spark):
    df, _ = entries(spark)
    s = splits.random_split(df, "id").collect()
    assert len({r["id"] for r in s}) == 50 and sum(r["split"] == "test" for r in s) == 10
    again = {r["id"]: r["split"] for r in splits.random_split(df.repartition(7), "id").collect()}
    assert again == {r["id"]: r["split"] for r in s}
    assert splits.random_split(df.limit(2), "id").filter("split = 'test'").count() == 1


def test_stratified_split(spark):
    df, m = entries(spark)
    s = {r["id"]: r["split"] for r in splits.stratified_split(df, m).collect()}
    assert len(s) == 50 and sum(v == "test" for v in s.values()) == 10
    sides = {}
    for r in m.collect():
        sides.setdefault(r["label"], set()).add(s[r["id"]])
    assert all(v == {"train", "test"} for k, v in sides.items() if k != "single")


def literal_stratified(ids, members, min_test, place):
    of, by_label = {}, {}
    for i, k in members:
        of.setdefault(i, set()).add(k)
        by_label.setdefault(k, set()).add(i)
    got, picked = dict.fromkeys(by_label, 0), set()
    for k in sorted(by_label):
        for i in sorted(by_label[k], key=place.get):
            if got[k] >= min(min_test, len(by_label[k]) - 1):
                break
            if i not in picked:
                picked.add(i)
                for other in of[i]:
                    got[other] += 1
    fill = sorted(ids, key=lambda i: (i not in picked, place[i]))[: max(1, int(len(ids) * 0.2))]
    return picked | set(fill)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_stratified_split_as_label_by_label(spark, seed):
    rng = np.random.default_rng(seed)
    members = [(i, f"t{k}") for i in range(40) for k in range(12) if rng.random() < (0.6 if k == 3 else 0.12)]
    df, m = spark.range(40), spark.createDataFrame(members, "id long, label string")
    place = {r["id"]: (r["_h"], r["id"]) for r in splits.hashed(df, "id").collect()}
    for min_test in (1, 3):
        got = splits.stratified_split(df, m, min_test=min_test).filter("split = 'test'").collect()
        assert {r["id"] for r in got} == literal_stratified(range(40), members, min_test, place)


def test_batches_and_pairs(spark):
    df, m = entries(spark)
    batch = splits.stratified_batch(m, 3)
    counts = {r["label"]: r["n"] for r in m.join(batch, "id", "left_semi").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert all(counts[k] >= 3 for k in ("t0", "t1", "t2", "t3")) and counts["rare"] == 2 and counts["single"] == 1
    t = spark.createDataFrame([("t0", 1), ("t0", 2), ("t1", 3)], "label string, template_id long")
    pos = splits.random_positive(m.filter("label in ('t0', 't1')"), t, 1).collect()
    assert all(r["template_id"] == 3 if r["label"] == "t1" else r["template_id"] in (1, 2) for r in pos)
    f = splits.folds(df.withColumn("file", F.concat(F.lit("f"), (F.col("id") % 2).cast("string"))), "file", ["f0", "f1"])
    assert f.count() == 100 and f.filter("split = 'test'").count() == 50


def test_chunks(spark):
    df = spark.createDataFrame([(0, ["<s>"] + [str(i) for i in range(10)]), (1, ["<s>"])], "id long, tokens array<string>")
    got = [(r["id"], r["start"], r["tokens"]) for r in score.chunk_tokens(df, 5, 3).orderBy("id", "chunk").collect()]
    assert [g[1] for g in got if g[0] == 0] == [1, 4, 7, 10]
    assert got[0][2] == ["<s>", "0", "1", "2", "3"] and got[3][2] == ["<s>", "9"] and got[4] == (1, 1, ["<s>"])
