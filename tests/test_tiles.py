"""Tiles of vectors against NumPy, and what leaves a task."""

import numpy as np
import pyarrow as pa
import pytest

from provloom.operators import score, tiles


def unit(a):
    return a / np.linalg.norm(a, axis=-1, keepdims=True)


@pytest.fixture
def texts(spark, monkeypatch):
    """Sentences far apart in their places, some places twice, references of very unequal sizes."""
    monkeypatch.setattr(tiles, "shapes", lambda left, right, rows=None: (3, 16, 2, 16))
    rng = np.random.default_rng(4)
    a = [(int(i), int(p) * 512, f"t{p % 7}", unit(rng.normal(size=4))) for i, p in zip(rng.integers(0, 5, 120), rng.integers(0, 60, 120), strict=True)]
    b = [("abcd"[min(int(k), 3)], int(p) * 512, f"r{p % 5}", unit(rng.normal(size=4))) for p, k in enumerate(rng.geometric(0.4, 150) - 1)]
    frame = lambda rows, key: spark.createDataFrame([(*r[:3], [float(x) for x in r[3]]) for r in rows], f"{key}, pos long, text string, v array<double>")
    return a, b, frame(a, "id long"), frame(b, "ref string")


def late(a, b, i, ref):
    best = {}
    for x in (x for x in a if x[0] == i):
        best[x[1]] = max([best.get(x[1], -2), *(float(x[3] @ y[3]) for y in b if y[0] == ref)])
    return np.mean(list(best.values()))


@pytest.mark.parametrize("pairs", [None, [(0, "a"), (1, "d"), (4, "b"), (0, "c"), (9, "a"), (1, "none")]])
def test_late_interaction_over_cut_references(spark, texts, pairs):
    a, b, rows, cols = texts
    want = {(i, ref): late(a, b, i, ref) for i in {x[0] for x in a} for ref in {y[0] for y in b} if pairs is None or (i, ref) in pairs}
    asked = spark.createDataFrame(pairs, "id long, ref string") if pairs else None
    got = score.late_interaction(rows, cols, asked)
    assert {(r["id"], r["ref"]): r["score"] for r in got.collect()} == pytest.approx(want)
    # no vector is copied for a chunk of places, which were as many here as there are columns
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan


def test_best_pairs_over_cut_references(spark, texts):
    a, b, rows, cols = texts
    pairs = [(0, "a"), (2, "b"), (3, "d")]
    got = score.best_sentence_pairs(rows, cols, spark.createDataFrame(pairs, "id long, ref string"), pool=6, top=3).collect()
    for i, ref in pairs:
        cells = sorted((-float(x[3] @ y[3]), x[1], y[1], x[2], y[2]) for x in a for y in b if (x[0], y[0]) == (i, ref))[:6]
        want = list(dict.fromkeys((t, r) for *_, t, r in cells))[:3]
        assert [(r["row_text"], r["ref_text"]) for r in sorted((r for r in got if (r["id"], r["ref"]) == (i, ref)), key=lambda r: r["rank"])] == want


def test_best_keeps_the_first_of_equal_columns():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 6, size=(50, 90)).astype(float)
    best = tiles.Best(50, 4)
    for i in range(0, 90, 2):
        best.add(s[:, i : i + 2])
    assert (best.at == np.argsort(-s, axis=1, kind="stable")[:, :4]).all()


def test_scores_held_at_once_are_bounded(monkeypatch):
    monkeypatch.setattr(score, "CELLS", 100)
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "v": [[1.0, 2.0]] * 50})
    assert [len(z) for _, z in score._pieces(batch, 40)] == [2] * 25
    assert len(next(score._pieces(batch, 1000))[1]) == 1


def test_vectors_of_two_lengths_are_refused():
    with pytest.raises(ValueError):
        tiles.matrix(pa.array([[1.0], [1.0, 2.0], [1.0, 2.0, 3.0]]))


def test_raised_maxima_are_those_of_full_precision():
    """Near copies, whose products differ by less than halved precision tells, and rows that are best already."""
    rng = np.random.default_rng(8)
    m = np.repeat(unit(rng.normal(size=(40, 16))), 8, axis=0)
    m = unit(m + rng.normal(scale=1e-7, size=m.shape))
    other = unit(np.concatenate([m[rng.permutation(320)], rng.normal(size=(30, 16))]))
    starts = np.array([0, 50, 51, 200])
    tile = tiles.Tile(0, None, None, None, None, None, m, None)
    right = tiles.Tile(1, None, starts, None, None, None, other, None)
    want = tiles.segment_max(m @ other.T, starts)
    for floor in (-1.0, 0.5):
        best = np.full(want.shape, floor)
        tiles.raise_max(tile, right, best)
        assert best == pytest.approx(np.maximum(want, floor), abs=1e-15)


def test_a_left_matrix_goes_to_the_worker_once(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in unit(rng.normal(size=4))]) for i in range(40)]
    left = tiles.packed(spark.createDataFrame(rows, "id long, v array<double>"), "id", 2, 7)
    right = tiles.packed(spark.createDataFrame(rows, "ref long, v array<double>"), "ref", 2, 5)
    met = tiles.met(left, right, "n long", lambda tile: [0], lambda tile, other, state, ask: iter(state.append(len(other.m)) or ()), lambda tile, state: iter(
        [pa.RecordBatch.from_arrays([pa.array([sum(state) * len(tile.m)])], ["n"])]
    ))
    assert met.agg({"n": "sum"}).head()[0] == 40 * 40
    assert "CASE WHEN" in met._jdf.queryExecution().optimizedPlan().toString()


def test_the_norm_is_computed_once_for_a_vector(spark):
    from pyspark.sql import functions as F

    from provloom.functions import vectors

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>").select(vectors.unit(F.col("v")).alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    divisions = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction(") if " / " in line]
    assert divisions and all("aggregate" not in line.split(" / ")[1].split(")")[0] for line in divisions)
