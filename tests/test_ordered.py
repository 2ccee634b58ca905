"""Ordered scans: sliced hot keys must give what one plain pass gives."""

import random

import pytest

from provloom.operators import ordered
from provloom.operators.anchored import anchored_windows


def skewed_rows(seed, n=400):
    """A third of the rows belongs to one key; times repeat."""
    rnd = random.Random(seed)
    return [(("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}"), rnd.randrange(0, 300), i, rnd.randrange(5)) for i in range(n)]


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("target", [None, 25, 7])
def test_scan_matches_one_pass(spark, target):
    rows = skewed_rows(1)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    got = ordered.scan(df, ["k"], ["t", "id"], index="i", lag={"pv": "v"}, first={"fv": "v"}, target_rows=target)
    got = {r["id"]: (r["i"], r["pv"], r["fv"]) for r in got.collect()}
    want = {}
    for g in by_key(rows).values():
        for i, r in enumerate(g):
            want[r[2]] = (i + 1, g[i - 1][3] if i else None, g[0][3])
    assert got == want


@pytest.mark.parametrize("target", [None, 30])
def test_scan_without_keys_numbers_everything(spark, target):
    rows = skewed_rows(2)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    got = {r["id"]: r["i"] for r in ordered.scan(df, [], ["t", "id"], index="i", target_rows=target).collect()}
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert got == want


@pytest.mark.parametrize("target", [None, 25])
def test_input_columns_may_have_any_name(spark, target):
    """Names that a scan might use for itself; those it does use are refused."""
    rows = skewed_rows(1)
    names = ["_at", "_cuts", "_n", "_s", "_o", "_thin", "_pieces", "__rn", "__before", "__m", "n", "part"]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").selectExpr("*", *[f"id * {i} AS {n}" for i, n in enumerate(names)])
    got = ordered.scan(df, ["k"], ["t", "id"], index="i", lag={"pv": "v"}, lead={"nv": "_cuts"}, first={"fv": "_n"}, target_rows=target)
    got = ordered.running_sum(got, ["k"], ["t", "id"], "_s", "rs", target)
    got = ordered.gap_sessions(got, ["k"], ["t", "id"], 4, target_rows=target)
    got = {r["id"]: r for r in ordered.scan(got, [], ["t", "id"], index="all").collect()}
    assert sorted(r["all"] for r in got.values()) == list(range(1, len(rows) + 1))
    for g in by_key(rows).values():
        total = 0
        for i, r in enumerate(g):
            x = got[r[2]]
            total += 3 * r[2]
            assert [x[n] for n in names] == [r[2] * j for j in range(len(names))]
            assert (x["i"], x["pv"], x["nv"], x["fv"], x["rs"]) == (i + 1, g[i - 1][3] if i else None, g[i + 1][2] if i + 1 < len(g) else None, 2 * g[0][2], total)
    with pytest.raises(ValueError):
        ordered.with_slices(df.withColumn("__ordered_n", df.id), ["k"], ["id"])


@pytest.mark.parametrize("target", [None, 20])
def test_running_max(spark, target):
    rows = skewed_rows(6)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").selectExpr("*", "IF(v = 0, id, NULL) AS mark")
    got = ordered.running_sliced(ordered.with_slices(df, ["k"], ["t", "id"], target), ["t", "id"], "mark", "m", "max").plain()
    got = {r["id"]: r["m"] for r in got.collect()}
    for g in by_key(rows).values():
        most = None
        for r in g:
            most = max(most or 0, r[2]) if r[3] == 0 else most
            assert got[r[2]] == most


@pytest.mark.parametrize("target", [None, 20])
def test_running_sum(spark, target):
    rows = skewed_rows(3)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    got = {r["id"]: r["s"] for r in ordered.running_sum(df, ["k"], ["t", "id"], "v", "s", target).collect()}
    want = {}
    for g in by_key(rows).values():
        s = 0
        for r in g:
            s += r[3]
            want[r[2]] = s
    assert got == want


def test_slices_of_a_double_order(spark):
    rows = [("a", i / 1000.0, i, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t double, id long, v long")
    cut = ordered.with_slices(df, ["k"], "t", 20)
    assert cut.hot and cut.df.select("_slice").distinct().count() >= 10
    got = {r["id"]: r["s"] for r in ordered.running_sum(df, ["k"], ["t", "id"], "v", "s", 20).collect()}
    assert got == {i: i + 1 for i in range(200)}


def test_one_time_for_all_rows_of_a_hot_key(spark):
    df = spark.createDataFrame([("a", 5, i, 1) for i in range(60)], "k string, t long, id long, v long")
    got = {r["id"]: r["i"] for r in ordered.scan(df, ["k"], ["t", "id"], index="i", target_rows=10).collect()}
    assert got == {i: i + 1 for i in range(60)}


@pytest.mark.parametrize("target", [None, 15])
@pytest.mark.parametrize("strict", [False, True])
def test_gap_sessions_boundary(spark, target, strict):
    rows = skewed_rows(4)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    got = {r["id"]: r["segment"] for r in ordered.gap_sessions(df, ["k"], ["t", "id"], 4, strict=strict, target_rows=target).collect()}
    want = {}
    for g in by_key(rows).values():
        s = 0
        for i, r in enumerate(g):
            gap = r[1] - g[i - 1][1] if i else 0
            s += bool(i and (gap > 4 if strict else gap >= 4))
            want[r[2]] = s
    assert got == want


@pytest.mark.parametrize("target", [None, 40, 9])
@pytest.mark.parametrize("width", [0, 3, 17, 90])
def test_anchored_windows_match_the_greedy_pass(spark, target, width):
    rows = skewed_rows(5 + width)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    got = {r["id"]: r["anchor"] for r in anchored_windows(df, ["k"], ["t", "id"], width, target_rows=target).collect()}
    want = {}
    for g in by_key(rows).values():
        anchor = None
        for r in g:
            if anchor is None or r[1] - anchor > width:
                anchor = r[1]
            want[r[2]] = anchor
    assert got == want


def slice_sizes(df, keys, order, target):
    cut = ordered.with_slices(df, keys, order, target)
    assert cut.hot
    return [r["count"] for r in cut.df.filter("_slice >= 0").groupBy(*keys, "_slice").count().collect()]


@pytest.mark.parametrize(
    "value",
    [
        "xxhash64(id)",  # the whole range of a long
        "IF(id % 500 = 0, 0, 1700000000000000000 + id * 1000)",  # missing times counted as 0
        "id % 2",  # a flag in front
        "IF(id = 77, 9000000000000000000, id)",  # one clock far off
        "5",
        "CAST(NULL AS BIGINT)",
    ],
)
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_slices_hold_about_the_target(spark, value, keys):
    df = spark.range(20_000).selectExpr("'a' AS k", f"{value} AS t", "id").repartition(4)
    sizes = slice_sizes(df, keys, ["t", "id"], 1000)
    assert sum(sizes) == 20_000 and max(sizes) <= 2000 and len(sizes) >= 15


def test_many_slices(spark):
    df = spark.range(30_000).selectExpr("id % 7 AS t", "id").repartition(4)
    assert max(slice_sizes(df, [], ["t", "id"], 150)) <= 300
    got = ordered.scan(df, [], ["t", "id"], index="i", target_rows=150).agg({"i": "max"}).head()[0]
    assert got == 30_000


def test_random_split_with_small_slices(spark):
    from provloom.operators import splits

    df = spark.range(500).selectExpr("CAST(id AS STRING) AS key")
    whole = sorted(splits.random_split(df, "key").collect())
    spark.conf.set("spark.provloom.targetRows", "20")
    try:
        assert sorted(splits.random_split(df, "key").collect()) == whole
    finally:
        spark.conf.unset("spark.provloom.targetRows")
    assert sum(r["split"] == "test" for r in whole) == 100
