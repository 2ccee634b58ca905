"""Graph rules against literal re-statements on random small graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provloom.functions.similarity import ratio
from provloom.operators import build, partition, reduce

EDGE = "src string, src_type string, dst string, dst_type string, edge_type string, ts_ns long, line_no long"


def edge_rows(seed, n=120, nodes=14):
    rnd = random.Random(seed)
    types = ["EVENT_READ", "EVENT_READ_SOCKET_PARAMS", "EVENT_WRITE", "EVENT_OPEN"]
    rows = []
    for i in range(n):
        a, b = (0 if rnd.random() < 0.3 else rnd.randrange(nodes)), rnd.randrange(nodes)
        kind = lambda x: ("SUBJECT_PROCESS", "FILE_OBJECT", "NetFlowObject")[x % 3]
        rows.append((f"n{a}", kind(a), f"n{b}", kind(b), rnd.choice(types), rnd.randrange(60), i))
    return rows


def literal_graph(rows):
    ids, kept, first = {}, [], {}
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        for u in (r[0], r[2]):
            ids.setdefault(u, len(ids))
        pair = (r[0], r[2])
        if pair not in first:
            first[pair] = [r[4], 0]
            kept.append((r[6], 0))
        elif r[4] not in first[pair][0]:
            first[pair][1] += 1
            kept.append((r[6], first[pair][1]))
    return ids, kept


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("target", [None, 10])
def test_build_graph(spark, seed, target):
    rows = edge_rows(seed)
    nodes, edges = build.build_graph(spark.createDataFrame(rows, EDGE), target_rows=target)
    ids, kept = literal_graph(rows)
    assert {r["uuid"]: r["node_id"] for r in nodes.collect()} == ids
    assert sorted((r["line_no"], r["edge_key"]) for r in edges.collect()) == sorted(kept)


def test_edges_with_kinds_say_which_files_processes_touch(spark):
    """Edges that carry the types of their nodes need no join for them, and give the same pairs."""
    rows = edge_rows(3)
    nodes, edges = build.build_graph(spark.createDataFrame(rows, EDGE), kinds=True)
    kind = {r["node_id"]: r["type"] for r in nodes.collect()}
    assert all((r["src_kind"], r["dst_kind"]) == (kind[r["src_id"]], kind[r["dst_id"]]) for r in edges.collect())
    files = nodes.filter("type like '%FILE%'").select("node_id", "ts_ns")
    for more in (None, files):
        fast, slow = (reduce.process_files(nodes, e, files=more) for e in (edges, edges.drop("src_kind", "dst_kind")))
        got = sorted(tuple(r) for r in fast.select(*slow.columns).collect())
        assert got and got == sorted(tuple(r) for r in slow.collect())
    assert "Join" not in reduce.process_files(nodes, edges)._jdf.queryExecution().optimizedPlan().toString()


def test_cascade_steps_read_written_tables(spark, monkeypatch):
    """The steps after the merges do not run them, or the search for touched files, again."""
    from provloom.plans import reduce_queries

    searches = []
    plain = reduce.process_files
    monkeypatch.setattr(reduce, "process_files", lambda *a, **k: searches.append(1) or plain(*a, **k))
    nodes, edges, _, shared = reduce_queries.walk_merges(spark, "/root/testdata/sf0.001")
    assert len(searches) == 1
    kept = reduce.cascade_strip(nodes, edges, shared)[1]
    for table in (shared, kept):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()


def literal_components(rows, theta, mins):
    ids, kept = literal_graph(rows)
    kind = {}
    for r in rows:
        kind[ids[r[0]]], kind[ids[r[2]]] = r[1], r[3]
    lines = {k for k, _ in kept}
    edges = [(ids[r[0]], ids[r[2]], r[5], r[6]) for r in rows if r[6] in lines]
    succ = {}
    for a, b, _, _ in edges:
        succ.setdefault(a, []).append(b)
    visited, comps, dep = set(), [], 0
    for seed in range(len(ids)):
        if seed in visited:
            continue
        members, stack = set(), [seed]
        while stack:
            n = stack.pop()
            members.add(n)
            if n in visited:
                continue
            visited.add(n)
            for m in succ.get(n, []):
                if m in visited:
                    members.add(m)
                else:
                    stack.append(m)
        inside = sorted((e for e in edges if e[0] in members and e[1] in members), key=lambda e: (e[2], e[3]))
        segs = []
        for i, e in enumerate(inside):
            if not i or e[2] - inside[i - 1][2] >= theta:
                segs.append([])
            segs[-1].append(e)
        good = [s for s in segs if len({x for e in s for x in e[:2]}) >= mins and len({kind[x] for e in s for x in e[:2]}) >= 2]
        for p, s in enumerate(good):
            comps.append((dep, p, len(good), seed, len(s), len({x for e in s for x in e[:2]}), s[0][2], s[-1][2]))
        dep += bool(good)
    return comps


@pytest.mark.parametrize("seed", range(4))
def test_seed_components_and_segments(spark, seed):
    rows = edge_rows(seed, n=60, nodes=20)
    nodes, edges = build.build_graph(spark.createDataFrame(rows, EDGE))
    seg = partition.segment_edges(partition.component_edges(nodes, edges), 4)
    got = partition.valid_segments(seg, nodes, min_nodes=3).collect()
    got = sorted((r["dep_id"], r["part_idx"], r["total_parts"], r["seed"], r["n_edges"], r["n_nodes"], r["start_ts"], r["end_ts"]) for r in got)
    assert got == sorted(literal_components(rows, 4, 3))


def test_similar_files_of_a_busy_folder(spark):
    """A hundred thousand files of one process and folder within five minutes, slices of a thousand. Names that begin alike are
    similar, others share too few letters: the parent of a file is the oldest one of its kind within 30 seconds."""
    n, kinds = 100_000, ["aaaaaaaaaaaa", "bbbbbbbbbbbb", "cccccccccccc"]
    at = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int"))
    ids = spark.range(1, n + 1)
    files = ids.select(F.col("id").alias("node_id"), F.lit("FILE").alias("type"), (F.col("id") * 3_000_000).alias("ts_ns"), F.concat(F.lit("/tmp/"), at, F.pmod("id", F.lit(90)).cast("string")).alias("name"))
    nodes = files.union(spark.createDataFrame([(0, "SUBJECT_PROCESS", 0, "p")], "node_id long, type string, ts_ns long, name string"))
    edges = ids.select(F.lit(0).cast("long").alias("src_id"), F.col("id").alias("dst_id"))
    got = {r["node_id"]: r["parent_id"] for r in reduce.similar_parents(nodes, edges, target_rows=1000).collect()}
    kind = {r["node_id"]: r["name"][5] for r in files.collect()}
    want, recent = {}, {}
    for i in range(1, n + 1):
        mine = recent.setdefault(kind[i], [])
        while mine and (i - mine[0]) * 3_000_000 > 30 * 10**9:
            mine.pop(0)
        if mine:
            want[i] = mine[0]
        mine.append(i)
    assert got == want


def literal_owners(n, edges):
    owner = list(range(n))
    succ = {}
    for a, b in edges:
        succ.setdefault(a, []).append(b)
    for seed in range(n):
        todo = [seed]
        while todo:
            x = todo.pop()
            for y in succ.get(x, []):
                if owner[y] > seed:
                    owner[y] = seed
                    todo.append(y)
    return owner


@pytest.mark.parametrize(("seed", "share"), [(0, 1_000_000), (1, 3), (2, 20)])
def test_owners_when_one_seed_owns_half(spark, monkeypatch, tmp_path, seed, share):
    """Half of the nodes hang below node 5 over long chains, whose label falls late; the rest is random."""
    rnd = random.Random(seed)
    n = 400
    low = list(range(5, 200))
    edges = [(5, x) for x in low[1:60]] + [(x, x + 60) for x in low[1:] if x + 60 < 200]
    edges += [(rnd.randrange(200, n), rnd.randrange(200, n)) for _ in range(150)]
    edges += [(a, a + 1) for a in range(300, 399)] + [(4, 5), (3, 4)]
    monkeypatch.setattr(partition, "shared_folder", lambda spark, name: str(tmp_path / name))
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    got = partition.owners(nodes, spark.createDataFrame(edges, "src_id long, dst_id long"), share_rows=share)
    want = literal_owners(n, edges)
    assert {r["node_id"]: r["owner"] for r in got.collect()} == dict(enumerate(want))
    rounds = len(list((tmp_path / "owners").iterdir()))
    wrote = [spark.read.parquet(str(tmp_path / "owners" / f"round={i}")).count() for i in range(rounds)]
    assert wrote[-1] == 0 and wrote[-2] < wrote[0] / 4
    assert sum(wrote) < (rounds - 1) * n / 2  # far from a state that is written whole


def test_owners_of_a_chain(spark, monkeypatch, tmp_path):
    """Ways halve, as labels are followed: a chain of 120 nodes takes some log 120 rounds."""
    monkeypatch.setattr(partition, "shared_folder", lambda spark, name: str(tmp_path / name))
    nodes = spark.createDataFrame([(i,) for i in range(120)], "node_id long")
    got = partition.owners(nodes, spark.createDataFrame([(a, a + 1) for a in range(119)], "src_id long, dst_id long"))
    assert {r["owner"] for r in got.collect()} == {0}
    assert len(list((tmp_path / "owners").iterdir())) <= 9


def test_owners_without_edges(spark):
    nodes = spark.createDataFrame([(0,), (1,)], "node_id long")
    got = partition.owners(nodes, spark.createDataFrame([(1, 1)], "src_id long, dst_id long"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0), (1, 1)]


def named_graph(spark, rows, target=None):
    nodes, edges = build.build_graph(spark.createDataFrame(rows, EDGE), target_rows=target)
    return nodes.withColumn("name", nodes.uuid), edges


def walk_rows(seed):
    rnd = random.Random(seed)
    paths = ["/a", "/a/b", "/a/b/c", "/a/b/d", "/a/e", "/a/e/f", "/x", "/x/y", "/x/y/z", "/x/y/z/w"]
    rows = []
    for i in range(40):
        t = "EVENT_OPEN" if rnd.random() < 0.6 else "EVENT_READ"
        rows.append((f"p{rnd.randrange(3)}", "SUBJECT_PROCESS", rnd.choice(paths), "FILE", t, rnd.randrange(50), i))
    return rows


def literal_cascade(rows):
    ids, kept = literal_graph(rows)
    lines = {k for k, _ in kept}
    ts, procs = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        for u in (r[0], r[2]):
            ts.setdefault(ids[u], r[5])
        if r[6] in lines:
            procs.setdefault(ids[r[0]], set()).add(ids[r[2]])
    name = {v: k for k, v in ids.items()}
    files = [n for n in sorted(name) if name[n].startswith("/")]
    at = {name[n]: n for n in files}
    order = {p: sorted(f, key=lambda n: (ts[n], n)) for p, f in procs.items()}
    merges = []
    for child_path in sorted(at, key=lambda p: -p.count("/")):
        child, parent_path = at[child_path], child_path.rsplit("/", 1)[0]
        parent = at.get(parent_path)
        if parent is None or name[parent] != parent_path or ts[parent] > ts[child]:
            continue
        if any(o[i] == parent and o[i + 1] == child for o in order.values() for i in range(len(o) - 1)):
            merges.append((parent, parent_path, child))
            at[parent_path] = child
    return merges


@pytest.mark.parametrize("seed", range(6))
def test_directory_cascade(spark, seed):
    rows = walk_rows(seed)
    merges = reduce.cascade_merges(*named_graph(spark, rows), target_rows=None if seed % 2 else 4)
    assert sorted(tuple(r) for r in merges.select("parent_id", "parent_path", "child_id").collect()) == sorted(literal_cascade(rows))


def random_candidates(seed):
    """Candidates over a random tree of paths, deep and with few branches."""
    rnd = random.Random(seed)
    paths = ["/0"]
    for i in range(1, rnd.choice([8, 25, 60])):
        above = paths[-1] if rnd.random() < rnd.choice([0.5, 0.95]) else rnd.choice(paths)
        paths.append(f"{above}/{i}")
    own = {p: i for i, p in enumerate(rnd.sample(paths, len(paths)))}
    seen = {p: i for i, p in enumerate(rnd.sample(paths, len(paths)))}
    out = set()
    for p in paths:
        below = [b for b in paths if b.startswith(p + "/")]
        near = [b for b in below if b.count("/") - p.count("/") <= 2]
        for f in rnd.sample(near, min(len(near), rnd.choice([0, 1, 1, 2]))) + rnd.sample(below, min(len(below), rnd.choice([0, 0, 0, 1]))):
            via = p + "/" + f[len(p) + 1 :].split("/")[0]
            out.add((seed, p, own[p], via, own[via], seen[via], own[f]))
    return sorted(out)


def literal_standing(rows):
    stands = {}
    for path in sorted({r[1] for r in rows}, key=lambda p: -p.count("/")):
        mine = [r for r in rows if r[1] == path]
        hits = [(r[5], r[6]) for r in mine if stands.get(r[3], r[4]) == r[6]]
        stands[path] = min(hits)[1] if hits else mine[0][2]
    return stands


def test_standing_nodes_of_random_forests(spark, monkeypatch):
    rows = [r for seed in range(60) for r in random_candidates(seed)]
    rounds = []
    whole = reduce._composed
    monkeypatch.setattr(reduce, "_composed", lambda *a: rounds.append(1) or whole(*a))
    df = spark.createDataFrame(rows, "g long, parent_path string, parent_id long, via string, own long, seen long, child_id long")
    got = [tuple(r) for r in reduce.standing_nodes(df, ["g"]).select("g", "parent_path", "stands").collect()]
    want = [(seed, p, f) for seed in range(60) for p, f in literal_standing([r for r in rows if r[0] == seed]).items()]
    assert sorted(got) == sorted(want) and len(rounds) <= 12


def test_cascade_of_a_deep_path(spark, monkeypatch):
    """Folders entered one after the other merge in turns: each answer hangs on the one below, 40 levels down."""
    deep = ["/" + "/".join(f"d{i}" for i in range(n)) for n in range(1, 41)]
    rows = [("p0", "SUBJECT_PROCESS", p, "FILE", "EVENT_OPEN", i, i) for i, p in enumerate(deep)]
    # a second process skips a level here and there, so that chains collapse over several folders
    rows += [("p1", "SUBJECT_PROCESS", p, "FILE", "EVENT_READ", i, 100 + i) for i, p in enumerate(deep) if i % 3]
    rounds = []
    whole = reduce._composed
    monkeypatch.setattr(reduce, "_composed", lambda *a: rounds.append(1) or whole(*a))
    merges = reduce.cascade_merges(*named_graph(spark, rows))
    want = literal_cascade(rows)
    assert sorted(tuple(r) for r in merges.select("parent_id", "parent_path", "child_id").collect()) == sorted(want)
    assert len(want) >= 15 and len(rounds) + 1 <= 8


def file_rows(seed):
    rnd = random.Random(seed)
    names = [f"/tmp/job{i}.tmp" for i in range(4)] + [f"/tmp/other-{i}.log" for i in range(3)] + ["/srv/a.lock", "/srv/b.lock", "/srv/keep.md", "/tmp/zzzz"]
    return [(f"p{rnd.randrange(3)}", "SUBJECT_PROCESS", rnd.choice(names), "FILE", rnd.choice(["EVENT_READ", "EVENT_WRITE"]), rnd.randrange(200) * 10**9, i) for i in range(30)]


def literal_similar(rows, window=30 * 10**9, threshold=0.7):
    ids, kept = literal_graph(rows)
    lines = {k for k, _ in kept}
    ts, procs = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        ts.setdefault(ids[r[2]], r[5])
        if r[6] in lines:
            procs.setdefault(ids[r[2]], set()).add(r[0])
    name = {v: k for k, v in ids.items()}
    short = lambda p: any(d in p for d in ("/tmp/", "/var/log/")) or p.endswith((".log", ".tmp", ".lock"))
    rep = {}
    dirs = {}
    for n in sorted(procs, key=lambda n: (ts[n], n)):
        dirs.setdefault(name[n].rsplit("/", 1)[0], []).append(n)
    for files in dirs.values():
        for i, a in enumerate(files):
            if not short(name[a]):
                continue
            for b in files[i + 1 :]:
                if not short(name[b]) or b in rep:
                    continue
                if ts[b] - ts[a] > window:
                    break
                if procs[a] & procs[b] and ratio(name[a].rsplit("/", 1)[1], name[b].rsplit("/", 1)[1]) > threshold:
                    rep[b] = rep.get(a, a)
    return rep


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("target", [None, 3])
def test_similar_files(spark, seed, target):
    rows = file_rows(seed)
    parents = reduce.similar_parents(*named_graph(spark, rows), target_rows=target)
    got = {r["node_id"]: r["rep_id"] for r in reduce.representatives(parents).collect()}
    assert got == literal_similar(rows)


def test_flow_merge_by_hand(spark):
    ns = 10**9
    flow = "10.0.0.1_{}_8.8.8.8_{}"
    rows = [
        ("p", "SUBJECT_PROCESS", flow.format(1, 443), "NetFlowObject", "EVENT_CONNECT", 0, 0),
        ("p", "SUBJECT_PROCESS", flow.format(2, 80), "NetFlowObject", "EVENT_SENDTO", ns, 1),  # exactly one window later: inside
        ("p", "SUBJECT_PROCESS", flow.format(3, 0), "NetFlowObject", "EVENT_RECVFROM", ns + 1, 2),  # outside
        ("p", "SUBJECT_PROCESS", flow.format(3, 0), "NetFlowObject", "EVENT_READ", 5 * ns, 3),  # never merged
    ]
    nodes, edges, merged = reduce.reduce_flows(*named_graph(spark, rows))
    m = merged.collect()
    assert len(m) == 1 and (m[0]["edge_type"], m[0]["dst_name"], m[0]["n_events"]) == ("CONNECT_SENDTO", "10.0.0.1_1_8.8.8.8_443_80", 2)
    assert sorted(r["edge_type"] for r in edges.collect()) == ["CONNECT_SENDTO", "EVENT_READ", "EVENT_RECVFROM"]
    assert sorted(r["name"] for r in nodes.collect()) == ["10.0.0.1_1_8.8.8.8_443_80", "10.0.0.1_3_8.8.8.8_0", "p"]


def test_cycles_and_self_loops_settle(spark):
    rows = [("a", "P", "b", "F", "X", 1, 0), ("b", "F", "c", "F", "X", 2, 1), ("c", "F", "a", "P", "X", 3, 2), ("d", "P", "d", "P", "X", 4, 3), ("d", "P", "a", "P", "X", 5, 4)]
    nodes, edges = build.build_graph(spark.createDataFrame(rows, EDGE))
    ids = {r["node_id"]: r["uuid"] for r in nodes.collect()}
    got = {ids[r["node_id"]]: ids[r["owner"]] for r in partition.owners(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_parents_in_small_blocks_as_in_large_ones():
    rng = random.Random(5)
    for n in (1, 2, 9, 23):
        for _ in range(40):
            ts = sorted(rng.randrange(90) for _ in range(n))
            base = [rng.choice(["item_1.tmp", "item_12.tmp", "daemon7.log", "daemon71.log", "a.lock", "", "zz"]) for _ in range(n)]
            halo = [rng.random() < 0.2 for _ in range(n)]
            many = reduce.many_parents(np.array(ts), np.array(base, object), np.array(halo), 30, 0.7)
            assert reduce.few_parents(ts, base, halo, 30, 0.7) == many.tolist()


def test_edges_travel_once_for_each_end(spark):
    """The parallel-edge rule runs on the rows as the join with the targets has dealt them; only named columns are kept."""
    rows = edge_rows(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, edges = build.build_graph(spark.createDataFrame(rows, EDGE), stage=False, keep=["line_no", "edge_key"])
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4  # edges and nodes at each of two joins
        ids, kept = literal_graph(rows)
        assert {r["uuid"]: r["node_id"] for r in nodes.collect()} == ids
        ends = {r[6]: (ids[r[0]], ids[r[2]]) for r in rows}
        got = sorted((r["line_no"], r["edge_key"], r["src_id"], r["dst_id"]) for r in edges.collect())
        assert edges.columns == ["line_no", "edge_key", "src_id", "dst_id"]
        assert got == sorted((line, key, *ends[line]) for line, key in kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_neighbourhood_shuffles_no_pairs_of_edges(spark):
    """A step reaches distinct nodes; the edges themselves need not be made distinct first."""
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 1), (3, 2), (4, 3)], "src_id long, dst_id long")
    seen = []
    real = partition.cut_lineage
    try:
        partition.cut_lineage = lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1]
        got = partition.neighbourhood(edges, spark.createDataFrame([(0,)], "node_id long"), 2)
    finally:
        partition.cut_lineage = real
    assert {(r["node_id"], r["hop"]) for r in got.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert not any("Aggregate [src_id" in p for p in seen)
