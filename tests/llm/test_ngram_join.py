import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from provloom.llm import batches, components, ngramjoin
from tests.llm.helpers import corpus, lower, prose, shingle_list, words


def expected(texts):
    sets = {i: set(shingle_list(t)) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_as_by_all_pairs(documents, seed):
    texts = dict(enumerate(corpus(seed, 60)))
    assert found(ngramjoin.join_components(documents(texts.items()))) == expected(texts)


def test_chain_and_threshold(documents):
    # n and n + k words with n shared shingles: similarity is exactly 3/4 at 7 to 10 words and below at 11
    w = prose(random.Random(5), 200).split(" ")
    texts = {0: " ".join(w[:100]), 1: " ".join(w[:124]), 2: " ".join(w[:156]), 3: " ".join(w[:200]), 4: " ".join(w[:7]), 5: " ".join(w[:6])}
    assert found(ngramjoin.join_components(documents(texts.items()))) == expected(texts)


def test_large_group_of_near_copies(documents, monkeypatch):
    monkeypatch.setattr(ngramjoin, "HUB_SETS", 4)
    monkeypatch.setattr(ngramjoin, "HUB_BLOCKS", 2)
    monkeypatch.setattr(ngramjoin, "BROADCAST_IDS", 3)
    rng = random.Random(9)
    base = prose(rng, 60).split(" ")
    texts = {}
    for i in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        texts[i] = " ".join(w)
    assert found(ngramjoin.join_components(documents(texts.items()))) == expected(texts)


def test_nulls_empty_long_repeated_and_extra_columns(documents, spark):
    long = prose(random.Random(3), 30_000)
    rows = [(3, None), (4, ""), (5, " \n\t "), (6, "One"), (7, "one"), (8, long), (9, long.upper()), (9, long.upper()), (None, "one")]
    df = documents(rows, extra="'x' AS id").withColumn("n", df_lit(1)).withColumn("cid", df_lit(2))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join_components(df).collect()), key=repr)
    n = len(set(shingle_list(long)))
    want = [(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, n, 8), (9, n, 8), (9, n, 8), (None, 1, 6)]
    assert got == sorted(want, key=repr)
    kept = ngramjoin.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert ngramjoin.join_components(df.limit(0)).collect() == []
    assert ngramjoin.one_of_each(df.limit(0)).collect() == []


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_one_row_stays_of_repeated_rows(documents):
    df = documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    assert [r.doc_id for r in ngramjoin.one_of_each(df).collect()] == [1]


def test_walk_agrees_with_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        base = np.unique(rng.integers(0, 200, 40).astype(np.uint64))
        sets = []
        for _ in range(30):
            keep = base[rng.random(len(base)) < rng.choice([0.5, 0.9, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 300, rng.integers(0, 8)).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        want = [4 * len(np.intersect1d(s, base)) >= 3 * len(np.union1d(s, base)) for s in sets]
        assert ngramjoin.walk(base, sets) == want


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 7, 40, 300):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 60, n).astype(np.uint64)]))
        assert ngramjoin.least_difference(ngramjoin.odd_sketch(a), ngramjoin.odd_sketch(b)) <= len(np.setxor1d(a, b))
        assert ngramjoin.least_difference(ngramjoin.odd_sketch(a), ngramjoin.odd_sketch(a)) == 0


def test_words_and_shingles_on_arrays():
    texts = ["Aa bb\x0bCC dd ee ff", None, "", "x", "\tÉa  b\r\n", "a b c d e f a b c d e f"]
    column = pa.array(texts, pa.string()).slice(0)
    data, bounds = batches.flat(column)
    s, e, doc = batches.words(batches.lower_ascii(data), bounds)
    got = [[] for _ in texts]
    low = batches.lower_ascii(data).tobytes()
    for a, b, d in zip(s, e, doc, strict=True):
        got[d].append(low[a:b].decode())
    assert got == [words(lower(t or "")) for t in texts]
    sets = ngramjoin.shingle_sets(column)
    assert [len(x) for x in sets] == [len(set(shingle_list(t))) for t in texts]
    sliced = ngramjoin.shingle_sets(pa.array(["zz", *texts], pa.string()).slice(1))
    assert all((a == b).all() for a, b in zip(sets, sliced, strict=True))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_texts_that_share_an_id(documents):
    a, b = "a b c d e f g h", "r s t u v w x y"
    got = sorted(tuple(r) for r in ngramjoin.join_components(documents([(5, a), (5, b), (3, b), (7, a)])).collect())
    assert got == [(3, 4, 3), (5, 4, 3), (5, 4, 5), (7, 4, 5)]


def test_one_of_each_tells_rows_of_one_id_apart(documents):
    rng = random.Random(12)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(3, a), (7, a), (7, b), (7, b), (8, b), (7, c), (7, None), (7, ""), (None, d), (None, e), (None, e), (None, None), (9, d)]
    got = sorted(((r.doc_id, r.text) for r in ngramjoin.one_of_each(documents(rows)).collect()), key=repr)
    assert got == sorted([(3, a), (7, b), (7, c), (7, None), (7, ""), (None, e), (None, None), (9, d)], key=repr)


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w


def test_words_on_which_polynomial_hashes_collide(documents):
    """Two words of 2,048 letters that no polynomial modulo 2 ** 64 tells apart, whatever its base."""
    one = thue_morse(2048)
    other = one.translate({97: 98, 98: 97})
    got = ngramjoin.join_components(documents([(1, one), (2, other), (3, one), (4, f"x {other}"), (5, f"x {one}")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_partners_of_a_large_subtree_in_little_memory():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 400, 6000)
    pos, label = rng.integers(0, 300, 6000) % n, rng.integers(0, 3, 6000)
    tracemalloc.start()
    got = ngramjoin.have_partner(n, pos, label, 75)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20  # 6,000 rows against blocks of 1,024 would be 49 MB for one array
    for i in rng.integers(0, 6000, 40).tolist():
        need = -(-75 * (n[i] + n) // 175)
        assert got[i] == ((np.minimum(n[i] - pos[i], n - pos) >= need) & (label != label[i])).any()
