"""SimHash blocks, spelling variants and the conversation trie against literal re-statements."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from provloom.llm import simhash, spelling, turntrie
from tests.llm.helpers import corpus, shingle_list, words

# --- simhash ------------------------------------------------------------------------------------


def literal_fingerprint(text):
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in shingle_list(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def literal_groups(values, distance=2):
    """Smallest member of every value's component."""
    label = list(range(len(values)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def balls(seed, n=400):
    """Fingerprints in dense balls, chains of single flipped bits, and single ones."""
    rng = random.Random(seed)
    out = {0, 1 << 63, 3}
    while len(out) < n:
        centre = rng.getrandbits(64)
        out.add(centre)
        for _ in range(rng.choice([0, 0, 3, 60])):
            centre ^= (1 << rng.randrange(64)) if rng.random() < 0.5 else 0
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_text_fingerprints():
    texts = [*corpus(5, 50), None, "", "  \t\x0b", "a", "A b", "É ÉA\nz", "x " * 70_000, "q" * 9000]
    assert simhash.text_fingerprints(pa.array(texts)).tolist() == [literal_fingerprint(t) for t in texts]
    assert simhash.text_fingerprints(pa.array([], pa.string())).tolist() == []


def test_choices_cover_every_pair():
    rng = random.Random(1)
    shared, free = 0, 64
    for _ in range(3):
        masks = simhash.block_choices(shared)
        assert all(m & shared == shared for m in masks) and len(set(masks)) == 10
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample([b for b in range(64) if not shared >> b & 1], 2):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)
        shared = max(masks, key=int.bit_count)
        free = max(64 - m.bit_count() for m in masks)
    assert free <= 4  # so no group is above 16 after three cuts


@pytest.mark.parametrize("group", [16, 25, 128])
def test_links_of_dense_balls(spark, group):
    values = balls(group)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.close_links(df, group=group).collect()]
    at = {v: i for i, v in enumerate(values)}
    label = list(range(len(values)))
    for _ in range(len(values)):
        before = list(label)
        for a, b in links:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
        if label == before:
            break
    assert label == literal_groups(values)


def test_near_duplicates(documents):
    texts = corpus(9, 60)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (2, " "), (None, "only one here"), (600, "only one here"), (600, "only one here")]
    got = sorted(map(tuple, simhash.near_duplicates(documents(rows, "'x' AS fp")).collect()), key=repr)
    values = [literal_fingerprint(t) for _, t in rows]
    groups = literal_groups(values)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    assert got == sorted(((i, f"{v:016x}", least[g]) for (i, _), v, g in zip(rows, values, groups, strict=True)), key=repr)


def test_no_documents(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert spelling.variants(documents([])).collect() == []


# --- spelling -----------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def literal_variants(rows, letters, least):
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
            run = ""
    n = {w: k for w, k in counts.items() if len(w) >= letters and k >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def vocabulary_rows(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéÀÿ") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    pool = list(stems)
    for s in stems:
        for _ in range(6):
            t, i = rng.choice([s, rng.choice(pool)]), rng.randrange(5)
            pool.append(rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice("abéÿ") + t[i:], t[:i] + rng.choice("abéÀ") + t[i + 1 :], t + "b", t[:-1]]))
    weights = [rng.choice([1, 1, 5, 40]) for _ in pool]
    rows = [(d, rng.choice([" ", "-", "1", "×".join("  ")]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in rng.choices(pool, weights, k=150))) for d in range(30)]
    return rows + [(None, " ".join(pool[:20])), (3, None), (4, ""), (5, rows[0][1]), (5, rows[0][1])]


@pytest.mark.parametrize(("seed", "tile"), [(1, 4096), (2, 3), (3, 1)])
def test_variants(documents, seed, tile):
    rows = vocabulary_rows(seed)
    got = spelling.variants(documents(rows, "1 AS word"), least=2, tile=tile).collect()
    assert len(got) == len({r.word for r in got}) and {tuple(r) for r in got} == literal_variants(rows, 6, 2)


def test_position_index():
    rng = random.Random(4)
    words_ = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    index = spelling.PositionIndex(words_)
    for q in [*words_[:60], "", "aaaaaaaa", "abcd"]:
        assert [words_[i] for i in index.members(index.near(q))] == [w for w in words_ if one_edit(q, w)]
        assert [words_[i] for i in index.members(index.near(q, 2))] == [w for w in words_ if one_edit(q, w) and (len(q) < 3 or w[:2] != q[:2])]


def test_roots_of_long_chains(spark):
    chain = [f"w{i:03d}" for i in range(70)]
    df = spark.createDataFrame([*zip(chain, chain[1:]), ("side", "w068")], "word string, form string")  # noqa: B905
    assert {tuple(r) for r in spelling.roots(df).collect()} == {(w, "w069") for w in [*chain[:-1], "side"]}


# --- trie ---------------------------------------------------------------------------------------


def literal_trie(sequences):
    """sequences: conv_id -> list of (role, text). Rows as the query returns them."""
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, m in members.items():
        saved = sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in below[p] if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(sequences[c]) == len(p)))
        up = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), up, len(m), children[p], sum(not children[x] for x in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def literal_rebuilt(own):
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + s[h:]
    return out


def talks(seed, n=120):
    rng = random.Random(seed)
    pool = [(rng.choice(["user", "assistant", ""]), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))) for _ in range(6)]
    out = {}
    for _ in range(n):
        s = [pool[0]] * (rng.random() < 0.7) + [rng.choice(pool) for _ in range(rng.choice([0, 1, 1, 2, 3, 5]))]
        if s:
            out[rng.randrange(300)] = s
    out[299] = [pool[1]] * 60
    return out


@pytest.mark.parametrize(("seed", "run_keys"), [(1, 1), (2, 3), (3, 17), (4, 20_000)])
def test_prefix_trie(spark, seed, run_keys):
    own = talks(seed)
    rows = [(c, t if t else None, role or None, text or None) for c, s in own.items() for t, (role, text) in enumerate(s)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string").selectExpr("*", "'k' AS key", "0 AS id")
    got = [tuple(r) for r in turntrie.prefix_trie(df.repartition(3), run_keys).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got)) and set(got) == literal_trie(literal_rebuilt(own))


def test_repeated_turns_and_no_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turntrie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(20, 1, "user", "x y")] * 3
    got = turntrie.trie(turntrie.turn_lists(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.depth, r.n_convs, r.n_children, r.n_leaves) for r in got) == [(d, 1, int(d < 3), 1) for d in range(4)]


def test_radix_tree_of_all_layouts():
    """Random byte strings of aligned lengths; children of one node grow through every layout."""
    rng = random.Random(8)
    keys = {bytes(rng.choice([7, 7, rng.randrange(256)]) for _ in range(2 * rng.randint(1, 3))) for _ in range(3000)}
    keys = sorted(keys | {b""})
    closed, opened = turntrie.run_nodes(keys, [[1] * (len(k) // 2) for k in keys], [1] * len(keys), list(range(len(keys))), [k.hex() for k in keys], width=2)
    prefixes = Counter(k[:d] for k in keys for d in range(0, len(k) + 1, 2))
    assert len(closed) + len(opened) == len(prefixes)
    edges = {k[:d] for k in (keys[0], keys[-1]) for d in range(0, len(k) + 1, 2)}
    assert len(opened) == len(edges)
    first = {p: min(i for i, k in enumerate(keys) if k.startswith(p)) for p in prefixes if len(p) <= 2}
    want = sorted((first[p], prefixes[p], sum(len(q) == 4 and q[:2] == p for q in prefixes)) for p in first if len(p) == 2 and p not in edges)
    assert sorted((r[0], r[4], r[5]) for r in closed if r[3] == 1) == want
    assert np.sum([r[4] for r in closed if r[3] == 3]) + sum(r[4] for r in opened if r[3] == 3) == sum(len(k) == 6 for k in keys)
