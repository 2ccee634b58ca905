import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from provloom.llm import chat, mixing
from tests.llm.helpers import prose, words


def targets(sizes, weights, share, passes):
    """Targets by sharing the excess again and again; sizes in code point order, null last."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        open_ = {s: w for s, w in weight.items() if s not in capped}
        rest = total - sum(capped.values())
        want = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in want if want[s] > passes * sizes[s]]
        if not over:
            return capped | want
        capped |= {s: passes * sizes[s] for s in over}


def test_mix_meets_the_targets(documents):
    rng = random.Random(1)
    names = ["b", "a", "é", None, "A", "c"]
    rows = [(i, prose(rng, rng.randint(0, 60)), None, rng.choices(names, [9, 3, 1, 2, 1, 1])[0]) for i in range(300)]
    got = mixing.mix(documents(rows), slice_rows=7).collect()
    sizes = {}
    for s in sorted({r[3] for r in rows}, key=lambda s: (s is None, s)):
        sizes[s] = sum(len(words(r[1])) for r in rows if r[3] == s)
    want = targets(sizes, (3, 1, 2), 1.5, 2)
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        assert (r.position is None) == (r.taken == 0 or r.taken is None)
        assert r.position is None or 0 <= r.position <= (r.position_again or 1) <= 1
    assert len(got) == 300 and all(0 <= want[s] - taken[s] < 1 for s in sizes)
    again = mixing.mix(documents(rows).repartition(5), slice_rows=1000).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_mix_positions_follow_the_schedule():
    """A rising schedule asks for less in the first half than a falling one."""
    def asked(slope, t):
        return (1 - slope) * t + slope * t * t

    assert asked(0.5, 0.5) < 0.5 < asked(-0.5, 0.5)


def test_positions_invert_the_demand(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("u"))
    for slope in (0.5, 0.0, -0.5):
        s = F.lit(slope)
        t = rows.select("u", mixing.position(F.col("u") * 7, F.lit(7.0), s).alias("t"))
        assert all(abs((1 - slope) * r.t + slope * r.t * r.t - r.u) < 1e-5 for r in t.collect())


def test_mix_of_odd_rows(documents):
    df = documents([(1, None, None, "a"), (2, "", None, "a"), (3, "x y", None, None), (3, "x y", None, None), (None, "z", None, "a")], "1 AS size")
    df = df.selectExpr("*", "2 AS place", "3 AS sk", "4 AS target", "5 AS row")
    got = sorted((tuple(r)[:2] for r in mixing.mix(df).collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (3, 2), (3, 2), (None, 1)], key=repr)
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.training_rows(df.limit(0)).collect() == []
    out = mixing.training_rows(df)
    assert out.columns == df.columns and all(r.text for r in out.collect())


@pytest.mark.parametrize("few", [10, 1_000_000])
def test_training_rows_are_whole_documents_in_order(documents, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", few)
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), None, "ab"[i % 2]) for i in range(80)]
    df = documents(rows)
    mixed = {r.doc_id: r for r in mixing.mix(df).collect()}
    out = [r.doc_id for r in mixing.training_rows(df).coalesce(1).collect()]
    for i, r in mixed.items():
        assert out.count(i) == round(r.taken / r.size + 1e-9)
    assert 115 <= len(out) <= 125


TURNS = "conv_id long, turn long, role string, text string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<\\|", "\\\\|", "<|", "\n", "plain", "é😀", "\\n", "$1", "<|im_end|>\n"]
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "to\nol\\n", None]), text))
    rows += [(30, 1, "assistant", "b"), (30, 1, "assistant", "a"), (30, 1, "assistant", "a"), (None, 1, "assistant", "x"), (31, None, "user", "u")]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    got = {r.conv_id: r for r in chat.read_back(df.selectExpr("*", "1 AS place", "2 AS piece")).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, _, r, x in turns))
        assert got[c].loss_sha256 == digest(loss) and got[c].loss_chars == len(loss)
        assert got[c].examples == sum(r == "assistant" for _, _, r, _ in turns)
    assert chat.read_back(df.limit(0)).collect() == []
    # contexts are all that stood before, and only frames hold the control string
    for e in chat.examples(df).collect():
        assert e.context.endswith("<|im_start|>assistant\n") and "<|" not in e.reply
        assert len(re.findall(r"<\|im_start\|>", e.context)) >= e.example
    assert sum(1 for _ in chat.examples(df).collect()) == sum(r[2] == "assistant" for r in rows)


def test_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "w" * 200) for t in range(300)]
    r = chat.read_back(spark.createDataFrame(rows, TURNS)).head()
    assert (r.n_turns, r.loss_chars, r.examples) == (300, 150 * 200, 150)
