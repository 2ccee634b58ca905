"""Report tables and texts, phrase relevance by blocks, pooled vectors: against literal re-statements."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from provloom.operators import bm25, dedup, reports, score


def literal_phrases(sentences, phrases):
    docs = {i: p.lower().split() for i, p in phrases}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for key, text in sentences:
        words = Counter("".join(c if c.isascii() and c.isalpha() else " " for c in text.lower()).split())
        if not any(t in idf for t in words):
            continue
        scores = {}
        for i, d in docs.items():
            s = sum(c * idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t, c in words.items() if t in d)
            scores[i] = round(s, 9)
        i = min(scores, key=lambda i: (-scores[i], i))
        out[key] = (dict(phrases)[i], pytest.approx(scores[i], abs=1e-8))
    return out


@pytest.mark.parametrize("block", [1, 3, 128])
def test_best_phrase_by_blocks(spark, monkeypatch, block):
    """Frequent terms weigh nothing or less; some sentences have only such terms."""
    monkeypatch.setattr(bm25, "BLOCK", block)
    rnd = random.Random(block)
    rare = [f"w{c}" for c in "abcdefghijkl"]
    rare = [w.replace("w", "x") + "y" for w in rare]
    phrases = [(i, " ".join([*(["the"] if i % 10 else []), *(["of"] if i % 3 else []), *rnd.choices(rare, k=rnd.randint(1, 3))])) for i in range(60)]
    phrases = list({p: (i, p) for i, p in reversed(phrases)}.values())
    sentences = [(k, " ".join(rnd.choices([*rare, "the", "of", "none", "The,"], k=rnd.randint(1, 5)))) for k in range(60)] + [(100, "the"), (101, "of the of"), (102, "none"), (103, "")]
    got = bm25.best_phrase(spark.createDataFrame(sentences, "k long, text string"), spark.createDataFrame(phrases, "phrase_id long, phrase string"), "k")
    assert {r["k"]: (r["phrase"], r["score"]) for r in got.collect()} == literal_phrases(sentences, phrases)


def test_mean_pool(spark):
    z = np.random.default_rng(1).normal(size=(50, 7))
    df = spark.createDataFrame([(i % 3, i % 2, [float(x) for x in v]) for i, v in enumerate(z)], "a long, b long, v array<double>")
    got = {(r["a"], r["b"]): r["v"] for r in score.mean_pool(df.repartition(4), ["a", "b"]).collect()}
    assert set(got) == {(a, b) for a in range(3) for b in range(2)}
    for (a, b), v in got.items():
        assert v == pytest.approx(z[[i for i in range(50) if (i % 3, i % 2) == (a, b)]].mean(0).tolist())
    assert score.mean_pool(df.limit(0), ["a"]).collect() == []


def test_embeddings_written_and_read_back(spark, tmp_path):
    v = [[0.25, -1.0], [1e-300, 3.5]]
    vectors = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    meta = spark.createDataFrame([(0, "a b", None), (1, "ä", "s"), (2, "without vector", "s")], "id long, label string, source string")
    score.write_embeddings(meta, vectors, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e")).orderBy("id").collect()
    assert [(r["id"], r["label"], r["source"], r["v"]) for r in back] == [(0, "a b", None, v[0]), (1, "ä", "s", v[1])]


def test_reduction_report(spark, tmp_path):
    texts = {"s1": ["read file one", "read file two", "zzz", "read file one"], "s2": ["only"]}
    df = spark.createDataFrame([(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)], "seq string, pos long, text string")
    report = reports.reduction_report(dedup.deduplicate(df, ["seq"]), ["seq"], 0.7)
    reports.write_lines(report, ["seq"], str(tmp_path / "r"))
    got = [r["line"] for r in reports.read_lines(spark, str(tmp_path / "r")).orderBy("line_no").collect()]
    rule, dash = "=" * 100, "-" * 100
    assert got == [
        rule, "  Sequence: s1   Threshold: 0.7", "  Before : 4 sentences", "  After  : 2 sentences  (50.0% removed)", dash, "  KEPT SENTENCES:",
        "       1. read file one", "       2. zzz", "  REMOVED SENTENCES  (removed, matched kept sentence, similarity):",
        "       1.  REMOVED : read file two", "           MATCHED : read file one  (sim=0.846)",
        "       2.  REMOVED : read file one", "           MATCHED : read file one  (sim=1.0)",
        rule, "  Sequence: s2   Threshold: 0.7", "  Before : 1 sentences", "  After  : 1 sentences  (0.0% removed)", dash, "  KEPT SENTENCES:",
        "       1. only", "  REMOVED SENTENCES  (removed, matched kept sentence, similarity):",
    ]


def test_match_and_evaluation_reports(spark):
    z = np.random.default_rng(3).normal(size=(14, 4))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(i // 4, i % 4, f"log {i % 3}", [float(x) for x in v]) for i, v in enumerate(z[:8])]
    cols = [("abc"[i // 2], i % 2, f"cti\n{i}", [float(x) for x in v]) for i, v in enumerate(z[8:])]
    ranking, explained = reports.ranked_reports(spark.createDataFrame(rows, "id long, pos long, text string, v array<double>"), spark.createDataFrame(cols, "ref string, pos long, text string, v array<double>"))
    want = []
    for i in range(2):
        mine = [r for r in rows if r[0] == i]
        late = {ref: np.mean([max(np.dot(r[3], c[3]) for c in cols if c[0] == ref) for r in mine]) for ref in "abc"}
        best = sorted(late, key=lambda ref: (-round(late[ref], 6), ref))
        want.append(f"    {i}")
        want += [f"      {ref:<40} {late[ref]:.4f}" for ref in best]
        for ref in best[:2]:
            cells = sorted((-np.dot(r[3], c[3]), r[1], c[1], r[2], c[2]) for r in mine for c in cols if c[0] == ref)[:10]
            want.append(f"    Top matching sentences for [{ref}]:")
            seen = []
            for s, _, _, a, b in cells:
                if (a, b) not in seen and len(seen) < 3:
                    seen.append((a, b))
                    want += [f"      [{len(seen)}] Score : {-s:.4f}", f"          LOG : {a}", f"          CTI : {b.replace(chr(10), ' ')}"]
    got = reports.match_report(ranking, explained).orderBy("id", "line_no").collect()
    assert [r["line"] for r in got] == want
    s = spark.createDataFrame([("ck2", "lrap", 0.5), ("ck1", "wrong@1", 3.0), ("ck1", "lrap", 0.25)], "name string, metric string, value double")
    got = [r["line"] for r in reports.evaluation_report(s).orderBy("name", "line_no").collect()]
    assert got == ["  === ck1 ===", f"    {'lrap':<30} 0.2500", f"    {'wrong@1':<30} 3.0000", "  === ck2 ===", f"    {'lrap':<30} 0.5000"]
