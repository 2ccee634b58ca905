import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from provloom.llm import imatch, languages
from tests.llm.helpers import edited, prose

# --- fingerprints -------------------------------------------------------------------------------


def term_hashes(text):
    import regex

    out = dict.fromkeys(w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w)
    return [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in out]


def band(texts, share=imatch.MOST_SHARE, least=imatch.LEAST_DOCS):
    df = {}
    for t in texts:
        for h in term_hashes(t):
            b = h & (1 << imatch.LEXICON_BITS) - 1
            df[b] = df.get(b, 0) + 1
    return {b for b, n in df.items() if least <= n <= max(least, share * len(texts))}


def expected_print(text, kept):
    terms = term_hashes(text)
    mine = [t for t in terms if t & (1 << imatch.LEXICON_BITS) - 1 in kept] or terms
    thin = max(0, int(np.floor(np.log2(max(len(mine), 1) / imatch.CELLS))))
    parts = []
    for level in (thin, thin + 1):
        cells = [[] for _ in range(imatch.CELLS)]
        for t in mine:
            if (t >> 24) & ((1 << level) - 1) == 0:
                cells[t >> 59].append(t - (1 << 64) if t >> 63 else t)
        out = []
        for c in cells:
            seed = 42
            for x in sorted(c):
                seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed=seed)
            out.append(f"{seed & 0xFFFFFF:06X}" if c else "")
        parts.append(",".join(out))
    return f"{thin}:{parts[0]};{parts[1]}"


@pytest.mark.parametrize("slices", [1, 4, 50])
def test_fingerprints_as_restated(documents, slices):
    rng = random.Random(slices)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(60)] + ["", "Éa é1 a-b", "é" * 9]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in imatch.fingerprints(documents([(i * 3, t) for i, t in enumerate(texts)]), slices).collect()}
    kept = band(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, following = got[i * 3], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        changed = t[: len(t) - q] + following[:q]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == expected_print(t, kept) and r.edited_fingerprint == expected_print(changed, kept)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_edits_are_nearer_than_strangers(documents):
    rng = random.Random(11)
    rows = imatch.fingerprints(documents([(i, prose(rng, rng.randint(40, 400))) for i in range(120)])).collect()
    assert np.mean([r.near_edited for r in rows]) > 0.35 and np.mean([r.near_next for r in rows]) < 0.05


def test_fingerprints_of_odd_rows(documents):
    rng = random.Random(3)
    long = prose(rng, 20_000)
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "a b"), (6, "a b"), (7, "...")]
    df = documents(rows, "1 AS slice").selectExpr("*", "'f' AS fingerprint", "2 AS next", "3 AS head")
    got = imatch.fingerprints(df, 3).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[2] == prints[7] and prints[3] == prints[4] and len(prints[4]) == 1 and prints[None] == prints[6]
    assert all(r.near_edited == 1.0 for r in got if r.doc_id == 2)
    assert imatch.fingerprints(df.limit(0)).collect() == []


# --- languages ----------------------------------------------------------------------------------

TONGUES = {"x": "ka lo mi tu re", "y": "shra vosk brin dle ump", "z": "éau ñor içe öl aß"}


def sentence(rng, lang, n):
    s = TONGUES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(documents):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, rng.randint(5, 200)), lang) for i, lang in enumerate(rng.choices("xyz", k=300))]
    got = {r.doc_id: r for r in languages.identify(documents(rows)).collect()}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 60 and all(got[i].lang_pred == rows[i][2] for i in out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learns_from_the_learnable_rows_only(documents):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        held = zlib.crc32(str(i).encode()) % 3 == 1
        lang = rng.choice("xyz")
        rows.append((i, sentence(rng, lang, 50), "zyx"["xyz".index(lang)] if held else lang))  # wrong labels where they must not be read
    got = {r.doc_id: r.lang_pred for r in languages.identify(documents(rows)).collect()}
    for i, _, lang in rows:
        held = zlib.crc32(str(i).encode()) % 3 == 1
        assert got[i] == ("zyx"["xyz".index(lang)] if held else lang)


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(3)
    for _ in range(20):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 30)))
        step = languages.suffix_automaton(text)
        for _ in range(200):
            probe = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 6)))
            state = 0
            for c in probe:
                state = step[state].get(c) if state is not None else None
            assert (state is not None) == (probe in text)


def test_symbols_on_arrays():
    rng = random.Random(9)
    model = languages.Languages({"x": "abc defghijklmnopqrstuvwxyz éß"})
    texts = ["".join(rng.choice("aB é12²_-\n İß½") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", " ", "a", "-a-", "A  b"]
    codes, size = model.coded(texts)
    names = {i: c for c, i in model.alphabet.items()}
    got = np.split(codes, np.cumsum(size)[:-1])
    for t, g in zip(texts, got, strict=True):
        assert [names.get(int(c), "?") for c in g] == [c if c in model.alphabet else "?" for c in languages.symbols(t)], t


def test_phrases_as_by_greedy_parsing(monkeypatch):
    monkeypatch.setattr(languages, "STRETCH", 37)
    rng = random.Random(4)
    samples = {k: languages.symbols(sentence(rng, k, 60)) for k in "xyz"}
    model = languages.Languages(samples)
    texts = [languages.symbols(sentence(rng, rng.choice("xyz"), rng.randint(1, 60)) + " ψ") for _ in range(30)] + ["a", "ψψψ"]
    rate, size = model.rates(texts)
    for k, label in enumerate(model.labels):
        for j, t in enumerate(texts):
            want = 0
            for a in range(0, len(t), 37):
                part, begin, ended = t[a : a + 37], 0, 0
                for i in range(len(part)):
                    if part[begin : i + 1] not in samples[label]:
                        ended += 1
                        begin = i if part[i] in samples[label] else i + 1
                want += ended + 1
            assert round(rate[k, j] * size[j] / model.norms[k]) == want, (label, t)


def test_odd_texts(documents):
    rng = random.Random(5)
    base = [(i, sentence(rng, "xy"[i % 2], 30), "xy"[i % 2]) for i in range(30)]
    odd = [(100, None, "x"), (101, "", "x"), (102, "12 ²½ -- \n", None), (103, sentence(rng, "y", 20_000), None), (103, "ka lo", None), (None, "shra vosk", None)]
    df = documents(base + odd, "1 AS score").selectExpr("*", "2 AS lang_pred", "3 AS place", "4 AS passage")
    got = [(r.doc_id, r.lang_pred, r.score) for r in languages.identify(df).collect()]
    assert len(got) == len(base) + len(odd)
    assert {(100, "und", 0.0), (101, "und", 0.0), (102, "und", 0.0)} <= set(got)
    assert {(i, x) for i, x, _ in got if i in (103, None)} == {(103, "y"), (103, "x"), (None, "y")}
    kept = languages.accepted(df)
    assert kept.columns == df.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([*range(30), 103, 103, -1])
    assert languages.identify(df.limit(0)).collect() == []
    unlabelled = documents([(1, "abc")])
    assert [(r.lang_pred, r.score) for r in languages.identify(unlabelled).collect()] == [("und", 0.0)]


def test_score_is_high_when_one_language_fits():
    rng = random.Random(6)
    model = languages.Languages({k: languages.symbols(sentence(rng, k, 300)) for k in "xy"})
    labels, score, _ = languages.answer(model, pa.array([sentence(rng, "x", 100), edited(rng, sentence(rng, "y", 100), 2)]))
    assert labels == ["x", "y"] and min(score) > 0.3
