"""Secret scan: fixed patterns and a battery of randomness tests under false-discovery control.

Three kinds are found by pattern: ``assign`` (a secret word, a sign, a value), ``access`` (key ids) and ``hex``
(long lower-case hexadecimal runs). Besides, every run of 20 or more signs of base64 or its URL form, padding at its
end only, is put to the battery, and so is every part of 20 or more between its ``/``, ``-`` and ``_``: a value behind a
name and ``=``, or behind the path of an address, is tested by itself. Of a run that a pattern's span cuts, what is
left outside is tested. The encoding is inferred as the smallest alphabet that holds the run. Three statistics are
taken: chi-squared of the signs against a uniform alphabet, changes between kinds of signs (runs), and the
lag-one serial correlation of sign numbers. For each the chance is computed that ordinary text gives a value
as random as this; the expectation for ordinary text comes from sign counts over all documents. The
chances are combined by Fisher's rule. Runs of like length form a band, and within a band Benjamini and
Hochberg's step-up rule at ``level`` decides over all candidates of all documents, from a histogram of the
chances. A run that the uniform alphabet itself rejects is dropped: it is neither text nor random.

Spans are code points, end exclusive. Found spans never overlap a pattern's span, patterns stay; of a found run its
parts are not told again.

Defined results: a null text is empty and has no spans; repeated rows are answered each; an empty table gives
no rows; extra columns pass by. Whole texts are searched; what is gathered is 512 counts and one histogram of
fixed size."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.batches import flat, pieces
from provloom.llm.shared import written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
SECRET_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+]{20,}={0,2}")

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: alphabets from small to large
ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _LOWER + _DIGITS, _UPPER + _DIGITS, _UPPER + _LOWER,
    _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_", _UPPER + _LOWER + _DIGITS + "+/-_",
)
_SETS = [frozenset(a) for a in ALPHABETS]
_PLACE = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
#: lower bounds of the length bands
BANDS = (20, 24, 32, 48, 96)
#: chances are counted in steps of a tenth of their natural logarithm, down to exp(-100)
STEPS = 1000
LEVEL = 0.01
#: chance below which the uniform alphabet is rejected, of any of three tests
UNIFORM_LEVEL = 1e-3

_CLASS = np.zeros(128, np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[[43, 47, 45, 95]] = 4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, in order of start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in SECRET_WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def tested_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs outside the patterns' spans, and their parts."""
    out = []
    for m in RUN.finditer(text):
        a, end = m.span()
        pieces_ = []
        for s, e, _ in base:  # in order of start
            if e > a and s < end:
                pieces_.append((a, s))
                a = max(a, e)
        for s, e in (*pieces_, (a, end)):
            if e - s >= BANDS[0]:
                out.append((s, e))
                out += [p.span() for p in PART.finditer(text, s, e) if p.span() != (s, e)]
    return out


def statistics(run: str) -> tuple[int, float, int, float]:
    """Alphabet number, chi-squared, changes of sign kind, serial correlation; padding is cut off before."""
    body = run.rstrip("=")
    signs = set(body)
    k = next((i for i, a in enumerate(_SETS) if signs <= a), -1)
    if k < 0 or len(body) < BANDS[0]:
        return -1, 0.0, 0, 0.0
    place = _PLACE[k]
    x = np.array([place[c] for c in body], float)
    n, size = len(x), len(ALPHABETS[k])
    counts = np.bincount(x.astype(int), minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    kind = _CLASS[np.frombuffer(body.encode("ascii"), np.uint8)]
    changes = int((kind[1:] != kind[:-1]).sum())
    centred = x - x.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum() / power) if power else 1.0
    return k, chi, changes, serial


class TextModel:
    """What ordinary text shows: shares of signs, of kind changes, and lag-one correlation per alphabet, from
    counts over all documents."""

    def __init__(self, signs: np.ndarray, pairs: np.ndarray):
        self.shares, self.moments = [], []
        for a in ALPHABETS:
            q = signs[[ord(c) for c in a]].astype(float) + 0.5
            q /= q.sum()
            size = len(a)
            s2, s3 = float((q**2).sum()), float((q**3).sum())
            self.shares.append(q)
            self.moments.append((size, s2, s3))
        self.change = (float(pairs[1]) + 0.5) / (float(pairs.sum()) + 1)

    def log_chance(self, n: int, k: int, chi: float, changes: int, serial: float) -> float:
        """Natural logarithm of the combined chance that text looks as random as this."""
        size, s2, s3 = self.moments[k]
        mean = size * (1 - s2) + n * (size * s2 - 1)
        spread = math.sqrt(max(1e-9, 4 * n * size**2 * (s3 - s2**2) + 2 * (size * s2) ** 2))
        uniform = _lower_tail((chi - mean) / spread)
        runs = _binomial_upper(n - 1, changes, self.change) if len({*_class_set(k)}) > 1 else 1.0
        against = _lower_tail(-abs(serial) * math.sqrt(n))
        flat_serial = min(1.0, max(1e-12, 1 - 2 * against))  # text is taken to show no less correlation than chance
        x = -(math.log(max(uniform, 1e-300)) + math.log(max(runs, 1e-300)) + math.log(max(flat_serial, 1e-12)))
        return -x + math.log1p(x + x * x / 2)


def _class_set(k: int) -> set[int]:
    return {int(_CLASS[ord(c)]) for c in ALPHABETS[k]}


def _lower_tail(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _binomial_upper(n: int, k: int, p: float) -> float:
    """Chance of k or more, by Chernoff's bound, which is on the safe side."""
    share = k / n if n else 0
    if share <= p:
        return 1.0
    if share >= 1:
        return p**n
    return math.exp(-n * (share * math.log(share / p) + (1 - share) * math.log((1 - share) / (1 - p))))


def is_uniform(n: int, k: int, chi: float, changes: int, serial: float) -> bool:
    """Whether the uniform alphabet is not rejected by any of the three tests."""
    size = len(ALPHABETS[k])
    z = abs(_deviate(UNIFORM_LEVEL / 6))
    if (chi - (size - 1)) / math.sqrt(2 * (size - 1)) > z + 1 or abs(serial) * math.sqrt(n) > z + 1:
        return False
    counts: dict[int, int] = {}
    for c in ALPHABETS[k]:
        counts[int(_CLASS[ord(c)])] = counts.get(int(_CLASS[ord(c)]), 0) + 1
    p = 1 - sum((v / size) ** 2 for v in counts.values())
    return len(counts) == 1 or abs(changes - (n - 1) * p) <= (z + 1) * math.sqrt((n - 1) * p * (1 - p)) + 1


def _deviate(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def sign_counts(docs: DataFrame) -> TextModel:
    """Signs of all texts, and neighbouring signs of equal and of different kind: 130 numbers."""

    def run(batches):
        signs, pairs = np.zeros(128, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, _ = flat(part.column("text"))
                ascii_ = data < 128
                kind = np.where(ascii_, _CLASS[data & 127], 0)
                signs += np.bincount(data[ascii_], minlength=128)
                both = (kind[1:] > 0) & (kind[:-1] > 0)
                n, d = int(both.sum()), int((both & (kind[1:] != kind[:-1])).sum())
                pairs += (n - d, d)
        yield pa.RecordBatch.from_arrays([pa.array(range(130), pa.int32()), pa.array(np.concatenate([signs, pairs]))], ["i", "n"])

    rows = docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(130, np.int64)
    for r in rows:
        out[r.i] = r.n
    return TextModel(out[:128], out[128:])


_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("chi", pa.float64()), ("changes", pa.int32()), ("serial", pa.float64())])
_FOUND_DDL = "array<struct<start: long, end: long, k: int, n: int, chi: double, changes: int, serial: double>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: the patterns' spans and the statistics of the runs beside them."""

    def one(text: str):
        base = base_spans(text)
        found = []
        for s, e in tested_spans(text, base):
            k, chi, changes, serial = statistics(text[s:e])
            if k >= 0:
                found.append({"start": s, "end": e, "k": k, "n": len(text[s:e].rstrip("=")), "chi": chi, "changes": changes, "serial": serial})
        return base, found

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [one(t or "") for t in part.column("text").to_pylist()]
                base = [told(b) for b, _ in rows]
                count = [[sum(k == kind for _, _, k in b) for b, _ in rows] for kind in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array(base, pa.string()),
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([f for _, f in rows], pa.list_(_FOUND)),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base", "base_sha256", "found"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, base_sha256 string, found {_FOUND_DDL}"
    )


def band_of(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def thresholds(histogram: dict[tuple[int, int], int], level: float = LEVEL) -> list[int]:
    """Per band the smallest step that counts as found: step-up over the candidates of the band, a step's
    chance being that of its upper end."""
    out = []
    for band in range(len(BANDS)):
        steps = {s: n for (b, s), n in histogram.items() if b == band}
        m, seen, best = sum(steps.values()), 0, STEPS + 1
        for s in sorted(steps, reverse=True):  # from the smallest chance up
            seen += steps[s]
            if math.exp(-s / 10) <= level * seen / m:
                best = s
        out.append(best)
    return out


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """One row per document with the patterns' counts, their digest, and all spans in order."""
    model = sign_counts(docs)
    held = written(candidates(docs), "secret-candidates")

    def step(f: dict) -> int:
        return min(STEPS, max(0, int(-10 * model.log_chance(f["n"], f["k"], f["chi"], f["changes"], f["serial"]))))

    def tally(batches):
        count: dict[tuple[int, int], int] = {}
        for batch in batches:
            for row in batch.column("found").to_pylist():
                for f in row:
                    key = band_of(f["n"]), step(f)
                    count[key] = count.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in count], pa.int32()), pa.array([s for _, s in count], pa.int32()), pa.array(list(count.values()), pa.int64())],
            ["band", "step", "n"],
        )

    tallied = held.select("found").mapInArrow(tally, "band int, step int, n long").groupBy("band", "step").agg(F.sum("n").alias("n"))
    least = thresholds({(r.band, r.step): r.n for r in tallied.collect()}, level)  # bands x steps rows at most

    def run(batches):
        for batch in batches:
            spans, more = [], []
            for base, row in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
                new = [
                    (f["start"], f["end"], "random") for f in row
                    if step(f) >= least[band_of(f["n"])] and is_uniform(f["n"], f["k"], f["chi"], f["changes"], f["serial"])
                ]
                new.sort(key=lambda x: (x[0], -x[1]))
                new = [x for i, x in enumerate(new) if all(y[1] < x[1] for y in new[:i])]  # parts of a found run
                old = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                order = {k: i for i, k in enumerate((*KINDS, "random"))}
                spans.append(told(sorted(old + new, key=lambda x: (x[0], order[x[2]]))))
                more.append(len(new))
            kept = [batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return held.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
