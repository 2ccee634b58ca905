"""Language identification by cross-parsing.

Of the labelled rows a bounded sample is kept per language: passages from up to ``rows`` documents, picked by
a hash, ``chars`` code points of one language at most. A suffix automaton of each sample accepts exactly the
strings that occur in it. A text is parsed from left to right into longest matches: the automaton is followed
as far as it goes, a phrase ends there, the next phrase starts with the next symbol. A language that the text
is written in needs few phrases. Phrases are normalised by the number of symbols and by the length that random
phrases have against a sample of that size; the language with the smallest number wins, ties go to the smaller
label.

Symbols are lower-case letters; every run of anything else is one blank. A symbol that a sample lacks is a phrase of its own.
Texts are parsed in stretches of ``STRETCH`` symbols, each beginning a phrase, so that thousands of stretches
advance together.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled row every
text is ``und``; rows with a null label or text are not learnt from; repeated rows are answered each; extra columns
pass by. Memory: automata of all languages hold ``total`` code points at most, whatever the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provloom.llm.batches import pieces

#: bounds of the labelled sample: documents per language, code points of one passage, per language, in all
SAMPLE_ROWS, PASSAGE, SAMPLE_CHARS, SAMPLE_TOTAL = 64, 512, 16_384, 1_000_000
STRETCH = 512
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def symbols(text: str) -> str:
    """Lower-case letters, each run of anything else between them one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, passage: int = PASSAGE) -> DataFrame:
    """lang, passage: of up to ``rows`` learnable documents per language one passage at a hashed place."""
    able = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    able = able.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("place"))
    room = F.greatest(F.length("text") - passage, F.lit(0)) + 1
    able = able.select("lang", "place", F.substring("text", (F.pmod("place", room) + 1).cast("int"), F.lit(passage)).alias("passage"))
    best = Window.partitionBy("lang").orderBy("place", "passage")
    return able.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rows).orderBy("lang", "n").select("lang", "passage")


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that accepts every substring of ``text``; state 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


class Languages:
    """Automata of all labels as one table: row = state, column = symbol number, value = next state or -1."""

    def __init__(self, passages: dict[str, str]):
        self.labels = sorted(passages)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(passages.values()))))}
        width = len(self.alphabet) + 1  # column 0: symbols of no sample
        self.tables, self.norms = [], []
        for label in self.labels:
            step = suffix_automaton(passages[label])
            t = np.full((len(step), width), -1, np.int32)
            for s, d in enumerate(step):
                for c, to in d.items():
                    t[s, self.alphabet[c]] = to * width  # states are kept as offsets of their rows
            self.tables.append(t.ravel())
            self.norms.append(float(np.log(len(passages[label]) + 2)))
        self.codes = np.zeros(0x110000, np.int32)
        for c, i in self.alphabet.items():
            self.codes[ord(c)] = i

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases that each stretch needs, per label. ``codes`` has a column per stretch and a row per place;
        stretches are in falling order of size."""
        out = np.ones((len(self.labels), len(sizes)), np.int64)  # the last phrase of each
        alive = np.searchsorted(-sizes, -np.arange(len(codes)), "left")  # stretches that have a place
        for count, table in zip(out, self.tables, strict=True):
            begin = np.maximum(table[: len(self.alphabet) + 1], 0)
            state = np.zeros(len(sizes), np.int32)
            for t, n in enumerate(alive.tolist()):
                c = codes[t, :n]
                to = table.take(state[:n] + c)
                ended = to < 0
                count[:n] += ended
                state[:n] = np.where(ended, begin.take(c), to)
        return out

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol numbers of all texts, as :func:`symbols` has them, and the symbols of each text."""
        low = [t.lower() for t in texts]
        of = np.repeat(np.arange(len(low)), [len(t) for t in low])
        point = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[point]
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (of[1:] == of[:-1])  # a blank stands right after a letter only
        at = np.flatnonzero(keep)
        owner = of[at]
        ends = np.append(owner[1:] != owner[:-1], True)[: len(at)]
        at = at[letter[at] | ~ends]  # and not at the end
        codes = np.where(letter[at], self.codes[point[at]], self.codes[32])
        return codes, np.bincount(of[at], minlength=len(low))

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases per symbol, labels x texts, and the symbols of each text."""
        codes, size = self.coded(texts)
        begins = np.cumsum(size) - size
        parts = -(-size // STRETCH)
        of = np.repeat(np.arange(len(texts)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes = begins[of] + k * STRETCH, np.minimum(size[of] - k * STRETCH, STRETCH)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, of = starts[order], sizes[order], of[order]
        depth = np.arange(int(sizes[0]) if len(sizes) else 0)
        grid = codes.take(starts[None] + depth[:, None], mode="clip")  # places past a stretch's end are not read
        found = self.phrases(grid, sizes)
        total = np.zeros((len(self.labels), len(texts)))
        for row, f in zip(total, found, strict=True):
            np.add.at(row, of, f)
        return total * np.array(self.norms)[:, None] / np.maximum(size, 1), size


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, passage: int = PASSAGE, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> dict[str, str]:
    """Training text of each label, within the bounds of the sample."""
    held: dict[str, list[str]] = {}
    for r in labelled_sample(docs, rows, passage).toLocalIterator():
        if s := symbols(r.passage):
            held.setdefault(r.lang, []).append(s)
    most = min(chars, total // max(1, len(held)))
    return {lang: " ".join(p)[:most] for lang, p in held.items()}


_MODELS: dict[tuple, Languages] = {}


def model_of(passages: dict[str, str]) -> Languages | None:
    """The automata, built once per worker."""
    key = tuple(sorted(passages.items()))
    if passages and key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Languages(passages)
    return _MODELS.get(key)


def answer(model: Languages | None, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """Label, score and phrase rate of each text. Score: 1 less the winner's rate over the runner-up's."""
    texts = [t or "" for t in column.to_pylist()]
    if model is None or not texts:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    rate, size = model.rates(texts)
    best = rate.argmin(0)
    low = rate.min(0)
    second = np.partition(rate, 1, 0)[1] if len(rate) > 1 else np.full(len(texts), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.clip(1 - low / second, 0, 1)
    labels = [model.labels[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)]
    score[size == 0] = 0
    return labels, score.tolist(), low.tolist()


def identify(docs: DataFrame, learn_from: DataFrame | None = None, **bounds) -> DataFrame:
    """doc_id, lang_pred, score and rate (normalised phrases per symbol of the winner) of every row."""
    spark = docs.sparkSession
    passages = learn(docs if learn_from is None else learn_from, **bounds)
    shipped = spark.sparkContext.broadcast(passages)  # at most ``total`` code points

    def run(batches):
        model = model_of(shipped.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                labels, score, rate = answer(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                    ["doc_id", "lang_pred", "score", "rate"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rate double")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is known; all columns."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(learn(docs))

    def run(batches):
        model = model_of(shipped.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                labels, _, _ = answer(model, part.column("text"))
                yield part.filter(pc.not_equal(pa.array(labels, pa.string()), UNKNOWN))

    return docs.mapInArrow(run, docs.schema)
