"""Vector scoring and retrieval. Relations: (id, v array<double>), references (ref, v[, label]).

Text encoders are a pluggable column producer; everything here starts at the vector. Scores are dot
products of unit vectors, computed as matrix products inside Arrow batches. A reference set is sent
to every task only after its size was counted; larger ones are cut into tiles (:mod:`tiles`), and only the
best few of a partition of tiles leave the task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from provloom.functions import vectors as vec
from provloom.operators import ordered, tiles
from provloom.session import cut_lineage

MAX_BROADCAST_FLOATS = 2_000_000
#: scores that a task holds at once for references that were sent to it
CELLS = 1 << 21
#: texts of a tile that meets labelled references; their products are made piece by piece
LABELLED_ROWS = 8192


def _matrix(vectors) -> np.ndarray:
    return tiles.unit_rows(np.array([np.asarray(v, dtype=np.float64) for v in vectors]))


def _small(refs: DataFrame) -> bool:
    row = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    return (row["n"] or 0) * (row["d"] or 0) <= MAX_BROADCAST_FLOATS


def _pieces(batch: pa.RecordBatch, n_refs: int):
    """Ids and unit vectors of a batch, few enough rows for the bound on scores."""
    step = max(1, CELLS // max(1, n_refs))
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part.column("id"), tiles.matrix(part.column("v"))


def _take(column: pa.Array, at: np.ndarray) -> pa.Array:
    return column.take(pa.array(at, pa.int64()))


def score_labels(texts: DataFrame, refs: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, label, score): best cosine of each text over the references of each label.

    The output has one row per text and label, so labels must be few; references are reduced to
    their best per label inside the task."""
    if not _small(refs):
        pairs = _block_best(texts, refs, id_type, per_label=True, k=1)
        return pairs.groupBy("id", "label").agg(F.max("score").alias("score"))
    label_type = refs.schema["label"].dataType.simpleString()
    rows = sorted(refs.select("label", "v").collect(), key=lambda r: r["label"])  # size checked above
    ddl = f"id {id_type}, label {label_type}, score double"
    if not rows:
        return texts.sparkSession.createDataFrame([], ddl)
    labels, kind = sorted({r["label"] for r in rows}), to_arrow_type(refs.schema["label"].dataType)
    starts = np.searchsorted([labels.index(r["label"]) for r in rows], np.arange(len(labels)))
    shared = texts.sparkSession.sparkContext.broadcast((labels, starts, tiles.unit_rows(np.array([r["v"] for r in rows], np.float64)).T))

    def run(batches):
        names, first, m = shared.value
        for batch in batches:
            for ids, z in _pieces(batch, m.shape[1]):
                best = tiles.segment_max(z @ m, first)
                yield pa.RecordBatch.from_arrays(
                    [_take(ids, np.repeat(np.arange(len(z)), len(names))), _take(pa.array(names, kind), np.tile(np.arange(len(names)), len(z))), pa.array(best.ravel())],
                    ["id", "label", "score"],
                )

    return texts.select("id", "v").mapInArrow(run, ddl)


def _top_rows(ids: pa.Array, best: tiles.Best, names: pa.Array, column: str = "ref") -> pa.RecordBatch:
    """Rows of the best references; ``names`` are those of all columns that were seen."""
    row, place = np.nonzero(best.at >= 0)
    return pa.RecordBatch.from_arrays([_take(ids, row), _take(names, best.at[row, place]), pa.array(best.score[row, place])], ["id", column, "score"])


def _block_best(texts: DataFrame, refs: DataFrame, id_type: str, per_label: bool, k: int, rows_per_block: int | None = None):
    name = "label" if per_label else "ref"
    parts, rows, ref_parts, ref_rows = tiles.shapes(texts, refs, rows_per_block, *([LABELLED_ROWS] if per_label else []))
    left, right = tiles.packed(texts.select("id", "v"), "id", parts, rows), tiles.packed(refs.select(name, "v"), name, ref_parts, ref_rows)
    ddl = f"id {id_type}, {name} {refs.schema[name].dataType.simpleString()}, score double"

    def add_best(tile, other, state, ask):
        state["best"].add(tile.m @ other.m.T)
        state["names"].append(_take(other.keys, other.segment()))
        yield from ()

    def give_best(tile, state):
        yield _top_rows(_take(tile.keys, tile.segment()), state["best"], pa.concat_arrays(state["names"]))

    def add_labels(tile, other, state, ask):
        labels = other.keys.to_pylist()
        known = [label in state for label in labels]
        best = np.full((len(tile.m), len(labels)), -np.inf)
        for j in np.flatnonzero(known):
            best[:, j] = state[labels[j]][2]
        if all(known):
            tiles.raise_max(tile, other, best)
        else:
            for i in range(0, len(tile.m), tiles.PIECE_ROWS):
                rows = slice(i, i + tiles.PIECE_ROWS)
                np.maximum(best[rows], tiles.segment_max(tile.m[rows] @ other.m.T, other.starts), out=best[rows])
        for j, label in enumerate(labels):
            state[label] = other.keys, j, best[:, j]
        yield from ()

    def give_labels(tile, state):
        ids = _take(tile.keys, tile.segment())
        for keys, j, best in state.values():
            yield pa.RecordBatch.from_arrays([ids, _take(keys, np.full(len(best), j)), pa.array(best)], ["id", name, "score"])

    if per_label:
        return tiles.met(left, right, ddl, lambda tile: {}, add_labels, give_labels)
    return tiles.met(left, right, ddl, lambda tile: {"best": tiles.Best(len(tile.m), k), "names": []}, add_best, give_best)


def top_references(texts: DataFrame, refs: DataFrame, k: int = 3, id_type: str = "long") -> DataFrame:
    """(id, ref, score, rank): the ``k`` references most similar to each text."""
    ref_type = refs.schema["ref"].dataType.simpleString()
    if _small(refs):
        rows = sorted(refs.select("ref", "v").collect(), key=lambda r: r["ref"])  # size checked above
        if not rows:
            return ordered.top_k(texts.sparkSession.createDataFrame([], f"id {id_type}, ref {ref_type}, score double"), ["id"], [F.desc("score"), F.asc("ref")], k)
        m = tiles.unit_rows(np.array([r["v"] for r in rows], np.float64)).T
        shared, kind = texts.sparkSession.sparkContext.broadcast(([r["ref"] for r in rows], m)), to_arrow_type(refs.schema["ref"].dataType)

        def run(batches):
            names, m = shared.value
            names = pa.array(names, kind)
            for batch in batches:
                for ids, z in _pieces(batch, m.shape[1]):
                    best = tiles.Best(len(z), k)
                    best.add(z @ m)
                    yield _top_rows(ids, best, names)

        best = texts.select("id", "v").mapInArrow(run, f"id {id_type}, ref {ref_type}, score double")
    else:
        best = _block_best(texts, refs, id_type, per_label=False, k=k)
    return ordered.top_k(best, ["id"], [F.desc("score"), F.asc("ref")], k)


def _tiled(rows: DataFrame, columns: DataFrame, pairs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Tiles of a text's rows and of the references' columns, the rows' with the wanted pairs."""
    parts, n, ref_parts, ref_n = tiles.shapes(rows, columns)
    left, right = tiles.packed(rows, "id", parts, n), tiles.packed(columns, "ref", ref_parts, ref_n)
    return (left if pairs is None else tiles.with_wanted(left, pairs, parts)), right


def late_interaction(rows: DataFrame, columns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(id, ref, score): mean over the text's row vectors of the best match among the reference's
    column vectors, for the wanted (id, ref) pairs, or for all.

    ``rows`` (id, pos, v), ``columns`` (ref, pos, v). Tiles of rows meet tiles of columns; of a reference that lies in
    one tile only a text's sum leaves it, of one that does not the best value of a row over the tiles of a partition."""
    left, right = _tiled(rows.select("id", "pos", "v"), columns.select("ref", "pos", "v"), pairs)
    id_t, ref_t = rows.schema["id"].dataType.simpleString(), columns.schema["ref"].dataType.simpleString()

    def found(ids, refs, pos, whole, total, n):
        size = len(total)
        return pa.RecordBatch.from_arrays(
            [ids, refs, pa.array(pos, pa.int64()), pa.array(np.full(size, whole)), pa.array(total), pa.array(n, pa.int64())], ["id", "ref", "pos", "whole", "total", "n"]
        )

    def step(tile, other, state, ask):
        if ask is not None and not ask.any():
            return
        s = tiles.segment_max(tile.m @ other.m.T, other.starts)
        if len(tile.runs) < len(s):
            s = np.maximum.reduceat(s, tile.runs, axis=0)  # rows of one place count once
        for j in np.flatnonzero(other.cut).tolist():
            key = other.keys[j].as_py()
            best = np.maximum(state[key][2], s[:, j]) if key in state else s[:, j].copy()
            state[key] = other.keys, j, best, None if ask is None else ask[:, j]
        whole = np.flatnonzero(~other.cut)
        if len(whole):
            first = np.searchsorted(tile.runs, tile.starts)
            total = np.add.reduceat(s[:, whole], first, axis=0)
            size = np.diff(np.append(first, len(s)))
            i, j = np.nonzero(np.ones(total.shape, bool) if ask is None else ask[:, whole])
            yield found(_take(tile.keys, i), _take(other.keys, whole[j]), np.zeros(len(i), np.int64), True, total[i, j], size[i])

    def finish(tile, state):
        segment = tile.segment()[tile.runs]
        for keys, j, best, asked in state.values():
            at = np.arange(len(best)) if asked is None else np.flatnonzero(asked[segment])
            if len(at):
                refs = _take(keys, np.full(len(at), j))
                yield found(_take(tile.keys, segment[at]), refs, tile.pos[tile.runs][at], False, best[at], np.ones(len(at), np.int64))

    out = tiles.met(left, right, f"id {id_t}, ref {ref_t}, pos long, whole boolean, total double, n long", lambda tile: {}, step, finish)
    total = F.when(F.col("whole"), F.sum("total")).otherwise(F.max("total"))
    n = F.when(F.col("whole"), F.sum("n")).otherwise(F.lit(1).cast("long"))
    per_row = out.groupBy("id", "ref", "whole", "pos").agg(total.alias("total"), n.alias("n"))
    return per_row.groupBy("id", "ref").agg((F.sum("total") / F.sum("n")).alias("score"))


def two_stage(
    texts: DataFrame, refs: DataFrame, rows: DataFrame, columns: DataFrame, k: int = 5, keep: int = 3
) -> DataFrame:
    """Top-``k`` by pooled cosine, re-ranked by late interaction, best ``keep`` stay."""
    id_t = texts.schema["id"].dataType.simpleString()
    first = top_references(texts, refs, k, id_t).select("id", "ref", F.col("score").alias("pooled"))
    second = late_interaction(rows, columns, first)
    both = first.join(second, ["id", "ref"])
    return ordered.top_k(both, ["id"], [F.desc("score"), F.desc("pooled"), F.asc("ref")], keep)


def final_scores(ranked: DataFrame, baseline: DataFrame) -> DataFrame:
    """Best candidate score of a text minus its similarity to the benign reference."""
    top = ranked.filter("rank = 1").select("id", "ref", "score")
    return top.join(baseline.select("id", F.col("score").alias("benign")), "id").withColumn(
        "final", F.col("score") - F.col("benign")
    )


def best_sentence_pairs(
    rows: DataFrame, columns: DataFrame, pairs: DataFrame, pool: int = 10, top: int = 3, digits: int | None = None
) -> DataFrame:
    """Per (id, ref): the ``pool`` best cells of the sentence matrix, equal text pairs once, first
    ``top``. With ``digits`` cells are rounded before they are compared. ``rows`` (id, pos, text, v), ``columns`` (ref, pos, text, v). Tiles of rows
    and columns meet in a task and only the pool of each pair of tiles leaves it."""
    left, right = _tiled(rows.select("id", "pos", "text", "v"), columns.select("ref", "pos", "text", "v"), pairs)
    id_t, ref_t = rows.schema["id"].dataType.simpleString(), columns.schema["ref"].dataType.simpleString()

    def cells(tile, other, state, ask):
        ends, other_ends = np.append(tile.starts[1:], len(tile.m)), np.append(other.starts[1:], len(other.m))
        at = []
        for i, j in zip(*np.nonzero(ask), strict=True):
            a, b = tile.starts[i], other.starts[j]
            sims = tile.m[a : ends[i]] @ other.m[b : other_ends[j]].T
            if digits is not None:
                sims = np.round(sims, digits)
            flat = sims.ravel()
            low = np.partition(flat, -pool)[-pool] if len(flat) > pool else -np.inf
            near = np.flatnonzero(flat >= low)
            near = near[np.argsort(-flat[near], kind="stable")[:pool]]  # ties by place, as rows are sorted by it
            r, c = np.unravel_index(near, sims.shape)
            at.append((np.full(len(near), i), np.full(len(near), j), a + r, b + c, flat[near]))
        if at:
            i, j, r, c, found = (np.concatenate(x) for x in zip(*at, strict=True))
            yield pa.RecordBatch.from_arrays(
                [_take(tile.keys, i), _take(other.keys, j), _take(tile.texts, r), _take(other.texts, c), pa.array(found), pa.array(tile.pos[r]), pa.array(other.pos[c])],
                ["id", "ref", "row_text", "ref_text", "score", "row_pos", "ref_pos"],
            )

    ddl = f"id {id_t}, ref {ref_t}, row_text string, ref_text string, score double, row_pos long, ref_pos long"
    best = tiles.met(left, right, ddl, lambda tile: None, cells, lambda tile, state: iter(()))
    pooled = ordered.top_k(best, ["id", "ref"], [F.desc("score"), F.asc("row_pos"), F.asc("ref_pos")], pool, "_r")
    once = pooled.groupBy("id", "ref", "row_text", "ref_text").agg(F.min("_r").alias("_r"), F.max("score").alias("score"))
    return ordered.top_k(once, ["id", "ref"], [F.asc("_r")], top).drop("_r")


def explain_tokens(rows: DataFrame, columns: DataFrame, ref: str, top: int = 5) -> DataFrame:
    """Best non-punctuation token of one reference per row vector (the overall best when all are
    punctuation), best ``top`` rows per text. ``columns`` (ref, pos, token, v)."""
    punct = r"^[\p{Punct}–—]*$"
    toks = columns.filter(F.col("ref") == ref).select(
        F.col("token").alias("ref"), "v", F.col("token").rlike(punct).alias("is_punct"), F.col("pos").alias("tpos")
    )
    words = toks.filter(~F.col("is_punct"))
    use = words if words.limit(1).count() else toks
    unique = use.groupBy("ref").agg(F.min_by("v", "tpos").alias("v"))
    keyed = rows.select(F.struct("id", "pos").alias("id"), "v")
    best = top_references(keyed, unique, 1, "struct<id:{},pos:bigint>".format(rows.schema["id"].dataType.simpleString()))
    flat = best.select(F.col("id.id").alias("id"), F.col("id.pos").alias("pos"), F.col("ref").alias("token"), F.round("score", 4).alias("score"))
    return ordered.top_k(flat, ["id"], [F.desc("score"), F.asc("pos")], top)


def chunk_tokens(tokens: DataFrame, size: int = 512, stride: int = 384) -> DataFrame:
    """(id, chunk, start, tokens): a lead token plus up to ``size - 1`` tokens, starting at position 1
    and every ``stride``, to the end. ``tokens`` (id, tokens array) with the lead token first."""
    n = F.size("tokens")
    starts = F.when(n > 1, F.sequence(F.lit(1), n - 1, F.lit(stride))).otherwise(F.array(F.lit(1)))
    return tokens.select("id", "tokens", F.posexplode(starts).alias("chunk", "start")).select(
        "id",
        F.col("chunk").cast("long").alias("chunk"),
        F.col("start").cast("long").alias("start"),
        F.concat(F.slice("tokens", 1, 1), F.slice("tokens", F.col("start") + 1, F.lit(size - 1))).alias("tokens"),
    )


def mean_pool(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean vector per key. The length of a vector is that of the first one; every entry is a partial sum of its own column,
    so a task hands on one row per key, and no entry is a row."""
    first = vectors.filter(F.col("v").isNotNull()).select(F.size("v").alias("n")).first()
    if first is None:
        return vectors.select(*keys, "v").limit(0)
    means = [F.avg(F.get("v", F.lit(i))).alias(f"_v{i}") for i in range(first["n"])]
    return vectors.groupBy(*keys).agg(*means).select(*keys, F.array(*[f"_v{i}" for i in range(first["n"])]).alias("v"))


def fold_prototypes(vectors: DataFrame) -> DataFrame:
    """(fold, label, v): for every file the mean vector per label of all other files. Vectors (file, label, v) are
    summed once per file and label; a fold is the label's total less the file's own part, so no row is
    copied into the folds. A label that only one file has is missing in that file's fold."""
    rows = vectors.filter(F.col("v").isNotNull())
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return vectors.select(F.col("file").alias("fold"), "label", "v").limit(0)
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"_v{i}") for i in range(first["n"])]
    entries = F.array(*[F.col(f"_v{i}") for i in range(first["n"])])
    own = cut_lineage(rows.groupBy("file", "label").agg(F.count(F.lit(1)).alias("n"), *sums).select("file", "label", "n", entries.alias("own")))
    total = own.withColumnRenamed("own", "v").groupBy("label").agg(F.sum("n").alias("total_n"), *sums).select("label", "total_n", entries.alias("total"))
    labels = own.agg(F.collect_set("label").alias("labels"))  # one row; labels are few
    every = vectors.select("file").distinct().join(F.broadcast(labels)).select("file", F.explode("labels").alias("label"))
    left = F.col("total_n") - F.coalesce("n", F.lit(0))
    rest = F.coalesce(F.zip_with("total", "own", lambda x, y: x - y), F.col("total"))
    out = every.join(total, "label").join(own, ["file", "label"], "left").select(F.col("file").alias("fold"), "label", left.alias("n"), rest.alias("v"))
    return out.filter("n > 0").select("fold", "label", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def score_folds(texts: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, fold, label, score): cosine of every text (id, file, v) with the prototypes of its own file's fold, for all
    folds in one join."""
    t = texts.select("id", F.col("file").alias("fold"), vec.unit(F.col("v")).alias("_t"))
    p = prototypes.select("fold", "label", vec.unit(F.col("v")).alias("_p"))
    return t.join(p, "fold").select("id", "fold", "label", vec.dot(F.col("_t"), F.col("_p")).alias("score"))


def fold_accuracy(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(fold, n, n_correct, accuracy) of the texts' best labels against truth (id, label); a text is in one fold."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("l")))
    pred = scores.groupBy("fold", "id").agg(best.alias("b")).select("fold", "id", F.col("b.l").alias("predicted"))
    ok = (F.col("predicted") == F.col("label")).cast("long")
    return pred.join(truth.select("id", "label"), "id").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_correct"), F.avg(ok.cast("double")).alias("accuracy")
    )


def token_means(token_vectors: DataFrame) -> DataFrame:
    """(id, token, v): mean vector of each token over the chunks that cover it. ``token_vectors``:
    id, start of the chunk, offset inside it (0 is the lead token, left out), v."""
    at = token_vectors.filter("offset > 0").withColumn("token", F.col("start") + F.col("offset") - 1)
    return mean_pool(at, ["id", "token"])


def hashed_vectors(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(id, v): the built-in embedder, a unit vector of hashed word counts. Any producer of (id, v)
    can stand in for it. Words are counted before they meet, so long texts spread."""
    words = texts.select("id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).filter("w <> ''")
    bucket = F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("long") % dim
    n = words.groupBy("id", bucket.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most ``dim`` entries per text
    m = n.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    zero = F.lit(0.0)
    v = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), zero))
    return m.select("id", v.alias("v")).select("id", vec.unit(F.col("v")).alias("v"))


def write_embeddings(meta: DataFrame, vectors: DataFrame, path: str) -> None:
    """Embedding table: metadata and vector per row."""
    meta.join(vectors, "id").write.mode("overwrite").parquet(path)


def softmax_scores(scores: DataFrame, scale: float) -> DataFrame:
    """Scaled softmax over the labels of each text, rounded to 6 decimals."""
    w = Window.partitionBy("id")  # one row per label
    x = F.col("score") * F.lit(scale)
    e = scores.withColumn("_x", x).withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(w)))
    return e.withColumn("score", F.round(F.col("_e") / F.sum("_e").over(w), 6)).drop("_x", "_e")


def rank_labels(scores: DataFrame) -> DataFrame:
    """Add ``rank`` of each label per text, best first, ties in label order."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("label"))  # one row per label
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def predictions(scores: DataFrame) -> DataFrame:
    """(id, predicted, score): best label per text, ties to the smaller label."""
    return (
        scores.groupBy("id")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("l"))).alias("b"))
        .select("id", F.col("b.l").alias("predicted"), (-F.col("b.s")).alias("score"))
    )


def accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    j = pred.join(truth.select("id", "label"), "id")
    ok = (F.col("predicted") == F.col("label")).cast("long")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_correct"), F.avg(ok.cast("double")).alias("accuracy")
    )


def score_matrix(scores: DataFrame, truth: DataFrame, labels: Sequence) -> DataFrame:
    """Text x label display matrix; the true label's cell is marked in ``true_label``."""
    wide = scores.groupBy("id").pivot("label", list(labels)).agg(F.first("score"))
    return wide.join(truth.select("id", F.col("label").alias("true_label")), "id", "left")


def extreme_best(scores: DataFrame) -> DataFrame:
    """Negative baseline: largest and smallest best score over the texts."""
    best = scores.groupBy("id").agg(F.max("score").alias("best"))
    return best.agg(F.max("best").alias("max_best"), F.min("best").alias("min_best"))


def best_checkpoint(scores: DataFrame) -> DataFrame:
    """Checkpoint with the largest score on the first text; the earlier one wins a tie."""
    first = scores.groupBy("checkpoint", "id").agg(F.max("score").alias("score"))
    head = first.agg(F.min("id").alias("id"))
    return (
        first.join(F.broadcast(head), "id")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "checkpoint")).alias("b"))
        .select(F.col("b.checkpoint").alias("checkpoint"), (-F.col("b.s")).alias("score"))
    )
