"""Vector scoring, retrieval, ranking metrics and losses over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from provloom.functions import vectors as vec
from provloom.operators import catalog, metrics, ordered, score, splits
from provloom.plans.registry import named
from provloom.plans.views import query

_E = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
_U = f"""e AS ({_E}), u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"""
# mean of the unit vectors of a label
_C = f"""{_U}, d AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM u),
    m AS (SELECT label, i, avg(x) AS x FROM d GROUP BY label, i),
    c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)"""
_S = f"""{_C}, s AS (SELECT u.id, c.label, u.label AS truth_label, list_cosine_similarity(u.v, c.v) AS score FROM u, c)"""
_P = f"""{_S}, p AS (SELECT id, label, truth_label, round(exp(20 * score) / sum(exp(20 * score)) OVER (PARTITION BY id), 6) AS score FROM s),
    t AS (SELECT *, CASE WHEN label = truth_label OR label = (truth_label + 3) % 10 THEN 1 ELSE 0 END AS truth FROM p)"""


def unit_vectors(spark, sf):
    e = query(spark, sf, "SELECT vec_id AS id, embedding, label FROM embeddings")
    return e.select("id", "label", vec.unit(vec.to_double(F.col("embedding"))).alias("v"))


def centroids(spark, sf):
    return score.mean_pool(unit_vectors(spark, sf), ["label"])


def label_scores(spark, sf):
    return score.score_labels(unit_vectors(spark, sf), centroids(spark, sf))


def members(spark, sf):
    """Each vector belongs to its own label and to the third after it."""
    e = query(spark, sf, "SELECT vec_id AS id, label FROM embeddings")
    return e.unionByName(e.withColumn("label", ((F.col("label") + 3) % 10).cast("int")))


def truth(spark, sf):
    return query(spark, sf, "SELECT vec_id AS id, label FROM embeddings")


def probabilities(spark, sf):
    """Softmax scores with their 0/1 truth."""
    return metrics.truth_table(score.softmax_scores(label_scores(spark, sf), 20.0), members(spark, sf))


@named(
    "unit_vectors",
    f"WITH {_U} SELECT id, round(v[1], 6) AS x_first, round(v[64], 6) AS x_last, round(list_dot_product(v, v), 6) AS len2 FROM u",
)
def unit_vector_check(spark, sf):
    u = unit_vectors(spark, sf)
    return u.select(
        "id", F.round(F.get("v", F.lit(0)), 6).alias("x_first"), F.round(F.get("v", F.lit(63)), 6).alias("x_last"),
        F.round(vec.dot(F.col("v"), F.col("v")), 6).alias("len2"),
    )


@named("label_centroids", f"WITH {_C} SELECT label, i, round(x, 6) AS x FROM m")
def label_centroids(spark, sf):
    """Mean-pooled vectors per label, one row per dimension."""
    c = centroids(spark, sf).select("label", F.posexplode("v").alias("i", "x"))
    return c.select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@named("label_similarity", f"WITH {_S} SELECT id, label, round(score, 6) AS score FROM s")
def label_similarity(spark, sf):
    return label_scores(spark, sf).withColumn("score", F.round("score", 6))


@named(
    "best_template_per_label",
    f"""WITH {_U} SELECT a.id, b.label, round(max(list_dot_product(a.v, b.v)), 6) AS score FROM u a, u b GROUP BY a.id, b.label""",
)
def best_template_per_label(spark, sf):
    """Best score of each text over the several templates of each label."""
    u = unit_vectors(spark, sf)
    return score.score_labels(u, u).withColumn("score", F.round("score", 6))


@named(
    "label_similarity_matrix",
    f"""WITH {_S}, x AS (SELECT id, truth_label, label, round(score, 4) AS score FROM s)
    SELECT id, truth_label AS true_label, {', '.join(f"max(CASE WHEN label = {i} THEN score END) AS l{i}" for i in range(10))} FROM x GROUP BY id, truth_label""",
)
def label_similarity_matrix(spark, sf):
    m = score.score_matrix(label_scores(spark, sf).withColumn("score", F.round("score", 4)), truth(spark, sf), list(range(10)))
    return m.select("id", "true_label", *[F.col(str(i)).alias(f"l{i}") for i in range(10)])


@named(
    "nearest_references",
    f"""WITH {_U}, s AS (SELECT a.id, b.id AS ref, list_dot_product(a.v, b.v) AS score FROM u a, u b),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ref) AS rank FROM s)
    SELECT id, ref, rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
)
def nearest_references(spark, sf):
    """Three most similar vectors of every vector (itself first)."""
    u = unit_vectors(spark, sf)
    return score.top_references(u, u.withColumnRenamed("id", "ref")).withColumn("score", F.round("score", 6))


@named(
    "best_and_second_match",
    f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank FROM s)
    SELECT id, max(CASE WHEN rank = 1 THEN label END) AS best, round(max(CASE WHEN rank = 1 THEN score END), 6) AS best_score,
    max(CASE WHEN rank = 2 THEN label END) AS second, round(max(CASE WHEN rank = 2 THEN score END), 6) AS second_score FROM r GROUP BY id""",
)
def best_and_second_match(spark, sf):
    b = catalog.best_two(label_scores(spark, sf).withColumnRenamed("label", "ref"))
    return b.withColumn("best_score", F.round("best_score", 6)).withColumn("second_score", F.round("second_score", 6))


@named(
    "predictions",
    f"WITH {_S} SELECT id, arg_max(label, (score, -label)) AS predicted, round(max(score), 6) AS score FROM s GROUP BY id",
)
def predictions(spark, sf):
    return score.predictions(label_scores(spark, sf)).withColumn("score", F.round("score", 6))


@named(
    "accuracy",
    f"""WITH {_S}, p AS (SELECT id, truth_label, arg_max(label, (score, -label)) AS predicted FROM s GROUP BY id, truth_label)
    SELECT count(*) AS n, count(CASE WHEN predicted = truth_label THEN 1 END) AS n_correct,
    round(count(CASE WHEN predicted = truth_label THEN 1 END) / count(*), 6) AS accuracy FROM p""",
)
def accuracy(spark, sf):
    return score.accuracy(score.predictions(label_scores(spark, sf)), truth(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@named(
    "prediction_collapse",
    f"""WITH {_S}, p AS (SELECT id, arg_max(label, (score, -label)) AS predicted FROM s GROUP BY id),
    n AS (SELECT predicted, count(*) AS c FROM p GROUP BY predicted)
    SELECT CAST(sum(c) AS BIGINT) AS n_results, max(c) AS n_top, arg_max(predicted, (c, -predicted)) AS top_label, round(max(c) / sum(c), 6) AS top_share,
    sum(c) >= 3 AND max(c) / sum(c) >= 0.9 AS collapsed FROM n""",
)
def prediction_collapse(spark, sf):
    return metrics.collapse(score.predictions(label_scores(spark, sf))).withColumn("top_share", F.round("top_share", 6))


@named("softmax_scores", f"WITH {_P} SELECT id, label, score FROM p")
def softmax_scores(spark, sf):
    return score.softmax_scores(label_scores(spark, sf), 20.0)


@named(
    "label_ranks",
    f"WITH {_S} SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank FROM s",
)
def label_ranks(spark, sf):
    return score.rank_labels(label_scores(spark, sf)).select("id", "label", "rank")


@named("label_truth_matrix", f"WITH {_P} SELECT id, label, truth FROM t")
def label_truth_matrix(spark, sf):
    """0/1 truth with every label present for every text."""
    t = truth(spark, sf)
    return metrics.label_matrix(t, t.select("label"), members(spark, sf))


_LRAP = f"""{_P}, r AS (SELECT *, count(*) OVER w AS rk, sum(truth) OVER w AS above FROM t
      WINDOW w AS (PARTITION BY id ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
    per AS (SELECT id, CASE WHEN sum(truth) IN (0, count(*)) THEN 1.0 ELSE avg(CASE WHEN truth = 1 THEN above / rk END) END AS lrap FROM r GROUP BY id)"""


@named("lrap_per_text", f"WITH {_LRAP} SELECT id, round(lrap, 6) AS lrap FROM per")
def lrap_per_text(spark, sf):
    return metrics.lrap_rows(probabilities(spark, sf)).withColumn("lrap", F.round("lrap", 6))


@named("label_ranking_average_precision", f"WITH {_LRAP} SELECT round(avg(lrap), 6) AS lrap FROM per")
def label_ranking_average_precision(spark, sf):
    return metrics.lrap(probabilities(spark, sf)).withColumn("lrap", F.round("lrap", 6))


_AP = f"""{_P}, th AS (SELECT label, score, sum(truth) AS tp, count(*) AS n FROM t GROUP BY label, score),
    cum AS (SELECT label, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY label) AS pos FROM th
            WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    ap AS (SELECT label, sum(tp / pos * ctp / cn) AS ap FROM cum WHERE pos > 0 GROUP BY label)"""


@named("average_precision_per_label", f"WITH {_AP} SELECT label, round(ap, 6) AS ap FROM ap")
def average_precision_per_label(spark, sf):
    return metrics.average_precision(probabilities(spark, sf)).withColumn("ap", F.round("ap", 6))


@named("macro_average_precision", f"WITH {_AP} SELECT round(avg(ap), 6) AS aupr FROM ap")
def macro_average_precision(spark, sf):
    return metrics.macro_average_precision(probabilities(spark, sf)).withColumn("aupr", F.round("aupr", 6))


@named(
    "wrong_at_one_and_three",
    f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank FROM t),
    b AS (SELECT id, min(CASE WHEN truth = 1 THEN rank END) AS best FROM r GROUP BY id)
    SELECT CAST(1 AS BIGINT) AS k, count(*) AS n_total, count(CASE WHEN best > 1 THEN 1 END) AS n_wrong FROM b
    UNION ALL SELECT 3, count(*), count(CASE WHEN best > 3 THEN 1 END) FROM b""",
)
def wrong_at_one_and_three(spark, sf):
    r = score.rank_labels(probabilities(spark, sf))
    out = [metrics.wrong_at(r, k).select(F.lit(k).cast("long").alias("k"), "n_total", "n_wrong") for k in (1, 3)]
    return out[0].unionByName(out[1])


@named("negative_baseline", f"WITH {_S}, b AS (SELECT id, max(score) AS best FROM s GROUP BY id) SELECT round(max(best), 6) AS max_best, round(min(best), 6) AS min_best FROM b")
def negative_baseline(spark, sf):
    b = score.extreme_best(label_scores(spark, sf))
    return b.select(F.round("max_best", 6).alias("max_best"), F.round("min_best", 6).alias("min_best"))


@named("train_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT 99, 0")
def train_counts(spark, sf):
    """Rows per label, zero for a label without any."""
    t = truth(spark, sf)
    labels = t.select("label").unionByName(spark.createDataFrame([(99,)], "label int"))
    return metrics.train_counts(t, labels)


@named(
    "class_weights",
    """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, n, round(least((SELECT avg(n) FROM n) / n, 3.0), 6) AS weight FROM n""",
)
def class_weights(spark, sf):
    t = truth(spark, sf)
    return metrics.class_weights(metrics.train_counts(t, t.select("label"))).withColumn("weight", F.round("weight", 6))


@named(
    "symmetric_info_nce",
    f"""WITH {_C}, k AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(y) AS x FROM
      (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS y FROM e) GROUP BY label, i) GROUP BY label),
    p AS (SELECT a.label AS r, b.label AS c, 10 * list_cosine_similarity(a.v, b.v) AS sim FROM c a, k b),
    l AS (SELECT (SELECT avg(x) FROM (SELECT ln(sum(exp(sim))) - max(CASE WHEN r = c THEN sim END) AS x FROM p GROUP BY r)) AS a,
                 (SELECT avg(x) FROM (SELECT ln(sum(exp(sim))) - max(CASE WHEN r = c THEN sim END) AS x FROM p GROUP BY c)) AS b)
    SELECT round((a + b) / 2, 6) AS loss FROM l""",
)
def symmetric_info_nce(spark, sf):
    """Label centroids of the unit vectors against those of the raw vectors."""
    raw = query(spark, sf, "SELECT label, embedding FROM embeddings").select("label", vec.to_double(F.col("embedding")).alias("v"))
    rows = centroids(spark, sf).select(F.col("label").alias("id"), "v")
    s = score.score_labels(rows, score.mean_pool(raw, ["label"]), "int")
    return metrics.info_nce(s.select(F.col("id").alias("row"), F.col("label").alias("col"), (F.col("score") * 10).alias("sim"))).select(
        F.round("loss", 6).alias("loss")
    )


@named(
    "prototype_loss",
    f"""WITH {_S}, t AS (SELECT *, CASE WHEN label = truth_label OR label = (truth_label + 3) % 10 THEN 1 ELSE 0 END AS truth, 10 * score AS x FROM s),
    per AS (SELECT id, ln(sum(CASE WHEN truth = 0 THEN exp(x) END)) AS neg, sum(truth) AS k, sum(CASE WHEN truth = 1 THEN x END) AS xs FROM t GROUP BY id)
    SELECT round(avg(greatest(neg - xs / k, 0)), 6) AS loss FROM per""",
)
def prototype_loss(spark, sf):
    """Multi-label prototype loss of the label similarities."""
    s = metrics.truth_table(label_scores(spark, sf), members(spark, sf))
    return metrics.prototype_loss(s, 10.0).withColumn("loss", F.round("loss", 6))


@named(
    "uniformity",
    f"""WITH {_U} SELECT round(ln(avg(exp(-2 * (2 - 2 * list_dot_product(a.v, b.v))))), 6) AS uniformity FROM u a JOIN u b ON a.id < b.id""",
)
def uniformity(spark, sf):
    return metrics.uniformity(unit_vectors(spark, sf)).withColumn("uniformity", F.round("uniformity", 6))


@named(
    "ridge_prototypes",
    f"""WITH {_U}, d AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM u),
    s AS (SELECT label, i, sum(x) AS x FROM d GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY label)
    SELECT s.label, s.i, round(s.x / n.n, 6) AS x FROM s JOIN n ON n.label = s.label""",
)
def ridge_prototypes(spark, sf):
    """With one label per vector the ridge solution is the normalised label sum; several labels are
    checked in the tests."""
    p = metrics.ridge_prototypes(unit_vectors(spark, sf).select("id", "v"), truth(spark, sf))
    return p.select("label", F.posexplode("v").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@named("ridge_prototypes_multi_label")
def ridge_prototypes_multi_label(spark, sf):
    p = metrics.ridge_prototypes(unit_vectors(spark, sf).select("id", "v"), members(spark, sf))
    return p.select("label", F.posexplode("v").alias("i", "x"))


@named(
    "ridge_normal_equations",
    f"""WITH {_U}, l AS (SELECT id, label, v FROM u UNION ALL SELECT id, (label + 3) % 10, v FROM u),
    d AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM l)
    SELECT CAST(label AS INTEGER) AS label, i, round(sum(x), 5) + 0.0 AS x FROM d GROUP BY label, i""",
)
def ridge_normal_equations(spark, sf):
    """The left side of the normal equations, from the rows and the solution for several labels; the checking SQL
    has the right side, the sums of the labels' vectors."""
    eps, m = 1e-3, members(spark, sf)
    v = metrics.ridge_solution(unit_vectors(spark, sf).select("id", "v"), m, eps).select("label", F.posexplode("v").alias("i", "x"))
    of_id = m.join(v, "label").groupBy("id", "i").agg(F.sum("x").alias("x"))
    left = m.join(of_id, "id").select("label", "i", "x").unionByName(v.withColumn("x", F.col("x") * F.lit(eps)))
    return left.groupBy("label", "i").agg(F.sum("x").alias("x")).select("label", (F.col("i") + 1).cast("long").alias("i"), (F.round("x", 5) + 0.0).alias("x"))


_LATE = f"""{_U}, b AS (SELECT a.label AS id, a.id AS pos, c.label AS ref, max(list_dot_product(a.v, c.v)) AS best FROM u a, u c GROUP BY ALL),
    late AS (SELECT id, ref, avg(best) AS score FROM b GROUP BY id, ref)"""


def _groups(spark, sf):
    """Every label as one text: its vectors are the rows."""
    u = unit_vectors(spark, sf)
    rows = u.select(F.col("label").alias("id"), F.col("id").alias("pos"), "v")
    cols = u.select(F.col("label").alias("ref"), F.col("id").alias("pos"), "v")
    return rows, cols


@named("late_interaction", f"WITH {_LATE} SELECT id, ref, round(score, 6) AS score FROM late")
def late_interaction(spark, sf):
    """Mean over a text's rows of the best match among a reference's columns, all label pairs."""
    rows, cols = _groups(spark, sf)
    labels = [r["label"] for r in truth(spark, sf).select("label").distinct().collect()]
    pairs = rows.select("id").distinct().withColumn("ref", F.explode(F.array(*[F.lit(x) for x in labels])))
    return score.late_interaction(rows, cols, pairs).withColumn("score", F.round("score", 6))


_TWO = f"""{_C}, b AS (SELECT a.label AS id, a.id AS pos, x.label AS ref, max(list_dot_product(a.v, x.v)) AS best FROM u a, u x GROUP BY ALL),
    late AS (SELECT id, ref, avg(best) AS score FROM b GROUP BY id, ref),
    pool AS (SELECT a.label AS id, k.label AS ref, list_cosine_similarity(a.v, k.v) AS pooled FROM c a, c k),
    first AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pooled DESC, ref) AS r FROM pool),
    two AS (SELECT f.id, f.ref, f.pooled, l.score, row_number() OVER (PARTITION BY f.id ORDER BY l.score DESC, f.pooled DESC, f.ref) AS rank
            FROM first f JOIN late l ON l.id = f.id AND l.ref = f.ref WHERE f.r <= 5)"""


def _two_stage(spark, sf):
    rows, cols = _groups(spark, sf)
    c = centroids(spark, sf)
    return score.two_stage(c.select(F.col("label").alias("id"), "v"), c.select(F.col("label").alias("ref"), "v"), rows, cols)


@named(
    "two_stage_retrieval",
    f"WITH {_TWO} SELECT id, ref, rank, round(pooled, 6) AS pooled, round(score, 6) AS score FROM two WHERE rank <= 3",
)
def two_stage_retrieval(spark, sf):
    return _two_stage(spark, sf).withColumn("pooled", F.round("pooled", 6)).withColumn("score", F.round("score", 6))


@named(
    "final_detection_scores",
    f"""WITH {_TWO}, g AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(x) AS x FROM d GROUP BY i)),
    benign AS (SELECT c.label AS id, list_cosine_similarity(c.v, g.v) AS benign FROM c, g)
    SELECT two.id, two.ref, round(two.score - b.benign, 6) AS final FROM two JOIN benign b ON b.id = two.id WHERE two.rank = 1""",
)
def final_detection_scores(spark, sf):
    """Best candidate minus the similarity to the mean of all vectors."""
    u = unit_vectors(spark, sf).withColumn("ref", F.lit(0))
    base = score.top_references(
        centroids(spark, sf).select(F.col("label").alias("id"), "v"), score.mean_pool(u, ["ref"]), 1, "int"
    )
    return score.final_scores(_two_stage(spark, sf), base).select("id", "ref", F.round("final", 6).alias("final"))


@named(
    "best_sentence_pairs",
    f"""WITH {_U}, cell AS (SELECT a.label AS id, b.label AS ref, concat('t', CAST(a.id // 2 AS STRING)) AS row_text, concat('r', CAST(b.id // 2 AS STRING)) AS ref_text,
      list_dot_product(a.v, b.v) AS score, a.id AS row_pos, b.id AS ref_pos FROM u a JOIN u b ON b.label = (a.label + 1) % 10),
    pool AS (SELECT *, row_number() OVER (PARTITION BY id, ref ORDER BY score DESC, row_pos, ref_pos) AS r FROM cell),
    once AS (SELECT id, ref, row_text, ref_text, min(r) AS r, max(score) AS score FROM pool WHERE r <= 10 GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY id, ref ORDER BY r) AS rank FROM once)
    SELECT id, ref, row_text, ref_text, rank, round(score, 6) AS score FROM top WHERE rank <= 3""",
)
def best_sentence_pairs(spark, sf):
    """Best distinct sentence pairs of each label with the next one."""
    rows, cols = _groups(spark, sf)
    half = F.floor(F.col("pos") / 2).cast("string")
    rows = rows.withColumn("text", F.concat(F.lit("t"), half))
    cols = cols.withColumn("text", F.concat(F.lit("r"), half))
    pairs = rows.select("id").distinct().withColumn("ref", ((F.col("id") + 1) % 10).cast("int"))
    return score.best_sentence_pairs(rows, cols, pairs).withColumn("score", F.round("score", 6))


@named(
    "token_explanations",
    f"""WITH {_U}, tok AS (SELECT id, CASE id % 5 WHEN 0 THEN ',' WHEN 1 THEN '--' ELSE concat('w', CAST(id AS STRING)) END AS token, v FROM u WHERE label = 3),
    s AS (SELECT a.label AS id, a.id AS pos, t.token, list_dot_product(a.v, t.v) AS score FROM u a, tok t WHERE t.token NOT IN (',', '--')),
    b AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY score DESC, token) AS r FROM s),
    top AS (SELECT id, pos, token, round(score, 4) AS score, row_number() OVER (PARTITION BY id ORDER BY round(score, 4) DESC, pos) AS rank FROM b WHERE r = 1)
    SELECT id, pos, token, score, rank FROM top WHERE rank <= 5""",
)
def token_explanations(spark, sf):
    """Best word of one reference for every row, punctuation skipped, best five rows per text."""
    rows, cols = _groups(spark, sf)
    token = F.when(F.col("pos") % 5 == 0, ",").when(F.col("pos") % 5 == 1, "--").otherwise(F.concat(F.lit("w"), F.col("pos").cast("string")))
    return score.explain_tokens(rows, cols.withColumn("token", token), 3)


@named(
    "text_chunks",
    """WITH t AS (SELECT doc_id AS id, list_concat(['<s>'], string_split_regex(text, '\\s+')) AS k FROM documents),
    s AS (SELECT id, k, unnest(generate_series(0, (len(k) - 2) // 48)) AS chunk FROM t WHERE len(k) > 1)
    SELECT id, chunk, 1 + chunk * 48 AS start, CAST(1 + least(63, len(k) - (1 + chunk * 48)) AS BIGINT) AS n_tokens,
    md5(array_to_string(list_concat(k[1:1], k[chunk * 48 + 2:chunk * 48 + 64]), ' ')) AS digest FROM s""",
)
def text_chunks(spark, sf):
    """Overlapping chunks of whole texts, each with the lead token."""
    t = query(spark, sf, "SELECT doc_id AS id, text FROM documents").select(
        "id", F.concat(F.array(F.lit("<s>")), F.split("text", r"\s+")).alias("tokens")
    )
    return score.chunk_tokens(t, 64, 48).select(
        "id", "chunk", "start", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest")
    )


_FOLD = f"""{_U}, f AS (SELECT id, label, v, id % 5 AS fold FROM u),
    d AS (SELECT k.fold, f.label, unnest(generate_series(1, len(f.v))) AS i, unnest(f.v) AS x FROM f JOIN (SELECT DISTINCT fold FROM f) k ON k.fold <> f.fold),
    c AS (SELECT fold, label, list(x ORDER BY i) AS v FROM (SELECT fold, label, i, avg(x) AS x FROM d GROUP BY ALL) GROUP BY fold, label),
    s AS (SELECT f.id, f.fold, f.label AS truth_label, c.label, list_cosine_similarity(f.v, c.v) AS score FROM f JOIN c ON c.fold = f.fold),
    p AS (SELECT id, fold, truth_label, arg_max(label, (score, -label)) AS predicted FROM s GROUP BY ALL)"""


@named(
    "leave_one_file_out_accuracy",
    f"""WITH {_FOLD} SELECT fold, count(*) AS n, count(CASE WHEN predicted = truth_label THEN 1 END) AS n_correct,
    round(count(CASE WHEN predicted = truth_label THEN 1 END) / count(*), 6) AS accuracy FROM p GROUP BY fold""",
)
def leave_one_file_out_accuracy(spark, sf):
    """Every file is the test set once, scored against centroids of the others."""
    u = unit_vectors(spark, sf).withColumn("file", F.col("id") % 5)
    out = score.fold_accuracy(score.score_folds(u, score.fold_prototypes(u)), u)
    return out.withColumn("accuracy", F.round("accuracy", 6)).select("fold", "n", "n_correct", "accuracy")


@named(
    "best_checkpoint",
    f"""WITH {_C}, s AS (SELECT 'full' AS checkpoint, u.id, max(list_cosine_similarity(u.v, c.v)) AS score FROM u, c GROUP BY u.id
      UNION ALL SELECT 'half', u.id, max(list_cosine_similarity(u.v[1:32], c.v[1:32])) FROM u, c GROUP BY u.id)
    SELECT checkpoint, round(score, 6) AS score FROM s WHERE id = (SELECT min(id) FROM s) ORDER BY score DESC, checkpoint LIMIT 1""",
)
def best_checkpoint(spark, sf):
    """Checkpoint with the largest score on the first text."""
    u, c = unit_vectors(spark, sf), centroids(spark, sf)
    half = F.slice("v", 1, 32)
    full = score.score_labels(u, c).withColumn("checkpoint", F.lit("full"))
    short = score.score_labels(u.withColumn("v", half), c.withColumn("v", half)).withColumn("checkpoint", F.lit("half"))
    return score.best_checkpoint(full.unionByName(short)).withColumn("score", F.round("score", 6))


@named(
    "checkpoint_score_table",
    f"""WITH {_C}, s AS (SELECT 'full' AS checkpoint, u.id, c.label, list_cosine_similarity(u.v, c.v) AS score FROM u, c
      UNION ALL SELECT 'half', u.id, c.label, list_cosine_similarity(u.v[1:32], c.v[1:32]) FROM u, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY checkpoint, id ORDER BY score DESC, label) AS rank FROM s)
    SELECT checkpoint, id, label, rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
)
def checkpoint_score_table(spark, sf):
    """Top three labels of every text under every checkpoint."""
    u, c = unit_vectors(spark, sf), centroids(spark, sf)
    half = F.slice("v", 1, 32)
    full = score.score_labels(u, c).withColumn("checkpoint", F.lit("full"))
    short = score.score_labels(u.withColumn("v", half), c.withColumn("v", half)).withColumn("checkpoint", F.lit("half"))
    top = ordered.top_k(full.unionByName(short), ["checkpoint", "id"], [F.desc("score"), F.asc("label")], 3)
    return top.withColumn("score", F.round("score", 6))


@named(
    "held_out_evaluation",
    f"""WITH {_U}, f AS (SELECT id, label, v, CASE WHEN contains(concat('file', CAST(id AS STRING)), '7') THEN 'test' ELSE 'train' END AS split FROM u),
    d AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM f WHERE split = 'train'),
    c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM d GROUP BY ALL) GROUP BY label),
    s AS (SELECT f.id, f.label AS truth_label, c.label, list_cosine_similarity(f.v, c.v) AS score FROM f, c WHERE f.split = 'test'),
    p AS (SELECT id, label, truth_label, round(exp(20 * score) / sum(exp(20 * score)) OVER (PARTITION BY id), 6) AS score FROM s),
    t AS (SELECT *, CASE WHEN label = truth_label OR label = (truth_label + 3) % 10 THEN 1 ELSE 0 END AS truth FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank, count(*) OVER w AS rk, sum(truth) OVER w AS above FROM t
          WINDOW w AS (PARTITION BY id ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
    per AS (SELECT id, avg(CASE WHEN truth = 1 THEN above / rk END) AS lrap, min(CASE WHEN truth = 1 THEN rank END) AS best FROM r GROUP BY id)
    SELECT count(*) AS n_total, round(avg(lrap), 6) AS lrap, count(CASE WHEN best > 3 THEN 1 END) AS n_wrong FROM per""",
)
def held_out_evaluation(spark, sf):
    """Stored split re-applied, prototypes fitted on the train side, test side scored and judged."""
    u = unit_vectors(spark, sf).withColumn("file", F.concat(F.lit("file"), F.col("id").cast("string")))
    s = splits.leave_out_split(u, "file", ["7"])
    fitted = score.mean_pool(s.filter("split = 'train'"), ["label"])
    probs = score.softmax_scores(score.score_labels(s.filter("split = 'test'"), fitted), 20.0)
    scored = metrics.truth_table(probs, members(spark, sf))
    wrong = metrics.wrong_at(score.rank_labels(scored), 3)
    return wrong.join(metrics.lrap(scored)).select("n_total", F.round("lrap", 6).alias("lrap"), "n_wrong")
