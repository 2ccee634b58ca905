"""BM25 relevance of sentences over a list of object phrases, as an inverted-index join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.operators import ordered
from provloom.session import cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25
THRESHOLD = 5.0


def _weights(phrases: DataFrame) -> DataFrame:
    """(term, phrase_id, phrase, w): weight one occurrence of the term in a sentence adds."""
    terms = phrases.select("phrase_id", "phrase", F.split(F.trim(F.lower("phrase")), r"\s+").alias("t"))
    tf = (
        terms.select("phrase_id", "phrase", F.size("t").alias("dl"), F.explode("t").alias("term"))
        .groupBy("phrase_id", "phrase", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    raw = (
        tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(size))
        .withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    )
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(F.broadcast(mean)).select(
        "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf")
    )
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "term").select("term", "phrase_id", "phrase", (F.col("idf") * gain).alias("w"))


#: phrases of a block, whose largest weights bound their scores
BLOCK = 128


def _postings(weights: DataFrame) -> DataFrame:
    """The weights with the block of their phrase. Phrases are in order of their heaviest term, so that a rare term
    stands in few blocks; every block holds as many phrases, whatever terms they have."""
    lead = weights.groupBy("phrase_id").agg(F.max_by("term", F.struct("w", "term")).alias("lead"))
    placed = ordered.scan(lead, [], ["lead", "phrase_id"], index="place")
    return weights.join(placed.select("phrase_id", F.floor((F.col("place") - 1) / BLOCK).cast("long").alias("block")), "phrase_id")


def best_phrase(sentences: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(key, phrase, score): the phrase with the largest score for each sentence that shares a term with
    some phrase, the first phrase on a tie.

    A phrase without a common term scores 0. Terms of more than half of the phrases weigh less than
    nothing, so where no matching phrase scores above 0 the first phrase without a common term is
    compared as well.

    Sentences with the same words are scored once. A bag of words meets the blocks of its terms, not their phrases:
    the largest weights of a block bound every score in it from above. The block with the largest bound is scored,
    and of the others those whose bound reaches the best score found there. So a term that most phrases hold
    costs a row per block, and phrases are written for the few blocks that may hold the best one; only bags
    whose terms all weigh nothing or less meet every phrase that has one of them."""
    words = F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit("([a-zA-Z]+)"), F.lit(1)))
    said = sentences.select(key, words.alias("words"))
    said = said.select(key, "words", F.sha2(F.array_join("words", " "), 256).alias("bag"))
    weights = cut_lineage(_weights(phrases))
    postings = cut_lineage(_postings(weights))
    terms = said.groupBy("bag").agg(F.first("words").alias("words")).select("bag", F.explode("words").alias("term"))
    terms = cut_lineage(terms.groupBy("bag", "term").agg(F.count(F.lit(1)).alias("c")).join(weights.select("term").distinct(), "term", "left_semi"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.select("bag", "block").join(terms, "bag").join(postings, ["term", "block"])
        return met.groupBy("bag", "phrase_id", "phrase").agg(F.round(F.sum(F.col("c") * F.col("w")), 9).alias("score"))

    tops = postings.groupBy("term", "block").agg(F.max(F.greatest("w", F.lit(0.0))).alias("top"))
    bounds = cut_lineage(terms.join(tops, "term").groupBy("bag", "block").agg(F.sum(F.col("c") * F.col("top")).alias("bound")))
    front = bounds.groupBy("bag").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block"))
    first_scores = cut_lineage(scored(front))
    reached = first_scores.groupBy("bag").agg(F.max("score").alias("reached"))
    # bounds are sums of doubles, so a hair below counts as reached
    others = bounds.join(front, ["bag", "block"], "left_anti").join(reached, "bag").filter(F.col("bound") >= F.col("reached") - 1e-6)
    every = first_scores.union(scored(others))

    first = F.max_by(F.struct("phrase_id", "phrase", "score"), F.struct("score", -F.col("phrase_id")))
    best = cut_lineage(every.groupBy("bag").agg(first.alias("b"), F.sort_array(F.collect_set(F.when(F.col("score") <= 0, F.col("phrase_id")))).alias("low")))
    answers = best.filter("b.score > 0").select("bag", "b.phrase", "b.score")
    rest = best.filter("b.score <= 0")
    if not rest.isEmpty():
        # where all matching phrases are in ``low``, the first phrase that is not among them scores 0
        numbered = ordered.scan(phrases.select("phrase_id", "phrase").distinct(), [], ["phrase_id"], index="place")
        places = (
            rest.select("bag", F.explode("low").alias("phrase_id")).join(numbered.select("phrase_id", "place"), "phrase_id")
            .groupBy("bag").agg(F.sort_array(F.collect_list("place")).alias("places"))
        )
        ahead = F.size(F.filter(F.transform("places", lambda x, i: x == i + 1), lambda x: x))
        free = places.select("bag", (ahead + 1).cast("long").alias("place")).join(
            numbered.select("place", F.col("phrase_id").alias("free_id"), F.col("phrase").alias("free")), "place", "left"
        )
        takes = F.col("free").isNotNull() & ((F.col("b.score") < 0) | (F.col("free_id") < F.col("b.phrase_id")))
        answers = answers.unionByName(rest.join(free, "bag").select(
            "bag", F.when(takes, F.col("free")).otherwise(F.col("b.phrase")).alias("phrase"),
            F.when(takes, F.lit(0.0)).otherwise(F.col("b.score")).alias("score"),
        ))
    return said.select(key, "bag").join(answers, "bag").select(key, "phrase", "score")


def relevant(sentences: DataFrame, phrases: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """Sentences whose best score reaches the threshold."""
    best = best_phrase(sentences, phrases, key).filter(F.col("score") >= threshold)
    return sentences.join(best, key)


def has_listed_verb(sentences: DataFrame, verbs: DataFrame, key: str) -> DataFrame:
    """Informational verb test on a pre-stemmed array column ``stems``."""
    hit = (
        sentences.select(key, F.explode("stems").alias("stem"))
        .join(verbs.select("stem").distinct(), "stem", "left_semi")
        .select(key)
        .distinct()
        .withColumn("has_verb", F.lit(True))
    )
    return sentences.join(hit, key, "left").fillna(False, ["has_verb"])
