"""Document fingerprints by I-Match with several randomised lexicon subsets.

Terms are runs of letters and digits, lower case, each once per document. The lexicon holds the terms within
a band of inverse document frequency, counted over all documents; a term is its 64-bit hash, and the lexicon
counts terms per ``2 ** LEXICON_BITS`` hash buckets, so that its size does not grow with the corpus. The
lexicon is split at random into ``CELLS`` subsets; a document's sorted terms within a subset are hashed, and
the subset hashes in order are its fingerprint. One changed term changes one subset's hash only. Longer
documents are matched on a thinner lexicon, halved until a subset holds one or two of the document's terms,
and with half of that again, so that documents of nearly equal size always share a thinning.

Likeness of two fingerprints: equal subset hashes among the subsets that either document has terms in, over
the thinnings that both have.

Defined results: null and empty texts have no terms and an empty fingerprint, equal to any other empty one
(likeness 1) and unlike the rest (0); a document without a term in the band uses all of its terms; equal
texts have equal fingerprints; repeated rows stay rows; an empty table gives no rows. Only doc_id and text
are read. The next document is the next in (doc_id, text hash) order; neighbours meet in slices of that
order, cut at quantiles of doc_id, so texts are shuffled once and no task holds more than a slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 32
LEXICON_BITS = 20
#: of all documents, at most this share may hold a term of the lexicon
MOST_SHARE = 0.05
#: and at least so many documents
LEAST_DOCS = 2


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def bucket(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << LEXICON_BITS) - 1))


def lexicon(docs: DataFrame, most_share: float = MOST_SHARE, least_docs: int = LEAST_DOCS) -> Column:
    """One bit per bucket: do its terms lie within the band? A scalar of ``2 ** LEXICON_BITS`` bits as longs,
    whatever the corpus holds."""
    many = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy(bucket(F.col("term")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    kept = df.where((F.col("n") >= least_docs) & (F.col("n") <= F.greatest(F.lit(least_docs), many.scalar() * most_share)))
    held = kept.groupBy(F.shiftright("b", 6).cast("int").alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    every = docs.sparkSession.range(1 << (LEXICON_BITS - 6)).select(F.col("id").cast("int").alias("i"))
    rows = every.join(held, "i", "left").select("i", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bits"))), lambda x: x.bits).alias("bits")).scalar()


def with_fingerprint(df: DataFrame, text: Column, band: Column, name: str) -> DataFrame:
    """Adds the fingerprint of ``text`` under ``name``: ``thinning:h,h,...;h,h,...``."""
    in_band = lambda t: F.getbit(
        F.element_at(F.col("__lexicon"), (F.shiftright(bucket(t), 6) + 1).cast("int")), bucket(t).bitwiseAND(F.lit(63)).cast("int")
    ) == 1
    df = df.withColumn("__lexicon", band).withColumn("__terms", terms(text))
    df = df.withColumn("__band", F.filter("__terms", in_band))
    df = df.withColumn("__band", F.when(F.size("__band") == 0, F.col("__terms")).otherwise(F.col("__band")))
    thin = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size("__band"), F.lit(1)) / CELLS))).cast("int")
    df = df.withColumn("__thin", thin)

    def thinned(level: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
        return F.sort_array(F.filter("__band", lambda t: F.shiftrightunsigned(t, 24).bitwiseAND(mask) == 0))

    def hashed(held: str) -> Column:
        def cell(k):
            mine = F.filter(held, lambda t: F.shiftrightunsigned(t, 59) == k)
            return F.when(F.size(mine) == 0, F.lit("")).otherwise(F.right(F.hex(F.xxhash64(mine)), F.lit(6)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell), ",")

    df = df.withColumn("__a", thinned(F.col("__thin"))).withColumn("__b", thinned(F.col("__thin") + 1))
    return df.withColumn(name, F.concat(F.col("__thin").cast("string"), F.lit(":"), hashed("__a"), F.lit(";"), hashed("__b"))).drop(
        "__lexicon", "__terms", "__band", "__thin", "__a", "__b"
    )


def likeness(x: Column, y: Column) -> Column:
    level = lambda f: F.substring_index(f, ":", 1).cast("int")
    part = lambda f, i: F.split(F.split_part(F.substring_index(f, ":", -1), F.lit(";"), F.lit(i)), ",")
    apart = level(y) - level(x)
    mine = F.when(apart == 0, F.concat(part(x, 1), part(x, 2))).when(apart == 1, part(x, 2)).when(apart == -1, part(x, 1)).otherwise(F.array().cast("array<string>"))
    other = F.when(apart == 0, F.concat(part(y, 1), part(y, 2))).when(apart == 1, part(y, 1)).when(apart == -1, part(y, 2)).otherwise(F.array().cast("array<string>"))
    pairs = F.filter(F.arrays_zip(mine.alias("a"), other.alias("b")), lambda p: (p.a != "") | (p.b != ""))
    same = F.size(F.filter(pairs, lambda p: p.a == p.b))
    return F.when(x == y, F.lit(1.0)).when(F.size(pairs) == 0, F.lit(0.0)).otherwise(same / F.size(pairs)).cast("double")


def sliced(docs: DataFrame, slices: int) -> DataFrame:
    """Adds ``slice``: the number of quantiles of doc_id at or below the document's."""
    shares = [i / slices for i in range(1, slices)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10_000)).head()[0] or [])) if shares else []
    if not bounds:
        return docs.withColumn("slice", F.lit(0))
    cuts = F.array(*map(F.lit, bounds))
    return docs.withColumn("slice", F.coalesce(F.size(F.filter(cuts, lambda b: b <= F.col("doc_id"))), F.lit(0)))


def fingerprints(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and the likeness to those and to the next."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    band = lexicon(docs)
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = sliced(docs, slices)
    order = F.struct("doc_id", F.xxhash64("text").alias("key"))
    inside = Window.partitionBy("slice").orderBy("doc_id", F.xxhash64("text"))
    d = with_fingerprint(docs, F.col("text"), band, "fingerprint")
    d = d.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(inside))
    # the first document of every slice follows the last one of the slice before; one row per slice
    first = docs.select("slice", order.alias("o")).groupBy("slice").agg(F.min("o").alias("o")).select("slice", "o.*")
    heads = docs.join(
        F.broadcast(first.select(F.col("slice").alias("s"), F.col("doc_id").alias("i"), "key")),
        (F.col("slice") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("key")),
    ).select("slice", "text").dropDuplicates(["slice"])
    heads = with_fingerprint(heads, F.col("text"), band, "fingerprint")
    along = Window.orderBy("slice")
    every = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("slice", F.struct("text", "fingerprint").alias("head"))
    heads = heads.select("slice", F.coalesce(F.lead("head").over(along), F.first("head").over(every)).alias("head"))
    d = d.join(heads, "slice").withColumn("next", F.coalesce("next", "head")).drop("head", "slice")
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    d = d.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"),
        F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next.text", F.lit(1), moved)).alias("edited"),
    )
    d = with_fingerprint(d, F.col("edited"), band, "edited_fingerprint")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
