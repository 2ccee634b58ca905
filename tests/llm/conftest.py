import pytest

from provloom.llm.shared import small_batches

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) rows."""
    small_batches(spark)

    def make(rows, extra=""):
        rows = [(*r, None, None)[:4] if len(r) < 4 else r[:4] for r in rows]
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCUMENTS)
        return df.repartition(3).selectExpr("*", *([extra] if extra else []))

    return make
