import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("text_hash", T.StringType()), T.StructField("n", T.StringType()), T.StructField("key", T.StringType()),
])


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) pairs or (doc_id, text, source) triples, with columns that clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", None, "k") for r in rows]
        return spark.createDataFrame(full, DOC)

    return make
