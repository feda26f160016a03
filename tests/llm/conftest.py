import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text[, lang, source]); extra columns have names the operators use inside."""

    def make(rows, extra=True):
        full = [(i, t, *(r + ["en", "s"][len(r):]), None if t is None else len(t)) for i, t, *r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("n", "node", "key", "kept", "t", "u", "twin", "place", "rank", "size", "component_id", "score", "copies", "h", "src"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (5, "x"), (5, "another text under one id"), (6, "word " * 30_000)]


@pytest.fixture
def odd():
    """Nulls, empty and very long texts, ties, repeated rows, one id with two texts."""
    return list(ODD)
