import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """documents of (doc_id, text) pairs or of longer rows, in a few partitions."""

    def make(rows, lang="en", parts=3):
        full = [(*r, lang, "src", None)[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture
def odd_rows():
    """Rows that every operator has to stand: nulls, empty texts, repeats, a long text."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t\n"), (4, "same text here"), (4, "same text here"), (None, "no id at all"), (None, None), (5, long), (6, long), (7, "ünïcödé ﬁ 漢字 \U0001f600 ퟿")]


@pytest.fixture
def clashing(spark):
    """Adds columns whose names operators might use inside."""

    def add(df):
        from pyspark.sql import functions as F

        for c in ("row", "rid", "id", "key", "a", "b", "fp", "_words", "pos", "n", "r", "d", "kept", "at", "mentions", "odd.name"):
            df = df.withColumn(c, F.lit(f"own {c}"))
        return df

    return add
