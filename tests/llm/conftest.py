import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (id, text) pairs, with columns whose names clash with those operators use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("size", T.StringType()), T.StructField("n", T.StringType()), T.StructField("x", T.StringType()), T.StructField("h", T.StringType())])
    return lambda pairs, lang="en": spark.createDataFrame([(i, t, lang, "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in pairs], schema)


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(20000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, long), (None, "a text without an id, with enough words to count"), (8, "Ünï ço dé x"), (9, "a b c d e f g h"), (10, "a b c d e f g h")]
