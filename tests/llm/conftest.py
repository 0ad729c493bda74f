import pytest
from pyspark.sql import types as T

LONG = "Lorem the idiot and 4111111111111111 word " * 4000

#: Columns whose names an operator might use itself.
CLASHING = ["id", "label", "n", "size", "row", "key", "shard", "part", "fp", "score", "hit", "kind", "spans", "words", "gap"]


def table(spark, rows, source="a"):
    """Documents of (doc_id, text) or (doc_id, text, source), with extra columns of clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, an empty text, blanks, a very long text, repeated rows, ties."""
    return [(1, "The first text, plainly."), (2, None, None), (3, "", "b"), (4, "   \n\t ", "b"), (5, LONG, "c"), (6, "same words here", "a"), (6, "same words here", "a"), (7, "same words here", None), (None, "no id at all", "a"), (8, "ünï ▁ çödé 日本 🎉\x00end", "b")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()
