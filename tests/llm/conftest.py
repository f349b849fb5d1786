import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()), ("rk", T.StringType()), ("kept", T.StringType()))])

LONG = " ".join(f"word{i}" for i in range(40))


def rows_of(texts):
    return [(i, t, "en", "src0", len(t or ""), "x", "y") for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    texts = [(1, LONG), (2, LONG), (3, ""), (4, None), (5, " \n\t "), (6, "a"), (7, LONG + " changed"),
             (8, "x" * 5000), (9, " ".join(f"t{i}" for i in range(30_000))), (None, LONG), (1, LONG),
             (10, "Ünï çödé " * 30), (11, "line one has five words\n" * 3 + "tail"), (12, "!!! ### $$$")]
    return spark.createDataFrame(rows_of(texts), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
