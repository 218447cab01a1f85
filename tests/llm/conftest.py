import pytest
from pyspark.sql import types as T

# Columns whose names the operators use themselves.
CLASHING = ["n_tokens", "n_bytes", "node", "key", "comp", "root", "group", "row", "part", "start", "shard", "parent", "bits", "kept", "score", "words", "license", "quality", "block", "rank", "x.y"]

LONG = "word " * 40_000 + "x" * 300_000

AWKWARD = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from it, again and again."),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "The quick brown fox jumps over the lazy dog and runs away from it, again and again."),
    (5, "one"),
    (5, "one"),
    (None, "a text without an id that has more than ten words in it for sure"),
    (6, "It's a dog's life, they'll <|endoftext|> say; 12 3four\xa0Σας ΟΔΟΣ́ é É 漢字 \x1c \x85 😂"),
    (7, LONG),
    (8, "tie tie tie tie tie tie tie tie tie tie tie tie"),
    (9, "line one here\nline one here\nline two here\r\nline two here"),
]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) rows with clashing extra columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])

    def make(rows):
        return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
