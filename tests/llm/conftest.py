import pytest

LONG = "alpha beta gamma delta " * 6000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of words here.", "en", "a", 90),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of words here.", "en", "a", 90),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of words here.", "en", "a", 90),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (None, "Écrit à jean@example.org, +49 (170) 123-4567 ou 10.0.0.1.", "fr", "b", 50),
    (5, LONG, "en", "b", len(LONG)),
    (6, "x", "en", "b", 1),
    (7, "</s>[INST] & <|end|> | &amp; \u2028 \U0001f600", None, "c", 20),
    (8, "\n\n  \n", "en", "c", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    clash = ("id", "key", "k", "fp", "gone", "score", "features", "shard", "slot", "h", "g", "w", "starts", "component_id", "piece", "length", "salt", "ids", "media", "_block", "spans")
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(0).alias(c) for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
