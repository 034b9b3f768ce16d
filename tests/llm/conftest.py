"""Tables of odd rows that every operator and stage takes."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (None, "the same words stand here again", "en", "b", 1),
    (4, "the same words stand here again", "en", "b", 1),
    (4, "the same words stand here again", "en", "b", 1),
    (5, "word " * 3000, "en", None, 1),
    (6, "é ñ 字 <|endoftext|> x", "fr", "c", 1),
]


@pytest.fixture
def odd(spark):
    """Odd rows with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({x: F.lit("extra") for x in ("k", "digest", "size", "key", "host", "component", "copies", "w", "sig")})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
