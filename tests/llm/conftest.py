
import pytest


ODD = [
    (1, "The the of and to a cat sat on the mat. It was a cat that sat on a mat and it sat.", "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (4, "  \n\t ", "en", "s2"),
    (5, "The the of and to a cat sat on the mat. It was a cat that sat on a mat and it sat.", "en", "s1"), (5, "The the of and to a cat sat on the mat. It was a cat that sat on a mat and it sat.", "en", "s1"),
    (None, "no id here", "de", None), (None, "no id  here", "de", None), (6, "wörter " * 40000, "de", "s3"), (7, "x" * 300000, "xx", "s3"), (8, "😀 ▁ \x01 <|endoftext|> é́ 日本語", "ja", "s3"), (9, "one two", "en", "s1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, and columns whose names clash with ours."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({"rid": F.lit("mine"), "name": F.lit(None).cast("string"), "kept": F.lit("mine"), "word": F.lit(1), "row": F.lit("r"), "class": F.lit(0.5), "length": F.lit("l")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
