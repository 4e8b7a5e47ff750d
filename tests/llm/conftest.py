import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text[, lang, source]), with columns that clash with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None) for r in rows]
        return (spark.createDataFrame(full, DOC).withColumn("fp", F.lit("x")).withColumn("digest", F.lit(1))
                .withColumn("pid", F.lit(2)).withColumn("d", F.lit(3)).withColumn("ids", F.lit(4)))
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, repeats, unbroken and very long texts."""
    return [(1, None), (2, ""), (3, "a"), (4, "Same text here"), (9, "same TEXT here"), (9, "same TEXT here"),
            (None, "SAME text here"), (None, None, None, None), (5, "x" * 20000), (6, "word " * 30000), (7, "Äé ß\n\n\tz"),
            (8, "!!! 123"), (10, "Same text here\nanother quite long line\n Another quite long LINE \t"),
            (11, "another quite long line\nshort\nshort")]
