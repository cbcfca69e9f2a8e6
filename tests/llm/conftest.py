import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use for themselves.
CLASHING = ("id", "key", "n", "a", "b", "w", "label", "bucket", "size", "score", "p", "kinds", "sha", "rank", "class_id", "toxic")
LONG = " ".join(f"mot{i % 977}x{i}" for i in range(20_000))


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for c in CLASHING if extra else ():
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


@pytest.fixture
def odd():
    """Nulls, empty and very long texts, ties, repeated rows."""
    return [(1, None), (2, ""), (3, "   "), (4, "hello world"), (4, "hello world"), (5, "hello world"), (6, LONG), (7, "!!! ###"), (None, "no id"), (8, "é"), (9, "Ab " * 3000)]
