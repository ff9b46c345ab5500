import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from texts (or (doc_id, text) pairs), with columns of clashing names added if asked for."""

    def f(texts, clash=False):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for c in ("size", "key", "id", "a", "b", "keep", "root", "sid", "lid", "spans", "words", "bin", "shard", "score", "item_id", "lids", "group_id", "packed", "line_no", "toxic", "quality"):
                df = df.withColumn(c, F.lit(7))
        return df

    return f


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, one sign, repeated rows, a very long text."""
    long = " ".join(f"word{i % 997} tail{i % 13}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "  \n\t\n"), (4, "."), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "no id at all"), (7, long), (8, "ünïcode … — „quoted“ \U0001f600 text")]
