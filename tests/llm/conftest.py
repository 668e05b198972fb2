import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from texts or (id, text) pairs, over several partitions, with columns whose names clash with results."""

    def make(rows, extra=True, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            df = df.selectExpr("*", "1 AS n_lines", "'x' AS row", "2 AS kept", "3 AS score", "4 AS offset", "5 AS sequence_id", "'y' AS key", "6 AS n_replaced", "7 AS grams", "8 AS node")
        return df.repartition(parts)

    return make
