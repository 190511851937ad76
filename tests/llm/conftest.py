import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra
    columns whose names clash with the operators' own."""
    words = [f"w{k % 977}x{k % 31}" for k in range(9_000)]
    long = " ".join(words)
    rows = [
        (1, "a few plain words stand here", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (3, "", "en", "s"),
        (None, "a text without an id, of some length", None, "s"), (4, long, "en", "s"), (5, long + " end", "fr", "s"), (4, long, "en", "s"),
        (6, "one", "en", "s"), (7, "  \n\n \t  ", "en", "s"), (8, "x" * 40_000, "en", "s"), (9, "a few plain words stand here", "de", "t"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    from pyspark.sql import functions as F

    return (spark.createDataFrame(rows, schema).repartition(3)
            .withColumns({c: F.lit(1) for c in ("ids", "node", "label", "k", "part", "w", "spans", "score", "sequence_id", "edge", "number")}))
