import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that the
    operators use as names of their own."""
    rows = [(1, None, None, None, None), (None, "words without an id", "en", "s", 19), (2, "", "en", "s", 0), (3, " \n\t ", "de", None, 4),
            (4, "The same row twice, with the same text in it.", "en", "s", 45), (4, "The same row twice, with the same text in it.", "en", "s", 45),
            (5, "long words " * 20_000, "en", "s", 220_000), (6, "7" * 50_000, None, "t", 50_000), (7, "é 😀 日本 ▁ \x00 <s>", "fr", "t", 12),
            (8, "The same row twice, with the same text in it.", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"fp": 1, "rank": 2, "id": 3, "vector": 4, "component_id": 5, "spans": 6, "topic": 7, "score": 8, "value": 9, "kind": 10, "weight": 11}
    from pyspark.sql import functions as F
    return df.withColumns({name: F.lit(v) for name, v in extra.items()})
