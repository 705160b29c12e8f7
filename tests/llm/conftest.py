import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, extra columns."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away again today", "en", "a", 70),
        (2, "the quick brown fox jumps over the lazy dog and runs away again today", "en", "a", 70),
        (2, "the quick brown fox jumps over the lazy dog and runs away again today", "en", "a", 70),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "de", None, 4),
        (6, long, "en", "b", len(long)),
        (None, "a text without an id that is long enough to count as ten words or so", None, None, None),
        (None, None, None, None, None),
        (7, "<|endoftext|> Licensed under the Apache License, Version 2.0. éü 中文 \U0001f600", "en", "é", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("h", "size", "place", "copy", "fp", "slot", "g", "sym", "n", "whole", "extra", "copies", "target", "bucket", "kept", "spans", "n_words", "component_id")})


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("doc_id < 0")
