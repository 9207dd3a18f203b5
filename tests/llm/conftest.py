import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))

# doc_id, text, lang, source; then columns whose names operators might use themselves
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n\r\x0b\x0c ", "en", None),
    (6, "12345 67 !!! ### 8", "en", None),
    (None, "a text without an id but with words in it", "en", "a"),
    (7, "日本語のテキスト と <|endoftext|> und Größe  zwei  Leerzeichen\n\nx", "de", "c"),
    (8, LONG, "en", "c"),
    (9, "x" * 30_000, None, "c"),
    (10, "one two three", "en", "c"),
    (11, "One Two THREE", "en", "c"),
    (12, "the same line\nthe same line\n\nthe same line\nother " + "again and again we say it now " * 12, "en", "a"),
]


def frame(spark, rows):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in ("id", "size", "n", "held_out", "component", "copies", "label", "__row", "a.b")]
    )
    return spark.createDataFrame([(*r, *(["?"] * 9)) for r in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
