"""Documents that every operator must take."""

from __future__ import annotations

LONG = "long words make a long line of text that goes on, and on. " * 4000
SHARED = "This very passage of more than forty characters stands in many documents."

ROWS = [
    (1, "a plain short text", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, "   \n\t ", "fr", "b"),
    (5, LONG, "de", "a"),
    (6, "the same text twice", "en", "c"),
    (7, "the same text twice", "en", "c"),
    (7, "the same text twice", "en", "c"),
    (8, f"{SHARED}\nkeep one\n{SHARED.upper()} ", "en", "a"),
    (9, f"x\n  {SHARED}", None, "a"),
    (10, SHARED, "en", None),
    (11, f"{SHARED}\n", "en", "a"),
    (12, f"{SHARED}\n{SHARED}", "en", "d"),
    (None, "a row without an id", "en", "a"),
    (None, None, None, None),
    (13, "é漢字 <|endoftext|> ’s it's\r\n  x\x85y　z 😀 123", "es", "a"),
    (14, "one", "en", "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=None):
    """The rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "1.5D AS score", "'k' AS key", "2L AS size", "3L AS n_lines", "'h' AS text_hash", "4 AS bucket", "'x' AS part", "5L AS n_tokens")
