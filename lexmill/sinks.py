"""Sinks: token texts, token lists, files in UTF-16, INI text."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_lists(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by, tokens): each document's surfaces in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "surface")))
    return tokens.groupBy(*by).agg(F.transform(ordered, lambda t: t["surface"]).alias("tokens"))


def marked_text(tokens: DataFrame, by: list[str], mark: str = "/x ") -> DataFrame:
    """(by, text): surfaces with a mark after each; line feeds break lines, carriage returns are dropped."""
    shown = F.when(F.col("surface") == "\n", "\n").when(F.col("surface") == "\r", "").otherwise(F.concat("surface", F.lit(mark)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown"))))
    return tokens.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda t: t["shown"]), "").alias("text"))


def write_text(texts: DataFrame, path: str, column: str = "text") -> None:
    texts.select(column).write.mode("overwrite").text(path)


def encoded(text: Column, charset: str = "UTF-16") -> Column:
    """Bytes with a byte order mark."""
    return F.encode(F.concat(F.lit("﻿"), text), "UTF-8") if charset == "UTF-8" else F.encode(text, charset)


def write_utf16(texts: DataFrame, path: str, column: str = "text") -> None:
    """Files in UTF-16 with a byte order mark, the texts' lines one after another; ``sources.readers.read_texts`` takes them.

    Spark's only writer that takes an encoding drops empty lines.
    """
    plain = {"encoding": "UTF-16", "quote": "", "escape": "", "emptyValue": "", "nullValue": "", "sep": "\x01", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = texts.select(F.explode(F.split(column, "\r?\n", -1)).alias("line"))
    lines.write.mode("overwrite").options(**plain).csv(path)


def ini_text(settings: DataFrame) -> DataFrame:
    """One row, text: the INI form of (section, key, value); settings are few."""
    line = F.concat("key", F.lit(" = "), "value")
    each = settings.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    whole = each.select(F.concat(F.lit("["), "section", F.lit("]\n"), "body").alias("part"))
    return whole.agg(F.array_join(F.array_sort(F.collect_list("part")), "\n").alias("text"))


@contextmanager
def timed(report=print) -> Iterator[None]:
    """Reports the milliseconds that the block took."""
    start = time.monotonic()
    yield
    report(f"Took: {(time.monotonic() - start) * 1000:.0f} ms.")


def unigram_records(dictionary: DataFrame) -> DataFrame:
    """(value): the two-line text record of each term, as ``sources.readers.read_unigrams`` takes it."""
    return dictionary.select(F.concat("term", F.lit("\t"), F.col("freq").cast("string"), F.lit("\nx:"), F.col("freq").cast("string")).alias("value"))


def thesaurus_records(thesaurus: DataFrame) -> DataFrame:
    """(value): the two-line text record of each term and its related terms."""
    return thesaurus.select(F.concat("term", F.lit("\n-"), F.array_join("related", ","), F.lit(",")).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """One text file in order of the records; dictionaries are small, and their text form is a single file."""
    records.orderBy("value").coalesce(1).write.mode("overwrite").text(path)
