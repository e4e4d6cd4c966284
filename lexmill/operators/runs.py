"""Cutting texts into pieces with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.config import SegmentConfig
from lexmill.functions import text as tx
from lexmill.functions.classes import JAVA_STAR, kind_of, me_pattern, piece_pattern


def pieces_of(text: Column, config: SegmentConfig = SegmentConfig()) -> Column:
    """The pieces that tile a text, as an array."""
    return F.regexp_extract_all(tx.clean(text), F.lit(piece_pattern(config.classes, config.merge, config.separate, config.joint, JAVA_STAR)), F.lit(0))


def pieces(rows: DataFrame, config: SegmentConfig = SegmentConfig(), text: str = "text") -> DataFrame:
    """The other columns of ``rows`` with pos, piece and kind of each piece of its text."""
    others = [c for c in rows.columns if c != text]
    out = rows.select(*others, F.posexplode(pieces_of(F.col(text), config)).alias("pos", "piece"))
    return out.withColumn("kind", kind_of(F.col("piece"), config.classes))


def letter_digit_runs(rows: DataFrame, config: SegmentConfig = SegmentConfig(), text: str = "text") -> DataFrame:
    """(token, n): the letter and digit runs of all texts and how often each occurs."""
    found = rows.select(F.explode(F.regexp_extract_all(tx.clean(F.col(text)), F.lit(me_pattern(config.classes, config.merge, config.separate, config.joint, JAVA_STAR)), F.lit(0))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def ordinary_runs(rows: DataFrame, config: SegmentConfig, text: str = "text") -> DataFrame:
    """(run, n): the distinct runs of ordinary characters and how often each occurs. What depends on a run alone is done once a run."""
    c = config.classes
    runs = rows.select(F.explode(F.regexp_extract_all(tx.clean(F.col(text)), F.lit(f"[^\\r\\n{c.any_of('m', 'e', 'w')}]+"), F.lit(0))).alias("run"))
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def class_counts(rows: DataFrame, config: SegmentConfig, by: str, text: str = "text") -> DataFrame:
    """Characters of each class a value of ``by``."""
    t = tx.clean(F.col(text))
    count = lambda body: F.coalesce(F.sum(F.regexp_count(t, F.lit(f"[{body}]"))), F.lit(0)).cast("long") if body else F.lit(0).cast("long")
    c = config.classes
    return rows.groupBy(by).agg(count(c.m).alias("numbers"), count(c.e).alias("letters"), count(c.w).alias("separators"), count("\\r\\n").alias("line_ends"), F.coalesce(F.sum(F.char_length(t)), F.lit(0)).cast("long").alias("chars"))
