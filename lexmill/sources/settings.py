"""INI settings as a DataFrame (section, key, value): typed getters, edits, and the segmenter's configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import SegmentConfig
from lexmill.functions import text as tx
from lexmill.sources import readers

# The settings' names in a configuration file; they are read from whichever section holds them.
KEYS = {"merge": "merge_number_and_ascii", "joint": "number_and_ascii_joint", "compress": "compress_space", "separate": "seperate_number_ascii", "omni": "omni_segmentation"}


def as_int(value: Column) -> Column:
    """The leading integer of a text: hexadecimal after 0x, octal after 0, else decimal; 0 where there is none."""
    t = F.trim(value)
    sign = F.when(t.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(t, "^[+-]", "")
    hexa, octal, deci = F.regexp_extract(body, "^0[xX]([0-9A-Fa-f]+)", 1), F.regexp_extract(body, "^0([0-7]+)", 1), F.regexp_extract(body, r"^(\d+)", 1)
    number = F.when(hexa != "", F.conv(hexa, 16, 10)).when(octal != "", F.conv(octal, 8, 10)).when(deci != "", deci).otherwise("0")
    return (number.try_cast("long") * sign).cast("long")


def as_bool(value: Column, default: bool = False) -> Column:
    """By the first character: y, Y, 1, t and T are true, n, N, 0, f and F false, others the default."""
    head = F.substring(F.trim(value), 1, 1)
    return F.when(head.isin(*"yY1tT"), True).when(head.isin(*"nN0fF"), False).otherwise(default)


def _one(settings: DataFrame, section: str | None, key: str, value: Column):
    rows = settings.where(F.col("key") == key.lower())
    if section is not None:
        rows = rows.where(F.col("section") == section.lower())
    row = rows.orderBy("section").select(value).first()
    return None if row is None else row[0]


def get(settings: DataFrame, section: str | None, key: str, default: str | None = None) -> str | None:
    """A setting's text; a section of None means any."""
    got = _one(settings, section, key, F.col("value"))
    return default if got is None else got


def get_int(settings: DataFrame, section: str | None, key: str, default: int = 0) -> int:
    got = _one(settings, section, key, as_int(F.col("value")))
    return default if got is None else got


def get_double(settings: DataFrame, section: str | None, key: str, default: float = 0.0) -> float:
    got = _one(settings, section, key, tx.to_float(F.col("value")))
    return default if got is None else got


def get_bool(settings: DataFrame, section: str | None, key: str, default: bool = False) -> bool:
    got = _one(settings, section, key, as_bool(F.col("value"), default))
    return default if got is None else got


def sections(settings: DataFrame) -> DataFrame:
    return settings.select("section").distinct()


def put(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings with the changes' values in place of their own."""
    return settings.join(changes, ["section", "key"], "left_anti").unionByName(changes.select("section", "key", "value"))


def unset(settings: DataFrame, names: DataFrame) -> DataFrame:
    return settings.join(names, ["section", "key"], "left_anti")


def segment_config(settings: DataFrame | None) -> SegmentConfig:
    """The configuration that settings describe; without any, flags are off and sub-words need a frequency of 2."""
    if settings is None:
        return SegmentConfig()
    on = lambda k: get_bool(settings, None, KEYS[k])
    return SegmentConfig(merge=on("merge"), separate=on("separate"), joint=get(settings, None, KEYS["joint"], "") or "", compress_space=on("compress"), omni=get_int(settings, None, KEYS["omni"], 2))


def read_config(spark: SparkSession, path: str) -> SegmentConfig:
    return segment_config(readers.read_ini(spark, path))
