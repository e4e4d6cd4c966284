"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "﻿"


def clean(text: Column) -> Column:
    """Text without a leading byte order mark, up to its first NUL, with invalid bytes replaced."""
    return F.regexp_replace(F.substring_index(F.make_valid_utf8(text), "\x00", 1), "^" + BOM, "")


def utf8_encode(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def utf8_decode(text: Column) -> Column:
    """The first code point; 0 at the end."""
    return F.ascii(F.substring(text, 1, 1))


def utf8_decode_length(text: Column) -> Column:
    """Bytes of the first character."""
    return F.octet_length(F.substring(text, 1, 1))


def utf8_length(text: Column) -> Column:
    """Number of characters."""
    return F.char_length(text)


def utf16_units(text: Column) -> Column:
    """Number of 16-bit units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def to_int(text: Column) -> Column:
    """The leading integer of a text, 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def to_float(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def bit_count(number: Column) -> Column:
    return F.bit_count(number)


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def trimmed(text: Column, chars: str = " \t") -> Column:
    return F.btrim(text, F.lit(chars))


def in_set(char: Column, joint: str) -> Column:
    return F.instr(F.lit(joint), char) > 0 if joint else F.lit(False)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column, delim: str) -> Column:
    """Nonempty parts between delimiters."""
    return F.filter(F.split(text, _quoted(delim)), lambda x: x != "")


def count_tokens(text: Column, delim: str) -> Column:
    return F.size(tokens(text, delim))


def nth_token(text: Column, delim: str, n: int) -> Column:
    """The n-th token from 1, null where there are fewer."""
    return F.try_element_at(tokens(text, delim), F.lit(n))


def remaining(text: Column, delim: str, n: int) -> Column:
    """What follows the first n tokens, joined again."""
    return F.array_join(F.slice(tokens(text, delim), n + 1, 1 << 30), delim)


def without(token: Column, part: str) -> Column:
    return F.replace(token, F.lit(part), F.lit(""))


def substrings(text: Column, least: int = 2) -> Column:
    """All contiguous substrings of at least ``least`` characters, by start and length."""
    n = F.char_length(text)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - (least - 1))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.substring(text, i, k))))


def prefixes(text: Column, most: int) -> Column:
    """Prefixes of 1 to ``most`` characters."""
    n = F.least(F.char_length(text), F.lit(most))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(text, 1, k))).otherwise(F.array().cast("array<string>"))


def _quoted(delim: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in delim) + "]"
