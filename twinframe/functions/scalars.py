"""Scalar functions of the query language and of dictionary lookups, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a dictionary server writes an identifier as a URL.
DICTIONARY_URL = r"^https?://api\.eclass-cdp\.com/(\d{4}-\d)-(\d{2}-[0-9A-Za-z]+)-(\d+)$"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """Number that the whole string spells, else null: no suffixes, so that `60d` is none."""
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def leading_number(c: Column) -> Column:
    """Number at the start of a string, a comma standing for the point; else null."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def to_boolean(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s == "true", True).when(s == "false", False)


def to_hex(c: Column) -> Column:
    return F.concat(F.lit("16#"), F.hex(to_number(c).cast("long")))


def to_datetime(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string"))


def to_seconds(c: Column) -> Column:
    """Seconds of the day of a time, its zone left aside; null if it is none."""
    part = lambda k: F.regexp_extract(c.cast("string"), r"^(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", k)
    return F.when(part(1) != "", part(1).cast("int") * 3600 + part(2).cast("int") * 60 + F.coalesce(part(3).try_cast("double"), F.lit(0.0)))


def irdi_base(c: Column) -> Column:
    """Identifier without its version, so that versions of one concept compare equal.

    Dictionary URLs become identifiers first; only values that start with four digits and a separator are cut.
    """
    plain = F.regexp_replace(c, DICTIONARY_URL, "$1#$2#$3")
    return F.when(plain.rlike(r"^\d{4}[-/]"), F.regexp_replace(plain, r"#\d+$", "")).otherwise(c)


def pick_text(texts: Column, fallback: Column) -> Column:
    """Of (language, text) entries the English one, else the German, else the first, else the plain value."""
    of = lambda lang: F.get(F.filter(texts, lambda x: F.lower(x["language"]).startswith(lang)), F.lit(0))["text"]
    return F.coalesce(of("en"), of("de"), F.get(texts, F.lit(0))["text"], fallback)
