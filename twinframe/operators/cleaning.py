"""Repair and deduplication of what was read."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER

#: Value types whose values must be numbers.
NUMERIC = tuple(f"xs:{t}" for t in "byte decimal double float int integer long negativeInteger nonNegativeInteger nonPositiveInteger positiveInteger short unsignedByte unsignedInt unsignedLong unsignedShort".split())


def fix_languages(texts: Column) -> Column:
    """Underscores in language tags become hyphens."""
    return F.transform(texts, lambda x: F.struct(F.replace(x["language"], F.lit("_"), F.lit("-")).alias("language"), x["text"].alias("text")))


def drop_empty_texts(texts: Column) -> Column:
    return F.filter(texts, lambda x: F.coalesce(x["text"], F.lit("")) != "")


def fix_value_type(value_type: Column, value: Column) -> Column:
    """xs:string for a numeric type whose value is not a number; an empty value keeps its type."""
    wrong = value_type.isin(*NUMERIC) & (value != "") & ~value.rlike(NUMBER) & ~F.lower(F.trim(value)).rlike(r"^[+-]?(inf|infinity|nan)$")
    return F.when(F.coalesce(wrong, F.lit(False)), F.lit("xs:string")).otherwise(value_type)


def fix_id_short(name: Column, hyphens: bool = False) -> Column:
    """Other characters than letters, digits and underscores become underscores; a name that starts with no letter gets an x.

    With hyphens, those stay, but for ones at the end.
    """
    plain = F.regexp_replace(name, r"[^A-Za-z0-9_-]" if hyphens else r"[^A-Za-z0-9_]", "_")
    if hyphens:
        tail = F.regexp_extract(plain, r"-+$", 0)
        plain = F.concat(F.regexp_replace(plain, r"-+$", ""), F.repeat(F.lit("_"), F.length(tail)))
    return F.when(plain.rlike(r"^[A-Za-z]"), plain).otherwise(F.concat(F.lit("x"), plain))


class Fixer(NamedTuple):
    """A repair: the column that it mends, and the mended column."""

    name: str
    column: str
    mended: Callable[[], Column]


FIXERS = (
    Fixer("language", "texts", lambda: fix_languages(F.col("texts"))), Fixer("emptyText", "texts", lambda: drop_empty_texts(F.col("texts"))),
    Fixer("numeric", "valueType", lambda: fix_value_type(F.col("valueType"), F.col("value"))), Fixer("idShort", "idShort", lambda: fix_id_short(F.col("idShort"))),
)


def repair(elements: DataFrame, fixers: tuple[Fixer, ...] = FIXERS) -> DataFrame:
    """elements after each repair in turn; own ones may come before, after or instead of FIXERS."""
    for fixer in fixers:
        elements = elements.withColumn(fixer.column, fixer.mended())
    return elements


def repair_report(elements: DataFrame, fixers: tuple[Fixer, ...] = FIXERS) -> DataFrame:
    """(fixer, n): how many elements each repair changes by itself."""
    counts = elements.agg(*(F.count_if(~f.mended().eqNullSafe(F.col(f.column))).alias(f.name) for f in fixers))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(f.name).alias("fixer"), F.col(f.name).alias("n")) for f in fixers))))


def first_wins(rows: DataFrame, key: str, *order: str, stored: DataFrame | None = None) -> DataFrame:
    """The first row of each key, by the given order, and all rows of null key; none whose key is stored already."""
    new = rows if stored is None else rows.join(stored.select(key).distinct(), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    known = new.filter(F.col(key).isNotNull()).withColumn("_place", place).filter("_place = 1").drop("_place")
    return known.unionByName(new.filter(F.col(key).isNull()))


def shared_references(refs: DataFrame) -> DataFrame:
    """(ref_id, ref, owners): references by content, each one once."""
    return refs.groupBy("ref_id").agg(F.first("ref").alias("ref"), F.count(F.lit(1)).alias("owners"))
