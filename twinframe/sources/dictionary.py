"""Dictionary segments in OntoML and UnitsML, read by Spark's XML source, and their concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import first_wins
from ..schema import CONCEPT, reference, shaped

NAMES = "struct<label:array<struct<_language_code:string,_VALUE:string>>>"
TEXTS = "struct<text:array<struct<_language_code:string,_VALUE:string>>>"
CLASS = f"_id string, preferred_name {NAMES}, definition {TEXTS}, its_superclass struct<_class_ref:string,_VALUE:string>, described_by struct<property:array<struct<_property_ref:string,_VALUE:string>>>, hierarchical_position string, is_deprecated string"
PROPERTY = f"_id string, preferred_name {NAMES}, short_name {NAMES}, definition {TEXTS}, domain struct<_type:string,unit:struct<_unit_ref:string,_VALUE:string>,_VALUE:string>, is_deprecated string"
UNIT = f"CodeListValue array<struct<_unitCodeValue:string,_codeListName:string,_VALUE:string>>, preferred_name {NAMES}, short_name {NAMES}"
#: Lengths that names and descriptions of a concept are cut to.
NAME_LENGTH, TEXT_LENGTH = 64, 1023


def canonical(irdi: Column) -> Column:
    """An identifier without the dictionary's qualifier between its issuer and item."""
    return F.regexp_replace(irdi, r"^(\d{4}-\d)---[^#]+#", "$1#")


def texts(entries: Column) -> Column:
    return F.transform(F.coalesce(entries, F.array().cast("array<struct<_language_code:string,_VALUE:string>>")), lambda x: F.struct(x["_language_code"].alias("language"), x["_VALUE"].alias("text")))


def is_true(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def read(spark: SparkSession, path: str, tag: str, schema: str, segments: list[int] | None = None) -> DataFrame:
    """Elements of one tag, streamed from files of any length; segments picks files by the number after _SG_ in their names."""
    found = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)
    if segments is not None:
        found = found.filter(F.regexp_extract(F.col("_metadata.file_path"), r"_SG_(\d+)\.xml$", 1).try_cast("int").isin(segments))
    return found


def classes(spark: SparkSession, path: str, segments: list[int] | None = None) -> DataFrame:
    rows = read(spark, path, "class", CLASS, segments).filter("_id IS NOT NULL")
    refs = F.transform(F.coalesce("described_by.property", F.array().cast("array<struct<_property_ref:string,_VALUE:string>>")), lambda p: canonical(p["_property_ref"]))
    return rows.select(canonical(F.col("_id")).alias("irdi"), texts(F.col("preferred_name.label")).alias("preferred_name"), texts(F.col("definition.text")).alias("definition"), canonical(F.col("its_superclass._class_ref")).alias("superclass_irdi"), "hierarchical_position", is_true("is_deprecated").alias("is_deprecated"), refs.alias("property_refs"))


def properties(spark: SparkSession, path: str, segments: list[int] | None = None) -> DataFrame:
    rows = read(spark, path, "property", PROPERTY, segments).filter("_id IS NOT NULL")
    return rows.select(
        canonical(F.col("_id")).alias("irdi"), texts(F.col("preferred_name.label")).alias("preferred_name"), texts(F.col("short_name.label")).alias("short_name"), texts(F.col("definition.text")).alias("definition"),
        F.regexp_replace(F.col("domain._type"), "^.*:", "").alias("data_type"), canonical(F.col("domain.unit._unit_ref")).alias("unit_irdi"), is_true("is_deprecated").alias("is_deprecated"),
    )


def units(spark: SparkSession, path: str) -> DataFrame:
    """Units that the list of identifiers names."""
    irdi = F.get(F.filter("CodeListValue", lambda x: x["_codeListName"] == "IRDI"), F.lit(0))["_unitCodeValue"]
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0))["_VALUE"], F.lit(""))
    return read(spark, path, "eClassUnit", UNIT).select(irdi.alias("irdi"), first("preferred_name.label").alias("preferred_name"), first("short_name.label").alias("short_name")).filter("irdi IS NOT NULL")


def by_language(entries: Column, length: int) -> Column:
    """One cut text for each language, the last that is not empty."""
    good = F.filter(F.transform(entries, lambda x: F.struct(x["language"].alias("language"), F.left(F.trim(x["text"]), F.lit(length)).alias("text"))), lambda x: (x["text"] != "") & (x["language"] != ""))
    last = F.aggregate(good, good, lambda acc, x: F.concat(F.filter(acc, lambda y: y["language"] != x["language"]), F.array(x)))
    return F.coalesce(last, F.array().cast("array<struct<language:string,text:string>>"))


def named(entries: Column, irdi: Column) -> Column:
    found = by_language(entries, NAME_LENGTH)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("en").alias("language"), F.left(irdi, F.lit(NAME_LENGTH)).alias("text"))))


def concepts(classes: DataFrame, properties: DataFrame, units: DataFrame) -> DataFrame:
    """Concepts of classes, properties and units; of one identifier, the first in this order."""
    irdi = F.col("irdi")
    described = {"id": irdi, "displayName": named(F.col("preferred_name"), irdi), "description": by_language(F.col("definition"), TEXT_LENGTH)}
    of_class = {"idShort": F.when(F.col("hierarchical_position") != "", F.concat(F.lit("eclass_"), F.col("hierarchical_position"))), "isCaseOf": F.when(F.col("superclass_irdi").isNotNull(), F.array(reference("ExternalReference", ("GlobalReference", F.col("superclass_irdi")))))}
    short = F.trim("short_name")
    of_unit = {"id": irdi, "displayName": named(F.array(F.struct(F.lit("de").alias("language"), F.col("preferred_name").alias("text"))), irdi), "idShort": F.when(short.rlike(r"^[A-Za-z][A-Za-z0-9_]*$"), short)}
    make = lambda df, columns, order: shaped(df.select(*(c.alias(n) for n, c in columns.items())), CONCEPT).withColumn("order", F.lit(order))
    rows = make(classes, described | of_class, 0).unionByName(make(properties, described | {"unit": F.col("unit_irdi")}, 1)).unionByName(make(units, of_unit, 2))
    return first_wins(rows, "id", "order").drop("order")


def put(known: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """known with new concepts; those of an id that is known replace it only if overwrite."""
    return known.join(new, "id", "left_anti").unionByName(new) if overwrite else known.unionByName(new.join(known, "id", "left_anti"))
