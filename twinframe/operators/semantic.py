"""Lookup by semantic identifier, across versions of a concept, and edges between dictionary concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import irdi_base, leading_number, pick_text
from ..schema import Graph, first_key
from .narrow import shells_of, there


def semantic_id(c: str = "semantic") -> Column:
    return first_key(F.col(c))


def matches(c: Column, identifier: str, version_agnostic: bool) -> Column:
    return irdi_base(c) == irdi_base(F.lit(identifier)) if version_agnostic else c == identifier


def find_referables(graph: Graph, identifier: str, version_agnostic: bool = True) -> DataFrame:
    """(node_id, model_type, idShort, semantic_id) of submodels and elements of a semantic identifier."""
    submodels = graph.submodels.select(F.col("id").alias("node_id"), F.lit("Submodel").alias("model_type"), "idShort", semantic_id().alias("semantic_id"))
    elements = graph.elements.select("node_id", "model_type", "idShort", semantic_id().alias("semantic_id"))
    return submodels.union(elements).filter(matches(F.col("semantic_id"), identifier, version_agnostic))


def submodels_by_type(graph: Graph, name: str, by_semantic_id: bool = False) -> DataFrame:
    return graph.submodels.filter(matches(semantic_id(), name, True) if by_semantic_id else F.col("idShort") == name)


def element_text() -> Column:
    return pick_text(F.col("texts"), F.col("value"))


COMPARISONS = {
    ">=": lambda n, v: n >= float(v), "<=": lambda n, v: n <= float(v), ">": lambda n, v: n > float(v), "<": lambda n, v: n < float(v),
}


def assets_by_criteria(graph: Graph, criteria: list[tuple[str, str, str]]) -> DataFrame:
    """Ids of shells with an element that meets each (semantic identifier, operator, value); operators >= <= > < = contains."""
    met = []
    for number, (identifier, op, wanted) in enumerate(criteria):
        text = element_text()
        if op in COMPARISONS:
            test = COMPARISONS[op](leading_number(text), wanted)
        elif op in ("=", "contains"):
            test = text == wanted if op == "=" else F.contains(F.lower(text), F.lit(wanted.lower()))
        else:
            raise ValueError(f"Unknown operator: {op}")
        met.append(graph.elements.filter(matches(semantic_id(), identifier, True) & test).select(F.col("submodel_id").alias("sm_id"), F.lit(number).alias("number")))
    every = reduce(DataFrame.union, met)
    # shells are only known through their submodels, which are looked up once for all criteria
    shells = there(graph, every.distinct()).join(shells_of(graph, every.select("sm_id")), "sm_id").groupBy("aas_id").agg(F.count_distinct("number").alias("n"))
    return shells.filter(F.col("n") == len(met)).select("aas_id")


def explain_property(graph: Graph, name: str, examples: int = 3) -> DataFrame:
    """What a property (idShort or identifier) means: for each concept base, the names in use, counts, texts and units, the first types of submodel that it stands in and the first of its values."""
    wanted = (F.col("idShort") == name) | (irdi_base(semantic_id()) == irdi_base(F.lit(name)))
    there = graph.elements.filter(wanted).select(irdi_base(semantic_id()).alias("base"), "idShort", "submodel_id", element_text().alias("text"))
    used = there.groupBy("base").agg(F.count(F.lit(1)).alias("uses"), F.array_join(F.sort_array(F.collect_set("idShort")), "|").alias("names"), F.count_distinct("submodel_id").alias("submodels"))
    known = graph.concepts.withColumn("base", irdi_base(F.col("id"))).groupBy("base").agg(F.count(F.lit(1)).alias("versions"), F.min(pick_text(F.col("displayName"), F.lit(None))).alias("meaning"), F.min("unit").alias("unit"))
    types = there.select("base", F.col("submodel_id").alias("id")).distinct().join(graph.submodels.select("id", "idShort"), "id")

    def first(values: DataFrame, value: str, alias: str) -> DataFrame:
        """The first distinct values of each base, cut off before they meet."""
        rank = F.row_number().over(Window.partitionBy("base").orderBy(value))
        kept = values.select("base", value).filter(F.col(value).isNotNull()).distinct().withColumn("rank", rank).filter(F.col("rank") <= examples)
        return kept.groupBy("base").agg(F.array_join(F.sort_array(F.collect_list(value)), "|").alias(alias)).withColumnRenamed("base", f"{alias}_base")

    for more, alias in ((first(types, "idShort", "classes"), "classes"), (first(there, "text", "examples"), "examples")):
        used = used.join(more, F.col("base").eqNullSafe(F.col(f"{alias}_base")), "left")
    return used.join(known, "base", "left").select("base", "names", "uses", "submodels", F.coalesce("versions", F.lit(0)).alias("versions"), "meaning", "unit", "classes", "examples")


def has_property(classes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(class_base, property_base) edges from classes (irdi, property_refs) whose both ends are known concepts of any version."""
    bases = concepts.select(irdi_base(F.col("id")).alias("base")).distinct()
    edges = classes.select(irdi_base(F.col("irdi")).alias("class_base"), F.explode("property_refs").alias("p")).select("class_base", irdi_base(F.col("p")).alias("property_base")).distinct()
    return edges.join(bases.withColumnRenamed("base", "class_base"), "class_base", "left_semi").join(bases.withColumnRenamed("base", "property_base"), "property_base", "left_semi")


def has_unit(properties: DataFrame, concepts: DataFrame) -> DataFrame:
    """(property_base, unit_base) edges from properties (irdi, unit_irdi)."""
    bases = concepts.select(irdi_base(F.col("id")).alias("base")).distinct()
    edges = properties.filter("unit_irdi IS NOT NULL").select(irdi_base(F.col("irdi")).alias("property_base"), irdi_base(F.col("unit_irdi")).alias("unit_base")).distinct()
    return edges.join(bases.withColumnRenamed("base", "property_base"), "property_base", "left_semi").join(bases.withColumnRenamed("base", "unit_base"), "unit_base", "left_semi")
