"""Compact rows of results: identity rows of shells and submodels, their top elements, and both as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pick_text
from ..schema import Graph


def joined_keys(reference: str = "semantic") -> Column:
    """The values of a reference's keys, joined by a bar; empty where there is none."""
    values = F.filter(F.transform(F.col(reference)["keys"], lambda k: k["value"]), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


def rows(graph: Graph, target: str, ids: DataFrame | None = None) -> DataFrame:
    """(modelType, idShort, id, globalAssetId) of shells or (…, semanticId) of submodels, of all or of those in ids (id)."""
    if target not in ("shells", "submodels"):
        raise ValueError(f"Unknown target: {target}")
    table = getattr(graph, target)
    table = table if ids is None else table.join(ids.select("id").distinct(), "id", "left_semi")
    kind, last = ("AssetAdministrationShell", F.col("globalAssetId")) if target == "shells" else ("Submodel", joined_keys().alias("semanticId"))
    return table.select(F.lit(kind).alias("modelType"), "idShort", "id", last)


def elements(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(submodel_id, idShort, modelType, value) of the elements right below submodels; those that hold others have no value, of texts one is picked."""
    top = graph.elements.filter(F.size("names") == 1)
    top = top if ids is None else top.join(ids.select(F.col("id").alias("submodel_id")).distinct(), "submodel_id", "left_semi")
    value = F.when(F.col("model_type") == "MultiLanguageProperty", pick_text(F.col("texts"), F.lit(None).cast("string"))).when(~F.col("model_type").isin("SubmodelElementCollection", "SubmodelElementList"), F.col("value"))
    return top.select("submodel_id", "idShort", F.col("model_type").alias("modelType"), value.alias("value"))


def write_csv(projected: DataFrame, path: str) -> None:
    """Rows as CSV files with a header; cells with commas or quotes are quoted."""
    projected.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
