"""Structural union of submodels: the template that all instances of a type fit."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph, labels
from ..session import new_folder
from .narrow import within
from .semantic import semantic_id


#: Levels of elements that paths are constants at, and how many submodels are looked up by a filter.
DEPTH, FIRSTS = 6, 1000


def union(graph: Graph, submodel_type: str, by_semantic_id: bool | None = False) -> DataFrame:
    """(path, depth, model_type, valueType, semantic_id, instances, optional) of each place that any submodel of the type has.

    Children of a list share one place, written as []. Attributes are those of the instance that comes first by submodel and node; children
    without a name outside lists are left out. A type is a name, a semantic identifier, or (by_semantic_id None) the identifier if any submodel has it, else the name.
    Raises ValueError when no submodel is of the type.
    """
    if by_semantic_id is None:
        by_semantic_id = not graph.submodels.filter(semantic_id() == submodel_type).isEmpty()
    test = semantic_id() == submodel_type if by_semantic_id else F.col("idShort") == submodel_type
    chosen = graph.submodels.filter(test).select(F.col("id").alias("submodel_id"))
    total = chosen.count()
    if not total:
        raise ValueError(f"No submodel of type {submodel_type}")
    placed = graph.elements.withColumn("path", F.coalesce(*(F.when(F.size("names") == n, joined(n)) for n in range(1, DEPTH + 1)), joined())).filter(~F.contains("path", F.lit("?")))
    depth = F.size("names").alias("depth")
    # an inner join, as a semi-join would go into every branch of a graph that is a union
    inside = within(placed.select("submodel_id", "path", depth), "submodel_id", chosen).join(chosen.distinct(), "submodel_id")
    counted = stored(inside.groupBy("path", "depth").agg(F.min("submodel_id").alias("submodel_id"), F.count_distinct("submodel_id").alias("instances")))
    # attributes stand in the first submodel that has a place
    firsts = [r["submodel_id"] for r in counted.select("submodel_id").distinct().limit(FIRSTS + 1).collect()]
    near = placed.filter(F.col("submodel_id").isin(firsts)) if len(firsts) <= FIRSTS else within(placed, "submodel_id", counted.select("submodel_id"))
    first = F.min(F.struct("node_id", "model_type", "valueType", semantic_id().alias("semantic_id"))).alias("f")
    attributes = near.groupBy("submodel_id", "path", depth).agg(first)
    places = counted.join(attributes, ["submodel_id", "path", "depth"])
    return places.select("path", "depth", "f.model_type", "f.valueType", "f.semantic_id", "instances", (F.col("instances") < total).alias("optional"))


def joined(depth: int | None = None) -> Column:
    """The path of an element at a depth, or at any. At a known one it is a constant for elements of one kind, so that neither places in lists nor names are made for each row."""
    step = lambda name, index: F.when(index.isNotNull(), F.lit("[]")).otherwise(name)
    if depth is None:
        return F.array_join(F.transform(F.arrays_zip("names", "indexes"), lambda x: step(x["names"], x["indexes"])), "/", "?")
    return F.concat_ws("/", *(F.coalesce(step(F.get("names", F.lit(k)), F.get("indexes", F.lit(k))), F.lit("?")) for k in range(depth)))


def stored(df: DataFrame) -> DataFrame:
    path = f"{new_folder(df.sparkSession)}/places"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def document(graph: Graph, submodel_type: str, by_semantic_id: bool | None = False) -> dict:
    """The template as one nested document: places of the union below one another, with their cardinality; the type as for union, and named as semanticId only where it is one by the caller's word.

    A type's places are few whatever the number of its submodels, so the document is put together by the driver.
    """
    places = sorted(union(graph, submodel_type, by_semantic_id).collect(), key=lambda r: (r["depth"], r["path"]))
    root = {"modelType": "Submodel", "kind": "Template", ("semanticId" if by_semantic_id else "idShort"): submodel_type, "submodelElements": []}
    made = {}
    for r in places:
        above, _, name = r["path"].rpartition("/")
        e = {"modelType": r["model_type"]} | ({} if name == "[]" else {"idShort": name}) | {k: v for k, v in (("valueType", r["valueType"]), ("semanticId", r["semantic_id"])) if v}
        made[r["path"]] = e | {"cardinality": "ZeroToOne" if r["optional"] else "One"}
        parent = made.get(above) if above else root
        if parent is not None:
            parent.setdefault("submodelElements" if parent is root else "value", []).append(made[r["path"]])
    return root


def as_yaml(value, depth: int = 0) -> str:
    """A document as YAML in block style; texts are quoted as in JSON, which YAML reads."""
    indent = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{indent}{k}:" + (f"\n{as_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {json.dumps(v, ensure_ascii=False)}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{indent}- {as_yaml(v, depth + 1).lstrip()}" for v in value)
    return f"{indent}{json.dumps(value, ensure_ascii=False)}\n"


def element_labels(graph: Graph) -> DataFrame:
    """(label, n): how many elements are of each class, its parents included."""
    return graph.elements.groupBy("model_type").agg(F.count(F.lit(1)).alias("n")).select(F.explode(labels(F.col("model_type"))).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))
