"""Tables that a graph of shells, submodels and elements is held in."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Classes of the metamodel and what each one also is.
DATA_ELEMENTS = ("Blob", "File", "MultiLanguageProperty", "Property", "Range", "ReferenceElement")
ELEMENTS = ("Capability", "Entity", "Operation", "RelationshipElement", "SubmodelElementCollection", "SubmodelElementList")
PARENTS = {
    "AssetAdministrationShell": ["Identifiable", "Referable"],
    "ConceptDescription": ["Identifiable", "Referable"],
    "Submodel": ["Identifiable", "Referable", "Qualifiable"],
    **{c: ["SubmodelElement", "Referable", "Qualifiable"] for c in ELEMENTS},
    "BasicEventElement": ["EventElement", "SubmodelElement", "Referable", "Qualifiable"],
    "AnnotatedRelationshipElement": ["RelationshipElement", "SubmodelElement", "Referable", "Qualifiable"],
    **{c: ["DataElement", "SubmodelElement", "Referable", "Qualifiable"] for c in DATA_ELEMENTS},
    "DataSpecificationIec61360": ["DataSpecificationContent"],
}

LANG = "array<struct<language:string,text:string>>"
KEYS = "array<struct<type:string,value:string>>"
REFERENCE = f"struct<type:string,keys:{KEYS}>"
QUALIFIERS = "array<struct<kind:string,type:string,valueType:string,value:string>>"
SPECIFIC = f"array<struct<name:string,value:string,externalSubject:{REFERENCE}>>"

#: One row for each submodel element at any depth. rels, names and indexes describe the path from the submodel; kind is s, n or b as the value was a
#: string, number or boolean; siblings are told apart by node_id and ordered by place. rest, in all
#: tables, is what a document says of a row that no column gives back, as JSON.
ELEMENT = f"""submodel_id string, node_id string, parent_id string, rels array<string>, names array<string>, indexes array<int>, ancestors array<string>,
    model_type string, idShort string, category string, value string, kind string, valueType string, min string, max string, texts {LANG},
    semantic {REFERENCE}, supplemental array<{REFERENCE}>, qualifiers {QUALIFIERS}, extensions array<string>, target {REFERENCE},
    entityType string, globalAssetId string, specific {SPECIFIC}, listType string, listValueType string, listSemantic {REFERENCE}, place int, rest string"""
SHELL = f"id string, idShort string, category string, assetKind string, assetType string, globalAssetId string, specific {SPECIFIC}, submodels array<{REFERENCE}>, version string, revision string, description {LANG}, extensions array<string>, rest string"
SUBMODEL = f"id string, idShort string, category string, kind string, semantic {REFERENCE}, supplemental array<{REFERENCE}>, qualifiers {QUALIFIERS}, version string, revision string, description {LANG}, extensions array<string>, rest string"
CONCEPT = f"id string, idShort string, displayName {LANG}, description {LANG}, isCaseOf array<{REFERENCE}>, unit string, version string, revision string, extensions array<string>, rest string"


@cache
def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of ddl, in order; those it lacks are null."""
    there = dict(df.dtypes)
    given = lambda f: F.col(f.name) if there[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType)
    return df.select(*((given(f) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in struct(ddl).fields))


def labels(model_type: Column) -> Column:
    """A class and all that it also is; an unknown class is itself alone."""
    known = F.create_map(*(x for c, up in PARENTS.items() for x in (F.lit(c), F.array(F.lit(c), *map(F.lit, up)))))
    return F.coalesce(F.try_element_at(known, model_type), F.array(model_type))


def reference(kind: str, *keys: tuple[str, Column]) -> Column:
    """A reference of the given kind and (type, value) keys."""
    return F.struct(F.lit(kind).alias("type"), F.array(*(F.struct(F.lit(t).alias("type"), v.cast("string").alias("value")) for t, v in keys)).alias("keys"))


def first_key(ref: Column) -> Column:
    return F.get(ref["keys"], F.lit(0))["value"]


@dataclass
class Graph:
    """The tables; bridge (aas_id, sm_id) says which submodels a shell refers to."""

    shells: DataFrame
    submodels: DataFrame
    elements: DataFrame
    concepts: DataFrame
    #: References, children and bridge as stored tables (operators.resolve.Links), if operators.resolve.link has made them.
    links: object | None = None

    @property
    def spark(self):
        return self.shells.sparkSession

    def changed(self, **tables: DataFrame) -> Graph:
        """This graph with other tables in place of some; stored links go."""
        return replace(self, links=None, **tables)

    @property
    def bridge(self) -> DataFrame:
        if self.links:
            return self.links.bridge
        refs = self.shells.select(F.col("id").alias("aas_id"), F.explode("submodels").alias("r")).select("aas_id", first_key(F.col("r")).alias("sm_id"))
        return refs.join(self.submodels.select(F.col("id").alias("sm_id")), "sm_id").distinct()

    def write(self, path: str) -> None:
        for name in ("shells", "submodels", "elements", "concepts"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def wipe(spark, path: str) -> None:
        """Removes the tables that write has made under path; none is no error."""
        for name in ("shells", "submodels", "elements", "concepts"):
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    @classmethod
    def load(cls, spark, path: str) -> Graph:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("shells", "submodels", "elements", "concepts")))
