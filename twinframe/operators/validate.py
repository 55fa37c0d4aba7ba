"""Constraint checks of the metamodel, each one a filter, join or group over the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph, labels
from .resolve import references

VERSIONS = ("3.0", "3.1", "3.2")
#: Rules that hold in some versions only, and classes of keys.
ONLY = {"AASd-090": ("3.0",), "AASd-120": ("3.0",), "AASd-137": ("3.2",), "AASd-138": ("3.2",)}
GLOBAL_KEYS = ("AssetAdministrationShell", "ConceptDescription", "Submodel", "GlobalReference")
MODEL_KEYS = GLOBAL_KEYS[:3]
ELEMENT_KEYS = (
    "AnnotatedRelationshipElement", "BasicEventElement", "Blob", "Capability", "DataElement", "Entity", "EventElement", "File", "MultiLanguageProperty",
    "Operation", "Property", "Range", "ReferenceElement", "RelationshipElement", "SubmodelElement", "SubmodelElementCollection", "SubmodelElementList",
)
FRAGMENT_KEYS = (*ELEMENT_KEYS, "FragmentReference")
REFERABLE_KEYS = (*MODEL_KEYS, *ELEMENT_KEYS, "Identifiable", "Referable")
VARIABLES = ("inputVariables", "outputVariables", "inoutputVariables")
NAME_30, NAME = r"^[a-zA-Z][a-zA-Z0-9_]*$", r"^[a-zA-Z][a-zA-Z0-9_-]*[a-zA-Z0-9_]+$"

RULES: dict[str, tuple[str, object]] = {}


def rule(number: str, description: str):
    def add(f):
        RULES[f"AASd-{number}"] = (description, f)
        return f

    return add


class Tables:
    def __init__(self, graph: Graph, version: str):
        self.graph, self.version = graph, version
        self.elements = graph.elements
        own = lambda df, kind: df.select(F.col("id").alias("node_id"), "idShort", F.lit(kind).alias("model_type"))
        self.referables = own(graph.shells, "AssetAdministrationShell").union(own(graph.submodels, "Submodel")).union(own(graph.concepts, "ConceptDescription")).union(self.elements.select("node_id", "idShort", "model_type"))
        qualified = "qualifiers", "semantic", "supplemental"
        self.qualifiables = graph.submodels.select(F.col("id").alias("node_id"), *qualified).union(self.elements.select("node_id", *qualified))
        self.lists = self.elements.filter("model_type = 'SubmodelElementList'").select(F.col("node_id").alias("parent_id"), "listType", "listValueType", F.to_json("listSemantic").alias("list_semantic"))
        self.children = self.elements.filter(F.get("indexes", F.size("indexes") - 1).isNotNull())

    def identified(self, *columns: str) -> DataFrame:
        """Columns that shells, submodels and concepts have."""
        own = [df.select(F.col("id").alias("node_id"), *columns) for df in (self.graph.shells, self.graph.submodels, self.graph.concepts)]
        return own[0].union(own[1]).union(own[2])

    @property
    def references(self) -> DataFrame:
        return references(self.graph).select(F.col("owner").alias("node_id"), F.col("ref.type").alias("type"), F.col("ref.keys").alias("keys"))


def last_rel() -> Column:
    """The containment that leads to an element from its parent."""
    return F.get("rels", F.size("rels") - 1)


def found(df: DataFrame, detail: Column | None = None) -> DataFrame:
    return df.select("node_id", (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def repeated(df: DataFrame, name: Column) -> DataFrame:
    """Nodes (node_id) with one name more than once."""
    return found(df.groupBy("node_id", name.alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND name IS NOT NULL"), F.col("name"))


@rule("002", "idShort consists of letters, digits, underscores and, since 3.1, inner hyphens")
def name_shape(t: Tables) -> DataFrame:
    return found(t.referables.filter(~F.col("idShort").rlike(NAME_30 if t.version == "3.0" else NAME)), F.col("idShort"))


@rule("005", "a revision needs a version")
def revision(t: Tables) -> DataFrame:
    return found(t.identified("version", "revision").filter("revision IS NOT NULL AND version IS NULL"))


@rule("014", "a self-managed entity names its asset, and in 3.0 no other does")
def entity_asset(t: Tables) -> DataFrame:
    entities = t.elements.filter("model_type = 'Entity'").withColumn("named", F.col("globalAssetId").isNotNull() | (F.coalesce(F.size("specific"), F.lit(0)) > 0))
    wrong = (F.col("entityType") == "SelfManagedEntity") & ~F.col("named")
    return found(entities.filter(wrong | ((F.col("entityType") != "SelfManagedEntity") & F.col("named")) if t.version == "3.0" else wrong))


@rule("021", "a qualifier type occurs once")
def qualifier_types(t: Tables) -> DataFrame:
    return repeated(t.qualifiables.select("node_id", F.explode("qualifiers").alias("q")), F.col("q.type"))


@rule("022", "names of siblings differ")
def sibling_names(t: Tables) -> DataFrame:
    # variables of an operation have rule 134
    outside = t.elements.filter(F.get("indexes", F.size("indexes") - 1).isNull() & ~last_rel().isin(*VARIABLES))
    return repeated(outside.select(F.col("parent_id").alias("node_id"), "idShort"), F.col("idShort"))


@rule("077", "names of extensions differ")
def extension_names(t: Tables) -> DataFrame:
    return repeated(t.elements.select("node_id", "extensions").union(t.identified("extensions")).select("node_id", F.explode("extensions").alias("e")), F.col("e"))


@rule("090", "the category of a data element is one of three")
def categories(t: Tables) -> DataFrame:
    data = t.elements.filter(F.array_contains(labels(F.col("model_type")), "DataElement"))
    return found(data.filter(~F.col("category").isin("CONSTANT", "PARAMETER", "VARIABLE")), F.col("category"))


def listed(t: Tables) -> DataFrame:
    return t.children.join(t.lists.withColumnsRenamed({"listType": "list_type", "listValueType": "list_value"}), "parent_id")


@rule("107", "list children have the semantic identifier that the list names")
def list_semantics(t: Tables) -> DataFrame:
    return found(listed(t).filter(F.col("semantic").isNotNull() & (F.to_json("semantic") != F.col("list_semantic"))))


@rule("108", "list children are of the type that the list names")
def list_types(t: Tables) -> DataFrame:
    return found(listed(t).filter(~F.array_contains(labels(F.col("model_type")), F.col("list_type"))))


@rule("109", "a list of properties or ranges names a value type, and its children have it")
def list_value_types(t: Tables) -> DataFrame:
    bare = t.elements.filter("model_type = 'SubmodelElementList' AND listType IN ('Property', 'Range') AND listValueType IS NULL")
    other = listed(t).filter("list_type IN ('Property', 'Range') AND valueType <> list_value")
    return found(bare).union(found(other, F.col("valueType")))


@rule("114", "semantic identifiers of list children agree")
def one_semantic(t: Tables) -> DataFrame:
    kinds = t.children.filter("semantic IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count_distinct(F.to_json("semantic")).alias("n"))
    return found(kinds.filter("n > 1"), F.col("n"))


@rule("117", "a referable outside lists has a name")
def named(t: Tables) -> DataFrame:
    return found(t.elements.filter(F.col("idShort").isNull() & F.get("indexes", F.size("indexes") - 1).isNull()))


@rule("118", "supplemental semantic identifiers need a main one")
def supplemental(t: Tables) -> DataFrame:
    return found(t.qualifiables.filter((F.size("supplemental") > 0) & F.col("semantic").isNull()))


def has_template_qualifier() -> Column:
    return F.coalesce(F.exists("qualifiers", lambda q: q["kind"] == "TemplateQualifier"), F.lit(False))


@rule("119", "template qualifiers stand in templates")
def template_qualifier(t: Tables) -> DataFrame:
    return found(t.graph.submodels.select(F.col("id").alias("node_id"), "kind", "qualifiers").filter(has_template_qualifier() & (F.col("kind") != "Template")))


@rule("120", "list children have no name")
def unnamed(t: Tables) -> DataFrame:
    return found(t.children.filter("idShort IS NOT NULL"), F.col("idShort"))


def key_rule(test):
    return lambda t: found(t.references.filter(test()), F.transform("keys", lambda k: k["type"]).cast("string"))


first, last = (lambda: F.get("keys", F.lit(0))["type"]), (lambda: F.try_element_at("keys", F.lit(-1))["type"])
external, model = (lambda: F.col("type") == "ExternalReference"), (lambda: F.col("type") == "ModelReference")
rule("121", "the first key is globally identifiable")(key_rule(lambda: ~first().isin(*GLOBAL_KEYS)))
rule("122", "an external reference starts with a global reference")(key_rule(lambda: external() & (first() != "GlobalReference")))
rule("123", "a model reference starts with an identifiable")(key_rule(lambda: model() & ~first().isin(*MODEL_KEYS)))
rule("124", "an external reference ends with a global or fragment reference")(key_rule(lambda: external() & ~last().isin("GlobalReference", "FragmentReference")))
rule("125", "later keys of a model reference are fragment keys")(key_rule(lambda: model() & F.exists(F.slice("keys", 2, 1000), lambda k: ~k["type"].isin(*FRAGMENT_KEYS))))
rule("126", "a fragment reference comes last")(key_rule(lambda: model() & F.exists(F.slice("keys", 1, F.greatest(F.size("keys") - 1, F.lit(0))), lambda k: k["type"] == "FragmentReference")))
rule("127", "a fragment reference follows a file or blob")(key_rule(lambda: model() & (F.size("keys") > 1) & (last() == "FragmentReference") & ~F.try_element_at("keys", F.lit(-2))["type"].isin("File", "Blob")))
rule("128", "the key after a list is a place")(key_rule(lambda: model() & F.exists(F.zip_with(F.slice("keys", 1, F.greatest(F.size("keys") - 1, F.lit(0))), F.slice("keys", 2, 1000), lambda a, b: (a["type"] == "SubmodelElementList") & ~b["value"].rlike("^[0-9]+$")), lambda x: x)))
rule("137", "an external reference has no key of a referable")(key_rule(lambda: external() & F.exists("keys", lambda k: k["type"].isin(*REFERABLE_KEYS))))


@rule("129", "elements with template qualifiers belong to a template")
def template_element(t: Tables) -> DataFrame:
    templates = t.graph.submodels.filter("kind = 'Template'").select(F.col("id").alias("submodel_id"))
    marked = t.elements.filter(has_template_qualifier())
    if t.version == "3.2":
        operations = t.elements.filter("model_type = 'Operation'").select(F.col("node_id").alias("op"))
        below = marked.select("node_id", F.explode("ancestors").alias("op")).join(operations, "op", "left_semi").select("node_id").distinct()
        marked = marked.join(below, "node_id", "left_anti")
    return found(marked.join(templates, "submodel_id", "left_anti"))


@rule("131", "a shell names its asset")
def asset_named(t: Tables) -> DataFrame:
    return found(t.graph.shells.filter(F.col("globalAssetId").isNull() & (F.coalesce(F.size("specific"), F.lit(0)) == 0)).withColumn("node_id", F.col("id")))


@rule("133", "an external subject is an external reference")
def subject(t: Tables) -> DataFrame:
    holders = t.graph.shells.select(F.col("id").alias("node_id"), "specific").union(t.elements.filter("model_type = 'Entity'").select("node_id", "specific"))
    return found(holders.filter(F.exists("specific", lambda s: s["externalSubject"]["type"] != "ExternalReference")))


@rule("134", "names of an operation's variables differ")
def variables(t: Tables) -> DataFrame:
    inner = t.elements.filter(last_rel().isin(*VARIABLES))
    return repeated(inner.select(F.col("parent_id").alias("node_id"), "idShort"), F.col("idShort"))


@rule("138", "a list in a template or below a variable of an operation has one child")
def template_lists(t: Tables) -> DataFrame:
    templates = t.graph.submodels.filter("kind = 'Template'").select(F.col("id").alias("submodel_id"))
    every = t.elements.filter("model_type = 'SubmodelElementList'")
    lists = every.join(templates, "submodel_id", "left_semi").select("node_id").union(every.filter(F.arrays_overlap("rels", F.array(*map(F.lit, VARIABLES)))).select("node_id")).distinct()
    sizes = t.children.groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return found(lists.join(sizes, "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1"), F.col("n"))


class Checker:
    """Checks of one metamodel version."""

    def __init__(self, graph: Graph, version: str = "3.1"):
        if version not in VERSIONS:
            raise ValueError(f"Unknown version: {version}")
        self.tables, self.version = Tables(graph, version), version

    @property
    def constraint_ids(self) -> list[str]:
        return sorted(r for r in RULES if self.version in ONLY.get(r, VERSIONS))

    def check(self, ids: list[str]) -> DataFrame:
        """(constraint_id, description, node_id, detail) of all violations of the given rules."""
        if bad := [i for i in ids if i not in self.constraint_ids]:
            raise ValueError(f"Unknown or not applicable in {self.version}: {bad}")
        parts = [RULES[i][1](self.tables).select(F.lit(i).alias("constraint_id"), F.lit(RULES[i][0]).alias("description"), "node_id", "detail") for i in ids]
        return reduce(DataFrame.union, parts)

    def check_all(self) -> DataFrame:
        return self.check(self.constraint_ids)
