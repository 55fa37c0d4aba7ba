"""A graph with planted violations of every constraint, made from the part table: the checks' results can be told from the keys alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ELEMENT, SHELL, SUBMODEL, Graph, reference, shaped

#: Every how many parts a rule is violated.
EVERY = 7


def graph(spark: SparkSession, sf_dir: str, base: Graph) -> Graph:
    """For each rule, a submodel `urn:check:<rule>:<part>` whose one element (or the submodel or its shell) breaks the rule if EVERY divides the part's key."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    bad = F.col("p_partkey") % EVERY == 0
    root = lambda rule: F.concat(F.lit(f"urn:check:{rule}:"), F.col("p_partkey").cast("string"))
    text = lambda s: F.lit(s).cast("string")
    either = lambda wrong, right: F.when(bad, wrong).otherwise(right)
    ref = lambda kind, *keys: reference(kind, *((k, F.lit(v)) for k, v in keys))
    qualifier = lambda kind, name: F.struct(text(kind).alias("kind"), text(name).alias("type"), text("xs:string").alias("valueType"), text("x").alias("value"))
    a, b = ref("ExternalReference", ("GlobalReference", "urn:a")), ref("ExternalReference", ("GlobalReference", "urn:b"))

    def element(rule: str, *names: str, rel: tuple[str, ...] = (), index: tuple[int | None, ...] | None = None, node: str | None = None, rows: DataFrame = part, **columns: Column) -> DataFrame:
        ids = [root(rule)]
        for k, n in enumerate(names):
            ids.append(F.concat(ids[-1], F.lit("/"), n if isinstance(n, Column) else F.lit(n if k + 1 < len(names) or node is None else node)))
        columns = {"model_type": F.lit("Property"), "idShort": names[-1] if isinstance(names[-1], Column) else F.lit(names[-1])} | columns
        placed = {
            "submodel_id": ids[0], "node_id": ids[-1], "parent_id": ids[-2], "rels": F.array(*map(F.lit, rel or ("submodelElements", *["value"] * (len(names) - 1)))),
            "names": F.array(*(n if isinstance(n, Column) else F.lit(n) for n in names[:-1]), columns["idShort"]), "indexes": F.array(*map(F.lit, index or [None] * len(names))).cast("array<int>"), "ancestors": F.array(*ids[:-1]),
        }
        return shaped(rows.select(*(c.alias(n) for n, c in (placed | columns).items())), ELEMENT)

    only_bad = part.filter(bad)
    a_list = lambda rule, **c: element(rule, "Items", model_type=F.lit("SubmodelElementList"), **c)
    child = lambda rule, place, **c: element(rule, "Items", "x", node=str(place), index=(None, place), idShort=text(None), **c)
    target = lambda rule, wrong, right: element(rule, "Elem", model_type=F.lit("ReferenceElement"), target=either(wrong, right))
    key = lambda kind, *keys: ref(kind, *((k, f"urn:{i}") for i, k in enumerate(keys)))
    good_model = key("ModelReference", "Submodel", "Property")
    elements = [
        element("002", either(F.lit("1bad"), F.lit("good")), idShort=either(F.lit("1bad"), F.lit("good"))),
        element("014", "Elem", model_type=F.lit("Entity"), entityType=F.lit("SelfManagedEntity"), globalAssetId=either(text(None), text("urn:x"))),
        element("021", "Elem", qualifiers=F.array(qualifier("ValueQualifier", "q"), F.when(bad, qualifier("ValueQualifier", "q")).otherwise(qualifier("ValueQualifier", "r")))),
        element("022", "Elem"), element("022", "Elem", node="Elem2", rows=only_bad),
        element("077", "Elem", extensions=either(F.array(F.lit("e"), F.lit("e")), F.array(F.lit("e"), F.lit("f")))),
        element("090", "Elem", category=either(F.lit("OTHER"), F.lit("CONSTANT"))),
        a_list("107", listType=F.lit("Property"), listValueType=F.lit("xs:int"), listSemantic=a), child("107", 0, semantic=either(b, a), valueType=F.lit("xs:int")),
        a_list("108", listType=either(F.lit("Range"), F.lit("DataElement")), listValueType=F.lit("xs:int")), child("108", 0, valueType=F.lit("xs:int")),
        a_list("109", listType=F.lit("Property"), listValueType=either(text(None), text("xs:int"))), child("109", 0, valueType=F.lit("xs:int")),
        a_list("114", listType=F.lit("Property"), listValueType=F.lit("xs:int")), child("114", 0, semantic=a, valueType=F.lit("xs:int")), child("114", 1, semantic=either(b, a), valueType=F.lit("xs:int")),
        element("117", "Elem", idShort=either(text(None), text("Elem"))),
        element("118", "Elem", supplemental=F.array(a), semantic=F.when(~bad, a)),
        a_list("120", listType=F.lit("Property"), listValueType=F.lit("xs:int")), element("120", "Items", "x", node="0", index=(None, 0), idShort=either(text("named"), text(None)), valueType=F.lit("xs:int")),
        target("121", key("AnyReference", "Property"), good_model), target("122", key("ExternalReference", "Submodel", "GlobalReference"), a), target("123", key("ModelReference", "GlobalReference"), good_model),
        target("124", key("ExternalReference", "GlobalReference", "Blob"), a), target("125", key("ModelReference", "Submodel", "Submodel"), good_model), target("126", key("ModelReference", "Submodel", "File", "FragmentReference", "File"), good_model),
        target("127", key("ModelReference", "Submodel", "Property", "FragmentReference"), key("ModelReference", "Submodel", "File", "FragmentReference")),
        target("128", ref("ModelReference", ("Submodel", "urn:0"), ("SubmodelElementList", "Items"), ("Property", "name")), ref("ModelReference", ("Submodel", "urn:0"), ("SubmodelElementList", "Items"), ("Property", "3"))),
        target("137", key("ExternalReference", "GlobalReference", "Property"), a),
        element("129", "Elem", qualifiers=F.when(bad, F.array(qualifier("TemplateQualifier", "q")))),
        element("134", "Action", model_type=F.lit("Operation")), *(element("134", "Action", n, rel=("submodelElements", r), node=f"{r}{n}", rows=w) for r, n, w in (("inputVariables", "argument", part), ("outputVariables", "argument", only_bad))),
        a_list("138", listType=F.lit("Property"), listValueType=F.lit("xs:int")), child("138", 0, valueType=F.lit("xs:int")), element("138", "Items", "x", node="1", index=(None, 1), idShort=text(None), valueType=F.lit("xs:int"), rows=only_bad),
    ]
    rules = [f"{n:03d}" for n in (2, 5, 14, 21, 22, 77, 90, 107, 108, 109, 114, 117, 118, 119, 120, 121, 122, 123, 124, 125, 126, 127, 128, 129, 134, 137, 138)]
    columns = {
        "005": {"version": either(text(None), text("1")), "revision": text("0")}, "119": {"kind": either(text("Instance"), text("Template")), "qualifiers": F.array(qualifier("TemplateQualifier", "q"))}, "138": {"kind": text("Template")},
    }
    submodels = [shaped(part.select(root(r).alias("id"), F.lit("Check").alias("idShort"), *(c.alias(n) for n, c in columns.get(r, {}).items())), SUBMODEL) for r in rules]
    entry = lambda subject: F.array(F.struct(F.lit("s").alias("name"), F.lit("v").alias("value"), subject.alias("externalSubject")))
    shells = [
        shaped(part.select(root("131").alias("id"), F.lit("Check").alias("idShort"), either(text(None), text("urn:x")).alias("globalAssetId")), SHELL),
        shaped(part.select(root("133").alias("id"), F.lit("Check").alias("idShort"), F.lit("urn:x").alias("globalAssetId"), entry(either(good_model, a)).alias("specific")), SHELL),
    ]
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return base.changed(shells=union([base.shells, *shells]), submodels=union([base.submodels, *submodels]), elements=union([base.elements, *elements]))
