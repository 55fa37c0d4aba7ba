"""The store, export without loss, projections, statistics, repairs of one's own, template documents and field search."""

import csv
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from twinframe.operators import cleaning, projection, resolve, statistics, template, tools
from twinframe.operators.store import Store
from twinframe.schema import SUBMODEL, Graph, shaped
from twinframe.sources import readers

GLOBAL = {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": "urn:g"}]}
SECTIONS = {"AssetAdministrationShell": "assetAdministrationShells", "Submodel": "submodels", "ConceptDescription": "conceptDescriptions"}


def to_element(*steps):
    kinds = ["Submodel", *["SubmodelElementCollection"] * (len(steps) - 2), "Property"]
    return {"type": "ModelReference", "keys": [{"type": k, "value": v} for k, v in zip(kinds, steps, strict=True)]}


def prop(name, value, **more):
    return {"modelType": "Property", "idShort": name, "valueType": "xs:string", "value": value} | more


def graph(spark, *identifiables):
    rows = [("f", 0, SECTIONS[x["modelType"]], i, json.dumps(x), None) for i, x in enumerate(identifiables)]
    g = readers.from_documents(spark.createDataFrame(rows, readers.DOCUMENT).coalesce(1))
    return Graph(*(getattr(g, t).cache() for t in ("shells", "submodels", "elements", "concepts")))


SHELL = {
    "modelType": "AssetAdministrationShell", "id": "urn:a", "idShort": "A", "displayName": [{"language": "en", "text": "shell"}], "derivedFrom": GLOBAL, "extensions": [{"name": "x", "value": "1", "valueType": "xs:int"}],
    "assetInformation": {"assetKind": "Instance", "globalAssetId": "urn:asset", "defaultThumbnail": {"path": "p.png"}, "specificAssetIds": [{"name": "n", "value": "v", "semanticId": GLOBAL}]}, "submodels": [GLOBAL | {"referredSemanticId": GLOBAL}],
}
MODEL = {
    "modelType": "Submodel", "id": "urn:s", "idShort": "S", "kind": "Template", "semanticId": GLOBAL, "administration": {"version": "1", "creator": GLOBAL}, "qualifiers": [{"type": "q", "valueType": "xs:int", "value": "1", "valueId": GLOBAL}],
    "submodelElements": [
        prop("Z", 1.5, valueId=GLOBAL, description=[{"language": "de", "text": "x"}], embeddedDataSpecifications=[{"dataSpecification": GLOBAL}]), prop("A", None), prop("B", True),
        {"modelType": "MultiLanguageProperty", "idShort": "M", "value": [{"language": "en", "text": "hi"}, {"language": "de", "text": "hallo"}]},
        {"modelType": "SubmodelElementList", "idShort": "L", "orderRelevant": True, "typeValueListElement": "Property", "valueTypeListElement": "xs:string", "value": [prop(f"n{i}", str(i)) for i in range(12)]},
        {"modelType": "RelationshipElement", "idShort": "R", "first": GLOBAL, "second": to_element("urn:s", "Z")}, {"modelType": "File", "idShort": "F", "contentType": "a/b", "value": "/f"}, {"modelType": "BasicEventElement", "idShort": "E", "observed": GLOBAL, "state": "on"},
        {"modelType": "Operation", "idShort": "O", "inputVariables": [{"value": prop("i", "1")}], "outputVariables": [{"value": prop("i", "2")}]}, {"modelType": "Entity", "idShort": "N", "entityType": "CoManagedEntity", "statements": [prop("s", "1")]},
        {"modelType": "SubmodelElementCollection", "idShort": "C", "value": [prop("Inner", "x"), {"modelType": "SubmodelElementCollection", "idShort": "Empty", "value": []}]},
    ],
}
CONCEPT = {"modelType": "ConceptDescription", "id": "urn:c", "displayName": [{"language": "en", "text": "C"}], "isCaseOf": [GLOBAL], "embeddedDataSpecifications": [{"dataSpecificationContent": {"modelType": "DataSpecificationIec61360", "unit": "mm", "preferredName": []}}]}


def test_export_gives_back_what_was_read(spark, tmp_path):
    g = graph(spark, SHELL, MODEL, CONCEPT)
    back = {r["id"]: json.loads(r["payload"]) for r in readers.export(g).collect()}
    empty = MODEL["submodelElements"][-1]["value"][1]
    back["urn:s"]["submodelElements"][-1]["value"][1].setdefault("value", empty["value"])  # an empty list is no children
    assert back == {"urn:a": SHELL, "urn:s": MODEL, "urn:c": CONCEPT}
    g.write(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    assert {r["id"]: json.loads(r["payload"])["modelType"] for r in readers.export(again).collect()} == {"urn:a": "AssetAdministrationShell", "urn:s": "Submodel", "urn:c": "ConceptDescription"}
    assert readers.element_document(g, Store(g).find("urn:s", "N")) == MODEL["submodelElements"][9]
    Graph.wipe(spark, str(tmp_path / "g"))
    Graph.wipe(spark, str(tmp_path / "nothing"))
    assert not (tmp_path / "g" / "shells").exists()


def test_repairs_reach_the_export(spark):
    fixed = Graph(*(getattr(graph(spark, {"modelType": "Submodel", "id": "urn:s", "submodelElements": [prop("1a", "x", valueType="xs:int")]}), t) for t in ("shells", "submodels", "elements", "concepts")))
    mended = fixed.changed(elements=cleaning.repair(fixed.elements))
    (e,) = json.loads(readers.export_submodels(mended).first()["payload"])["submodelElements"]
    assert (e["idShort"], e["valueType"]) == ("x1a", "xs:string")
    own = cleaning.Fixer("upper", "value", lambda: F.upper("value"))
    assert cleaning.repair(fixed.elements, (own,)).first()["value"] == "X" and {r["fixer"]: r["n"] for r in cleaning.repair_report(fixed.elements, (*cleaning.FIXERS, own)).collect()} == {"language": 0, "emptyText": 0, "numeric": 1, "idShort": 1, "upper": 1}


def two(spark):
    inner = {"modelType": "SubmodelElementCollection", "idShort": "C", "value": [prop("P", "1"), prop("Q", "2")]}
    pointer = {"modelType": "ReferenceElement", "idShort": "R", "value": to_element("urn:s", "C", "P")}
    return Store(graph(spark, {"modelType": "Submodel", "id": "urn:s", "submodelElements": [inner]}, {"modelType": "Submodel", "id": "urn:t", "submodelElements": [pointer]}))


def test_remove_keeps_what_others_name(spark):
    store = two(spark)
    left, n = store.removed("urn:s")
    assert n == 3 and {r["node_id"] for r in left.graph.elements.collect()} == {"urn:s/C/P", "urn:t/R"} and "urn:s" not in left
    left, n = store.removed_element("urn:s", "C")
    assert n == 2 and {r["node_id"] for r in left.graph.elements.collect()} == {"urn:s/C/P", "urn:t/R"}
    left, n = store.removed("urn:t")
    assert n == 2 and left.removed("urn:s")[1] == 4
    with pytest.raises(KeyError):
        store.removed("urn:x")


def test_commit_discard_upsert(spark):
    store = two(spark)
    row = shaped(spark.createDataFrame([("urn:t", "new")], "id string, idShort string"), SUBMODEL)
    changed = store.commit("Submodel", row)
    assert len(changed) == 2 and changed.get("urn:t")[1].first()["idShort"] == "new" and changed.graph.elements.filter("submodel_id = 'urn:t'").isEmpty()
    with pytest.raises(KeyError):
        store.commit("Submodel", row.withColumn("id", F.lit("urn:u")))
    assert store.discard("urn:u") is store and len(store.discard("urn:t")) == 1 and "urn:t" in store
    other = graph(spark, {"modelType": "Submodel", "id": "urn:t", "idShort": "T2"}, {"modelType": "Submodel", "id": "urn:u", "submodelElements": [prop("P", "1")]}, SHELL)
    merged = store.upsert(other)
    assert sorted((r["kind"], r["id"]) for r in merged.ids().collect()) == [("AssetAdministrationShell", "urn:a"), ("Submodel", "urn:s"), ("Submodel", "urn:t"), ("Submodel", "urn:u")]
    assert {r["node_id"] for r in merged.graph.elements.collect()} == {"urn:s/C", "urn:s/C/P", "urn:s/C/Q", "urn:u/P"}
    found = merged.query({"$condition": {"$eq": [{"$field": "$sme.P#value"}, {"$strVal": "1"}]}})
    assert [r["id"] for r in found.collect()] == ["urn:u"] and [r["id"] for r in merged.ids("AssetAdministrationShell").collect()] == ["urn:a"]


def test_projection_and_csv(spark, tmp_path):
    double = {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": "a,b"}, {"type": "GlobalReference", "value": 'c"d'}]}
    g = graph(spark, SHELL, MODEL, {"modelType": "Submodel", "id": "urn:d", "idShort": "D", "semanticId": double}, {"modelType": "Submodel", "id": "urn:e"})
    got = {r["id"]: tuple(r) for r in projection.rows(g, "submodels").collect()}
    assert got["urn:d"] == ("Submodel", "D", "urn:d", 'a,b|c"d') and got["urn:e"][-1] == "" and got["urn:s"][-1] == "urn:g"
    assert [tuple(r) for r in projection.rows(g, "shells").collect()] == [("AssetAdministrationShell", "A", "urn:a", "urn:asset")]
    assert {r["idShort"]: r["value"] for r in projection.elements(g, g.submodels.filter("id = 'urn:s'")).collect()} == {"Z": "1.5", "A": None, "B": "true", "M": "hi", "L": None, "R": None, "F": "/f", "E": None, "O": None, "N": None, "C": None}
    with pytest.raises(ValueError):
        projection.rows(g, "concepts")
    projection.write_csv(projection.rows(g, "submodels").coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    with part.open() as f:
        assert {r["id"]: r["semanticId"] for r in csv.DictReader(f)} == {"urn:s": "urn:g", "urn:d": 'a,b|c"d', "urn:e": ""}


def test_statistics(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"submodels": [MODEL], "assetAdministrationShells": [SHELL]}))
    (tmp_path / "b.json").write_text("{")
    assert tuple(statistics.load_statistics(readers.read_documents(spark, str(tmp_path))).first()) == (2, 1, 1, 1, 0)
    seen = Observation()
    g = readers.read_aas(spark, str(tmp_path), observation=seen)
    assert seen.get == {"files": 2, "failed": 1, "shells": 1, "submodels": 1, "concepts": 0} and g.submodels.count() == 1
    counts = {(r["what"], r["name"]): r["n"] for r in statistics.storage_counts(graph(spark, SHELL, MODEL, CONCEPT)).collect()}
    assert counts["label", "Identifiable"] == 3 and counts["label", "Property"] == 19 and counts["containment", "value"] == 14 and counts["containment", "statements"] == 1
    assert counts["value", "id"] == 3 and counts["value", "version"] == 1 and ("value", "unit") in counts


def test_template_document(spark):
    a = {"modelType": "Submodel", "id": "urn:1", "idShort": "T", "submodelElements": [{"modelType": "SubmodelElementCollection", "idShort": "C", "value": [prop("P", "1")]}, {"modelType": "SubmodelElementList", "idShort": "L", "value": [prop(None, "1"), prop(None, "2")]}]}
    b = {"modelType": "Submodel", "id": "urn:2", "idShort": "T", "submodelElements": [{"modelType": "SubmodelElementCollection", "idShort": "C", "value": [prop("Q", "1", semanticId=GLOBAL)]}]}
    leaf = lambda name, **more: {"modelType": "Property", "idShort": name, "valueType": "xs:string"} | more | {"cardinality": "ZeroToOne"}
    assert template.document(graph(spark, a, b), "T") == {
        "modelType": "Submodel", "kind": "Template", "idShort": "T", "submodelElements": [
            {"modelType": "SubmodelElementCollection", "idShort": "C", "cardinality": "One", "value": [leaf("P"), leaf("Q", semanticId="urn:g")]},
            {"modelType": "SubmodelElementList", "idShort": "L", "cardinality": "ZeroToOne", "value": [{"modelType": "Property", "valueType": "xs:string", "cardinality": "ZeroToOne"}]},
        ],
    }


def test_type_by_meaning_else_by_name(spark):
    a = {"modelType": "Submodel", "id": "urn:1", "idShort": "T", "semanticId": {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": "U"}]}, "submodelElements": [prop("A", "1")]}
    b = {"modelType": "Submodel", "id": "urn:2", "idShort": "U", "submodelElements": [prop("B", "1")]}
    g = graph(spark, a, b)
    paths = lambda name: [r["path"] for r in template.union(g, name, None).collect()]
    assert paths("U") == ["A"] and paths("T") == ["A"]
    with pytest.raises(ValueError, match="No submodel"):
        paths("V")


def test_template_as_yaml():
    yaml = pytest.importorskip("yaml")
    document = {"modelType": "Submodel", "idShort": "no", "submodelElements": [{"idShort": "A: b", "value": [{"x": "1"}, {"x": None, "y": [[1, 2], []]}]}, {"idShort": "ü \"q\" #", "n": 1.5, "e": {}}, "text", True]}
    assert yaml.safe_load(template.as_yaml(document)) == document


def test_overview_of_odd_names(spark):
    plates = [{"modelType": "Submodel", "id": f"urn:{i}", "idShort": "N", "submodelElements": [prop("ManufacturerName", name)]} for i, name in enumerate([" Maker ", "Maker", "unknown", "", None])]
    got = sorted((r["section"], r["name"], r["n"]) for r in tools.overview(graph(spark, *plates, SHELL)).collect())
    assert got == [("asset", "A", 1), ("count", "concepts", 0), ("count", "shells", 1), ("count", "submodels", 5), ("manufacturer", "Maker", 2), ("type", "N", 5)]


def test_fields_of_several_queries(spark):
    corpus = spark.createDataFrame([(1, "Temp", "T", "b1", [0.0, 0.0]), (2, "Temperatur", "U", "b1", [0.0, 1.0]), (3, "Flow", "T", None, [5.0, 5.0]), (4, "Temp", "V", "b1", [0.0, 0.5])], "id long, field string, submodel_type string, base string, embedding array<float>")
    queries = spark.createDataFrame([(-1, [0.0, 0.4]), (-2, [5.0, 5.0])], "query_id long, query array<float>")
    found = tools.relevant_fields(corpus, queries, 2)
    assert [(r["rank"], r["field"], r["submodel_type"]) for r in found.orderBy("rank").collect()] == [(1, "Flow", "T"), (2, "Temp", "V")]
    concepts = spark.createDataFrame([("b1", [("de", "Temperatur"), ("en", "temperature")])], "id string, displayName array<struct<language:string,text:string>>")
    groups = tools.by_concept(tools.relevant_fields(corpus, queries, 8), concepts).collect()
    assert [(r["base"], r["name"], r["fields"]) for r in groups] == [("b1", "temperature", ["Temp", "Temperatur"])]


def test_many_changes_keep_plans_and_results(spark, tmp_path):
    store = Store(graph(spark, *({"modelType": "Submodel", "id": f"urn:{i}", "submodelElements": [prop("P", str(i))]} for i in range(60))), str(tmp_path))
    size = lambda s: len(s.graph.elements._jdf.queryExecution().optimizedPlan().toString().splitlines())
    row = shaped(spark.createDataFrame([("urn:new",)], "id string"), SUBMODEL)
    sizes = {}
    for i in range(50):
        store = store.changed(store.mark(("submodels", f"urn:{i}"), ("owner", f"urn:{i}")), submodels=row.withColumn("id", F.lit(f"urn:new{i}")))
        sizes[i + 1] = size(store)
    assert sizes[2] == sizes[50] and len(store.changes) == 50
    left = {f"urn:{i}" for i in range(50, 60)}
    assert {r["submodel_id"] for r in store.graph.elements.collect()} == left and {r["id"] for r in store.ids().collect()} == left | {f"urn:new{i}" for i in range(50)}
    again = Store.open(store.base, str(tmp_path))
    assert again.changes == store.changes
    # a branch from an earlier change does not see later ones, nor do they see it
    early = Store(store.base, str(tmp_path), store.changes[:10]).discard("urn:30")
    assert "urn:31" in early and "urn:30" not in early and "urn:new40" not in early and "urn:31" not in store and len(store) == 60
    compact = store.compact(str(tmp_path / "compact"))
    assert compact.changes == () and sorted(compact.ids().collect()) == sorted(store.ids().collect())


def test_add_referable_asks_for_a_place(spark):
    store = two(spark)
    row = spark.createDataFrame([("urn:n", "N", "Property")], "id string, idShort string, model_type string")
    assert "urn:n" in store.add_referable(row, "Submodel") and store.add_referable(row, "Property", "urn:s").find("urn:s", "N").count() == 1
    for kind, place in (("Submodel", ("urn:s",)), ("Property", ())):
        with pytest.raises(ValueError):
            store.add_referable(row, kind, *place)
    with pytest.raises(KeyError):
        store.add_referable(row, "Property", "urn:x")


def test_named_elements_stay_alone_unless_named_from_within_alike(spark):
    pointer = {"modelType": "ReferenceElement", "idShort": "R", "value": to_element("urn:s", "C", "P")}
    inner = {"modelType": "SubmodelElementCollection", "idShort": "C", "value": [prop("P", "1"), prop("Q", "2"), pointer]}
    store = Store(graph(spark, {"modelType": "Submodel", "id": "urn:s", "submodelElements": [inner]}, {"modelType": "Submodel", "id": "urn:t", "submodelElements": [pointer]}))
    left, n = store.removed("urn:s")  # the reference from outside is held within as well
    assert n == 5 and {r["node_id"] for r in left.graph.elements.collect()} == {"urn:t/R"}


def test_links_heal_without_a_shuffle_of_references(spark, tmp_path):
    store = two(spark)
    linked = resolve.link(store.graph, str(tmp_path / "links"))
    known = resolve.resolve(linked)
    full = lambda g: sorted(map(tuple, resolve.resolve(g).collect()))
    assert full(linked) == full(store.graph) and [r["target_id"] for r in known.collect()] == ["urn:s/C/P"]
    new = graph(spark, {"modelType": "Submodel", "id": "urn:u", "submodelElements": [{"modelType": "ReferenceElement", "idShort": "R", "value": to_element("urn:s", "C", "Q")}]})
    for after, ids in ((store.upsert(new), ["urn:u"]), (store.remove_element("urn:s", "C.Q"), ["urn:s"]), (store.removed("urn:t")[0], ["urn:t"]), (store.upsert(new).remove("urn:s"), ["urn:u", "urn:s"])):
        healed = resolve.heal(linked.links, known, after.graph, spark.createDataFrame([(i,) for i in ids], "id string"))
        assert sorted(map(tuple, healed.collect())) == full(after.graph)
    plan = linked.links.references.join(spark.createDataFrame([("urn:s",)], "id string").hint("merge"), F.col("root") == F.col("id"), "left_semi")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "hashpartitioning(root" not in text  # only the ids are dealt
    asked = spark.createDataFrame([("urn:s", "n:C")], "parent string, key string").hint("merge").join(linked.links.children, ["parent", "key"])
    assert asked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_name_that_is_a_place_is_found_once(spark):
    items = [prop("1", "a"), prop("01", "b"), prop("x", "c"), prop("03", "d")]
    g = graph(spark, {"modelType": "Submodel", "id": "urn:s", "submodelElements": [{"modelType": "SubmodelElementList", "idShort": "L", "value": items}]})
    for step, want in {"0": ["0"], "1": ["0", "1"], "01": ["1"], "2": ["2"], "x": ["2"], "3": ["3"], "03": ["3"], "4": []}.items():
        refs = spark.createDataFrame([("r", ("ModelReference", [("Submodel", "urn:s"), ("SubmodelElementList", "L"), ("Property", step)]))], "ref_id string, ref struct<type:string,keys:array<struct<type:string,value:string>>>")
        assert sorted(r["target_id"] for r in resolve.resolve(g, refs).collect()) == [f"urn:s/L/{w}" for w in want], step


def test_rows_within_a_budget(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(500)], "k long, text string").repartition(5)
    sizes = [len(f'{{"k":{i},"text":"{"x" * (i % 7)}"}}') for i in range(500)]
    for budget in (1, 60, 3000, 10**6):
        want = [i for i in range(500) if sum(sizes[: i + 1]) <= budget or i == 0]
        assert [r["k"] for r in tools.within_budget(rows, ["k"], budget).orderBy("k").collect()] == want
    shown, total = tools.capped(rows.orderBy("k"), 200, 60)
    assert [r["k"] for r in shown] == [0, 1, 2] and total == 500
    assert tools.within_budget(rows.filter("k < 0"), ["k"], 10).count() == 0
