import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from twinframe.functions.scalars import irdi_base, to_boolean, to_hex, to_number
from twinframe.operators import cleaning, resolve, template, validate
from twinframe.operators.store import Store
from twinframe.schema import ELEMENT, SUBMODEL, shaped
from twinframe.sources import readers
from twinframe.sources.formats import environments
from twinframe.streaming import operational

XML = b"""<aas:environment xmlns:aas="https://admin-shell.io/aas/3/0"><aas:submodels><aas:submodel><aas:id>urn:x</aas:id><aas:submodelElements>
<aas:property><aas:idShort>P</aas:idShort><aas:valueType>xs:int</aas:valueType><aas:value>5</aas:value></aas:property>
<aas:multiLanguageProperty><aas:idShort>M</aas:idShort><aas:value><aas:langStringTextType><aas:language>en</aas:language><aas:text>hi</aas:text></aas:langStringTextType></aas:value></aas:multiLanguageProperty>
<aas:submodelElementList><aas:idShort>L</aas:idShort><aas:orderRelevant>true</aas:orderRelevant><aas:value><aas:property><aas:valueType>xs:int</aas:valueType></aas:property></aas:value></aas:submodelElementList>
</aas:submodelElements></aas:submodel></aas:submodels></aas:environment>"""


def package(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            z.writestr(name, data)
    return out.getvalue()


def test_formats():
    env = environments("a.xml", XML)[0]
    elements = env["submodels"][0]["submodelElements"]
    assert [e["modelType"] for e in elements] == ["Property", "MultiLanguageProperty", "SubmodelElementList"]
    assert elements[1]["value"] == [{"language": "en", "text": "hi"}] and elements[2]["orderRelevant"] is True
    assert environments("a.json.gz", gzip.compress(b'{"submodels": []}')) == [{"submodels": []}]
    data = package(("[Content_Types].xml", b"<Types/>"), ("aasx/data.xml", XML), ("x.json", b'{"submodels": [{"id": "urn:y"}]}'))
    assert [e["submodels"][0]["id"] for e in environments("p.aasx", data)] == ["urn:x", "urn:y"]
    assert [e["submodels"][0]["id"] for e in environments("p.aasx", data[:-60])] == ["urn:x", "urn:y"]
    with pytest.raises(ValueError):
        environments("p.aasx", b"PK nothing")


def test_read_isolates_failures_and_first_id_wins(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps({"submodels": [{"modelType": "Submodel", "id": "urn:s", "submodelElements": [{"modelType": "Property", "idShort": "first", "value": "1"}]}]}))
    (tmp_path / "a" / "2.json").write_text(json.dumps({"submodels": [{"modelType": "Submodel", "id": "urn:s", "submodelElements": [{"modelType": "Property", "idShort": "second", "value": True}]}]}))
    (tmp_path / "a" / "3.json").write_text("{broken")
    (tmp_path / "a" / "4.xml.gz").write_bytes(gzip.compress(XML))
    docs = readers.read_documents(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in docs.filter("error IS NOT NULL").collect()] == ["3.json"]
    g = readers.from_documents(docs, fix=True)
    assert sorted(r["idShort"] or "" for r in g.elements.collect()) == ["", "L", "M", "P", "first"]
    assert readers.read_documents(spark, str(tmp_path), max_per_dir=1).filter("section IS NOT NULL").count() == 1
    back = {r["id"]: json.loads(r["payload"]) for r in readers.export_submodels(g).collect()}
    assert back["urn:s"]["submodelElements"] == [{"modelType": "Property", "idShort": "first", "value": "1"}]
    assert [e["idShort"] for e in back["urn:x"]["submodelElements"]] == ["P", "M", "L"] or len(back["urn:x"]["submodelElements"]) == 3


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "base"),
    [
        ("0199-7#02-FLO001#004", "0199-7#02-FLO001"), ("0199-7#02-FLO001", "0199-7#02-FLO001"), ("https://api.eclass-cdp.com/0199-7-02-FLO001-004", "0199-7#02-FLO001"), ("0145/8///70001_2#XYZ9#12", "0145/8///70001_2#XYZ9"),
        ("http://names.test/page#7", "http://names.test/page#7"), ("urn:1999-1#5", "urn:1999-1#5"), ("", ""), (None, None),
    ],
)
def test_irdi_base(spark, value, base):
    assert one(spark, value, irdi_base) == base


def test_casts(spark):
    assert [one(spark, v, to_number) for v in ("60", " 1.5e2", "60d", "abc", "", None)] == [60.0, 150.0, None, None, None, None]
    assert [one(spark, v, to_boolean) for v in ("true", " FALSE", "1", None)] == [True, False, None, None]
    assert [one(spark, v, to_hex) for v in ("65280", "x")] == ["16#FF00", None]


def test_repairs(spark):
    name = lambda v, **k: one(spark, v, lambda c: cleaning.fix_id_short(c, **k))
    assert [name(v) for v in ("a-b", "1a", "ok_1", "é")] == ["a_b", "x1a", "ok_1", "x_"]
    assert name("a-b--", hyphens=True) == "a-b__"
    kind = lambda v: one(spark, v, lambda c: cleaning.fix_value_type(F.lit("xs:int"), c))
    assert [kind(v) for v in ("5", "5..6", "", None)] == ["xs:int", "xs:string", "xs:int", "xs:int"]


def submodel(spark, *elements):
    payload = json.dumps({"modelType": "Submodel", "id": "urn:s", "idShort": "S", "submodelElements": list(elements)})
    docs = spark.createDataFrame([("f", 0, "submodels", 0, payload, None)], readers.DOCUMENT)
    return readers.from_documents(docs)


def test_store(spark):
    store = Store(submodel(spark, {"modelType": "SubmodelElementList", "idShort": "l-x", "value": [{"modelType": "Property", "value": "1"}]}))
    assert store.exists("urn:s") and not store.exists("urn:t")
    with pytest.raises(KeyError):
        store.add_identifiable("Submodel", spark.createDataFrame([("urn:s",)], "id string"))
    more = store.add_element(shaped(spark.createDataFrame([("Property", "2")], "model_type string, value string"), ELEMENT), "urn:s", "l-x")
    assert more.find("urn:s", "l-x[1]").first()["value"] == "2" and more.find("urn:s", "l-x[0]").first()["value"] == "1"
    with pytest.raises(KeyError):
        store.find("urn:s", "l-x[1]")
    assert more.remove_element("urn:s", "l-x").graph.elements.count() == 0
    added = store.add_identifiable("Submodel", shaped(spark.createDataFrame([("urn:t",)], "id string"), SUBMODEL))
    assert added.count() == 2 and added.remove("urn:s").graph.elements.count() == 0


def test_nodes_of_one_name_stay_apart(spark):
    prop = lambda v: {"modelType": "Property", "idShort": "P", "value": v}
    g = submodel(spark, prop("1"), prop("2"), {"modelType": "Operation", "idShort": "Op", "inputVariables": [{"value": prop("3")}], "outputVariables": [{"value": prop("4")}]}, {"modelType": "SubmodelElementList", "idShort": "L", "value": [prop("5")]})
    rows = g.elements.collect()
    assert len({r["node_id"] for r in rows}) == len(rows) == 7
    assert {r["value"]: r["parent_id"] for r in rows if r["value"]} == {"1": "urn:s", "2": "urn:s", "3": "urn:s/Op", "4": "urn:s/Op", "5": "urn:s/L"}
    found = lambda version, rule: [r["node_id"] for r in validate.Checker(g, version).check([rule]).collect()]
    assert found("3.1", "AASd-022") == ["urn:s"] and found("3.1", "AASd-134") == ["urn:s/Op"]
    store = Store(g)
    assert store.find("urn:s", "L[0]").first()["value"] == "5" == store.find("urn:s", "L.P").first()["value"]


def test_identifiables_without_id_all_stay(spark):
    payloads = [json.dumps({"modelType": "Submodel", "idShort": n}) for n in "ab"] + [json.dumps({"modelType": "Submodel", "id": "urn:s", "idShort": n}) for n in "cd"]
    docs = spark.createDataFrame([("f", 0, "submodels", i, p, None) for i, p in enumerate(payloads)], readers.DOCUMENT)
    assert sorted(r["idShort"] for r in readers.from_documents(docs).submodels.collect()) == ["a", "b", "c"]


def test_rules_on_all_that_they_name(spark):
    extension = {"extensions": [{"name": "e"}, {"name": "e"}]}
    entity = {"modelType": "Entity", "idShort": "En", "specificAssetIds": [{"name": "n", "value": "v", "externalSubjectId": {"type": "ModelReference", "keys": [{"type": "Submodel", "value": "x"}]}}]}
    lists = {"modelType": "Operation", "idShort": "Op", "inputVariables": [{"value": {"modelType": "SubmodelElementList", "idShort": "L", "value": []}}]}
    target = {"modelType": "ReferenceElement", "idShort": "Re", "value": {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": "g"}, {"type": "Referable", "value": "r"}]}}
    concept = {"modelType": "ConceptDescription", "id": "urn:c", "administration": {"revision": "1"}} | extension
    documents = {"submodels": {"modelType": "Submodel", "id": "urn:s", "idShort": "S", "submodelElements": [entity, lists, target]} | extension, "conceptDescriptions": concept}
    g = readers.from_documents(spark.createDataFrame([("f", 0, k, 0, json.dumps(v), None) for k, v in documents.items()], readers.DOCUMENT))
    found = lambda rule: sorted(r["node_id"] for r in validate.Checker(g, "3.2").check([f"AASd-{rule}"]).collect())
    assert {r: found(r) for r in ("005", "077", "133", "137", "138")} == {"005": ["urn:c"], "077": ["urn:c", "urn:s"], "133": ["urn:s/En"], "137": ["urn:s/Re"], "138": ["urn:s/Op/L"]}


def test_resolution_heals_and_dangles(spark):
    ref = lambda *keys: {"type": "ModelReference", "keys": [{"type": t, "value": v} for t, v in keys]}
    g = submodel(spark, {"modelType": "Property", "idShort": "P", "value": "1"}, {"modelType": "ReferenceElement", "idShort": "R", "value": ref(("Submodel", "urn:s"), ("Property", "P"))}, {"modelType": "ReferenceElement", "idShort": "D", "value": ref(("Submodel", "urn:s"), ("Property", "Q"))})
    assert [r["target_id"] for r in resolve.resolve(g).collect()] == ["urn:s/P"]
    assert resolve.dangling(g).count() == 1
    known = resolve.resolve(g)
    assert sorted(resolve.resolve_for(g, "urn:s", known).collect()) == sorted(known.collect())


def test_template(spark):
    g = submodel(spark, {"modelType": "SubmodelElementList", "idShort": "L", "value": [{"modelType": "Property", "valueType": "xs:int", "value": "1"}, {"modelType": "Property", "valueType": "xs:int", "value": "2"}]})
    assert sorted(r["path"] for r in template.union(g, "S").collect()) == ["L", "L/[]"]
    with pytest.raises(ValueError):
        template.union(g, "nothing")


def test_checker(spark):
    g = submodel(spark, {"modelType": "Property", "idShort": "1x", "value": "1"}, {"modelType": "Entity", "idShort": "E", "entityType": "CoManagedEntity", "globalAssetId": "urn:g"})
    assert len(validate.Checker(g, "3.0").constraint_ids) == 27 and len(validate.Checker(g).constraint_ids) == 25 and len(validate.Checker(g, "3.2").constraint_ids) == 27
    assert sorted((r["constraint_id"], r["node_id"]) for r in validate.Checker(g, "3.0").check_all().collect()) == [("AASd-002", "urn:s/1x"), ("AASd-014", "urn:s/E")]
    with pytest.raises(ValueError):
        validate.Checker(g).check(["AASd-090"])


def test_stream_keeps_latest(spark, tmp_path):
    row = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    make = lambda *rows: spark.createDataFrame(list(rows), "event_id long, t string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t")).select(*(c.split()[0] for c in row.split(", ")))
    make((1, "2024-01-01 00:00:00", 1, "a", 1.0, "{}"), (2, "2024-01-02 00:00:00", 1, "b", 2.0, "{}")).coalesce(1).write.parquet(str(tmp_path / "in"))
    make((3, "2024-01-01 12:00:00", 1, "c", 3.0, "{}"), (4, "2024-01-01 12:00:00", 2, "d", 4.0, "{}"), (0, "2024-01-02 00:00:00", 1, "e", 9.0, "{}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = operational.run(operational.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    out = str(tmp_path / "out")
    values = lambda: sorted((r["user_id"], r["value"]) for r in operational.current(spark, out).collect())
    assert values() == [(1, 2.0), (2, 4.0)]
    # a batch writes the users that it has; late and repeated events change nothing
    make((5, "2024-01-03 00:00:00", 2, "f", 5.0, "{}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make((1, "2024-01-01 00:00:00", 1, "a", 1.0, "{}"), (5, "2024-01-03 00:00:00", 2, "f", 5.0, "{}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = operational.run(operational.read_events(spark, str(tmp_path / "in"), 1), out, str(tmp_path / "check"), compact_every=3)
    query.processAllAvailable()
    query.stop()
    assert values() == [(1, 2.0), (2, 5.0)]
    assert sorted(p.name for p in (tmp_path / "out" / "values").iterdir() if p.is_dir()) == ["batch=2", "batch=3"] and spark.read.parquet(f"{out}/values/batch=3").count() == 2
    operational.compact(spark, out, 3)
    assert values() == [(1, 2.0), (2, 5.0)] and [p.name for p in (tmp_path / "out" / "values").iterdir() if p.is_dir()] == ["batch=3"]


def test_identifiables_are_pulled_one_at_a_time(spark, tmp_path):
    from twinframe.sources import formats

    made = {"other": [1, {"submodels": [1]}], "submodels": [{"id": "a", "x": ["}", "]"]}, 3, {"id": "b"}], "assetAdministrationShells": [], "conceptDescriptions": [{"id": "\u00e9"}]}
    text = json.dumps(made, indent=2)
    want = [(0, "submodels", 0, made["submodels"][0]), (0, "submodels", 2, {"id": "b"}), (0, "conceptDescriptions", 0, {"id": "\u00e9"})]
    assert list(formats.identifiables("a.json", text.encode())) == list(formats.identifiables("a.json.gz", gzip.compress(("\ufeff" + text).encode()))) == want
    assert list(formats.identifiables("a.json", b"{}")) == list(formats.identifiables("a.json", b'{"submodels": []}')) == []
    for bad in (b"[]", b'{"submodels": [{"id": "a"}', b'{"submodels": [{"id": "a"},]}', b'{"a": 1} x', b'{"a" 1}', b""):
        with pytest.raises(ValueError):
            next(formats.identifiables("a.json", bad))
    assert [(s, i["id"]) for _, s, _, i in formats.identifiables("a.xml", XML)] == [(k, i["id"]) for k, v in environments("a.xml", XML)[0].items() for i in v]
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(text[:-40])
    g = readers.read_aas(spark, str(tmp_path), linked=True)
    assert sorted(r["id"] for r in g.submodels.collect()) == ["a", "b"] and g.links is not None
    assert "MapInArrow" in (plan := g.submodels._jdf.queryExecution().executedPlan().toString()) and plan.count("MapInArrow") == 1 and "binaryFile" not in plan
