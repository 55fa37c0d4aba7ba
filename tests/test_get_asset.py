"""Lookup of shells by name: what they refer to is put together for the named ones alone."""

import re

from test_store import graph

from twinframe.operators import tools
from twinframe.plans import project


def test_names_reach_the_table_behind_references(spark):
    """Before, references of all shells were gathered and then joined with the named ones."""
    g = project.graph(spark, "/root/testdata/sf0.001")
    plan = tools.get_asset(g, "lier_1")._jdf.queryExecution().optimizedPlan().toString()
    gathered = [m.start() for m in re.finditer(r"collect_list\(l_partkey", plan)]
    assert gathered and all("lier_1" in plan[at:].split("Relation")[0] for at in gathered)


def test_counts_of_repeated_and_missing_references(spark):
    ref = lambda i: {"type": "ModelReference", "keys": [{"type": "Submodel", "value": i}]}
    shell = lambda i, *refs: {"modelType": "AssetAdministrationShell", "id": i, "idShort": i.upper(), "assetInformation": {"assetKind": "Instance"}, "submodels": [ref(r) for r in refs]}
    names = [{"modelType": "Property", "idShort": n, "value": v} for n, v in (("ManufacturerName", "B"), ("Company", "A"), ("ManufacturerProductDesignation", "D"))]
    models = [{"modelType": "Submodel", "id": "m1", "submodelElements": names}, {"modelType": "Submodel", "id": "m2"}]
    g = graph(spark, shell("pump-1", "m1", "m1", "m2", "gone"), shell("pump-12"), shell("fan", "m2"), *models)
    g = g.changed(shells=g.shells.union(g.shells.filter("id = 'pump-1'")))
    rows = lambda name: sorted({(r["id"], r["rank"], r["matches"], r["manufacturer"], r["designation"], r["submodels"]) for r in tools.get_asset(g, name).collect()})
    assert rows("pump-1") == [("pump-1", 0, 2, "B", "D", 2)]
    assert rows("PUMP") == [("pump-1", 2, 3, "B", "D", 2), ("pump-12", 2, 3, None, None, 0)]
    assert rows("none") == []
