"""What is shuffled is narrowed first, and no query stores more links than it reads."""

import os

from pyspark.sql import functions as F

from twinframe.operators import narrow, resolve, semantic, statistics, template, tools
from twinframe.plans import project
from twinframe.schema import CONCEPT, ELEMENT, SHELL, SUBMODEL, Graph, reference, shaped

SF = "/root/testdata/sf0.001"


def small(spark):
    """Shell a refers to s (with a collection, twice) and b (of a property alone), c (of nothing) and one that is not there; an element of the latter is there."""
    to = lambda i: reference("ModelReference", ("Submodel", F.lit(i)))
    shells = spark.range(1).select(F.lit("a").alias("id"), F.lit("A").alias("idShort"), F.array(to("s"), to("s"), to("b"), to("c"), to("gone")).alias("submodels"))
    shells = shells.union(spark.range(1).select(F.lit("e").alias("id"), F.lit("E").alias("idShort"), F.array(to("c")).alias("submodels")))
    row = lambda sm, name, kind, value: (sm, f"{sm}/{name}", sm, name, kind, value)
    rows = [row("s", "X", "SubmodelElementCollection", None), row("s", "P", "Property", "1"), row("b", "P", "Property", "2"), row("gone", "P", "Property", "3")]
    elements = spark.createDataFrame(rows, "submodel_id string, node_id string, parent_id string, idShort string, model_type string, value string")
    submodels = spark.createDataFrame([("s", "T"), ("b", "T"), ("c", "T"), ("u", "U")], "id string, idShort string")
    return Graph(shaped(shells, SHELL), shaped(submodels, SUBMODEL), shaped(elements, ELEMENT), spark.createDataFrame([], CONCEPT))


def test_rows_of_other_ids_are_dropped_by_bits(spark):
    ids = spark.range(0, 3000, 3).select(F.concat(F.lit("urn:"), F.col("id").cast("string")).alias("x"))
    rows = spark.range(3000).select(F.concat(F.lit("urn:"), F.col("id").cast("string")).alias("c"), "id")
    kept = [r["id"] for r in narrow.within(rows, "c", ids).collect()]
    assert {*range(0, 3000, 3)} <= set(kept) and len(kept) == len(set(kept)) < 1010
    assert narrow.within(rows, "c", ids.filter("false")).count() == 0 and narrow.within(spark.sql("SELECT CAST(NULL AS STRING) AS c"), "c", ids).count() == 0


def test_no_bridge_is_stored_for_one_use(spark, tmp_path):
    g = resolve.link(small(spark), str(tmp_path))
    assert sorted(r["raw"] for r in tools.asset_values(g, "P").collect()) == ["1", "2"]
    assert [r["asset"] for r in tools.assets_missing(g, "U").collect()] == ["A", "E"] and [r["asset"] for r in tools.assets_missing(g, field="P").collect()] == ["E"]
    assert [tuple(r) for r in tools.asset_components(g, "T").collect()] == [("a", 1, 0, 0)] and tools.asset_components(g, "T", "E").count() == 0
    assert semantic.assets_by_criteria(g, [("x", "=", "1")]).count() == 0
    assert not os.listdir(tmp_path)


def test_submodels_without_counted_elements_still_count(spark):
    g = small(spark)
    plain = Graph(g.shells, g.submodels, g.elements.filter("model_type = 'Property'"), g.concepts)
    assert [tuple(r) for r in tools.asset_components(plain, "T").collect()] == [("a", 0, 0, 0)]


def test_paths_of_a_template_need_no_window(spark):
    g = project.graph(spark, SF)
    paths = g.elements.select("submodel_id", F.coalesce(*(F.when(F.size("names") == n, template.joined(n)) for n in range(1, template.DEPTH + 1)), template.joined()).alias("path"))
    assert "Window" not in paths._jdf.queryExecution().optimizedPlan().toString()
    deep = spark.sql("SELECT array('a', null, 'b', null) AS names, array(null, 0, null, null) AS indexes")
    assert tuple(deep.select(template.joined(4), template.joined()).first()) == ("a/[]/b/?",) * 2


def test_counts_that_are_not_asked_for_are_not_made(spark):
    counts = statistics.storage_counts(project.graph(spark, SF))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(counts.filter("what <> 'value'")) <= scans(counts) / 2


def test_distinct_references_of_one_type(spark):
    g = small(spark)
    assert sorted(r["target_id"] for r in resolve.resolve(g, kind="ModelReference").collect()) == ["b", "c", "s"]
    assert resolve.resolve(g, kind="ExternalReference").count() == 0 and resolve.distinct(g).count() == 4
    assert {r["ref_id"] for r in resolve.distinct(g).collect()} == {r["ref_id"] for r in resolve.references(g).collect()}
