"""Marks by their kind: tables are joined only with marks that there are, and removal and dangling references in stores over a union."""

from pyspark.sql import functions as F

from twinframe.operators import resolve
from twinframe.operators.store import Store
from twinframe.schema import CONCEPT, ELEMENT, SHELL, SUBMODEL, Graph, reference, shaped


def models(spark, ids, target=None):
    """Submodels of one element P each, which names target."""
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    to = {"target": reference("ModelReference", ("Submodel", F.lit(target[0])), ("Property", F.lit(target[1])))} if target else {}
    elements = rows.select(F.col("id").alias("submodel_id"), F.concat("id", F.lit("/P")).alias("node_id"), F.col("id").alias("parent_id"), F.lit("P").alias("idShort"), F.lit("Property").alias("model_type"), *(c.alias(n) for n, c in to.items()))
    none = lambda ddl: spark.createDataFrame([], ddl)
    return Graph(none(SHELL), shaped(rows, SUBMODEL), shaped(elements, ELEMENT), none(CONCEPT))


def test_only_marks_that_there_are_meet_the_rows(spark):
    after = Store(models(spark, ["a", "b"])).upsert(models(spark, ["b", "c"]))
    assert after.changes[-1].marks == {"submodels": 2, "owner": 2}
    plan = after.graph.elements._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join" not in after.graph.concepts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["node_id"] for r in after.graph.elements.collect()) == ["a/P", "b/P", "c/P"]
    again = Store.open(after.base, after.path)
    assert again.changes == after.changes and again.count() == 3


def test_dangling_reads_references_from_one_table(spark):
    g = models(spark, ["a", "b"], ("a", "X"))
    found = resolve.dangling(g)
    assert [r["first"] for r in found.collect()] == ["a"] and resolve.dangling(models(spark, ["a"], ("a", "P"))).count() == 0
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()  # content addresses are taken once
