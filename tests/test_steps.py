"""Resolution of deep references: elements that no step leads to are not dealt, and a reference's row goes once to where its submodel lies."""

from pyspark.sql import functions as F

from twinframe.operators import resolve
from twinframe.plans import project
from twinframe.schema import CONCEPT, SHELL, SUBMODEL, Graph, reference, shaped


def lists(spark, n=40):
    """A submodel for each number, with a list of one named item in it, and a property beside it; some items stand twice."""
    rows, own = spark.range(n), project.key("urn:", "id")
    item = project.branch(rows, own, "L", None, index=F.lit(0)).withColumns({"idShort": F.lit("X"), "names": F.array(F.lit("L"), F.lit("X"))})
    elements = [project.branch(rows, own, "L", model_type="SubmodelElementList"), item, item.filter("submodel_id = 'urn:3'"), project.branch(rows, own, "P")]
    none = lambda ddl: spark.createDataFrame([], ddl)
    return Graph(none(SHELL), shaped(rows.select(own.alias("id")), SUBMODEL), elements[0].union(elements[1]).union(elements[2]).union(elements[3]), none(CONCEPT))


def refs(spark, n=40, *last):
    to = lambda x, i: reference("ModelReference", ("Submodel", project.key("urn:", "id")), ("SubmodelElementList", F.lit("L")), (i, F.lit(x)))
    every = [spark.range(n).select(to(x, i).alias("ref")) for x in last for i in ("Property", "Range")]
    found = every[0]
    for x in every[1:]:
        found = found.union(x)
    return found.union(found).select(F.sha2(F.to_json("ref"), 256).alias("ref_id"), "ref")


def test_rows_are_dealt_once_and_other_elements_are_not(spark):
    found = resolve.resolve(lists(spark), refs(spark, 40, "0", "00", "X", "9", "P"))
    got = [r["target_id"] for r in found.collect()]
    # three of the five steps lead to the item, each from references of two types; one submodel has it twice
    assert len(got) == 40 * 6 + 6 and set(got) == {f"urn:{i}/L/0" for i in range(40)}
    text = found.select("target_id")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert text.count("Exchange shufflepartitionidpassthrough") == 3 and "Exchange hashpartitioning" not in text


def test_many_steps_at_a_depth(spark, monkeypatch):
    want = sorted(map(tuple, resolve.resolve(lists(spark), refs(spark, 40, "0", "X", "zz")).collect()))
    monkeypatch.setattr(resolve, "FEW", 1)
    monkeypatch.setattr(resolve, "SENT", 0)
    assert sorted(map(tuple, resolve.resolve(lists(spark), refs(spark, 40, "0", "X", "zz")).collect())) == want and len(want) == 40 * 4 + 4


def test_no_children_are_stored_to_resolve(spark, tmp_path):
    import os

    g = resolve.link(lists(spark), str(tmp_path))
    assert resolve.resolve(g, refs(spark, 40, "0")).count() == 82 and resolve.resolve(g).count() == 0 and not os.listdir(tmp_path)


def test_columns_without_references_of_a_kind_are_not_read(spark):
    refs = resolve.references(lists(spark), "ModelReference", 2)
    assert "Range" not in refs._jdf.queryExecution().optimizedPlan().toString() and refs.count() == 0


def test_what_dangles_is_told_where_it_lies(spark):
    g, to = lists(spark, 5), lambda *steps: reference("ModelReference", ("Submodel", F.lit("urn:1")), *(("Property", F.lit(x)) for x in steps))
    ways = [to("P"), to("P"), to("Q"), to("L", "0"), to("L", "7"), to(), reference("ModelReference", ("Submodel", F.lit("urn:9"))), reference("ModelReference", ("Submodel", F.lit(None))), F.struct(F.lit("ModelReference").alias("type"), F.array().cast("array<struct<type:string,value:string>>").alias("keys"))]
    rows, own = spark.range(1), project.key("urn:t", "id")
    pointing = [project.branch(rows, own, f"R{n}", model_type="ReferenceElement", target=way) for n, way in enumerate(ways)]
    for x in pointing:
        g = g.changed(elements=g.elements.unionByName(x))
    found = resolve.dangling(g)
    assert sorted((r["first"] or "") for r in found.collect()) == ["", "", "urn:1", "urn:1", "urn:9"]
    # the content addresses of references of one key are not dealt twice
    assert found.filter("first = 'urn:9'").count() == 1 and found._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 2


def test_healing_reads_what_is_not_stored(spark, tmp_path):
    from twinframe.operators.store import Store

    g = resolve.link(lists(spark, 6).changed(), str(tmp_path))
    rows, own = spark.range(2, 4), project.key("urn:p", "id")
    to = reference("ModelReference", ("Submodel", project.key("urn:", "id")), ("Property", F.lit("P")))
    none = lambda ddl: spark.createDataFrame([], ddl)
    new = Graph(none(SHELL), shaped(rows.select(own.alias("id")), SUBMODEL), project.branch(rows, own, "R", model_type="ReferenceElement", target=to), none(CONCEPT))
    after = Store(g.changed()).upsert(new).graph
    healed = resolve.heal(g.links, resolve.resolve(g), after, new.submodels.select("id"))
    assert sorted(r["target_id"] for r in healed.collect()) == ["urn:2/P", "urn:3/P"] and not g.links.stored and not (tmp_path / "references").exists()
