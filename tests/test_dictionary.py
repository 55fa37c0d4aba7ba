import pytest
from pyspark.sql import functions as F

from twinframe.operators import semantic, tools
from twinframe.plans import project
from twinframe.sources import dictionary

#: Two classes, three properties and two units of an invented dictionary.
SEGMENT = """<?xml version='1.0' encoding='UTF-8'?>
<d:root xmlns:d="urn:dict" xmlns:o="urn:onto" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><o:body>
<o:class xsi:type="o:KLASS" id="0199-7---PUMPS_3_0#01-QRS410#002"><preferred_name><label language_code="en">Gear pump</label><label language_code="fr">Pompe</label><label language_code="en"> Pump with gears </label></preferred_name>
<definition><text language_code="en">Moves oil</text><text language_code="fr"> </text></definition><hierarchical_position>41250107</hierarchical_position><is_deprecated> TRUE </is_deprecated>
<described_by><property property_ref="0199-7---PUMPS_3_0#02-FLO001#004"/><property property_ref="0199-7#02-HEA002#001"/><property property_ref="0199-7#02-GON999#001"/></described_by></o:class>
<o:class id="0199-7#01-QRS411#001"><its_superclass class_ref="0199-7---PUMPS_3_0#01-QRS410#002"/></o:class>
<o:class><hierarchical_position>1</hierarchical_position></o:class>
<o:property id="0199-7---PUMPS_3_0#02-FLO001#005"><preferred_name><label language_code="en">Flow</label></preferred_name><short_name><label language_code="en">Q</label></short_name><domain xsi:type="o:INT_TYPE"><unit unit_ref="0199-7---PUMPS_3_0#05-LPM010#001"/></domain></o:property>
<o:property id="0199-7#02-HEA002#001"><preferred_name><label language_code="en">%s</label></preferred_name></o:property>
</o:body></d:root>""" % ("Head " * 20)
UNITS = """<?xml version='1.0' encoding='UTF-8'?>
<w:units xmlns:w="urn:w" xmlns:m="urn:meters"><m:UnitSet>
<w:eClassUnit><m:CodeListValue unitCodeValue="l/min" codeListName="OTHER"/><m:CodeListValue unitCodeValue="0199-7#05-LPM010#003" codeListName="IRDI"/><w:preferred_name><label language_code="de">Liter je Minute</label></w:preferred_name><w:short_name><label language_code="de">l/min</label></w:short_name></w:eClassUnit>
<w:eClassUnit><m:CodeListValue unitCodeValue="0199-7#05-BAR020#001" codeListName="IRDI"/><w:short_name><label language_code="de">bar</label></w:short_name></w:eClassUnit>
<w:eClassUnit><m:CodeListValue unitCodeValue="psi" codeListName="OTHER"/></w:eClassUnit></m:UnitSet></w:units>"""


@pytest.fixture(scope="module")
def segment(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dictionary")
    (folder / "pumps_SG_41.xml").write_text(SEGMENT)
    (folder / "pumps_SG_42.xml").write_text(SEGMENT.replace("QRS41", "QRS51"))
    (folder / "units.xml").write_text(UNITS)
    return str(folder)


def test_segments_are_chosen_by_their_number(spark, segment):
    chosen = lambda *numbers: sorted(r["irdi"] for r in dictionary.classes(spark, segment + "/pumps*", list(numbers) or None).collect())
    assert chosen(41) == ["0199-7#01-QRS410#002", "0199-7#01-QRS411#001"] and chosen(40) == []
    assert len(chosen()) == 4 == len(chosen(42, 41))


def test_rows_of_a_segment(spark, segment):
    classes = {r["irdi"]: r for r in dictionary.classes(spark, segment + "/pumps*", [41]).collect()}
    pump, child = classes["0199-7#01-QRS410#002"], classes["0199-7#01-QRS411#001"]
    assert pump["is_deprecated"] and not child["is_deprecated"] and child["superclass_irdi"] == pump["irdi"] and pump["superclass_irdi"] is None
    assert pump["property_refs"] == ["0199-7#02-FLO001#004", "0199-7#02-HEA002#001", "0199-7#02-GON999#001"] and child["property_refs"] == []
    flow, head = dictionary.properties(spark, segment + "/pumps*", [41]).orderBy("irdi").collect()
    assert (flow["data_type"], flow["unit_irdi"], flow["short_name"][0]["text"]) == ("INT_TYPE", "0199-7#05-LPM010#001", "Q") and head["unit_irdi"] is None
    assert {r["irdi"]: (r["preferred_name"], r["short_name"]) for r in dictionary.units(spark, segment + "/units.xml").collect()} == {"0199-7#05-LPM010#003": ("Liter je Minute", "l/min"), "0199-7#05-BAR020#001": ("", "bar")}


def test_concepts_and_their_edges(spark, segment):
    path = segment + "/pumps*"
    classes, properties = dictionary.classes(spark, path, [41]), dictionary.properties(spark, path, [41])
    concepts = dictionary.concepts(classes, properties, dictionary.units(spark, segment + "/units.xml"))
    got = {r["id"]: r for r in concepts.collect()}
    names = lambda i: [tuple(x) for x in got[i]["displayName"]]
    assert len(got) == 6 and got["0199-7#01-QRS410#002"]["idShort"] == "eclass_41250107"
    assert names("0199-7#01-QRS410#002") == [("fr", "Pompe"), ("en", "Pump with gears")] and [tuple(x) for x in got["0199-7#01-QRS410#002"]["description"]] == [("en", "Moves oil")]
    assert got["0199-7#01-QRS411#001"]["isCaseOf"][0]["keys"][0]["value"] == "0199-7#01-QRS410#002" and names("0199-7#01-QRS411#001") == [("en", "0199-7#01-QRS411#001")]
    assert len(names("0199-7#02-HEA002#001")[0][1]) == dictionary.NAME_LENGTH
    assert got["0199-7#05-BAR020#001"]["idShort"] == "bar" and got["0199-7#05-LPM010#003"]["idShort"] is None
    # edges meet by base, whatever the versions; a reference to nothing makes none
    assert sorted(r["property_base"] for r in semantic.has_property(classes, concepts).collect()) == ["0199-7#02-FLO001", "0199-7#02-HEA002"]
    assert [r["unit_base"] for r in semantic.has_unit(properties, concepts).collect()] == ["0199-7#05-LPM010"]


def test_put(spark, segment):
    units = dictionary.units(spark, segment + "/units.xml")
    none = dictionary.classes(spark, segment + "/pumps*", [40]), dictionary.properties(spark, segment + "/pumps*", [40])
    known = dictionary.concepts(*none, units.filter("short_name = 'bar'"))
    new = dictionary.concepts(*none, units).withColumn("idShort", F.lit("new"))
    short = lambda df: sorted((r["id"][-10:], r["idShort"]) for r in df.collect())
    assert short(dictionary.put(known, new)) == [("BAR020#001", "bar"), ("LPM010#003", "new")]
    assert short(dictionary.put(known, new, overwrite=True)) == [("BAR020#001", "new"), ("LPM010#003", "new")]


def test_reading_tools(spark):
    graph = project.graph(spark, "/root/testdata/sf0.001")
    assert tools.sql_read(graph, "SELECT count(*) AS n FROM submodels WHERE idShort = 'Nameplate'").first()["n"] == 10
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO y SELECT * FROM x"):
        with pytest.raises(ValueError):
            tools.sql_read(graph, bad)
    rows, total = tools.capped(graph.concepts.select("id"), 5)
    assert len(rows) == 5 and total == 60
    assert tools.ask(graph, {"$condition": {"$eq": [{"$field": "$aas#idShort"}, {"$strVal": "Supplier_1"}]}}).first()["id"] == "urn:aas:supplier:1"
