"""The star-schema tables seen as shells, submodels, elements and concepts.

Each kind of element is a branch of a union with constant paths, so that a query for one path folds the other branches away
and its filter and columns reach the scan of the one table behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CONCEPT, ELEMENT, SHELL, SUBMODEL, Graph, reference, shaped

VERSIONS = 3


def concept(number: int, version: Column | None = None) -> Column:
    """Identifier of a concept; version is a column of 1 to VERSIONS."""
    return F.concat(F.lit(f"0173-1#02-AAA{number:03d}#00"), (F.lit(1) if version is None else version).cast("string"))


def global_reference(value: Column) -> Column:
    return reference("ExternalReference", ("GlobalReference", value))


def key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def branch(df: DataFrame, submodel: Column, *path, model_type: str = "Property", value: Column | None = None, value_type: str | None = None, kind: str = "s", index: Column | None = None, **columns: Column) -> DataFrame:
    """Elements of one kind: path holds names (or None in a list, where index is the place)."""
    last = len(path) - 1
    indexes = [index if name is None else F.lit(None) for name in path]
    node = F.concat_ws("/", submodel, *(F.lit(n) if n is not None else index.cast("string") for n in path))
    ups = [submodel] + [F.concat_ws("/", submodel, *(F.lit(n) if n is not None else index.cast("string") for n in path[: k + 1])) for k in range(last)]
    made = df.select(
        submodel.alias("submodel_id"), node.alias("node_id"), ups[-1].alias("parent_id"),
        F.array(F.lit("submodelElements"), *[F.lit("value")] * last).alias("rels"), F.array(*(F.lit(n).cast("string") for n in path)).alias("names"),
        F.array(*(i.cast("int") for i in indexes)).alias("indexes"), F.array(*ups).alias("ancestors"), F.lit(model_type).alias("model_type"),
        F.lit(path[-1]).cast("string").alias("idShort"), (F.lit(None) if value is None else value).cast("string").alias("value"),
        F.lit(kind if value is not None else None).cast("string").alias("kind"), F.lit(value_type).cast("string").alias("valueType"),
        *(c.alias(n) for n, c in columns.items()),
    )
    return shaped(made, ELEMENT)


def texts(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(lang.alias("language"), text.alias("text")) for lang, text in pairs))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, supplier, customer, part, orders, lineitem, documents, events = map(read, "region nation supplier customer part orders lineitem documents events".split())
    lines = lineitem.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")) - 1)
    # an order's places are as many as its lines, whichever line has which
    slots = lineitem.select("l_orderkey").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_orderkey")) - 1)
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")

    # a task sends each part of a supplier once
    supplied = lineitem.groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))
    to = lambda prefix, c: reference("ModelReference", ("Submodel", F.concat(F.lit(prefix), c.cast("string"))))
    suppliers = supplier.join(places, supplier.s_nationkey == places.n_nationkey).join(supplied, supplier.s_suppkey == supplied.l_suppkey, "left").select(
        key("urn:aas:supplier:", "s_suppkey").alias("id"), key("Supplier_", "s_suppkey").alias("idShort"), F.lit("Instance").alias("assetKind"), F.lit("Supplier").alias("assetType"),
        key("urn:asset:supplier:", "s_suppkey").alias("globalAssetId"),
        F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value"), global_reference(F.lit("urn:registry")).alias("externalSubject")) for n, c in (("nation", "n_name"), ("region", "r_name")))).alias("specific"),
        F.concat(F.array(to("urn:sm:nameplate:", F.col("s_suppkey"))), F.transform(F.coalesce("parts", F.array().cast("array<bigint>")), lambda p: to("urn:sm:technicaldata:", p))).alias("submodels"),
    )
    ordered = orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    customers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(ordered, customer.c_custkey == ordered.o_custkey, "left").select(
        key("urn:aas:customer:", "c_custkey").alias("id"), key("Customer_", "c_custkey").alias("idShort"), F.lit("Instance").alias("assetKind"), F.col("c_mktsegment").alias("assetType"),
        key("urn:asset:customer:", "c_custkey").alias("globalAssetId"),
        F.array(F.struct(F.lit("nation").alias("name"), F.col("n_name").alias("value"), global_reference(F.lit("urn:registry")).alias("externalSubject"))).alias("specific"),
        F.transform(F.coalesce("keys", F.array().cast("array<bigint>")), lambda o: to("urn:sm:order:", o)).alias("submodels"),
    )

    tech, plate, order, doc, oper = (key(f"urn:sm:{n}:", c) for n, c in (("technicaldata", "p_partkey"), ("nameplate", "s_suppkey"), ("order", "o_orderkey"), ("doc", "doc_id"), ("operational", "user_id")))
    line = key("urn:sm:order:", "l_orderkey")
    submodel = lambda df, i, name, semantic, kind="Instance": shaped(df.select(i.alias("id"), F.lit(name).alias("idShort"), F.lit(kind).alias("kind"), global_reference(F.lit(semantic)).alias("semantic"), F.lit("1").alias("version"), F.lit("0").alias("revision")), SUBMODEL)
    users = events.select("user_id").distinct()
    submodels = [
        submodel(part, tech, "TechnicalData", "0173-1#01-AHX837#002"), submodel(supplier, plate, "Nameplate", "https://admin-shell.io/zvei/nameplate/2/0/Nameplate"),
        submodel(orders, order, "OrderRecord", "urn:semantic:order"), submodel(documents, doc, "HandoverDocumentation", "0173-1#01-AHF578#001"), submodel(users, oper, "OperationalData", "urn:semantic:operational"),
    ]

    version = F.pmod(F.col("p_partkey"), F.lit(VERSIONS)) + 1
    german = part.filter(F.col("p_partkey") % 4 == 0)
    english = part.filter(F.col("p_partkey") % 4 != 0)
    size = {"value": F.col("p_size"), "value_type": "xs:int", "semantic": global_reference(concept(1, version))}
    latest = events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    nations = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    elements = [
        branch(part, tech, "GeneralInformation", model_type="SubmodelElementCollection"),
        branch(part, tech, "GeneralInformation", "Name", value=F.col("p_name"), value_type="xs:string", semantic=global_reference(concept(2, version))),
        branch(part, tech, "GeneralInformation", "Brand", value=F.col("p_brand"), value_type="xs:string", semantic=global_reference(concept(3))),
        branch(part, tech, "GeneralInformation", "ProductType", value=F.col("p_type"), value_type="xs:string", semantic=global_reference(concept(4))),
        branch(part, tech, "TechnicalPropertyAreas", model_type="SubmodelElementCollection"),
        branch(english, tech, "TechnicalPropertyAreas", "Size", **size),
        branch(german, tech, "TechnicalPropertyAreas", "Groesse", **size),
        branch(part, tech, "TechnicalPropertyAreas", "RetailPrice", value=F.col("p_retailprice"), value_type="xs:double", kind="n", semantic=global_reference(concept(5))),
        branch(supplier, plate, "ManufacturerName", model_type="MultiLanguageProperty", texts=texts((F.lit("en"), F.col("s_name")), (F.lit("de"), F.concat(F.lit("Firma "), F.col("s_name")))), semantic=global_reference(concept(6))),
        branch(nations, plate, "CountryOfOrigin", value=F.col("n_name"), value_type="xs:string", semantic=global_reference(concept(7))),
        branch(supplier, plate, "AccountBalance", value=F.col("s_acctbal"), value_type="xs:double", semantic=global_reference(concept(8))),
        branch(orders, order, "Status", value=F.col("o_orderstatus"), value_type="xs:string"),
        branch(orders, order, "Priority", value=F.col("o_orderpriority"), value_type="xs:string"),
        branch(orders, order, "TotalPrice", value=F.col("o_totalprice"), value_type="xs:double", kind="n", semantic=global_reference(concept(9))),
        branch(orders, order, "OrderDate", value=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), value_type="xs:dateTime"),
        branch(orders, order, "Lines", model_type="SubmodelElementList", listType=F.lit("SubmodelElementCollection")),
        branch(slots, line, "Lines", None, index=F.col("i"), model_type="SubmodelElementCollection"),
        branch(lines, line, "Lines", None, "Quantity", index=F.col("i"), value=F.col("l_quantity"), value_type="xs:double", kind="n", semantic=global_reference(concept(10))),
        branch(lines, line, "Lines", None, "ExtendedPrice", index=F.col("i"), value=F.col("l_extendedprice"), value_type="xs:double", kind="n"),
        branch(lines, line, "Lines", None, "Discount", index=F.col("i"), value=F.col("l_discount"), value_type="xs:double"),
        branch(lines, line, "Lines", None, "ReturnFlag", index=F.col("i"), value=F.col("l_returnflag"), value_type="xs:string"),
        branch(lines, line, "Lines", None, "ShipDate", index=F.col("i"), value=F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), value_type="xs:dateTime"),
        branch(documents, doc, "Text", model_type="MultiLanguageProperty", texts=texts((F.col("lang"), F.col("text")))),
        branch(documents, doc, "Source", value=F.col("source"), value_type="xs:string"),
        branch(documents, doc, "CharCount", value=F.col("n_chars"), value_type="xs:long", kind="n"),
        branch(latest, oper, "CurrentValue", value=F.col("value"), value_type="xs:double", kind="n"),
        branch(latest, oper, "LastEvent", value=F.col("event_type"), value_type="xs:string"),
    ]

    numbers = spark.range(1, 11).select(F.col("id").cast("int").alias("n")).withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(VERSIONS))))
    irdi = F.format_string("0173-1#02-AAA%03d#00%d", F.col("n"), F.col("v"))
    concepts = shaped(numbers.select(irdi.alias("id"), F.format_string("Concept_%d_%d", "n", "v").alias("idShort"), texts((F.lit("en"), F.format_string("concept %d", "n")), (F.lit("de"), F.format_string("Konzept %d", "n"))).alias("displayName"), F.when(F.col("n").isin(1, 10), F.lit("0173-1#05-AAA480#001")).alias("unit")), CONCEPT)
    geography = shaped(nation.join(region, nation.n_regionkey == region.r_regionkey).select(key("urn:nation:", "n_nationkey").alias("id"), F.col("n_name").alias("idShort"), F.array(global_reference(key("urn:region:", "r_regionkey"))).alias("isCaseOf")), CONCEPT).union(shaped(region.select(key("urn:region:", "r_regionkey").alias("id"), F.col("r_name").alias("idShort")), CONCEPT))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return Graph(union([shaped(suppliers, SHELL), shaped(customers, SHELL)]), union(submodels), union(elements), concepts.union(geography))
