"""Read operators for analysis: counts, aggregates of a field, absence, structure and lookup."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import irdi_base, leading_number, pick_text
from ..schema import Graph, first_key
from ..session import new_folder
from .narrow import shells_of, there, within
from .semantic import element_text, matches, semantic_id


def count_stats(graph: Graph) -> DataFrame:
    """One row: numbers of shells, submodels and concepts."""
    tables = (("shells", graph.shells), ("submodels", graph.submodels), ("concepts", graph.concepts))
    kinds = reduce(DataFrame.union, [df.select(F.lit(n).alias("kind")) for n, df in tables])
    return kinds.agg(*(F.count_if(F.col("kind") == n).alias(n) for n, _ in tables))


def count_by_type(graph: Graph) -> DataFrame:
    return graph.elements.groupBy("model_type").agg(F.count(F.lit(1)).alias("n"))


def submodel_types(graph: Graph) -> DataFrame:
    return graph.submodels.groupBy("idShort", semantic_id().alias("semantic_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "idShort")


def submodel_types_by_semantic_id(graph: Graph) -> DataFrame:
    return graph.submodels.groupBy(semantic_id().alias("semantic_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "semantic_id")


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s_]+", text.lower()) if len(w) > 2]


def is_field(name: str) -> Column:
    """Elements whose name holds every word of name."""
    tests = [F.contains(F.lower("idShort"), F.lit(w)) for w in words(name) or [name.lower()]]
    return reduce(Column.__and__, tests)


def asset_values(graph: Graph, field: str | None = None, identifier: str | None = None) -> DataFrame:
    """(asset, field, raw, number) of a field by name or semantic identifier, for each shell that refers to it."""
    test = matches(semantic_id(), identifier, True) if identifier else is_field(field)
    values = graph.elements.filter(test).select(F.col("submodel_id").alias("sm_id"), F.col("idShort").alias("field"), element_text().alias("raw")).filter("raw IS NOT NULL")
    return there(graph, values).join(shells_of(graph, values.select("sm_id")), "sm_id").select("asset", "field", "raw", leading_number(F.col("raw")).alias("number"))


def aggregate_field(graph: Graph, op: str, field: str | None = None, identifier: str | None = None, most: int = 50) -> DataFrame:
    """count_by_value, max, min (with the row they stand in), sum or avg of a field over shells."""
    rows = asset_values(graph, field, identifier)
    if op == "count_by_value":
        return rows.groupBy(F.col("raw").alias("value")).agg(F.count_distinct("asset").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    numbers = rows.filter("number IS NOT NULL")
    if op in ("max", "min"):
        # ties go to the smallest asset, then field
        sign = 1 if op == "min" else -1
        first = F.min(F.struct((sign * F.col("number")).alias("key"), "asset", "field", "raw")).alias("x")
        return numbers.agg(first).select("x.asset", "x.field", "x.raw", F.round(sign * F.col("x.key"), 4).alias("number"))
    if op == "sum":
        return numbers.agg(F.round(F.sum("number"), 2).alias("number"), F.count(F.lit(1)).alias("n"))
    if op in ("avg", "average", "mean"):
        return numbers.agg(F.round(F.avg("number"), 4).alias("number"), F.count(F.lit(1)).alias("n"))
    raise ValueError(f"Unknown operation: {op}")


def property_values(graph: Graph, field: str, asset: str | None = None, contains: str | None = None, least: float | None = None, most: float | None = None, rows: int = 60) -> DataFrame:
    found = asset_values(graph, field)
    if asset:
        found = found.filter(F.contains(F.lower("asset"), F.lit(asset.lower())))
    if contains:
        found = found.filter(F.contains(F.lower("raw"), F.lit(contains.lower())))
    if least is not None:
        found = found.filter(F.col("number") >= least)
    if most is not None:
        found = found.filter(F.col("number") <= most)
    return found.select("asset", "field", "raw").distinct().orderBy("asset", "field", "raw").limit(rows)


def assets_missing(graph: Graph, submodel_type: str | None = None, field: str | None = None) -> DataFrame:
    """Shells that refer to no submodel of a type, or to none with a field."""
    if submodel_type:
        having = graph.submodels.filter(F.col("idShort") == submodel_type).select(F.col("id").alias("sm_id"))
    else:
        having = there(graph, graph.elements.filter(is_field(field)).select(F.col("submodel_id").alias("sm_id")).distinct())
    with_it = shells_of(graph, having).join(having, "sm_id", "left_semi").select(F.col("aas_id").alias("id")).distinct()
    return graph.shells.select("id", F.col("idShort").alias("asset")).join(with_it, "id", "left_anti").select("asset").orderBy("asset")


def asset_components(graph: Graph, submodel_type: str = "HierarchicalStructures", asset: str | None = None) -> DataFrame:
    """Per shell, or for one by its idShort, how many collections its submodels of a type hold and how many relationships of each direction."""
    inside = graph.elements.filter(~F.coalesce(F.col("idShort").isin("ArcheType", "EntryNode"), F.lit(False))).withColumnRenamed("submodel_id", "sm_id")
    tests = {"parts": F.col("model_type").isin("Entity", "SubmodelElementCollection"), "has_part": F.col("idShort").startswith("HasPart"), "is_part_of": F.col("idShort").startswith("IsPartOf")}
    counted = inside.filter(reduce(Column.__or__, tests.values())).groupBy("sm_id").agg(*(F.count_if(t).alias(c) for c, t in tests.items()))
    chosen = graph.submodels.filter(F.col("idShort") == submodel_type).select(F.col("id").alias("sm_id")).distinct()
    known = chosen.join(counted, "sm_id", "left")
    # elements that count for nothing are looked up where a submodel holds no others
    bare = within(inside.select("sm_id"), "sm_id", known.filter("parts IS NULL").select("sm_id")).distinct().withColumn("bare", F.lit(True))
    known = known.join(bare, "sm_id", "left").filter("parts IS NOT NULL OR bare").select("sm_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in tests))
    held = shells_of(graph, chosen)
    held = held if asset is None else held.filter(F.col("asset") == asset)
    # a shell that is there twice counts once
    return known.join(held.select("sm_id", "aas_id"), "sm_id").distinct().groupBy("aas_id").agg(*(F.sum(c).alias(c) for c in tests))


def get_asset(graph: Graph, name: str) -> DataFrame:
    """The best tier of shells for a name: id first, then idShort, then part of either; with their number (`matches`, ambiguous above 1), manufacturer, designation and submodel count."""
    low = name.lower()
    named = reduce(Column.__or__, [test for c in ("id", "idShort") for test in (F.lower(c) == low, F.contains(F.lower(c), F.lit(low)))])
    # what a shell refers to is put together for shells of that name alone: their names are asked first, as columns of the tables behind them
    some = graph.shells.filter(named)
    rank = F.when(F.lower("id") == low, 0).when(F.lower("idShort") == low, 1).otherwise(2)
    ranked = some.select("id", "idShort", "globalAssetId", rank.alias("rank"))
    best = ranked.join(ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("matches")).orderBy("rank").limit(1), "rank")
    refers = some.select(F.col("id").alias("aas_id"), F.explode(F.array_distinct(F.transform("submodels", first_key))).alias("sm_id")).join(best.select(F.col("id").alias("aas_id")).distinct(), "aas_id", "left_semi")
    known = within(graph.submodels.select(F.col("id").alias("sm_id")), "sm_id", refers.select("sm_id")).distinct()
    # a shell that is there twice counts a submodel once
    held = refers.join(known, "sm_id", "left_semi").distinct()
    said = graph.elements.filter(F.col("idShort").isin("ManufacturerName", "Company", "ManufacturerProductDesignation")).select(F.col("submodel_id").alias("sm_id"), F.col("idShort").alias("what"), element_text().alias("text"))
    maker = F.min(F.when(F.col("what") != "ManufacturerProductDesignation", F.struct((F.col("what") != "ManufacturerName").alias("second"), "text")))
    designation = F.min(F.when(F.col("what") == "ManufacturerProductDesignation", F.col("text")))
    facts = said.filter("text <> ''").groupBy("sm_id").agg(maker.alias("maker"), designation.alias("designation"))
    facts = held.join(facts, "sm_id", "left").groupBy(F.col("aas_id").alias("id")).agg(F.min("maker")["text"].alias("manufacturer"), F.min("designation").alias("designation"), F.count(F.lit(1)).alias("submodels"))
    return best.join(facts, "id", "left").select("id", "idShort", "globalAssetId", "rank", "matches", "manufacturer", "designation", F.coalesce("submodels", F.lit(0)).alias("submodels"))


def manufacturers(graph: Graph) -> DataFrame:
    return named_manufacturers(graph).distinct()


def named_manufacturers(graph: Graph) -> DataFrame:
    named = graph.elements.filter(F.col("idShort") == "ManufacturerName").select(F.trim(element_text()).alias("manufacturer"))
    return named.filter("manufacturer <> '' AND lower(manufacturer) <> 'unknown'")


def overview(graph: Graph) -> DataFrame:
    """(section, name, semantic_id, n): what there is, in one report: numbers of identifiables (`count`), types of submodels (`type`), manufacturers with how many elements name them (`manufacturer`) and names of assets (`asset`)."""
    none = F.lit(None).cast("string")
    kinds = (("shells", graph.shells), ("submodels", graph.submodels), ("concepts", graph.concepts))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("count").alias("section"), F.lit(name).alias("name"), none.alias("semantic_id"), "n") for name, df in kinds]
    types = graph.submodels.groupBy("idShort", semantic_id().alias("semantic_id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type"), "idShort", "semantic_id", "n")
    makers = named_manufacturers(graph).groupBy("manufacturer").agg(F.count(F.lit(1)).alias("n")).select(F.lit("manufacturer"), "manufacturer", none, "n")
    assets = graph.shells.filter("idShort <> ''").groupBy("idShort").agg(F.count(F.lit(1)).alias("n")).select(F.lit("asset"), "idShort", none, "n")
    return reduce(DataFrame.union, [*counts, types, makers, assets])


def field_corpus(graph: Graph, submodel_type: str | None = None) -> DataFrame:
    """Distinct (submodel type, field, concept base) with their number of uses, of one type or of all."""
    owner = graph.submodels.select(F.col("id").alias("submodel_id"), F.col("idShort").alias("submodel_type"))
    elements = graph.elements
    if submodel_type is not None:
        owner = owner.filter(F.col("submodel_type") == submodel_type)
        elements = within(elements, "submodel_id", owner.select("submodel_id"))
    fields = elements.filter("idShort IS NOT NULL").groupBy("submodel_id", F.col("idShort").alias("field"), irdi_base(semantic_id()).alias("base")).agg(F.count(F.lit(1)).alias("n"))
    return fields.join(owner, "submodel_id").groupBy("submodel_type", "field", "base").agg(F.sum("n").alias("n"))


#: Bytes of query vectors that are sent to every task at a time; queries and rows whose pairs a task compares at a time.
QUERY_BYTES, QUERIES, ROWS = 32_000_000, 1024, 2048


def nearest_fields(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, id, distance): exact k nearest of a stated set of queries (query_id, query) among vectors (id, embedding) but their own, by squared distance to six digits, ties by id.

    The queries go to every task, more than QUERY_BYTES of them in blocks by the hash of their id. A task holds the k best of each query among its rows and sends these alone; products of
    matrices rule out all pairs that can't be among them. Vectors that are null, of another length than the first query or hold null or non-finite values take no part.
    """
    named = queries.filter("query IS NOT NULL")
    first = named.select(F.size("query").alias("n")).first()
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", corpus.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    if first is None:
        return corpus.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1)).select("query_id", "rank", "id", "distance")
    size = first["n"]
    named = named.filter(F.size("query") == size)
    blocks = max(1, -(-named.count() * size * 8 // QUERY_BYTES))
    parts = []
    for block in range(blocks):
        lot = named.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "query").toArrow().combine_chunks()
        parts.append(corpus.filter(F.size("embedding") == size).select("id", "embedding").mapInArrow(best_of(lot.column(0).to_pylist(), matrix(lot.column(1), size), k, schema), schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return reduce(DataFrame.union, parts).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def matrix(rows, size: int):
    """A column of lists of one size as floats; nulls are no numbers."""
    import numpy as np

    flat = (rows.combine_chunks() if hasattr(rows, "combine_chunks") else rows).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def best_of(names: list, vectors, k: int, schema: T.StructType):
    """A function over batches (id, embedding) that gives each query's k nearest of a task's rows as schema has them; vectors has a row for each name.

    Pairs are compared in tiles of QUERIES queries and ROWS rows, so that memory does not grow with either but for the k best of each query.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out, queries, rows = to_arrow_schema(schema), QUERIES, ROWS
    good = np.isfinite(vectors).all(axis=1) if len(vectors) else np.zeros(0, bool)
    vectors, names = vectors[good], [n for n, ok in zip(names, good, strict=True) if ok]

    class Tile:
        """The k best of some queries so far."""

        def __init__(self, start):
            self.names, self.wanted = names[start : start + queries], vectors[start : start + queries]
            self.squares, self.worst = (self.wanted**2).sum(axis=1), np.full(len(self.names), np.inf)
            self.query, self.near, self.held = np.zeros(0, np.int64), np.zeros(0), pa.array([], out.field("id").type)

        def add(self, ids, same, x, norms):
            about = self.squares[:, None] + norms - 2 * self.wanted @ x.T
            slack = 2e-6 + 1e-9 * (self.squares.max() + norms.max())
            # one more than k: a query's own row may be among them
            bound = np.minimum(self.worst, np.partition(about, k, axis=1)[:, k] if len(x) > k else np.inf)
            i, j = np.nonzero(about <= (bound + slack)[:, None])
            other = np.fromiter((self.names[a] != same[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            i, j = i[other], j[other]
            if not len(i):
                return
            exact = np.concatenate([np.round(((self.wanted[i[at : at + rows]] - x[j[at : at + rows]]) ** 2).sum(axis=1), 6) for at in range(0, len(i), rows)])
            query, near, held = np.concatenate([self.query, i]), np.concatenate([self.near, exact]), pa.concat_arrays([self.held, ids.take(pa.array(j))])
            order = np.lexsort((np.argsort(np.argsort(held.to_numpy(zero_copy_only=False), kind="stable"), kind="stable"), near, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            order = order[place < k]
            self.query, self.near, self.held = query[order], near[order], held.take(pa.array(order))
            full = np.flatnonzero(np.bincount(self.query, minlength=len(self.names)) == k)
            self.worst[full] = self.near[np.searchsorted(self.query, full, side="right") - 1]

    def run(batches):
        tiles = [Tile(start) for start in range(0, len(names), queries)]
        for batch in batches if names else ():
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                x = matrix(part.column(1), vectors.shape[1])
                ids, x = part.column(0).filter(pa.array(fit := np.isfinite(x).all(axis=1))), x[fit]
                if not len(x):
                    continue
                same, norms = ids.to_pylist(), (x**2).sum(axis=1)
                for tile in tiles:
                    tile.add(ids, same, x, norms)
        for tile in tiles:
            yield pa.RecordBatch.from_arrays([pa.array(tile.names, out.field("query_id").type).take(pa.array(tile.query)), tile.held, pa.array(tile.near)], schema=out)

    return run


def relevant_fields(corpus: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(rank, field, submodel_type, base, distance): the k fields nearest to any of a question's queries (query_id, query).

    corpus (id, field, submodel_type, base, embedding) has a vector for each field. Each query gives its k nearest, of which a field (with its concept)
    keeps its best distance.
    """
    near = nearest_fields(corpus.select("id", "embedding"), queries, k).join(corpus.select("id", "field", "submodel_type", "base"), "id")
    best = near.groupBy("field", "base").agg(F.min(F.struct("distance", "submodel_type")).alias("best")).select("field", "best.submodel_type", "base", "best.distance")
    rank = F.row_number().over(Window.orderBy("distance", "field", F.col("base").asc_nulls_last()))
    return best.orderBy("distance", "field", F.col("base").asc_nulls_last()).limit(k).select(rank.alias("rank"), "field", "submodel_type", "base", "distance")


def by_concept(fields: DataFrame, concepts: DataFrame) -> DataFrame:
    """(base, name, fields) of fields that share a concept, however they are spelled; name is the concept's text, if it has one."""
    named = concepts.select(irdi_base(F.col("id")).alias("base"), pick_text(F.col("displayName"), F.lit(None).cast("string")).alias("name")).groupBy("base").agg(F.min("name").alias("name"))
    groups = fields.filter("base IS NOT NULL").groupBy("base").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return groups.join(named, "base", "left").select("base", "name", "fields")


def sql_read(graph: Graph, statement: str) -> DataFrame:
    """One SELECT over the graph's tables; ValueError for anything that is not a lone query."""
    text = statement.strip().rstrip(";")
    if ";" in text or not re.match(r"(?is)^(select|with)\b", text) or re.search(r"(?i)\b(insert|create|drop|alter|truncate|merge|update|delete|set|load|cache|refresh|use)\b", re.sub(r"'[^']*'", "''", text)):
        raise ValueError("Only a single SELECT is allowed")
    for name in ("shells", "submodels", "elements", "concepts", "bridge"):
        getattr(graph, name).createOrReplaceTempView(name)
    return graph.spark.sql(text)


def capped(rows: DataFrame, most: int = 200, characters: int = 4000) -> tuple[list[dict], int]:
    """The first rows of a report that fit into so many characters of JSON (one at least), `most` at the most, and how many there are in all."""
    shown, size = [], 0
    for r in rows.limit(most).select(F.struct("*").alias("row"), F.char_length(F.to_json(F.struct("*"))).alias("size")).toLocalIterator():
        size += r["size"]
        if shown and size > characters:
            break
        shown.append(r["row"].asDict(recursive=True))
    return shown, rows.count()


def within_budget(rows: DataFrame, order: list[str], characters: int) -> DataFrame:
    """The rows, in an order that tells them apart, that fit together into so many characters of JSON; the first one in any case.

    Running sums in two passes: rows are dealt into ranges of the order and stored, the ranges' sums are added up (a row for each range), and each range goes on from the sum of those before it.
    """
    size = F.char_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))).cast("long")
    path = f"{new_folder(rows.sparkSession)}/ranges"
    rows.repartitionByRange(*order).withColumns({"_size": size, "_range": F.spark_partition_id()}).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum("_size").alias("own")).select("_range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("_before"))
    # a range that begins beyond the budget holds nothing that fits
    near = dealt.join(F.broadcast(ranges.filter(F.col("_before") < characters)), "_range")
    within = F.sum("_size").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_sum", F.col("_before") + within).filter((F.col("_sum") <= characters) | (F.col("_sum") == F.col("_size"))).select(*(F.col(f"`{c}`") for c in rows.columns))


def ask(graph: Graph, query: dict | str) -> DataFrame:
    """Ids that an AASQL query selects: shells if it names them, else submodels; where that is empty, the other kind."""
    from ..plans.aasql import compile_query

    text = query if isinstance(query, str) else str(query)
    first, second = ("aas", "sm") if "$aas" in text else ("sm", "aas")
    found = compile_query(query, graph, first).select("id")
    return compile_query(query, graph, second).select("id") if found.isEmpty() else found
