"""Adding, reading and removing of identifiables and elements, as a log of changes beside a graph that stays as it is.

Each change is one generation: rows that it adds, and marks of what it takes away. A row counts if no later generation marks its id, its node or its submodel. So a change writes only what
it changes, reading costs one anti-join with the marks however many changes there are, and stores that share a past (each change gives a new store) don't disturb each other. A generation counts
once its entry in the log is written, last of all; one writer at a time. `compact` writes what counts as a graph of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.aasql import compile_query
from ..schema import CONCEPT, ELEMENT, SHELL, SUBMODEL, Graph, shaped, struct
from ..session import new_folder
from .cleaning import repair
from .resolve import SENT, children, descend, first_of, references, sent

TABLES = {"AssetAdministrationShell": ("shells", SHELL), "Submodel": ("submodels", SUBMODEL), "ConceptDescription": ("concepts", CONCEPT)}
ROWS = {"shells": SHELL, "submodels": SUBMODEL, "elements": ELEMENT, "concepts": CONCEPT}
#: What marks name: identifiables by id, all elements of a submodel, single nodes.
MARK, LOG = "what string, key string", "parent int, tables array<string>, marks long, kinds map<string,bigint>"


@dataclass(frozen=True)
class Generation:
    number: int
    tables: tuple[str, ...]
    #: How many marks there are of each kind (what).
    marks: dict[str, int]


def id_path(path: str) -> list[str]:
    """Steps of an idShort path such as `A.B-c[2].D`; places in lists as their number."""
    return [s for part in path.split(".") for s in part.replace("]", "").split("[")]


@dataclass
class Store:
    """A graph and the changes to it that lie under path (a new folder, if none is given)."""

    base: Graph
    path: str | None = None
    changes: tuple[Generation, ...] = ()

    @classmethod
    def open(cls, base: Graph, path: str) -> Store:
        """The store as the last change under path left it."""
        log = base.spark.read.schema(f"{LOG}, gen int").parquet(f"{path}/log").collect()
        entries, line = {r["gen"]: r for r in log}, []
        at = max(entries, default=0)
        while at:
            r = entries[at]
            # logs of before have no counts by kind: any mark may be of any
            line.append(Generation(at, tuple(r["tables"]), r["kinds"] if r["kinds"] is not None else dict.fromkeys(("owner", "node", *ROWS), r["marks"])))
            at = r["parent"]
        return cls(base, path, tuple(reversed(line)))

    @property
    def spark(self):
        return self.base.spark

    def written(self, what: str, ddl: str, generations: list[Generation]) -> DataFrame:
        """What generations have written, with their number as gen."""
        paths = [f"{self.path}/{what}/gen={g.number}" for g in generations]
        return self.spark.read.schema(f"{ddl}, gen int").option("basePath", f"{self.path}/{what}").parquet(*paths)

    def live(self, name: str) -> DataFrame:
        base, ddl = getattr(self.base, name), ROWS[name]
        if not self.changes:
            return base
        rows = shaped(base, ddl).withColumn("gen", F.lit(0))
        if own := [g for g in self.changes if name in g.tables]:
            rows = rows.unionByName(self.written(name, ddl, own))
        for what, column in (("owner", "submodel_id"), ("node", "node_id")) if name == "elements" else ((name, "id"),):
            if marking := [g for g in self.changes if g.marks.get(what)]:
                those = self.written("marks", MARK, marking).filter(F.col("what") == what).groupBy(F.col("key").alias(column)).agg(F.max("gen").alias("until"))
                those = F.broadcast(those) if sum(g.marks[what] for g in marking) <= SENT else those
                # an anti-join would go into every branch of a graph that is a union
                rows = rows.join(those, column, "left").filter("until IS NULL OR until <= gen").drop("until")
        return rows.select(*struct(ddl).names)

    @cached_property
    def graph(self) -> Graph:
        return self.base.changed(**{name: self.live(name) for name in ROWS}) if self.changes else self.base

    def changed(self, marks: DataFrame | None = None, **tables: DataFrame) -> Store:
        """The store after one more generation."""
        path, spark = self.path or new_folder(self.spark), self.spark
        log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
        fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
        number = 1 + max((int(s.getPath().getName().removeprefix("gen=")) for s in fs.listStatus(log) if s.isDirectory()), default=0) if fs.exists(log) else 1
        for name, rows in tables.items():
            shaped(rows, ROWS[name]).write.mode("overwrite").parquet(f"{path}/{name}/gen={number}")
        n = {}
        if marks is not None:
            marks.select("what", "key").write.mode("overwrite").parquet(f"{path}/marks/gen={number}")
            n = {r["what"]: r["count"] for r in spark.read.schema(MARK).parquet(f"{path}/marks/gen={number}").groupBy("what").count().collect()}
        made = Generation(number, tuple(tables), n)
        parent = self.changes[-1].number if self.changes else 0
        spark.createDataFrame([(parent, list(tables), sum(n.values()), n)], LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/gen={number}")
        return Store(self.base, path, (*self.changes, made))

    def aside(self, df: DataFrame) -> DataFrame:
        """df written beside the changes and read from there: what a change uses several times."""
        self.path = self.path or new_folder(self.spark)
        df.write.parquet(path := f"{self.path}/aside/{uuid.uuid4().hex}")
        return self.spark.read.schema(df.schema).parquet(path)

    def compact(self, path: str) -> Store:
        """The store with all that counts written as one graph under path, and no changes."""
        self.graph.write(path)
        return Store(Graph.load(self.spark, path))

    def mark(self, *rows: tuple[str, str]) -> DataFrame:
        return self.spark.createDataFrame(list(rows), MARK)

    def exists(self, identifier: str) -> bool:
        return not self.ids().filter(F.col("id") == identifier).limit(1).isEmpty()

    def add_identifiable(self, kind: str, row: DataFrame, elements: DataFrame | None = None, fix: bool = False) -> Store:
        """Adds one identifiable; KeyError if its id is taken."""
        identifier = row.first()["id"]
        if self.exists(identifier):
            raise KeyError(identifier)
        return self.changed(**self.rows(kind, row, elements, fix))

    @staticmethod
    def rows(kind: str, row: DataFrame, elements: DataFrame | None, fix: bool) -> dict[str, DataFrame]:
        if elements is not None:
            elements = shaped(elements, ELEMENT)
            elements = repair(elements) if fix else elements
        return {TABLES[kind][0]: row} | ({} if elements is None else {"elements": elements})

    def get(self, identifier: str) -> tuple[str, DataFrame]:
        kind = self.kind(identifier)
        return kind, getattr(self.graph, TABLES[kind][0]).filter(F.col("id") == identifier)

    def kind(self, identifier: str) -> str:
        found = self.ids().filter(F.col("id") == identifier).first()
        if found is None:
            raise KeyError(identifier)
        return found["kind"]

    def find(self, submodel_id: str, path: str) -> DataFrame:
        """The element at an idShort path; KeyError if there is none, ValueError if there are more."""
        steps = id_path(path)
        own = self.graph.elements.filter((F.col("submodel_id") == submodel_id) & (F.size("names") == len(steps)))
        for k, step in enumerate(steps):  # a named child of a list has a name and a place
            own = own.filter((F.get("names", F.lit(k)) == step) | (F.get("indexes", F.lit(k)).cast("string") == step))
        found = own
        n = len(found.select("node_id").take(2))
        if n != 1:
            raise (ValueError if n else KeyError)(f"{submodel_id}/{path}")
        return found

    def add_referable(self, row: DataFrame, kind: str, submodel_id: str | None = None, path: str | None = None, elements: DataFrame | None = None) -> Store:
        """Adds an identifiable, which takes no place, or an element, which needs one; ValueError otherwise."""
        if kind in TABLES:
            if submodel_id or path:
                raise ValueError(f"{kind} stands alone: no submodel and no path")
            return self.add_identifiable(kind, row, elements)
        if not submodel_id:
            raise ValueError(f"{kind} needs a submodel")
        return self.add_element(row, submodel_id, path)

    def add_element(self, row: DataFrame, submodel_id: str, path: str | None = None) -> Store:
        """Adds an element below a submodel or the element at a path; in a list it gets the next place."""
        new = shaped(row, ELEMENT)
        if path is None:
            if self.kind(submodel_id) != "Submodel":
                raise KeyError(submodel_id)
            parent, rels, names, indexes, ups, index = submodel_id, [], [], [], [], None
        else:
            p = self.find(submodel_id, path).first()
            parent, rels, names, indexes, ups = p["node_id"], p["rels"], p["names"], p["indexes"], p["ancestors"]
            index = self.graph.elements.filter(F.col("parent_id") == parent).count() if p["model_type"] == "SubmodelElementList" else None
        text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        place = {
            "submodel_id": F.lit(submodel_id), "parent_id": F.lit(parent), "node_id": F.concat(F.lit(parent + "/"), F.lit(str(index)) if index is not None else F.col("idShort")),
            "rels": text([*rels, "value" if rels else "submodelElements"]), "names": F.concat(text(names), F.array(F.lit(None).cast("string") if index is not None else F.col("idShort"))),
            "indexes": F.array(*map(F.lit, [*indexes, index])).cast("array<int>"), "ancestors": text([*ups, parent]),
        }
        return self.changed(elements=new.withColumns(place))

    def remove(self, identifier: str) -> Store:
        """Removes an identifiable and its elements; KeyError if it is unknown."""
        return self.removed(identifier)[0]

    def removed(self, identifier: str) -> tuple[Store, int]:
        """The store without an identifiable and its elements, and how many nodes went; KeyError if it is unknown.

        An element stays if a reference names it that nothing within the identifiable holds as well; what is above and below it goes.
        """
        self.kind(identifier)
        return self.removed_all(self.spark.createDataFrame([(identifier,)], "id string"))

    def removed_all(self, identifiers: DataFrame) -> tuple[Store, int]:
        """The store without the identifiables (id) and their elements, in one change, as removed does for each; and how many nodes went. Unknown ids count for nothing."""
        ids = sent(self.aside(identifiers.select("id").distinct()))
        marks = [getattr(self.graph, t).join(ids, "id").select(F.lit(t).alias("what"), F.col("id").alias("key")) for t, _ in TABLES.values()]
        marks.append(marks[list(TABLES).index("Submodel")].withColumn("what", F.lit("owner")))
        below = self.aside(self.graph.elements.join(ids.withColumnRenamed("id", "submodel_id"), "submodel_id"))  # ids are distinct; a semi-join would go into every branch of a union
        refs = references(self.graph, least=2)
        aimed = self.aside(refs.join(ids, first_of(refs["ref"]) == ids["id"]).drop("id"))
        within = aimed.join(ids.withColumnRenamed("id", "home"), "home", "left_semi").select("ref_id")
        held = below.join(self.named(aimed.join(within, "ref_id", "left_anti"), below), "node_id", "left_semi")
        store = self.changed(reduce(DataFrame.union, marks), elements=held)
        last = store.changes[-1]
        went = sum(n for what, n in last.marks.items() if what != "owner") + below.count() - store.written("elements", ELEMENT, [last]).count()
        return store, went

    def orphans(self) -> DataFrame:
        """Elements whose submodel is not there: what removed ones have left. Their submodels are told from distinct ids, so that no rows are shuffled but of those."""
        elements, there = self.graph.elements, self.graph.submodels.select(F.col("id").alias("submodel_id"), F.lit(True).alias("there")).distinct()
        # an anti-join would go into every branch of a graph that is a union
        gone = self.aside(elements.select("submodel_id").distinct().join(there, "submodel_id", "left").filter("there IS NULL").select(F.col("submodel_id").alias("gone")))
        return elements.join(sent(gone), F.col("submodel_id").eqNullSafe(F.col("gone"))).drop("gone")

    def named(self, refs: DataFrame, below: DataFrame) -> DataFrame:
        """(node_id): those of the elements `below` that references name."""
        return descend(children(self.base.changed(elements=below)), refs).select(F.col("node").alias("node_id")).distinct()

    def remove_element(self, submodel_id: str, path: str) -> Store:
        """Removes the element at a path and what is below it, as removed does."""
        return self.removed_element(submodel_id, path)[0]

    def removed_element(self, submodel_id: str, path: str) -> tuple[Store, int]:
        node = self.find(submodel_id, path).first()["node_id"]
        own = self.graph.elements.filter(F.col("submodel_id") == submodel_id)
        inside = own.filter((F.col("node_id") == node) | F.array_contains("ancestors", node)).select("node_id")
        aimed = self.aside(references(self.graph, least=2).filter(first_of(F.col("ref")) == submodel_id))
        within = aimed.filter(F.col("home") == submodel_id).join(inside.withColumnRenamed("node_id", "owner"), "owner", "left_semi").select("ref_id")
        held = self.named(aimed.join(within, "ref_id", "left_anti"), own).filter(F.col("node_id") != node)
        store = self.changed(inside.join(held, "node_id", "left_anti").select(F.lit("node").alias("what"), F.col("node_id").alias("key")))
        return store, store.changes[-1].marks.get("node", 0)

    def commit(self, kind: str, row: DataFrame, elements: DataFrame | None = None, fix: bool = False) -> Store:
        """Puts a new version in the place of a stored identifiable; KeyError if there is none. No element of the old one stays: references resolve when they are read, to the new one."""
        identifier = row.first()["id"]
        table = TABLES[self.kind(identifier)][0]
        return self.changed(self.mark((table, identifier), ("owner", identifier)), **self.rows(kind, row, elements, fix))

    def discard(self, identifier: str) -> Store:
        """The store without an identifiable; itself if there is none."""
        return self.remove(identifier) if self.exists(identifier) else self

    def upsert(self, other: Graph) -> Store:
        """Takes over all identifiables of other, in the place of stored ones of their ids, in one change."""
        ids = {t: getattr(other, t).select(F.col("id").alias("key")) for t, _ in TABLES.values()}
        marks = [df.select(F.lit(what).alias("what"), "key") for t, df in ids.items() for what in [t, *(["owner"] if t == "submodels" else [])]]
        return self.changed(reduce(DataFrame.union, marks).filter("key IS NOT NULL"), **{name: getattr(other, name) for name in ROWS})

    def ids(self, kind: str | None = None) -> DataFrame:
        """(kind, id) of all identifiables, or of one kind."""
        parts = [getattr(self.graph, table).select(F.lit(k).alias("kind"), "id") for k, (table, _) in TABLES.items() if kind in (None, k)]
        return reduce(DataFrame.union, parts)

    def query(self, query: str | dict, target: str | None = None) -> DataFrame:
        """The rows that an AASQL query selects."""
        return compile_query(query, self.graph, target)

    def count(self) -> int:
        return self.ids().count()

    def __contains__(self, identifier: str) -> bool:
        return self.exists(identifier)

    def __len__(self) -> int:
        return self.count()
