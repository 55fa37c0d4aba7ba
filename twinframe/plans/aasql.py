"""AASQL: a JSON query language over shells, submodels, elements and concepts, compiled to DataFrame plans.

parse() turns the JSON into nested tuples and checks it; compile_query() gives every distinct root of a path a variable and
joins the variables' rows to their shell or submodel. Conjuncts that touch one variable each become independent semi-joins; formulas over several elements of a submodel become
one scan that or-s a bit for each part; what else ties several variables is joined and filtered together. Comparisons keep three-valued logic, and strings never equal numbers.

With semantics "reference", every path of a query must exist, also under $or and $not, named paths in one $match are not
correlated, and values without a cast have the type that the document gave them. With "spec", a value is cast to the literal's type, $or and $not
do not ask for paths to exist, and paths with `[]` in one $match are about the same items of the lists that they have in common.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_boolean, to_datetime, to_hex, to_number, to_seconds
from ..schema import SHELL, SUBMODEL, Graph, first_key, shaped

COMPARE = {"$eq": "=", "$ne": "<>", "$gt": ">", "$ge": ">=", "$lt": "<", "$le": "<=", "$contains": "contains", "$starts-with": "startswith", "$ends-with": "endswith", "$regex": "regex"}
LITERALS = {"$strVal": "str", "$numVal": "num", "$boolean": "bool", "$hexVal": "str", "$dateTimeVal": "datetime", "$timeVal": "time"}
CASTS = {"$strCast": "str", "$numCast": "num", "$hexCast": "hex", "$boolCast": "bool", "$dateTimeCast": "datetime", "$timeCast": "time"}
PARTS = {"$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$dayOfWeek": lambda c: F.weekday(c) + 1}
ANY_DEPTH = ("submodelElements", "value", "statements", "annotations")
SWAPPED = {"=": "=", "<>": "<>", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


def parse(query: str | dict) -> tuple[str | None, tuple]:
    """($select, condition) of a query; ValueError names what is wrong."""
    q = json.loads(query) if isinstance(query, str) else query
    q = q.get("Query", q)
    select = q.get("$select")
    if select not in (None, "id"):
        raise ValueError(f"Unsupported $select: {select}")
    if "$condition" not in q:
        raise ValueError("Query has no $condition")
    return select, condition(q["$condition"])


def condition(x: dict) -> tuple:
    for op in ("$match", "$and", "$or"):
        if op in x:
            return (op, tuple(map(condition, x[op])))
    if "$not" in x:
        return ("$not", condition(x["$not"]))
    for op in COMPARE:
        if op in x:
            left, right = map(value, x[op])
            if op == "$regex" and right[0] == "literal":
                try:
                    re.compile(right[2])
                except re.error as e:
                    raise ValueError(f"Invalid regular expression {right[2]!r}: {e}") from None
            return (op, left, right)
    raise ValueError(f"Unknown expression: {sorted(x)}")


def value(x: dict) -> tuple:
    if "$field" in x:
        return ("field", *path(x["$field"]))
    for name, kind in LITERALS.items():
        if name in x:
            return ("literal", kind, x[name])
    for name, kind in CASTS.items():
        if name in x:
            return ("cast", kind, value(x[name]))
    for name in PARTS:
        if name in x:
            inner = x[name]
            return ("part", name, ("literal", "datetime", inner) if isinstance(inner, str) else value(inner))
    raise ValueError(f"Unknown value: {sorted(x)}")


def step(text: str) -> tuple[str, tuple[int | None, ...]]:
    """A name and its indexes; None for `[]`."""
    m = re.fullmatch(r"([^\[\]]*)((?:\[[^\[\]]*\])*)", text)
    if not m:
        raise ValueError(f"Malformed path step: {text}")
    indexes = re.findall(r"\[([^\[\]]*)\]", m[2])
    if bad := next((i for i in indexes if i and not i.isdigit()), None):
        raise ValueError(f"Index must be a number: [{bad}]")
    return m[1], tuple(int(i) if i else None for i in indexes)


def path(text: str) -> tuple[str, tuple, tuple]:
    """(root, path steps of an element, attribute steps) of a field identifier."""
    root, _, attributes = text.partition("#")
    kind, _, names = root.partition(".")
    if kind not in ("$aas", "$sm", "$sme", "$cd", "$aasdesc", "$smdesc"):
        raise ValueError(f"Unknown root: {kind}")
    return kind, tuple(map(step, names.split("."))) if names else (), tuple(map(step, attributes.split("."))) if attributes else ()


@dataclass
class Operand:
    """One side of a comparison: many values or one, of a fixed type or, for what a document holds, of the type that kind says.

    Where has is false, a plain value (single) stands for the many.
    """

    column: Column
    type: str
    many: bool = False
    kind: Column | None = None
    single: Column | None = None
    has: Column | None = None

    def cast(self, f, to: str) -> Operand:
        if not self.many:
            return Operand(f(self.column), to)
        return Operand(F.transform(self.column, f), to, True, None, None if self.single is None else f(self.single), self.has)


@dataclass
class Formula:
    """A condition as a column over the variables that it uses, and the conditions that it is made of ($and, $or, $not)."""

    kind: str
    column: Column
    used: set[str]
    parts: list[Formula] = field(default_factory=list)


@dataclass
class Compiler:
    graph: Graph
    semantics: str
    variables: dict = field(default_factory=dict)
    #: The $match that a path with `[]` is correlated in, of those variables that are; and the columns of the list items that such a $match has in common.
    scopes: dict = field(default_factory=dict)
    ties: dict = field(default_factory=dict)

    def variable(self, root: str, steps: tuple, scope: dict | None) -> str:
        """Name of the variable of a root: one for a named path, one for each use or $match of a bare element."""
        if root == "$sme" and not steps:
            name = None if scope is None else scope.get("anchor")
            if name is None:
                name = f"any{sum(n.startswith('any') for n in self.variables)}"
                if scope is not None:
                    scope["anchor"] = name
        else:
            match = None
            if self.semantics == "spec" and scope is not None and root == "$sme" and any(i is None for _, at in steps for i in at):
                match = scope.setdefault("number", len({*self.scopes.values()}))
            name = next((n for n, k in self.variables.items() if k == (root, steps) and self.scopes.get(n) == match), None) or (f"v_{root[1:]}" if root != "$sme" else f"sme{len(self.variables)}")
            if match is not None:
                self.scopes[name] = match
                for depth, prefix in self.items(steps):
                    self.ties.setdefault((match, prefix), f"item{len(self.ties)}")
        self.variables[name] = (root, steps)
        return name

    @staticmethod
    def flat(steps: tuple) -> tuple[tuple, tuple]:
        """Names and indexes of a path, one of each for every level of elements."""
        names, indexes = [], []
        for n, at in steps:
            names += [n] + [None] * len(at)
            indexes += [None] + list(at)
        return tuple(names), tuple(indexes)

    def items(self, steps: tuple) -> list[tuple[int, tuple]]:
        """(depth, path down to there) of each `[]` of a path."""
        names, indexes = self.flat(steps)
        return [(k + 1, (names[: k + 1], indexes[: k + 1])) for k, n in enumerate(names) if n is None and indexes[k] is None]

    def tied(self, name: str) -> dict[str, int]:
        """Of a correlated variable, the columns of its list items and their depths."""
        return {self.ties[self.scopes[name], prefix]: depth for depth, prefix in self.items(self.variables[name][1])} if name in self.scopes else {}

    def field(self, name: str, root: str, attributes: tuple) -> Operand:
        at = lambda c: F.col(f"{name}.{c}")
        if not attributes:
            raise ValueError("Path ends on a node: no comparable property")
        (first, index), rest = attributes[0], attributes[1:]
        plain = {"$aas": {"id", "idShort"}, "$sm": {"id", "idShort", "kind"}, "$cd": {"id", "idShort"}, "$sme": {"idShort", "valueType", "entityType", "globalAssetId"}}.get(root, {"id", "idShort"})
        if first == "assetInformation" and root == "$aas" and not rest:
            raise ValueError("Path ends on a node: no comparable property")
        if first == "assetInformation" and root == "$aas":
            (first, index), rest = rest[0], rest[1:]
            plain = {"assetKind", "assetType", "globalAssetId"}
        if first in plain and not rest:
            return Operand(at(first), "str")
        if first == "value" and root == "$sme" and not rest:
            return Operand(F.transform(at("texts"), lambda x: x["text"]), "any", True, F.coalesce(at("kind"), F.lit("s")), at("value"), at("texts").isNotNull())
        if first == "language" and root == "$sme" and not rest:
            return Operand(F.transform(at("texts"), lambda x: x["language"]), "str", True)
        if first == "semanticId" and root in ("$sme", "$sm"):
            return Operand(first_key(at("semantic")), "str") if not rest else self.keys(at("semantic"), rest)
        if first == "specificAssetIds" and root == "$aas" and rest:
            one = index and index[0] is not None
            pick = lambda f: Operand(f(F.get(at("specific"), F.lit(index[0]))), "str") if one else Operand(F.transform(at("specific"), f), "str", True)
            if rest[0][0] in ("name", "value") and len(rest) == 1:
                return pick(lambda x: x[rest[0][0]])
            if rest[0][0] == "externalSubjectId" and len(rest) > 1:
                return pick(lambda x: self.keys(x["externalSubject"], rest[1:]).column)
        if first == "submodels" and root == "$aas" and rest:
            if index and index[0] is not None and self.semantics == "spec":
                return self.keys(F.get(at("submodels"), F.lit(index[0])), rest)
            # a shell's references carry no index in stored documents, so that a numbered one never matches
            refs = at("submodels") if not index or index[0] is None else F.filter(at("submodels"), lambda x: F.lit(False))
            each = F.transform(refs, lambda x: self.keys(x, rest).column)
            return Operand(F.flatten(each) if rest[0] == ("keys", (None,)) else each, "str", True)
        if first in ("assetInformation", "semanticId", "specificAssetIds", "submodels", "externalSubjectId"):
            raise ValueError("Path ends on a node: no comparable property")
        raise ValueError(f"Unknown attribute element: {first}")

    def keys(self, ref: Column, steps: tuple) -> Operand:
        (first, index), rest = steps[0], steps[1:]
        if first == "type" and not rest:
            return Operand(ref["type"], "str")
        if first == "keys" and index and len(rest) == 1 and rest[0][0] in ("value", "type"):
            if index[0] is not None:
                return Operand(F.get(ref["keys"], F.lit(index[0]))[rest[0][0]], "str")
            # any key; stored documents have no values below a reference, so that nothing is known of them
            return Operand(F.transform(ref["keys"], lambda k: k[rest[0][0]]) if self.semantics == "spec" else F.array(F.lit(None).cast("string")), "str", True)
        raise ValueError("keys needs an index and one of value or type" if first == "keys" else f"Unknown attribute element: {first}")

    def operand(self, x: tuple, scope: dict | None) -> tuple[Operand, set[str]]:
        if x[0] == "field":
            _, root, steps, attributes = x
            name = self.variable(root, steps, scope)
            return self.field(name, root, attributes), {name}
        if x[0] == "literal":
            made = {"datetime": to_datetime, "time": to_seconds}.get(x[1], lambda c: c)(F.lit(x[2]) if x[1] != "num" else F.lit(float(x[2])))
            return Operand(made, x[1]), set()
        inner, used = self.operand(x[2], scope)
        if x[0] == "part":
            moment = inner if inner.type == "datetime" else inner.cast(to_datetime, "datetime")
            return moment.cast(lambda c: PARTS[x[1]](c).cast("double"), "num"), used
        if inner.type == x[1]:
            return inner, used
        f = {"str": lambda c: c.cast("string"), "num": to_number, "hex": to_hex, "bool": to_boolean, "datetime": to_datetime, "time": to_seconds}[x[1]]
        return inner.cast(f, "str" if x[1] == "hex" else x[1]), used

    def compare(self, op: str, a: Operand, b: Operand) -> Column:
        if b.many and not a.many and op in SWAPPED:
            return self.compare(SWAPPED[op], b, a)
        if a.many and b.many:
            return F.lit(False)  # elements of one list are held against the other list as a whole
        held, meet = (b, lambda v: self.one(op, a, a.column, b, v)) if b.many else (a, lambda v: self.one(op, a, v, b, b.column))
        if not held.many:
            return meet(a.column)
        some = F.exists(held.column, meet)
        return some if held.single is None else F.when(held.has, some).otherwise(meet(held.single))

    def one(self, op: str, a: Operand, x: Column, b: Operand, y: Column) -> Column:
        """x op y, false or unknown across types as the language has it."""
        if a.type == b.type == "any":
            return F.when(a.kind == b.kind, self.apply(op, x, y)).otherwise(self.mixed(op))
        if b.type == "any":
            return self.one_any(op, b, y, a, x, True)
        if a.type == "any":
            return self.one_any(op, a, x, b, y, False)
        return self.apply(op, x, y) if a.type == b.type else self.mixed(op)

    def one_any(self, op: str, held: Operand, x: Column, other: Operand, y: Column, swapped: bool) -> Column:
        read = {"num": to_number, "bool": to_boolean, "datetime": to_datetime, "time": to_seconds}.get(other.type, lambda c: c)
        hit = self.apply(op, y, read(x)) if swapped else self.apply(op, read(x), y)
        if self.semantics == "spec":
            return hit
        kinds = {"num": "n", "bool": "b", "str": "s"}
        return F.when(held.kind == kinds[other.type], hit).otherwise(self.mixed(op)) if other.type in kinds else self.mixed(op)

    @staticmethod
    def mixed(op: str) -> Column:
        """What comparing a string with a number, say, gives."""
        return F.lit(False) if op == "=" else F.lit(True) if op == "<>" else F.lit(None).cast("boolean")

    @staticmethod
    def apply(op: str, x: Column, y: Column) -> Column:
        if op == "regex":
            return F.rlike(x, F.concat(F.lit("\\A(?:"), y, F.lit(")\\z")))
        if op in ("contains", "startswith", "endswith"):
            return getattr(F, op)(x, y)
        return {"=": x == y, "<>": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]

    def expression(self, x: tuple, scope: dict | None = None) -> Formula:
        if x[0] in ("$and", "$or", "$match"):
            inner = {} if x[0] == "$match" else scope
            parts = [self.expression(y, inner) for y in x[1]]
            return Formula("$or" if x[0] == "$or" else "$and", reduce(Column.__or__ if x[0] == "$or" else Column.__and__, [p.column for p in parts]), set().union(*(p.used for p in parts)), parts)
        if x[0] == "$not":
            inner = self.expression(x[1], scope)
            return Formula("$not", ~inner.column, inner.used, [inner])
        (a, u), (b, v) = self.operand(x[1], scope), self.operand(x[2], scope)
        return Formula("", self.compare(COMPARE[x[0]], a, b), u | v)

    def conjuncts(self, x: tuple, scope: dict | None = None) -> list[Formula]:
        if x[0] in ("$and", "$match"):
            inner = {} if x[0] == "$match" else scope
            return [c for y in x[1] for c in self.conjuncts(y, inner)]
        return [self.expression(x, scope)]

    def owners(self, lot: set[str], formulas: list[Formula]) -> DataFrame | None:
        """The submodels (sm) whose elements satisfy formulas over several variables, from one scan: a bit for each part over one variable, or-ed for each submodel, and the formulas over bits.

        None where a variable stands in more than one part: these have to hold for one element.
        """
        if any(self.variables[v][0] != "$sme" or v in self.scopes for v in lot):
            return None
        bits: list[tuple[str, Column]] = []

        def over(f: Formula, negated: bool) -> Column:
            if len(f.used) == 1:
                bits.append((next(iter(f.used)), ~f.column if negated else f.column))
                return F.col(f"bit{len(bits) - 1}")
            if not f.used:
                return ~f.column if negated else f.column
            if not f.parts:
                raise LookupError  # a comparison of two variables
            if f.kind == "$not":
                return over(f.parts[0], not negated)
            either = (f.kind == "$or") != negated
            return reduce(Column.__or__ if either else Column.__and__, [over(p, negated) for p in f.parts])

        try:
            whole = reduce(Column.__and__, [over(f, False) for f in formulas])
        except LookupError:
            return None
        if len({v for v, _ in bits}) < len(bits):
            return None
        names = sorted(lot)
        scanned = self.graph.elements.filter(reduce(Column.__or__, [self.at_path(v, "") for v in names])).select(F.col("submodel_id").alias("sm"), *(F.struct("*").alias(v) for v in names))
        some = lambda c, alias: F.bool_or(F.coalesce(c, F.lit(False))).alias(alias)
        held = scanned.groupBy("sm").agg(*(some(self.at_path(v, f"{v}.") & c, f"bit{i}") for i, (v, c) in enumerate(bits)), *(some(self.at_path(v, f"{v}."), f"there_{v}") for v in names))
        there = [F.col(f"there_{v}") for v in names] if self.semantics == "reference" else []
        return reduce(DataFrame.filter, [*there, whole], held).select("sm")

    def at_path(self, name: str, prefix: str) -> Column:
        """Whether an element, whose columns have a prefix, stands at the path of an element variable."""
        at = lambda c: F.col(f"{prefix}{c}")
        names, indexes = self.flat(self.variables[name][1])
        if not names:
            return F.forall(at("rels"), lambda r: r.isin(*ANY_DEPTH))
        tests = [F.size(at("names")) == len(names)]
        for k, (n, i) in enumerate(zip(names, indexes, strict=True)):
            rel = F.get(at("rels"), F.lit(k))
            tests.append(rel == ("submodelElements" if k == 0 else "value") if self.semantics == "reference" or k == 0 else rel.isin(*ANY_DEPTH))
            # a place asks for a child of a list, whether that has a name or not
            tests.append(F.get(at("names"), F.lit(k)) == n if n is not None else F.get(at("indexes"), F.lit(k)).isNotNull())
            if i is not None:
                tests.append(F.get(at("indexes"), F.lit(k)) == i)
        return reduce(Column.__and__, tests)

    def rows(self, name: str) -> DataFrame:
        """The rows of a variable: an owner id and the variable's columns as one struct."""
        root, steps = self.variables[name]
        if root != "$sme":
            table = {"$aas": self.graph.shells, "$sm": self.graph.submodels, "$cd": self.graph.concepts}.get(root)
            table = table if table is not None else shaped(self.graph.submodels, SHELL if root == "$aasdesc" else SUBMODEL).filter("false")
            return table.select(F.col("id").alias("owner"), F.struct("*").alias(name))
        places = [F.get("ancestors", F.lit(depth)).alias(c) if depth < len(self.flat(steps)[0]) else F.col("node_id").alias(c) for c, depth in self.tied(name).items()]
        return self.graph.elements.filter(self.at_path(name, "")).select(F.col("submodel_id").alias("owner"), F.struct("*").alias(name), *places)


def compile_query(query: str | dict, graph: Graph, target: str | None = None, semantics: str = "reference") -> DataFrame:
    """The shells, submodels or concepts (`target`, else in this order of preference) that a query selects, as rows of their table; with $select, their ids."""
    select, tree = parse(query)
    c = Compiler(graph, semantics)
    conjuncts = c.conjuncts(tree)
    kinds = {c.variables[v][0] for v in c.variables}
    roots = {"aas": bool(kinds & {"$aas", "$aasdesc"}), "sm": bool(kinds & {"$sm", "$smdesc", "$sme"}), "cd": "$cd" in kinds}
    target = target or next((r for r in ("aas", "sm", "cd") if roots[r]), "sm")
    if target not in roots or not (roots[target] or (target in ("aas", "sm") and (roots["aas"] or roots["sm"]))):
        raise ValueError(f"Target {target} is not bound by the query")
    # variables that one conjunct ties together share a join
    lots: list[set[str]] = [{v} for v in c.variables]
    for used in [f.used for f in conjuncts] + [{v for v in c.scopes if tie in c.tied(v)} for tie in c.ties.values()]:
        joined = [lot for lot in lots if lot & used]
        if len(joined) > 1:
            lots = [lot for lot in lots if lot not in joined] + [set().union(*joined)]
    owner = lambda v: "aas" if c.variables[v][0] in ("$aas", "$aasdesc") else "cd" if c.variables[v][0] == "$cd" else "sm"
    sides: dict[tuple[str, ...], list[DataFrame]] = {}
    constant = [f.column for f in conjuncts if not f.used]
    for lot in lots:
        owners = tuple(sorted({owner(v) for v in lot}))
        mine = [f for f in conjuncts if f.used and f.used <= lot]
        if len(lot) > 1 and (once := c.owners(lot, mine)) is not None:
            sides.setdefault(owners, []).append(once)
            continue
        frames = {}
        for v in sorted(lot):
            rows = reduce(DataFrame.filter, [f.column for f in mine if f.used == {v}], c.rows(v))
            o = owner(v)
            rows = rows.withColumnRenamed("owner", o)
            # variables of one $match meet on the list items that they have in common
            frames[o] = rows if o not in frames else frames[o].join(rows, [o, *(t for t in c.tied(v) if t in frames[o].columns)], "inner" if semantics == "reference" else "full")
        joined = reduce(lambda a, b: a.crossJoin(b), frames.values()) if "cd" in frames or len(frames) < 2 else frames["aas"].join(graph.bridge.withColumnsRenamed({"aas_id": "aas", "sm_id": "sm"}), "aas").join(frames["sm"], "sm")
        # an outer join brings back rows that one variable's own conditions have dropped
        joined = reduce(DataFrame.filter, [f.column for f in mine if len(f.used) > 1 or semantics != "reference" and len(lot) > 1], joined)
        sides.setdefault(owners, []).append(joined.select(*owners).distinct())
    singles = {o[0]: reduce(lambda a, b: a.join(b, a.columns[0], "left_semi"), dfs) for o, dfs in sides.items() if len(o) == 1}
    pairs = [df for o, dfs in sides.items() if len(o) > 1 for df in dfs]
    for df in pairs:
        for o in df.columns:
            if o in singles:
                df = df.join(singles[o], o, "left_semi")
        for o in df.columns:
            singles[o] = df.select(o).distinct()
    tied = any({"aas", "sm"} <= set(df.columns) for df in pairs)
    other = {"aas": "sm", "sm": "aas"}.get(target)
    if other in singles and not tied or target not in singles:
        bridge = graph.bridge.withColumnsRenamed({"aas_id": "aas", "sm_id": "sm"})
        found = bridge.join(singles[other], other, "left_semi").select(target).distinct()
        singles[target] = found.join(singles[target], target, "left_semi") if target in singles else found
    ids = singles[target]
    if target != "cd" and "cd" in singles and not any("cd" in df.columns for df in pairs):
        ids = ids.join(singles["cd"].limit(1).select(F.lit(True).alias("_there")), F.lit(True), "left_semi")
    ids = reduce(DataFrame.filter, constant, ids)
    if select == "id":
        return ids.select(F.col(target).alias("id"))
    table = {"aas": graph.shells, "sm": graph.submodels, "cd": graph.concepts}[target]
    return table.join(ids.select(F.col(target).alias("id")), "id", "left_semi")


def explain(query: str | dict, graph: Graph, target: str | None = None) -> str:
    """The plan of a query, as text."""
    return compile_query(query, graph, target)._jdf.queryExecution().toString()
