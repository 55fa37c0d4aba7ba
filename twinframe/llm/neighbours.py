"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors form one node, which keeps its KEEP smallest ids: no answer needs more of them. The graph starts from neighbours within small
blocks of nodes that lie side by side in the order of random projections (equal runs of a global sort, so no dense region makes a large one); of a large
table they know only few true neighbours. Then each round joins every node's neighbours, forward and backward, with their vectors and
compares the neighbours of a node with one another, unless both were there when the round before did so. Each node keeps the nearest it has met. Rounds end when one
changes at most `settled` of all entries. Searches start at a node's own neighbours and expand the best candidates not yet expanded, all
queries in step, until none is left among the best `beam`.

Scale: a round moves about 2 k rounded vectors a node and what beats the worst entry of its list; nothing is held for all nodes anywhere. A much-linked
node passes on its k nearest back links only, and lists that reach it are merged as they come. Candidates are chosen by vectors rounded to half precision under
each vector's own power of two, in double arithmetic; scores are exact. Tests and README give recall before and after the rounds.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than most; ties go to
the smaller id; repeated rows of an id count once, and one with several vectors is as near as the nearest of them; with fewer candidates than k, all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.session import ship

from .common import add_columns, cut


class Sizes(NamedTuple):
    """Neighbours of a node; the most a node learns from one comparison; share of entries that the last round changes at most; random projections, planes of
    each whose sides come first in its order, nodes of a block; candidates of a query, and how many it expands a round."""

    k: int = 32
    learned: int = 12
    settled: float = 0.05
    projections: int = 6
    planes: int = 4
    block: int = 512
    beam: int = 256
    expanded: int = 64


SIZES = Sizes()
KEEP = 11
#: Entries that a task merges at a time.
MERGED = 400_000
GRAPH = "node long, nbrs array<long>, dists array<double>, fresh array<boolean>"
FOUND = "node long, known boolean, nbrs array<long>, dists array<double>"


def packed(kind: str):
    """Of vectors, their components as bytes of a numpy kind; null where one takes no part. Negative zero is zero."""

    def pack(vectors):
        out = []
        for v in vectors:
            a = np.array([np.nan if x is None else x for x in v or ()], kind)
            out.append((a + a.dtype.type(0)).tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
        return [out]

    return pack


def rounded(kind: str):
    """Of packed vectors, components as half-precision numbers under a power of two, whose exponent comes last."""

    def turn(vectors):
        out = []
        for v in vectors:
            a = np.frombuffer(v, kind).astype(np.float64)
            e = int(np.frexp(np.abs(a).max())[1])
            out.append(np.ldexp(a, -e).astype(np.float16).tobytes() + np.int16(e).tobytes())
        return [out]

    return turn


def matrix(column: list[bytes]) -> np.ndarray:
    """Rounded vectors as rows."""
    raw = np.frombuffer(b"".join(column), np.float16).reshape(len(column), -1)
    return np.ldexp(raw[:, :-1].astype(np.float64), raw[:, -1].copy().view(np.int16).astype(np.int32)[:, None])


def distances(v: np.ndarray) -> np.ndarray:
    """Distances of all rows of v."""
    most = np.abs(v).max(1)
    if most.max() < 1e150 and most.min() > 1e-150:
        square = (v * v).sum(1)
        return np.sqrt(np.maximum(square[:, None] + square[None] - 2 * v @ v.T, 0))
    return np.stack([exact(v, row[None]) for row in v])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a from those of b in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = a - b
        most = np.abs(apart).max(1)
        dist = np.sqrt((apart**2).sum(1))
        odd = np.isfinite(most) & ((most > 1e150) | ((most < 1e-150) & (most > 0)))
        if odd.any():  # squares that no double holds
            dist[odd] = most[odd] * np.sqrt(((apart[odd] / most[odd, None]) ** 2).sum(1))
    return dist


def runs(batches, key, *names):
    """Rows that follow one another with the same key."""
    last, held = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (key, *names)), strict=True):
            if held and k != last:
                yield last, held
                held = []
            last = k
            held.append(row)
    if held:
        yield last, held


def nearest(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ids and their distances: those with a finite one to another id, how many each one gets (k at most), and these ids and distances row by row."""
    d[ids[:, None] == ids[None]] = np.inf
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], ids[:0], d[0, :0]
    best = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(d, best, 1)
    there = np.isfinite(near)
    counts = there.sum(1)
    some = counts > 0
    return ids[some], counts[some], ids[best[there]], near[there]


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def gathered(parts, size: int = 200_000):
    """Batches of FOUND from what nearest gives."""
    held, total = [], 0

    def batch():
        node, counts, nbrs, dists = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.zeros(len(node), bool)), lists(counts, pa.array(nbrs)), lists(counts, pa.array(dists))], names=["node", "known", "nbrs", "dists"])

    for part in parts:
        held.append(part)
        total += len(part[2])
        if total > size:
            yield batch()
            held, total = [], 0
    if total:
        yield batch()


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all that the rows of a node list; fresh marks those that its known row lacks."""

    def best(node, ids, dists, known):
        """The k nearest of each node; of one pair's measurements the least, so that lists only improve and rounds come to an end."""
        order = np.lexsort((dists, ids, node))
        node, ids, dists, known = node[order], ids[order], dists[order], known[order]
        head = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])]))
        known = np.maximum.reduceat(known, head)
        node, ids, dists = node[head], ids[head], dists[head]
        order = np.lexsort((ids, dists, node))
        node, ids, dists, known = node[order], ids[order], dists[order], known[order]
        rank = np.arange(len(node)) - np.searchsorted(node, node)
        return tuple(x[rank < k] for x in (node, ids, dists, known))

    def out(node, ids, dists, known):
        names, counts = np.unique(node, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names), lists(counts, pa.array(ids)), lists(counts, pa.array(dists)), lists(counts, pa.array(~known))], names=["node", "nbrs", "dists", "fresh"])

    def merge(batches):
        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            nbrs = batch.column(2)
            counts = np.diff(nbrs.offsets.to_numpy())
            held.append((np.repeat(batch.column(0).to_numpy(), counts), nbrs.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(zero_copy_only=False), counts)))
            total += len(held[-1][0])
            if total > MERGED:
                node, *rest = best(*(np.concatenate(x) for x in zip(*held, strict=True)))
                # the last node may go on in the next batch
                done = node < node[-1]
                if done.any():
                    yield out(*(x[done] for x in (node, *rest)))
                held = [tuple(x[~done] for x in (node, *rest))]
                total = len(held[0][0])
        if total:
            yield out(*best(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return found.repartition("node").sortWithinPartitions("node").mapInArrow(merge, GRAPH)


def first_graph(nodes: DataFrame, count: int, width: int, seed: int, sizes: Sizes = SIZES) -> DataFrame:
    """Neighbours of nodes (node, coarse) within blocks."""
    planes = np.random.default_rng(seed).normal(size=(sizes.projections, sizes.planes + 1, width))

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1).to_pylist())
            for r in range(sizes.projections):
                at = v @ planes[r].T
                side = ((at[:, 1:] > 0) << np.arange(sizes.planes)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), r, np.int64)), pa.array(side.astype(np.int64)), pa.array(at[:, 0]), *batch.columns], names=["r", "side", "at", "node", "coarse"])

    def block(batches):
        def parts():
            held, last = [], None
            for batch in batches:
                for r, node, coarse in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                    # a block ends with its projection; what the last full one leaves stays with it
                    if held and (r != last or len(held) >= 2 * sizes.block):
                        cutoff = len(held) if r != last else sizes.block
                        yield from compared(held[:cutoff])
                        held = held[cutoff:]
                    last = r
                    held.append((node, coarse))
            yield from compared(held)

        def compared(lot):
            for part in np.array_split(np.arange(len(lot)), max(1, round(len(lot) / sizes.block))):
                if len(part) > 1:
                    v = matrix([lot[i][1] for i in part])
                    yield nearest(np.array([lot[i][0] for i in part]), distances(v), sizes.k)

        return gathered(parts())

    dealt = nodes.mapInArrow(project, "r long, side long, at double, node long, coarse binary")
    tasks = max(1, count * sizes.projections // (32 * sizes.block))
    return best_of(dealt.repartitionByRange(tasks, "r", "side", "at", "node").sortWithinPartitions("r", "side", "at", "node").mapInArrow(block, FOUND), sizes.k)


def descend(graph: DataFrame, nodes: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """One round: neighbours of a node meet each other."""
    edges = graph.select("node", F.explode(F.arrays_zip("nbrs", "dists", "fresh")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist"), F.col("e.fresh").alias("fresh"))
    back = edges.withColumn("rank", F.row_number().over(Window.partitionBy("nbr").orderBy("dist", "node"))).filter(F.col("rank") <= sizes.k)
    around = edges.select(F.col("node").alias("hub"), F.struct(F.col("nbr").alias("member"), "fresh").alias("m")).union(back.select(F.col("nbr").alias("hub"), F.struct(F.col("node").alias("member"), "fresh").alias("m")))
    # at most 2 k members a hub; where none is fresh, all of them have met
    hubs = around.groupBy("hub").agg(F.collect_set("m").alias("members")).filter(F.exists("members", lambda m: m["fresh"]))
    far = F.when(F.size("dists") >= sizes.k, F.array_max("dists")).otherwise(F.lit(float("inf")))
    vectors = nodes.join(graph.select("node", far.alias("far")), "node", "left").select(F.col("node").alias("member"), "coarse", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    met = hubs.select("hub", F.inline("members")).join(vectors, "member").select("hub", "member", "fresh", "far", "coarse").repartition("hub").sortWithinPartitions("hub")

    def meet(batches):
        def parts():
            for _, lot in runs(batches, "hub", "member", "fresh", "far", "coarse"):
                v, fresh = matrix([x[3] for x in lot]), np.array([x[1] for x in lot])
                d = distances(v)
                d[~(fresh[:, None] | fresh[None]) | (d >= np.array([x[2] for x in lot])[:, None])] = np.inf
                yield nearest(np.array([x[0] for x in lot]), d, sizes.learned)

        return gathered(parts())

    return best_of(graph.select("node", F.lit(True).alias("known"), "nbrs", "dists").union(met.mapInArrow(meet, FOUND)), sizes.k)


def settle(graph: DataFrame, nodes: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """Rounds until few entries change."""
    while True:
        graph = cut(descend(graph, nodes, sizes))
        entries = graph.agg(F.sum(F.size("nbrs")).alias("n"), F.sum(F.size(F.filter("fresh", lambda x: x))).alias("fresh")).first()
        if not entries["n"] or entries["fresh"] <= sizes.settled * entries["n"]:
            return graph


def flat(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """Packed vectors of one length as rows, without a copy of each."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1).astype(np.float64)


def measured(pairs: DataFrame, kind: str) -> DataFrame:
    """(q, cand, dist) of pairs (q, cand, va, vb)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                dist = exact(flat(batch.column(2), kind), flat(batch.column(3), kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dist)], names=["q", "cand", "dist"])

    return pairs.select("q", "cand", "va", "vb").mapInArrow(run, "q long, cand long, dist double")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, kind: str, sizes: Sizes = SIZES) -> DataFrame:
    """(q, cand, dist): the `beam` nearest nodes that greedy search finds from each node q of queries."""
    hop = graph.select("node", F.explode("nbrs").alias("cand"))
    asked = queries.join(nodes.withColumnRenamed("node", "q"), "q").select("q", F.col("vec").alias("va"))
    state, fresh = None, hop.join(queries, hop.node == queries.q).select("q", "cand").distinct()
    by_distance = Window.partitionBy("q").orderBy("dist", "cand")
    while True:
        met = measured(fresh.join(nodes.select(F.col("node").alias("cand"), F.col("vec").alias("vb")), "cand").join(asked, "q"), kind).withColumn("done", F.lit(False))
        best = (met if state is None else state.union(met)).withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= sizes.beam)
        turn = F.sum(F.when(F.col("done"), 0).otherwise(1)).over(by_distance)
        state = cut(best.select("q", "cand", "dist", "done", (~F.col("done") & (turn <= sizes.expanded)).alias("go")))
        going = state.filter("go")
        if not going.limit(1).count():
            return state.select("q", "cand", "dist")
        reached = going.select("q", F.col("cand").alias("node")).join(hop, "node").filter("q <> cand").select("q", "cand").distinct()
        fresh = reached.join(state.select("q", "cand"), ["q", "cand"], "left_anti")
        state = state.select("q", "cand", "dist", (F.col("done") | F.col("go")).alias("done"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, seed: int = 11, sizes: Sizes = SIZES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of queries (query_id) the k nearest other rows of vectors found."""
    ship(vectors.sparkSession)
    kind = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    read = add_columns(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), [("vec", "binary", pa.binary())], packed(kind), "vector").drop("vector")
    read = cut(read.filter("vec IS NOT NULL AND id IS NOT NULL"))
    lengths = read.groupBy(F.length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bytes").first()
    usual = lengths["bytes"] if lengths else 8
    keep = max(KEEP, k + 1)
    rows = read.filter(F.length("vec") == usual).withColumn("place", F.row_number().over(Window.partitionBy(F.sha2("vec", 256)).orderBy("id"))).filter(F.col("place") <= keep + k)
    nodes_all = cut(rows.groupBy("vec").agg(F.slice(F.sort_array(F.collect_set("id")), 1, keep).alias("ids")).withColumn("node", F.col("ids")[0]))
    nodes, count = nodes_all.select("node", "vec"), nodes_all.count()
    coarse = cut(add_columns(nodes, [("coarse", "binary", pa.binary())], rounded(kind), "vec").drop("vec"))
    graph = settle(cut(first_graph(coarse, count, usual // int(kind[1]), seed, sizes)), coarse, sizes)
    asked = cut(read.filter(F.length("vec") == usual).join(queries.select(F.col("query_id").alias("id")).distinct(), "id").distinct().join(nodes_all.select("vec", "node"), "vec").select(F.col("id").alias("query_id"), F.col("node").alias("q")))
    found = search(graph, nodes, asked.select("q").distinct(), kind, sizes)
    same = asked.select("q").distinct().select("q", F.col("q").alias("cand"), F.lit(0.0).alias("dist"))
    spread = asked.join(found.union(same), "q").join(nodes_all.select(F.col("node").alias("cand"), "ids"), "cand").select("query_id", "dist", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("dist").alias("dist"))
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("dist").alias("score"))
