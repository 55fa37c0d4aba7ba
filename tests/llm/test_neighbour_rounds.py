"""NN-descent itself: blocks that hold a small share of the nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import neighbours
from twinframe.llm.common import cut

SMALL = neighbours.Sizes(k=16, learned=8, settled=0.02, projections=2, block=40, beam=64, expanded=16)


def brute(vectors, k):
    d = neighbours.distances(vectors)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k]


@pytest.mark.parametrize("n", [1000, 4000])
def test_rounds_find_what_blocks_do_not(spark, n, monkeypatch):
    """At 25 and 100 blocks: the first graph, each round's graph and the answers."""
    width = 24
    vectors = np.random.default_rng(12).normal(size=(n, width)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
    want, recalls, whole = brute(vectors.astype(float), 10), [], neighbours.descend

    def recall(found):
        return sum(len(set(ids) & set(want[q].tolist())) for q, ids in found) / (10 * len(found))

    def descend(graph, nodes, sizes):
        recalls.append(recall([(r["node"], r["nbrs"][:10]) for r in graph.collect()]))
        return whole(graph, nodes, sizes)

    monkeypatch.setattr(neighbours, "descend", descend)
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    got = {}
    for r in neighbours.nearest_neighbours(df, asked, sizes=SMALL).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert recalls[0] < 0.5 and recalls[-1] > recalls[0] + 0.15 and len(recalls) > 2
    assert len(got) == n // 20 and recall(list(got.items())) >= 0.9


def test_large_and_small_vectors(spark):
    """Components whose squares no single, or no double, holds; answers stay exact."""
    rng = np.random.default_rng(13)
    vectors = np.concatenate([rng.normal(size=(40, 5)) * 10.0**e for e in (-160, 0, 25, 170)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest_neighbours(df, df.selectExpr("vec_id AS query_id")).collect()
    assert len(rows) == 1600 and all(np.isfinite(r["score"]) for r in rows)
    for q in (5, 45, 85, 125):
        scale = np.abs(vectors[q]).max()
        with np.errstate(over="ignore"):
            d = scale * np.sqrt((((vectors - vectors[q]) / scale) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert np.allclose([s for _, _, s in mine], np.sort(d)[:10], rtol=1e-12)


def test_only_fresh_entries_meet(spark):
    vectors = np.random.default_rng(14).normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(vectors)], "node long, vec binary")
    nodes = cut(neighbours.add_columns(df, [("coarse", "binary", neighbours.pa.binary())], neighbours.rounded("f4"), "vec").drop("vec"))
    first = cut(neighbours.first_graph(nodes, 300, 8, 11, SMALL))
    assert all(all(r["fresh"]) for r in first.collect())
    known = first.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
    same = {r["node"]: r["nbrs"] for r in neighbours.descend(known, nodes, SMALL).collect()}
    assert same == {r["node"]: r["nbrs"] for r in first.collect()}


def test_exact_measure():
    a, b = np.array([[3.0, 0.0], [1e200, 0.0], [-1.5e308, 1.0]]), np.array([[0.0, 4.0], [0.0, 0.0], [1.5e308, 1.0]])
    with np.errstate(over="ignore"):
        assert neighbours.exact(a, b).tolist() == [5.0, 1e200, float("inf")]
