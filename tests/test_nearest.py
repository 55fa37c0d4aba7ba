"""The kNN search for every fiftieth id, and in blocks of queries, held against brute force."""

import numpy as np

from twinframe import queries
from twinframe.operators import tools


def brute(vectors, asked, k=5):
    square = lambda q, i: round(float(((vectors[q] - vectors[i]) ** 2).sum()), 6)
    return {(q, rank, i) for q in asked for rank, (_, i) in enumerate(sorted((square(q, i), i) for i in range(len(vectors)) if i != q)[:k], 1)}


def test_every_fiftieth_id_is_asked(spark, tmp_path):
    vectors = np.random.default_rng(4).integers(-9, 10, (260, 6)).astype(float)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["knn_fields"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == brute(vectors, range(0, 260, 50)) and len(got) == 30


def test_more_queries_than_a_block(spark):
    vectors = np.random.default_rng(5).integers(-99, 100, (1100, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    got = tools.nearest_fields(df, df.selectExpr("id AS query_id", "embedding AS query")).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == brute(vectors, range(1100)) and len(got) == 5500


def test_against_all_pairs_over_many_batches(spark):
    import random

    rng = random.Random(5)
    vectors = [(i, [float(rng.randrange(3)) for _ in range(6)]) for i in range(400)] + [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 6), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(vectors, "id long, embedding array<double>").repartition(5)
    asked = {i: v for i, v in vectors[:40]}
    queries = spark.createDataFrame([(i, v) for i, v in asked.items()] + [(-1, None), (-2, [0.0])], "query_id long, query array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r["query_id"], r["rank"]): (r["distance"], r["id"]) for r in tools.nearest_fields(table, queries, 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = {}
    for q, v in asked.items():
        pairs = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in vectors[:400] if i != q)
        want |= {(q, n): p for n, p in enumerate(pairs[:5], 1)}
    assert found == want
    assert [(r["query_id"], r["id"]) for r in tools.nearest_fields(table, queries.filter("query_id < 0"), 5).collect()] == [(-2, 1001)]
    assert tools.nearest_fields(table, queries.filter("query_id = -1"), 5).count() == 0


def test_pairs_are_compared_in_tiles():
    import resource

    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    rng = np.random.default_rng(6)
    queries, rows = rng.normal(size=(40_000, 4)), rng.normal(size=(4000, 4))
    run = tools.best_of(list(range(-1, -40_001, -1)), queries, 5, _parse_datatype_string("query_id long, id long, distance double"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = pa.Table.from_batches(run([batch]))
    # all pairs at once would take 1 280 MB
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000 and found.num_rows == 200_000
    for q in (0, 1023, 1024, 39_999):
        want = sorted((round(float(((queries[q] - v) ** 2).sum()), 6), i) for i, v in enumerate(rows))[:5]
        assert [(d, i) for n, i, d in zip(*(c.to_pylist() for c in found.columns), strict=True) if n == -1 - q] == want
