"""The pipeline on a small corpus, stage by stage against what each one has to keep."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from twinframe.llm.common import stored


def test_pipeline(spark, tmp_path):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    clean = [(i, text(40), "en", f"s{i % 4}", 5) for i in range(60)]
    near = [(100 + i, clean[i][1] + " tail", "en", "s1", 5) for i in range(5)]
    same = [(200, clean[7][1].upper(), "en", "s2", 5), (3, clean[3][1], "en", "s3", 5)]
    dirty = [(300, f"{text(10)} {item} {text(10)}", "en", "s0", 5), (301, text(700) + " " + item, "en", "s0", 5)]
    secret = [(400, f"{text(20)} password = hunter2222 {text(20)}", None, None, 5)]
    none = [(500, None, "en", "s0", 0), (501, "12 34 !!", "en", "s0", 8), (502, "", None, None, 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    other = [(2, text(40), "en", "s1", 5)]  # an id with two texts
    docs = [*clean, *near, *same, *dirty, *secret, *none, *other]
    mine = {"score": 0.123, "items": "mine", "n_words": "w", "secret_spans": "s", "row": "r", "hash": "h", "component": "c"}
    spark.createDataFrame(docs, columns).withColumns({k: F.lit(v) for k, v in mine.items()}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)))
        kept[name] = now.collect()
        assert name == "mix" or now.columns == [*(c.split()[0] for c in columns.split(", ")), *mine]
        assert name == "mix" or all(r[k] == v for r in kept[name] for k, v in mine.items())
    ids = lambda name: sorted(r["doc_id"] for r in kept[name])
    assert ids("language") == sorted(d[0] for d in docs if d not in none)
    assert ids("near_duplicates") == sorted(d[0] for d in [*clean, *dirty, *secret, *other])
    assert ids("decontaminate") == ids("secrets") == sorted([d[0] for d in [*clean, *secret, *other]] + [301])
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept["secrets"]}
    assert all(texts[d[0]] == (d[1], 5) for d in clean if d[0] != 2)
    assert sorted(r["text"] for r in kept["secrets"] if r["doc_id"] == 2) == sorted([clean[2][1], other[0][1]])
    assert "hunter" not in texts[400][0] and "[SECRET]" in texts[400][0] and texts[400][1] == len(texts[400][0])
    assert set(ids("mix")) <= set(ids("secrets")) and all(0 < r["taken"] <= 2 * r["size"] for r in kept["mix"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(whole) == sorted(kept["mix"])


def test_empty_table(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_with_columns_that_have_no_order(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, {"a": "1", "b": "2"}, ["x"], (1, {"k": 1})), (1, words, {"a": "1"}, ["y"], (2, {})), (1, words, None, None, None), (2, words, {"z": "1"}, [], None), (3, "other words here", {}, [], None), (3, "other words here", {}, [], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, props map<string,string>, tags array<string>, inner struct<n:int,m:map<string,int>>")
    found = [sorted(map(str, corpus_pipeline.deduplicate(spark, docs.repartition(n), str(tmp_path)).collect())) for n in (1, 3)]
    assert found[0] == found[1] and len(found[0]) == 2 and any("doc_id=3" in r for r in found[0])
    assert corpus_pipeline.mask(spark, docs, str(tmp_path)).columns == docs.columns
