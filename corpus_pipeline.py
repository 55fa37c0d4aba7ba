"""Corpus preparation: the stages run one after the other, each over all rows that its predecessor kept.

Columns of the table keep their values whatever they are called: those that a stage does not read travel through it in one struct. Rows are told apart
by their id and the hash of their text, not by their id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import decontaminate, language, mixing, ngram_join, secrets
from twinframe.llm.common import held_out, small, stored, table


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that a stage reads, and all others in `row`."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    return docs.select(*read, F.struct(*(others or [F.lit(None).alias("none")])).alias("row"))


def unpacked(docs: DataFrame, *read: str) -> list[Column]:
    """The columns of docs, from a table that packed made of it."""
    return [F.col(f"`{c}`") if c in read else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without text or without a letter go."""
    found = language.identify_language(packed(docs, "text"), docs.filter(~held_out("doc_id")))
    return found.filter("lang_pred <> 'und'").select(*unpacked(docs, "text"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, then the smallest hash of its text; of rows that are alike in both, that of the smallest hash of its other columns as JSON.

    Rows whose text has no words stay. Columns of any type keep their values: none is ordered.
    """
    rows = stored(ngram_join.jaccard_components(docs, with_component=True).filter("component IS NOT NULL").select("doc_id", "hash", "component"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("first"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")))
    gone = stored(rows.join(first, "component").filter(other).select("doc_id", "hash").distinct())
    again = stored(rows.groupBy("doc_id", "hash").count().filter("count > 1").select("doc_id", "hash"))
    marked = packed(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text"))

    def those(side: DataFrame, how: str, of: DataFrame) -> DataFrame:
        side = small(side, side.count())
        return of.join(side, of["doc_id"].eqNullSafe(side["doc_id"]) & (of["hash"] == side["hash"]), how)

    kept = those(gone, "left_anti", marked)
    if again.limit(1).count():
        alike = those(again, "left_semi", kept).withColumn("order", F.xxhash64(F.to_json("row")))
        repeated = alike.groupBy("doc_id", "hash").agg(*(F.min_by(c, "order").alias(c) for c in ("text", "row")))
        kept = those(again, "left_anti", kept).select("doc_id", "text", "row").union(repeated.select("doc_id", "text", "row"))
    return kept.select(*unpacked(docs, "doc_id", "text"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark has not contaminated."""
    found = decontaminate.decontaminate(packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.filter("NOT contaminated").select(*unpacked(docs, "text"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars, where there is such a column, follows."""
    read = [c for c in ("text", "n_chars") if c in docs.columns]
    masked = secrets.redact(secrets.find_secrets(packed(docs, *read)))
    if "n_chars" in read:
        changed = F.when(F.size("secret_spans") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        masked = masked.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return masked.select(*unpacked(docs, *read))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes words from, and how many (repeats counted)."""
    return mixing.mix_sources(docs).filter("taken > 0").select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("decontaminate", clean), ("secrets", mask), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else stored(docs)
    return docs
