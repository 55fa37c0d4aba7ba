"""How far the sources of a language differ in their words: DuckDB counts in shards, Spark merges.

Terms are hashed with their language into shards. Tasks count the terms of their rows for each source and send each shard one packed Arrow table a chunk.
DuckDB adds these up, shard by shard, and keeps the terms in at least `least_docs` rows of the language. In a second pass over what was kept it sums, again in
SQL within a shard, for each pair of sources of a term; Spark adds up the shards' sums and ranks.

A pair's value runs over all kept terms, those that neither source has as well. With p what a source gives a term and z what it gives one that it lacks, the sum over all terms is that
of f(p, p') - f(p, z') - f(z, p') + f(z, z') over the terms that both have, the sums of f(p, z') over the terms of the one and of the other (from a histogram of p), and
f(z, z') times the number of all terms less those of each. So only sources that share a term meet on it.

Nothing is broadcast but tables whose counted rows are small; a shard holds about SHARD_BYTES of text's distinct terms, however often they occur, and spills in DuckDB beyond its memory.
A hot source or term is counted before it is sent, so it costs a row a chunk.

Cases: null text, lang and source are ''; a row is a document, repeated or not; a group of rows without terms has all kept terms with count 0; a language without kept terms
gives pairs of value 0 and no term rows; a language of one source gives no pairs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import contextlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.session import ship

from .common import frugal, small, stored
from .words import CHUNK_BYTES, Words, as_bytes, fold, slices

LEAST_DOCS, TOP = 10, 10
#: Characters between terms.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
#: Bytes of text a shard stands for, the fewest shards, and what DuckDB may hold of one before it spills.
SHARD_BYTES, LEAST_SHARDS, DUCKDB_MEMORY = 64_000_000, 48, "400MB"
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
KEPT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
SUMS = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("p", pa.int64()), ("value", pa.int64())])

KEEP_SQL = """
WITH c AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(d) AS d FROM counts GROUP BY ALL),
    k AS (SELECT *, sum(d) OVER w AS docs, min(source) OVER w AS least FROM c WINDOW w AS (PARTITION BY lang, term))
SELECT $shard::INTEGER AS shard, lang, source, term, n, (source = least)::BIGINT AS first FROM k WHERE docs >= $least_docs
"""
#: p is the group's own, z that of an absent term, q the language's.
RATES_SQL = """
CREATE OR REPLACE TABLE rates AS SELECT lang, source, term, (1 + 1000000000::HUGEINT * (n + 2) // (size + 2 * terms))::BIGINT AS p, 1 + 2000000000 // (size + 2 * terms) AS z,
    (1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2) // (whole + 2 * terms))::BIGINT AS q FROM kept
"""
SUMS_SQL = """
SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS p, sum(f(a.p, b.p) - f(a.p, b.z) - f(a.z, b.p) + f(a.z, b.z))::BIGINT AS value
FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 'rate', lang, source, NULL, p, count(*) FROM rates GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, 0, f(p, q) AS v FROM rates WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY v DESC, term) <= $top
"""


def hashes(strings: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings.to_pylist()), np.uint64, len(strings))


def counted(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """For each (group, term) of texts that stand in groups: group, term, its hash, occurrences and texts."""
    words = Words(b"\n".join(texts))
    owner, size = words.piece(), max(len(words.dictionary), 1)
    each, n = np.unique(owner * size + words.codes, return_counts=True)
    keys, place = np.unique(groups[each // size] * size + each % size, return_inverse=True)
    sums = [np.bincount(place, w, len(keys)).astype(np.int64) for w in (n, None)]
    return keys // size, words.dictionary.take(pa.array(keys % size)), hashes(words.dictionary)[keys % size], *sums


def count_terms(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, counts): packed COUNTS of a chunk's rows (lang, source, text) in each shard."""
    table = fold(APART)

    def rows_of(langs: list, sources: list, texts: list[bytes]) -> tuple[pa.Table, np.ndarray]:
        """COUNTS of texts, and the hash of each row's language and term. Texts of a chunk go together, a longer one by itself in slices."""
        names = sorted({*zip(langs, sources, strict=True)})
        number = {x: i for i, x in enumerate(names)}
        lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        group, of_lang = np.array([number[x] for x in zip(langs, sources, strict=True)], np.int64), hashes(lang) * np.uint64(0x9E3779B97F4A7C15)

        def tabled(g, term, n, d):
            return pa.Table.from_arrays([lang.take(pa.array(g)), source.take(pa.array(g)), term, pa.array(n), pa.array(d)], schema=COUNTS)

        if len(texts) > 1 or len(texts[0]) <= 2 * CHUNK_BYTES:
            g, term, mark, n, d = counted(texts, group)
            return tabled(g, term, n, d), mark + of_lang[g]
        parts = pa.concat_tables(tabled(g, term, n, d) for g, term, _, n, d in (counted([part], group) for part, _ in slices(texts[0])))
        summed = parts.group_by(["lang", "source", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "source", "term", "n"])
        return summed.append_column("d", pa.array(np.ones(len(summed), np.int64))).cast(COUNTS), hashes(summed["term"]) + of_lang[0]

    def packed(rows: pa.Table, mark: np.ndarray) -> pa.RecordBatch:
        """A row for each shard that occurs in rows."""
        shard = (mark % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        rows, cuts = rows.take(pa.array(order)), np.searchsorted(shard[order], np.arange(shards + 1))
        rows = rows.set_column(0, "lang", rows["lang"].dictionary_encode()).set_column(1, "source", rows["source"].dictionary_encode()).combine_chunks()
        there, out = np.flatnonzero(np.diff(cuts)), []
        for s in there:
            part = rows.slice(cuts[s], cuts[s + 1] - cuts[s])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
                stream.write_table(part)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(out, pa.binary())], names=["shard", "counts"])

    def run(batches):
        langs, sources, texts, size = [], [], [], 0

        def flush():
            nonlocal size
            if texts:
                rows, mark = rows_of(langs, sources, texts)
                if len(rows):
                    yield packed(rows, mark)
            for x in (langs, sources, texts):
                x.clear()
            size = 0

        for batch in batches:
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                if size and size + len(text) > 4 * CHUNK_BYTES:
                    yield from flush()
                langs.append(a)
                sources.append(b)
                texts.append(text.translate(table))
                size += len(text)
        yield from flush()

    return docs.mapInArrow(frugal(run), "shard int, counts binary")


@contextlib.contextmanager
def shard_database():
    """An in-memory DuckDB of one thread that spills to a folder of its own, which goes with it."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder:
        db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
        db.execute("CREATE MACRO f(p, q) AS (p - q) * (p - q) // (p + q)")
        try:
            yield db
        finally:
            db.close()


def by_shard(batches, schema: pa.Schema, work):
    """Batches of what work(db, shard, batches of its rows) selects, for each run of equal shards in sorted batches, one after the other."""
    import itertools

    def runs():
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(shard[a]), batch.slice(int(a), int(b - a))

    with shard_database() as db:
        for shard, parts in itertools.groupby(runs(), key=lambda x: x[0]):
            for batch in work(db, shard, (part for _, part in parts)).to_arrow_reader(50_000):
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(batch.columns, schema.types, strict=True)], schema=schema)


def keep_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """KEPT: occurrences in each source of the terms in at least least_docs rows of their language; `first` is 1 on one row of each."""

    def work(db, shard, parts):
        db.execute("CREATE OR REPLACE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT)")
        for part in parts:
            more = pa.concat_tables(pa.ipc.open_stream(x).read_all().cast(COUNTS) for x in part.column(1).to_pylist())  # noqa: F841
            db.execute("INSERT INTO counts SELECT * FROM more")
        return db.sql(KEEP_SQL, params={"shard": shard, "least_docs": least_docs})

    def run(batches):
        yield from by_shard(batches, KEPT, work)

    return counts.repartition("shard").sortWithinPartitions("shard").mapInArrow(frugal(run), "shard int, lang string, source string, term string, n long, first long")


def shard_sums(kept: DataFrame, top: int) -> DataFrame:
    """SUMS of rows (shard, lang, source, term, n, size, whole, terms): of pairs over shared terms, of terms a rate, and the top terms."""

    def work(db, shard, parts):
        for k, part in enumerate(parts):
            more = pa.Table.from_batches([part])  # noqa: F841
            db.execute("CREATE OR REPLACE TABLE kept AS SELECT * FROM more" if not k else "INSERT INTO kept SELECT * FROM more")
        db.execute(RATES_SQL)
        return db.sql(SUMS_SQL, params={"top": top})

    def run(batches):
        yield from by_shard(batches, SUMS, work)

    return kept.repartition("shard").sortWithinPartitions("shard").mapInArrow(frugal(run), "kind string, lang string, source string, item string, p long, value long")


def f(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language all others by divergence (`pair`), and its `top` own terms against the language (`term`)."""
    ship(docs.sparkSession)
    read = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    whole = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kept = stored(keep_terms(count_terms(read, max(LEAST_SHARDS, -(-whole // SHARD_BYTES))), least_docs))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first").alias("firsts"))
    occurring = read.select("lang", "source").distinct().join(own, ["lang", "source"], "left").fillna(0, ["size", "firsts"])
    of_lang = occurring.groupBy("lang").agg(F.sum("size").alias("whole"), F.sum("firsts").alias("terms"))
    groups = stored(occurring.drop("firsts").join(of_lang, "lang"))
    sized = small(groups, groups.count())
    sums = stored(shard_sums(kept.join(sized, ["lang", "source"]).select("shard", "lang", "source", "term", "n", "size", "whole", "terms"), top))

    # of a group and every other of its language
    rates = sums.filter("kind = 'rate'").groupBy("lang", "source", "p").agg(F.sum("value").alias("k"))
    zeros = groups.select("lang", "source", "terms", F.expr("CASE WHEN terms > 0 THEN 1 + 2000000000 div (size + 2 * terms) ELSE 1 END").alias("z"))
    other = zeros.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    small_other = small(other, groups.count())
    alone = rates.join(small_other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * f("p", "y")).alias("alone"), F.sum("k").alias("held"))
    shared = sums.filter("kind = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("shared"))
    both = lambda df, *values: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), *values))
    parts = [both(shared, "shared").withColumnRenamed("shared", "v"), both(alone, "alone", "held").withColumnRenamed("alone", "v")]
    added = parts[0].withColumn("held", F.lit(0).cast("long")).unionByName(parts[1]).groupBy("lang", "source", "item").agg(F.sum("v").alias("v"), F.sum("held").alias("held"))
    pairs = zeros.join(small_other, "lang").filter("source <> item").join(added, ["lang", "source", "item"], "left")
    absent = F.when(F.col("terms") > 0, (F.col("terms") - F.coalesce("held", F.lit(0))) * f("z", "y")).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("v", F.lit(0)) + absent).cast("long").alias("value"))
    terms = sums.filter("kind = 'term'").select("lang", "source", F.col("kind").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
