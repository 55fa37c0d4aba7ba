"""Phrases whose words stand together more often than apart, by hashed counting (PCY/DHP) with Apriori pruning.

Pass k scans the texts once. It counts exactly those phrases of k words that two bitmaps let through: the buckets that phrases of k words filled at least `least` times, which the pass
before has counted, and the marks of the frequent phrases of k - 1 words, in which both of its parts must be (Apriori). On the way it counts phrases of k + 1 words whose parts were
let through into BUCKETS hash buckets for the next pass. Bitmaps only spare work: every phrase that occurs `least` times passes all of them, and what passes is counted by its words.

A bitmap takes BUCKETS bits, however large the corpus. Bucket counts leave a task in ranges, no higher than `least` (a byte each, or only those that are not 0), and are added up range
by range. Phrases leave a task counted for each chunk, so a hot phrase costs a row a chunk. Everything else is joins and groups on (language, phrase); a language's best phrases are cut
to `top` in each task before they meet.

Cases: null text is empty, null language `und`; repeated rows count as often as they stand there; phrases cross no piece and no text; a text of any length goes in slices that overlap by
three words; pieces shorter than a phrase give none of it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.session import ship

from .common import frugal, stored
from .shingles import mix
from .words import CHUNK_BYTES, Words, as_bytes, fold, slices

LEAST, TOP, COVER, LONGEST = 30, 2000, 80, 4
#: Characters between words, and between pieces.
APART, BREAKS = r"[\x20\x09]", r"[.,;:!?\x0A-\x0D]"
#: Hash buckets, and those of one range; both powers of two.
BUCKETS, RANGE = 1 << 24, 1 << 14
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PASS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("hash", pa.int64()), ("n", pa.int64()), ("range", pa.int32()), ("counts", pa.binary())])
PASS_DDL = "lang string, phrase string, hash long, n long, range int, counts binary"


def hashes(strings: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))


def marked(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the bucket of each hash is set in a packed bitmap."""
    bucket = hashed & np.uint64(BUCKETS - 1)
    return (bits[bucket >> np.uint64(3)] >> (np.uint8(7) - (bucket & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def ranges(counts: np.ndarray, least: int):
    """(range, payload) of each range with counts: no higher than least, all of them or places and counts of those that are not 0."""
    kind = np.uint8 if least < 256 else np.uint32
    full = np.flatnonzero(counts.reshape(-1, RANGE).any(axis=1))
    for r in full.tolist():
        part = np.minimum(counts[r * RANGE : (r + 1) * RANGE], least).astype(kind)
        places = np.flatnonzero(part)
        sparse = len(places) * (2 + part.itemsize) < part.nbytes
        yield r, b"\1" + places.astype(np.uint16).tobytes() + part[places].tobytes() if sparse else b"\0" + part.tobytes()


def bitmap(df: DataFrame, least: int) -> np.ndarray:
    """The buckets with at least least, packed, of rows (range, counts)."""
    kind = np.dtype(np.uint8 if least < 256 else np.uint32)

    def run(batches):
        at, total = None, None

        def done():
            return pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

        for batch in batches:
            for r, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != at:
                    if at is not None:
                        yield done()
                    at, total = r, np.zeros(RANGE, np.int64)
                if payload[0]:
                    n = (len(payload) - 1) // (2 + kind.itemsize)
                    total[np.frombuffer(payload, np.uint16, n, 1)] += np.frombuffer(payload, kind, n, 1 + 2 * n)
                else:
                    total += np.frombuffer(payload, kind, RANGE, 1)
        if at is not None:
            yield done()

    found = df.filter("range IS NOT NULL").select("range", "counts").repartition("range").sortWithinPartitions("range").mapInArrow(run, "range int, bits binary")
    bits = np.zeros(BUCKETS // 8, np.uint8)
    for r in found.collect():  # BUCKETS bits at most
        bits[r["range"] * RANGE // 8 : (r["range"] + 1) * RANGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def marks(frequent: DataFrame) -> DataFrame:
    """(range, counts) with a 1 for the bucket of each row's hash."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.uint8)
        for batch in batches:
            counts[batch.column(0).to_numpy().view(np.uint64) & np.uint64(BUCKETS - 1)] = 1
        for r, payload in ranges(counts, 1):
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "counts": pa.array([payload], pa.binary())})

    return frequent.select("hash").mapInArrow(frugal(run), "range int, counts binary")


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of codes, column by column: the place of the first row of each kind, and how many there are."""
    ids = parts[0]
    for more in parts[1:]:
        ids = pa.array(ids << 32 | more).dictionary_encode().indices.to_numpy().astype(np.int64)
    kinds, first, n = np.unique(ids, return_index=True, return_counts=True)
    return first, n


def chunk_counts(chunk: bytes, own: int, seed: np.uint64, k: int, bits: np.ndarray | None, parts: np.ndarray | None, buckets: np.ndarray | None):
    """(phrases, hashes, counts) of k words of a folded chunk that start in its first `own` bytes; phrases of k + 1 words are added to buckets."""
    words = Words(chunk)
    n = len(words)
    if n < k:
        return [], EMPTY, EMPTY
    piece, mine = words.piece(), words.starts < own
    hashed = [hashes(words.dictionary.to_pylist())[words.codes] + seed]
    for j in range(1, k + (buckets is not None)):
        hashed.append(mix(hashed[-1][: n - j] * FACTOR + hashed[0][j:]) if n > j else EMPTY.view(np.uint64))
    whole = lambda m: piece[: n - m + 1] == piece[m - 1 :]
    alive = whole(k)
    if k > 1:
        lower = marked(parts, hashed[k - 2])
        alive &= lower[:-1] & lower[1:]
        alive[alive] = marked(bits, hashed[k - 1][alive])
    if buckets is not None and n > k:
        longer = alive[:-1] & alive[1:] & whole(k + 1) & mine[: n - k]
        np.add.at(buckets, (hashed[k][longer] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
    at = np.flatnonzero(alive & mine[: n - k + 1])
    if not len(at):
        return [], EMPTY, EMPTY
    first, count = distinct([words.codes[at + j] for j in range(k)])
    first = at[first]
    texts = [words.dictionary.take(pa.array(words.codes[first + j])) for j in range(k)]
    return pc.binary_join_element_wise(*texts, " "), hashed[k - 1][first].view(np.int64), count


EMPTY = np.zeros(0, np.int64)


def count_pass(docs: DataFrame, k: int, bits: np.ndarray | None, parts: np.ndarray | None, least: int, longest: int) -> DataFrame:
    """PASS rows: phrases of k words with their counts in a chunk, and the ranges of a task's bucket counts of phrases of k + 1 words."""
    table, sent = fold(APART, BREAKS), docs.sparkSession.sparkContext.broadcast((bits, parts))

    def run(batches):
        buckets = np.zeros(BUCKETS, np.uint32) if k < longest else None
        waiting: dict[str, list[bytes]] = {}

        def counted(lang, chunk, own):
            phrases, hashed, n = chunk_counts(chunk, own, hashes([lang])[0], k, *sent.value, buckets)
            if len(n):
                none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int8))), phrases, pa.array(hashed), pa.array(n.astype(np.int64)), *none], schema=PASS)

        def flush(lang):
            chunk = b"\n".join(waiting.pop(lang))
            yield from counted(lang, chunk, len(chunk))

        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                folded = text.translate(table)
                if len(folded) > CHUNK_BYTES:
                    for part, own in slices(folded, reach=longest - 1):
                        yield from counted(lang, part, own)
                    continue
                if waiting.get(lang) and sizes[lang] + len(folded) > CHUNK_BYTES:
                    yield from flush(lang)
                waiting.setdefault(lang, []).append(folded)
                sizes[lang] = sum(map(len, waiting[lang])) if len(waiting[lang]) == 1 else sizes[lang] + len(folded)
                if sum(sizes[x] for x in waiting) > 4 * CHUNK_BYTES:  # of many languages
                    yield from flush(max(waiting, key=sizes.get))
        for lang in list(waiting):
            yield from flush(lang)
        if buckets is not None:
            for r, payload in ranges(buckets, least):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, PASS.types[0]), pa.nulls(1, PASS.types[1]), *(pa.nulls(1, pa.int64()),) * 2, pa.array([r], pa.int32()), pa.array([payload], pa.binary())], schema=PASS)

    return docs.mapInArrow(frugal(run), PASS_DDL)


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """(lang, phrase, hash, n) of the phrases of 1, 2, ... longest words of docs (lang, text) that occur least times, and all words of each language."""
    found, bits, parts, words = [], None, None, None
    for k in range(1, longest + 1):
        counts = stored(count_pass(docs, k, bits, parts, least, longest))
        phrases = counts.filter("range IS NULL").groupBy("lang", "phrase").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))
        words = words if words is not None else counts.filter("range IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
        found.append(stored(phrases.filter(F.col("n") >= least)))
        if k < longest:
            bits, parts = bitmap(counts, least), bitmap(marks(found[-1]), 1)
    return found, words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, cover: int = COVER, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words by score, without those that longer ones cover."""
    ship(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found, words = frequent_phrases(read, least, longest)
    part = lambda at, size: F.array_join(F.slice("words", at, size), " ")

    def sized(k: int) -> DataFrame:
        return found[k - 1].withColumn("words", F.split("phrase", " "))

    # longer phrases cover what lies within them
    within = [sized(k).select("lang", "n", F.explode(F.array(*(part(at, m) for m in range(2, k) for at in range(1, k - m + 2)))).alias("phrase")) for k in range(3, longest + 1)]
    covers = reduce(DataFrame.union, within).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = lambda k: F.array(*(F.struct(F.lit(at).alias("cut"), F.lit(side).alias("side"), text.alias("part")) for at in range(1, k) for side, text in (("l", part(1, at)), ("r", part(at + 1, k - at)))))
    candidates = reduce(DataFrame.union, [sized(k).select("lang", "phrase", F.col("n").alias("a"), cuts(k).alias("cuts")) for k in range(2, longest + 1)])
    free = candidates.join(covers, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * exact("most") < cover * exact("a")))
    halves = free.select("lang", "phrase", "a", F.inline("cuts")).join(reduce(DataFrame.union, found[:-1]).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    scored = halves.groupBy("lang", "phrase", "a", "cut").agg(side("l"), side("r"))
    score = F.expr("(cast(a AS decimal(19,0)) * 2000000) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
