"""Benchmark decontamination by Wu-Manber multi-pattern search.

A test item's windows of `window` consecutive words (the whole item, if shorter) are the patterns, searched in texts
whose words are joined by single spaces. For each class of pattern lengths, a shift table over blocks of bytes tells how far the search may
jump; where it may not, the bucket of that suffix block holds the patterns to compare byte by byte.

Documents are only scanned: no shuffle, while the patterns of all items come from at most PATTERN_BYTES of text. A larger benchmark, its distinct pieces
of at most PIECE_WORDS words dealt into blocks by their hash, takes a scan of the texts for each block, which writes what it hits and nothing else; the
hits are then joined to the documents by the hash of their text. So no driver and no worker holds more than the patterns of one block.

Cases: null texts and texts without words have no words and no hits; a repeated item counts once; items of null id still
hit but are not listed; an empty benchmark hits nothing; an empty table gives no rows; columns of the results' names are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.session import ship

from .common import add_columns, cut, frugal, small, stored, utf8

WINDOW = 13
#: Bytes of benchmark text whose patterns are searched for at a time (compiled, they take about 200 times as much), and words of a piece.
PATTERN_BYTES, PIECE_WORDS = 1_000_000, 10_000
#: Every byte as it counts in a word: capitals A-Z as small letters, what belongs to no word as a space.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
FIELDS = [("n_words", "long", pa.int64()), ("n_hit", "long", pa.int64()), ("items", "array<string>", pa.list_(pa.string()))]
HITS = "key binary, bits binary, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split() if text else []


class Patterns:
    """Shift tables and buckets of one class of lengths (least to twice as many bytes)."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.b = b = max(2, min(8, m // 3))
        self.far = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for q in range(b, m + 1):
                block = p[q - b : q]
                self.shift[block] = min(self.shift.get(block, self.far), m - q)
            self.bucket[p[m - b : m]].append(p)

    def search(self, text: bytes):
        """(start, pattern) of every occurrence."""
        at, end, m, b, far, get = self.m, len(text), self.m, self.b, self.far, self.shift.get
        while at <= end:
            jump = get(text[at - b : at], far)
            if jump:
                at += jump
                continue
            for p in self.bucket[text[at - b : at]]:
                if text.startswith(p, at - m):
                    yield at - m, p
            at += 1


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """(piece, ids): distinct stretches of the words of items (id, text) that hold all their windows, and the items they come from."""

    def cut_up(texts):
        out = []
        for text in texts:
            words = words_of(text)
            starts = range(0, max(len(words) - window, 0) + 1, PIECE_WORDS) if words else ()
            out.append([b" ".join(words[i : i + PIECE_WORDS + window - 1]).decode("utf-8", "surrogatepass") for i in starts])
        return [out]

    cut_items = add_columns(items, [("pieces", "array<string>", pa.list_(pa.string()))], cut_up, "text")
    return cut_items.select("id", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def compile_pieces(pieces: list[tuple[str, list[str]]], window: int) -> tuple[list[Patterns], dict[bytes, tuple[int, frozenset[str]]]]:
    """The searchers, and for each pattern its number of words and its items."""
    found: dict[bytes, tuple[int, frozenset[str]]] = {}
    for piece, ids in pieces:
        words, own = utf8(piece).split(), frozenset(ids)
        for i in range(max(len(words) - window, 0) + 1):
            part = words[i : i + window]
            pattern = b" " + b" ".join(part) + b" "
            known = found.get(pattern)
            found[pattern] = (len(part), own if known is None or known[1] <= own else known[1] | own)
    classes = defaultdict(list)
    for p in found:
        classes[len(p).bit_length()].append(p)
    return [Patterns(ps) for _, ps in sorted(classes.items())], found


def hits_in(words: list[bytes], compiled) -> tuple[np.ndarray, frozenset[str]] | None:
    """Which of the words lie in an occurrence of a pattern, and the items of those patterns."""
    searchers, known = compiled
    padded = b" " + b" ".join(words) + b" "
    found = [hit for s in searchers for hit in s.search(padded)] if words else []
    if not found:
        return None
    starts = np.flatnonzero(np.frombuffer(padded, np.uint8)[:-1] == 32)  # of the space before each word
    edges = np.zeros(len(words) + 1, np.int64)
    first = np.searchsorted(starts, [at for at, _ in found])
    np.add.at(edges, first, 1)
    np.add.at(edges, first + np.array([known[p][0] for _, p in found]), -1)
    return np.cumsum(edges[:-1]) > 0, frozenset().union(*{known[p][1] for _, p in found})


def scan(docs: DataFrame, pieces: list, text_col: str, window: int) -> DataFrame:
    """docs with FIELDS."""
    compiled = docs.sparkSession.sparkContext.broadcast(compile_pieces(pieces, window))

    def work(texts):
        out = [[], [], []]
        for text in texts:
            words = words_of(text)
            hits = hits_in(words, compiled.value)
            for column, x in zip(out, (len(words), int(hits[0].sum()) if hits else 0, sorted(hits[1]) if hits else []), strict=True):
                column.append(x)
        return out

    return add_columns(docs, FIELDS, work, text_col)


def hit_texts(texts: DataFrame, pieces: list, window: int) -> DataFrame:
    """HITS of each text (text) in which a pattern occurs, keyed by its hash."""
    compiled = texts.sparkSession.sparkContext.broadcast(compile_pieces(pieces, window))
    schema = pa.schema([("key", pa.binary()), ("bits", pa.binary()), ("items", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                hits = hits_in(words_of(text), compiled.value)
                if hits:
                    rows.append({"key": hashlib.sha256(utf8(text)).digest(), "bits": np.packbits(hits[0]).tobytes(), "items": sorted(hits[1])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.mapInArrow(frugal(run), HITS).dropDuplicates(["key"])


def scan_in_blocks(docs: DataFrame, pieces: DataFrame, blocks: int, text_col: str, window: int) -> DataFrame:
    """docs with FIELDS, a block of pieces at a time."""
    ship(docs.sparkSession)
    texts, hits = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL"), []
    for k in range(blocks):
        part = pieces.filter(F.pmod(F.xxhash64("piece"), F.lit(blocks)) == k).collect()
        if part:
            hits.append(stored(hit_texts(texts, [tuple(r) for r in part], window)))
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    # one row of a text for each block at most
    by_text = every.groupBy("key").agg(F.collect_list("bits").alias("bits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def count(texts_bits):
        return [[int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits])).sum()) for bits in texts_bits]]

    by_text = cut(add_columns(by_text, [("n_hit", "long", pa.int64())], count, "bits").drop("bits"))
    names = [name for name, _, _ in FIELDS]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in names or c == text_col))
    keyed = docs.select(F.unhex(F.sha2(F.col(f"`{text_col}`"), 256)).alias("key"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    joined = keyed.join(small(by_text, by_text.count()), "key", "left")
    joined = add_columns(joined, [("n_words", "long", pa.int64())], lambda texts: [[len(words_of(t)) for t in texts]], "text")
    return joined.select("row.*", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least_share: int = 20, block_bytes: int = PATTERN_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids with an occurring window) and contaminated (at least 1 / least_share of its words hit)."""
    items = benchmark.select(F.col(item_id_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    pieces = cut(pieces_of(items, window))
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    found = scan(docs, [tuple(r) for r in pieces.collect()], text_col, window) if blocks == 1 else scan_in_blocks(docs, pieces, blocks, text_col, window)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
