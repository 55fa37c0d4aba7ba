"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of its labelled text. A text is parsed greedily into the longest phrases that occur in a
language's text; the language whose phrases cost fewest bits (their number times the log of the labelled text's length, less the log of
the language's share of labelled rows, which decides between a few phrases) wins.
Many texts are walked through the automata at once, one character a step, as gathers from one transition table.

Every label is learned. Of each, DOCUMENTS rows at most are chosen by the hash of their id, and stretches from the start to the end of their texts make up
REFERENCE_CHARS characters; with more than REFERENCE_TOTAL / REFERENCE_CHARS labels the text of each gets shorter, down to LEAST_CHARS. Only these texts are broadcast. The tables
walked, 2 * CLASSES * 4 bytes for each character, are built by the workers for BLOCK_CHARS of labelled text at a time: once, if that is all, else anew for
each batch of texts, each block's costs adding to the one before. Prediction is a scan without a shuffle.

Cases: null texts and texts without a letter get `und` with score 0, as does every text if nothing is labelled; equal costs go to the language with
more labelled rows, then by code point; texts are cut into segments of SEGMENT characters whose phrases add up, so length costs no memory;
repeated rows get equal results; of rows with one id, the text of one is learned; an empty table gives no rows; columns of the results' names are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, pieces

DOCUMENTS, REFERENCE_CHARS, REFERENCE_TOTAL, LEAST_CHARS = 64, 12_000, 240_000, 1_000
BLOCK_CHARS = 240_000
#: Stretches of a text that are learned, from evenly spread places.
STRETCHES = 3
#: Character classes: 0 is everything but letters, 1 rare letters, the rest a letter each.
CLASSES = 64
SEGMENT, CHUNK = 512, 500_000
FIELDS = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, tuple[int, str]]:
    """For each language its number of labelled rows and text of a bounded sample of them."""
    labels = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("hash"), F.col(text_col).alias("text")).filter("lang IS NOT NULL")
    # a language's least hash in each of DOCUMENTS buckets: no row is ranked against others, and repeated ids count once
    chosen = labels.groupBy("lang", F.pmod("hash", F.lit(DOCUMENTS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("hash")).collect()
    if not chosen:
        return {}
    counts, documents = Counter(), Counter()
    for r in chosen:
        counts[r["lang"]] += r["n"]
        documents[r["lang"]] += 1
    chars = max(LEAST_CHARS, min(REFERENCE_CHARS, REFERENCE_TOTAL // len(counts)))
    picked = labelled.sparkSession.createDataFrame([(r["lang"], r["hash"], max(30, 2 * chars // documents[r["lang"]] // STRETCHES)) for r in chosen], "lang string, hash long, each int")
    size, each = F.char_length("text"), F.col("each")
    parts = [F.substring("text", F.lit(1) + F.floor(F.greatest(size - each, F.lit(0)) * k / (STRETCHES - 1)).cast("int"), each) for k in range(STRETCHES)]
    stretches = F.when(size <= STRETCHES * each, F.col("text")).otherwise(F.concat_ws("\n", *(p for p in parts)))
    # the table of chosen rows has DOCUMENTS rows a language at most
    read = labels.join(F.broadcast(picked), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min(stretches).alias("text")).collect()
    texts: dict[str, list] = {lang: [] for lang in counts}
    for r in sorted(read, key=lambda r: r["hash"]):
        if r["text"]:
            texts[r["lang"]].append(r["text"])
    return {lang: (n, "\n".join(texts[lang])[:chars]) for lang, n in counts.items() if texts[lang]}


def class_table(texts: list[str]) -> np.ndarray:
    """The class of each code point."""
    letters = Counter(c for t in texts for c in t.lower() if c.isalpha())
    table = np.fromiter((1 if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint8, 0x110000)
    for k, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: CLASSES - 2]):
        table[ord(c)] = k + 2
    return table


def classes_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts' characters, runs of non-letters as one, and the end of each text among them."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = table[codes]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != 0) | (kinds[:-1] != 0)
    ends = np.cumsum([len(t) for t in lower])
    starts = ends - [len(t) for t in lower]
    keep[starts[starts < ends]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return kinds[keep], total[ends]


def suffix_automaton(string: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton for all substrings; state 0 is the start."""
    after: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in string.tolist():
        new = len(after)
        after.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                split = len(after)
                after.append(dict(after[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = split
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = split
                    p = link[p]
        last = new
    return after


class CrossParser:
    """Phrase counts of texts against each language's text."""

    def __init__(self, texts: dict[str, tuple[int, str]], letters: np.ndarray | None = None, rows: int | None = None):
        self.langs = ranked(texts)
        self.letters = class_table([texts[lang][1] for lang in self.langs]) if letters is None else letters
        everything = rows or sum(n for n, _ in texts.values())
        rows, roots, bits = [], [], []
        for lang in self.langs:
            string, _ = classes_of([texts[lang][1]], self.letters)
            after, base = suffix_automaton(string), sum(map(len, rows))
            # an entry holds the row's place that comes next, and how many phrases end with this character
            step = np.full((len(after), CLASSES), -1, np.int64)
            for state, moves in enumerate(after):
                for c, to in moves.items():
                    step[state, c] = (base + to) * CLASSES << 2
            root = step[0].copy()
            fresh = np.where(root >= 0, root + 1, base * CLASSES << 2 | 2)
            missing = step < 0
            step[missing] = np.broadcast_to(fresh, step.shape)[missing]
            step[0] = np.where(root >= 0, root, base * CLASSES << 2 | 1)
            rows.append(step.astype(np.int32))
            roots.append(base * CLASSES)
            bits.append(np.log2(max(len(string), 2)))
        self.prior = np.log([texts[lang][0] for lang in self.langs]) - np.log(everything)
        self.table, self.roots, self.bits = np.concatenate(rows).ravel(), np.array(roots, np.int32), np.array(bits)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (text, language), and whether a text has a letter."""
        kinds, ends = classes_of(texts, self.letters)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        n = -(-(ends - starts) // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), n)
        at = np.repeat(starts, n) + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(SEGMENT, ends[owner] - at)
        order = np.argsort(-length, kind="stable")
        owner, at, length = owner[order], at[order], length[order]
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        counts = np.zeros(state.shape, np.int32)
        alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for t, live in enumerate(alive):
            step = self.table[state[:, :live] + kinds[at[:live] + t]]
            counts[:, :live] += step & 3
            state[:, :live] = step >> 2
        counts += state != self.roots[:, None]
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        np.add.at(total, owner, counts.T)
        letter = np.concatenate([[0], np.cumsum(kinds != 0)])
        return total, letter[ends] > letter[starts]

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats (text, language), and whether a text has a letter."""
        total, letter = self.phrases(texts)
        return total * self.bits * np.log(2) - self.prior, letter


def ranked(texts: dict[str, tuple[int, str]]) -> list[str]:
    return sorted(texts, key=lambda lang: (-texts[lang][0], lang))


class Identifier:
    """The language and score of texts, by cross-parsers of at most BLOCK_CHARS labelled text each."""

    def __init__(self, texts: dict[str, tuple[int, str]], most: int = BLOCK_CHARS):
        self.texts, order = texts, ranked(texts)
        self.blocks = [order[a:b] for a, b in pieces([len(texts[lang][1]) for lang in order], most)]
        self.letters, self.rows, self.parser = class_table([texts[lang][1] for lang in order]), sum(n for n, _ in texts.values()), None

    def block(self, langs: list[str]) -> CrossParser:
        if self.parser is None or len(self.blocks) > 1:
            self.parser = None
            self.parser = CrossParser({lang: self.texts[lang] for lang in langs}, self.letters, self.rows)
        return self.parser

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found, low, mass = ["und"] * len(texts), np.full(len(texts), np.inf), np.zeros(len(texts))
        letter = np.zeros(len(texts), bool)
        for langs in self.blocks:
            parser = self.block(langs)
            for a, b in pieces([len(t) for t in texts], CHUNK):
                cost, letter[a:b] = parser.costs(texts[a:b])
                best = cost.argmin(axis=1)
                least = np.minimum(low[a:b], cost.min(axis=1))
                with np.errstate(invalid="ignore", over="ignore"):
                    before = np.where(np.isinf(low[a:b]), 0.0, mass[a:b] * np.exp(np.maximum(least - low[a:b], -700)))
                mass[a:b] = before + np.exp(np.maximum(least[:, None] - cost, -700)).sum(axis=1)
                for i in np.flatnonzero(cost.min(axis=1) < low[a:b]):
                    found[a + i] = parser.langs[best[i]]
                low[a:b] = least
        return [x if ok else "und" for x, ok in zip(found, letter, strict=True)], np.where(letter, 1 / np.maximum(mass, 1), 0.0).tolist()


def identify_language(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df with lang_pred and score (share of the best language's likelihood), learned from the rows of labelled with a language."""
    texts = sample(labelled, id_col, text_col, lang_col)
    model = df.sparkSession.sparkContext.broadcast(Identifier(texts) if texts else None)

    def work(batch):
        langs, scores = ["und"] * len(batch), [0.0] * len(batch)
        there = [i for i, t in enumerate(batch) if t] if model.value else []
        if there:
            for i, lang, score in zip(there, *model.value.predict([batch[i] for i in there]), strict=True):
                langs[i], scores[i] = lang, score
        return [langs, scores]

    return add_columns(df, FIELDS, work, text_col)
