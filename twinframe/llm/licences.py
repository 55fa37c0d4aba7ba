"""Licence scan by a generalised suffix automaton over the words of licence names and notices.

Texts stream through the automaton, which tells at every word how long a stretch that ends there stands in some template, and where (matching statistics). Whole names are found as they
end. Long stretches become anchors; anchors of one notice that follow each other in text and notice, with at most `gap` words between, are chained, and a chain that covers `cover` of the
notice's words is a span with that label. Words are walked only where pairs of neighbours stand in a template, which any longer stretch consists of.

Documents are scanned, without a shuffle; templates are a parameter and go to the tasks with the code.

Cases: null text has no words and no labels, as has a text without words; a text of any length goes in slices that overlap by the longest template; repeated rows get equal results; of chains of one notice that
overlap, the best counts; an empty table gives no rows; columns of the results' names are replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, utf8
from .licence_texts import NAMES, PHRASES, TEMPLATES
from .words import CHUNK_BYTES, Words, fold, slices

#: Words of an anchor at least, words between anchors of a chain at most, and share of a notice's words that makes a span.
ANCHOR, GAP, COVER = 4, 40, 0.6
#: Characters between words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
FIELDS = [
    ("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()), ("base_labels", "array<string>", pa.list_(pa.string())),
    ("labels", "array<string>", pa.list_(pa.string())), ("spans", "array<struct<label:string,start:long,end:long,covered:double>>", pa.list_(SPAN)), ("score", "double", pa.float64()),
]


class Automaton:
    """The smallest automaton for all stretches of several sequences; state 0 is the start."""

    def __init__(self, sequences: list[list[int]]):
        self.after: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, c in enumerate(sequence, 1):
                last = self.extended(last, c)
                own += [[] for _ in range(len(self.after) - len(own))]
                own[last].append((number, end))
        #: Where the stretches of a state end: (sequence, words up to there).
        self.ends = own
        for state in sorted(range(1, len(own)), key=lambda s: -self.longest[s]):
            self.ends[self.link[state]].extend(own[state])

    def state(self, like: int | None, longest: int) -> int:
        self.after.append({} if like is None else dict(self.after[like]))
        self.link.append(0 if like is None else self.link[like])
        self.longest.append(longest)
        return len(self.after) - 1

    def parted(self, p: int, c: int) -> int:
        """The state that c leads to from p, parted from longer stretches that do not end alike."""
        q = self.after[p][c]
        if self.longest[q] == self.longest[p] + 1:
            return q
        short = self.state(q, self.longest[p] + 1)
        self.link[q] = short
        while p >= 0 and self.after[p].get(c) == q:
            self.after[p][c] = short
            p = self.link[p]
        return short

    def extended(self, last: int, c: int) -> int:
        if c in self.after[last]:
            return self.parted(last, c)
        new, p = self.state(None, self.longest[last] + 1), last
        while p >= 0 and c not in self.after[p]:
            self.after[p][c] = new
            p = self.link[p]
        self.link[new] = self.parted(p, c) if p >= 0 else 0
        return new

    def walk(self, words: list[int]):
        """(state, length of the longest known stretch that ends here) at each word."""
        state = length = 0
        for c in words:
            while state and c not in self.after[state]:
                state = self.link[state]
                length = self.longest[state]
            if c in self.after[state]:
                state, length = self.after[state][c], length + 1
            yield state, length


def words_of(text: str) -> list[str]:
    return utf8(text).translate(fold(APART)).decode("utf-8", "surrogatepass").split()


class Scanner:
    def __init__(self, phrases: dict[str, str], names: dict[str, str], templates: dict[str, list[str]], anchor: int, gap: int, cover: float):
        self.anchor, self.gap, self.cover, self.table = anchor, gap, cover, fold(APART)
        named = [*phrases.items(), *names.items()]
        sequences = [words_of(p) for p, _ in named] + [words_of(t) for ts in templates.values() for t in ts]
        self.labels = [label for _, label in named] + [label for label, ts in templates.items() for _ in ts]
        self.base, self.names, self.size, self.reach = len(phrases), len(named), [len(s) for s in sequences], max(map(len, sequences))
        self.number = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}), 1)}
        coded = [[self.number[w] for w in s] for s in sequences]
        self.automaton = Automaton(coded)
        self.pairs = np.zeros((len(self.number) + 1,) * 2, bool)
        self.closing = np.zeros_like(self.pairs)
        for s in coded:
            for a, b in zip(s[:-1], s[1:], strict=True):
                self.pairs[a, b] = True
        for s in coded[: self.names]:
            self.closing[s[-2], s[-1]] = True
        # names that a state's stretches end with, and their words: its own, and those of the shorter stretches that it links to
        self.closes: list[list[tuple[int, int]]] = [[] for _ in self.automaton.after]
        for i, s in enumerate(coded[: self.names]):
            *_, (state, _) = self.automaton.walk(s)
            self.closes[state].append((i, len(s)))
        for state in sorted(range(1, len(self.closes)), key=lambda q: self.automaton.longest[q]):
            self.closes[state] += self.closes[self.automaton.link[state]]

    def stretches(self, words: Words, piece: np.ndarray):
        """(first, last) of runs of words that may hold an anchor or a name."""
        known = np.fromiter((self.number.get(w, 0) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        ids = known[words.codes]
        linked = self.pairs[ids[:-1], ids[1:]] & (piece[:-1] == piece[1:])
        edges = np.diff(linked.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        closing = np.concatenate([[0], np.cumsum(self.closing[ids[:-1], ids[1:]] & linked)])
        keep = (last - first + 1 >= self.anchor) | (closing[last] > closing[first])
        return ids, first[keep].tolist(), last[keep].tolist()

    def chunk(self, folded: bytes, owns: list[int]):
        """For each text of a folded chunk: its words that start in the first `own` bytes, (place, name) of names and (notice, place, place there, words) of anchors that start there."""
        words = Words(folded)
        piece = words.piece()
        begin = np.searchsorted(piece, np.arange(len(owns)))
        at = np.concatenate([[0], np.flatnonzero(words.raw == 10) + 1])
        mine = words.starts < (at + owns)[piece] if len(words) else np.zeros(0, bool)
        count = np.bincount(piece[mine], minlength=len(owns)).tolist()
        names, anchors = defaultdict(list), defaultdict(list)
        if len(words) > 1:
            ids, firsts, lasts = self.stretches(words, piece)
            for first, last in zip(firsts, lasts, strict=True):
                text = int(piece[first])
                limit = int(begin[text]) + count[text]
                before = None
                for i, (state, length) in enumerate([*self.automaton.walk(ids[first : last + 1].tolist()), (0, 0)], first):
                    for name, size in self.closes[state]:
                        if size <= length and i - size + 1 < limit:
                            names[text].append((i - size + 1 - int(begin[text]), name))
                    # a stretch that the next word does not prolong
                    if before and length <= before[1] >= self.anchor and i - before[1] < limit:
                        for notice, end in self.automaton.ends[before[0]]:
                            if notice >= self.names:
                                anchors[text].append((notice, i - before[1] - int(begin[text]), end - before[1], before[1]))
                    before = (state, length)
        return [(count[k], names[k], anchors[k]) for k in range(len(owns))]

    def chains(self, anchors: list[tuple[int, int, int, int]]):
        """(notice, start, end, share covered) of chains of anchors, sorted by notice and place; of those that overlap, the best."""
        anchors.sort()
        best: list[tuple[int, int]] = []  # words covered, and place of the first anchor
        for i, (notice, place, there, n) in enumerate(anchors):
            found = (n, place)
            for j in range(i - 1, -1, -1):
                other, p, t, m = anchors[j]
                if other != notice or place - p > self.gap + self.reach:
                    break
                if p < place and t < there and place - p - m <= self.gap and there - t - m <= self.gap:
                    found = max(found, (best[j][0] + n - min(n, max(0, p + m - place, t + m - there)), best[j][1]), key=lambda x: (x[0], -x[1]))
            best.append(found)
        whole = [(notice, start, place + n, min(1.0, covered / self.size[notice])) for (notice, place, _, n), (covered, start) in zip(anchors, best, strict=True)]
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for notice, start, end, share in sorted((w for w in whole if w[3] >= self.cover), key=lambda w: (w[0], -w[3], w[2] - w[1], w[1])):
            if all(end <= a or b <= start for a, b in taken[notice]):
                taken[notice].append((start, end))
                yield notice, start, end, share

    def result(self, parts: list[tuple[int, list, list]]) -> tuple:
        """FIELDS of a text from its slices."""
        n, names, anchors = 0, [], []
        for count, own_names, own_anchors in parts:
            names += [(place + n, name) for place, name in own_names]
            anchors += [(notice, place + n, there, size) for notice, place, there, size in own_anchors]
            n += count
        base = [place for place, name in names if name < self.base]
        spans = [(self.labels[name], place, place + self.size[name], 1.0) for place, name in names]
        spans += [(self.labels[notice], start, end, share) for notice, start, end, share in self.chains(anchors)]
        spans.sort(key=lambda s: (s[1], s[2], s[0]))
        labels = sorted({s[0] for s in spans})
        return n, len(base), min(base, default=None), max(base, default=None), sorted({self.labels[name] for _, name in names if name < self.base}), labels, spans, max((s[3] for s in spans), default=0.0)

    def scan(self, texts: list[str | None]) -> list[tuple]:
        out: list[tuple] = []
        waiting, size = [], 0

        def flush():
            nonlocal size
            if waiting:
                out.extend(self.result([x]) for x in self.chunk(b"\n".join(waiting), [len(t) for t in waiting]))
            waiting.clear()
            size = 0

        for text in texts:
            folded = utf8(text).translate(self.table) if text else b""
            if size and size + len(folded) > CHUNK_BYTES:
                flush()
            if len(folded) > CHUNK_BYTES:
                out.append(self.result([x for part, own in slices(folded, reach=self.reach) for x in self.chunk(part, [own])]))
                continue
            waiting.append(folded)
            size += len(folded) + 1
        flush()
        return out


def find_licences(
    df: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, names: dict[str, str] = NAMES, templates: dict[str, list[str]] = TEMPLATES, anchor: int = ANCHOR, gap: int = GAP, cover: float = COVER
) -> DataFrame:
    """df with n_words, places of the base phrases (n_base, first_word, last_word, base_labels), and labels, spans (in words) and the best covered share of all."""
    scanner = df.sparkSession.sparkContext.broadcast(Scanner(phrases, names, templates, anchor, gap, cover))

    def work(texts):
        found = scanner.value.scan(texts)
        columns = [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in FIELDS]
        columns[6] = [[dict(zip(("label", "start", "end", "covered"), s, strict=True)) for s in spans] for spans in columns[6]]
        return columns

    return add_columns(df, FIELDS, work, text_col)


def digest(found: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")
