"""Personal data, also where it is disguised.

Plain identifiers are found by fixed patterns. Where a text shows a sign of disguise, transducers rewrite it step by step, each
character keeping the stretch of the source that it came from: look-alike and wide characters become plain ones, invisible ones go,
spelled digits become digits, and at and dot in brackets or between words become signs. The same patterns then run over the rewritten
text, and what they find beyond the plain spans is mapped back to the source. An address written with spaces ends in letters of one case; what
follows them without a space is the next sentence.

One scan, no shuffle. Cases: a null text is empty; spans of different kinds may overlap; an added span that overlaps a plain one of its kind
stays only if it holds all of it; repeated rows get equal results; an empty table gives no rows; columns of the results' names are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; of an email, the part after the sign.
LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), re.compile(r"[0-9](?:[\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Digits as spelled in English, German, French and Spanish.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "oh": 0,
}
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοντıɡ", "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXovtig", strict=True))
#: Signs that stand for a dot, a hyphen, a plus or an at, and characters without width.
SIGNS = {"․": ".", "。": ".", "﹒": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹢": "+", "﹫": "@", " ": " ", " ": " ", " ": " "}
INVISIBLE = "­​‌‍‎‏⁠﻿"
ODD = re.compile("[" + "".join(LOOKALIKES) + "".join(re.escape(c) for c in SIGNS if c not in "–—· ") + INVISIBLE + "０-９Ａ-Ｚａ-ｚ＠．＋－（）\U0001d400-\U0001d7ff①-⑨⓪⁰¹²³⁴-⁹₀-₉٠-٩۰-۹०-९]")
#: Signs that are ordinary in prose: dashes are rewritten between digits or their brackets, middle dots between letters or digits, no-break spaces anywhere.
ORDINARY = re.compile("(?<=[0-9)])[–—](?=[0-9(])|(?<=[A-Za-z0-9])·(?=[A-Za-z0-9])|\u00a0")
WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
DIGIT_RUN = re.compile(rf"(?i)(?<!\w)(?:{WORD}|[0-9])(?:(?:[\s,.–—-]{{1,2}})(?:{WORD}|[0-9])){{3,}}(?!\w)")
SPELLED_ONE = re.compile(rf"(?i)(?<!\w)({WORD})(?!\w)")
AT_WORD, DOT_WORD = "at|arroba|chez", "dot|punkt|point|punto"
BRACKETED = re.compile(rf"(?i)[\[({{<]\s*(?:({AT_WORD}|@)|({DOT_WORD}|\.))\s*[\])}}>]\s*")
BARE = re.compile(rf"(?i)(?<=[A-Za-z0-9])\s+(?:{AT_WORD})\s+(?=[A-Za-z0-9-]+\s*(?:\s(?:{DOT_WORD})\s|\.[A-Za-z]))")
BARE_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])\s+(?:{DOT_WORD})\s+(?=[A-Za-z0-9])")
DOTTED = re.compile(rf"(?i)@[A-Za-z0-9-]+(?:\s+(?:{DOT_WORD})\s+[A-Za-z0-9-]+)+|(?<![0-9.])[0-9]{{1,3}}(?:\s+(?:{DOT_WORD})\s+[0-9]{{1,3}}){{3}}")
#: Whether text in small letters may hold a digit run, or a bare at: quicker than those, and true wherever they match.
FEW_DIGITS = re.compile(rf"[\s,.–—-](?:{WORD}|[0-9])[\s,.–—-]{{1,2}}(?:{WORD}|[0-9])[\s,.–—-]{{1,2}}(?:{WORD}|[0-9])(?!\w)")
LOW_BARE = re.compile(rf"(?<=[a-z0-9])\s+(?:{AT_WORD})\s+[a-z0-9-]+\s*(?:\s(?:{DOT_WORD})\s|\.[a-z])")
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s*@\s*(?=[A-Za-z0-9])")
DOTS = re.compile(rf"(?i)\s(?:{DOT_WORD})\s")
PLUS = re.compile(r"(?i)(?<!\w)plus\s+(?=[0-9])")
#: Top parts that a bare `point` may lead to; `at this point in` is no address.
TOPS = "com|org|net|edu|gov|mil|int|info|biz|name|io|dev|app|ai|co|de|fr|es|uk|us|eu|ch|ca|au|nl|pl|ru|jp|br|se|dk|fi|pt|cz"
NO_POINT = re.compile(rf"(?i)(?:[A-Za-z0-9-]+\s+point\s+)++(?!(?:{TOPS})(?![\w-]))")
#: The end of an address that was written with spaces: two letters or more, of one case.
TOP = re.compile(r"\.(?:[a-z]{2,}|[A-Z]{2,})$")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in (2 * int(x) for x in digits[-2::-2]))
    return total % 10 == 0


def emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of what the fixed patterns find."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewritten:
    """A text and, for each of its characters, the stretch of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.stop = text, list(range(len(text))), list(range(1, len(text) + 1))

    def transduce(self, pattern: re.Pattern, to, spaces: bool = False) -> None:
        """Replaces each match, with the white space before it if asked for, by to(match); each new character stands for all that it replaces."""
        parts, start, stop, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None or m.end() == m.start():
                continue
            begin = m.start()
            while spaces and begin > last and self.text[begin - 1].isspace():
                begin -= 1
            parts += [self.text[last:begin], new]
            start += self.start[last:begin] + [self.start[begin]] * len(new)
            stop += self.stop[last:begin] + [self.stop[m.end() - 1]] * len(new)
            last = m.end()
        if parts:
            self.text = "".join(parts) + self.text[last:]
            self.start, self.stop = start + self.start[last:], stop + self.stop[last:]


def folded(m: re.Match) -> str:
    c = m[0]
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES or c in SIGNS:
        return LOOKALIKES.get(c) or SIGNS[c]
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that the patterns find only in the rewritten text."""
    low = text.lower()
    odd = not text.isascii() and (ODD.search(text) or ORDINARY.search(text))
    spelled = FEW_DIGITS.search(low) is not None
    bracketed = ("[" in text or "(" in text or "{" in text or "<" in text) and BRACKETED.search(text)
    spaced = "@" in text and SPACED_AT.search(text) is not None
    if not (odd or spelled or bracketed or spaced or DOTS.search(low) or ("plus" in low and PLUS.search(text)) or LOW_BARE.search(low)):
        return []
    r = Rewritten(text)
    if odd:
        r.transduce(ODD, folded)
        r.transduce(ORDINARY, folded)
    # a run of spelled digits becomes digits without what stands between them, unless that is a dot
    r.transduce(DIGIT_RUN, lambda m: re.sub(r"[\s,–—-]+", "", SPELLED_ONE.sub(lambda w: str(SPELLED[w[1].lower()]), m[0])) if SPELLED_ONE.search(m[0]) else None)
    r.transduce(PLUS, lambda m: "+")
    r.transduce(BRACKETED, lambda m: "@" if m[1] else ".", spaces=True)
    r.transduce(BARE, lambda m: None if NO_POINT.match(r.text, m.end()) else "@")
    within = [m.span() for m in DOTTED.finditer(r.text)]
    starts = [a for a, _ in within]
    inside = lambda m: (k := bisect_right(starts, m.start())) and m.end() <= within[k - 1][1]
    r.transduce(BARE_DOT, lambda m: "." if inside(m) else None)
    r.transduce(SPACED_AT, lambda m: "@" if len(m[0]) > 1 else None)
    found = []
    for a, kind, b in plain_spans(r.text):
        # an address written with spaces may have run on into the next sentence
        while kind == 0 and b > a and any(map(str.isspace, text[r.start[a] : r.stop[b - 1]])) and not TOP.search(r.text, a, b):
            cut = r.text.rfind(".", a, b)
            b = cut if "." in r.text[r.text.index("@", a) : cut] else a
        if b > a:
            found.append((r.start[a], kind, r.stop[b - 1]))
    return found


def all_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and plain and added ones."""
    if not text:
        return [], []
    plain = plain_spans(text)
    of_kind = [[(a, b) for a, kind, b in plain if kind == k] for k in range(len(KINDS))]
    stops = [[b for _, b in spans] for spans in of_kind]

    def adds(a: int, kind: int, b: int) -> bool:
        """Whether no plain span of the kind overlaps it, or only ones within it. Plain spans of a kind lie apart, in order."""
        k = bisect_right(stops[kind], a)
        while k < len(of_kind[kind]) and of_kind[kind][k][0] < b:
            c, d = of_kind[kind][k]
            if c < a or d > b or (c, d) == (a, b):
                return False
            k += 1
        return True

    return plain, sorted(plain + [x for x in disguised_spans(text) if adds(*x)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("plain", pa.bool_())])
FIELDS = [("pii", "array<struct<kind:string,start:int,stop:int,plain:boolean>>", pa.list_(SPAN))]


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with `pii`: spans in code points, ordered by start, then kind; plain marks those of the fixed patterns."""

    def work(texts):
        out = []
        for t in texts:
            plain, spans = all_spans(t)
            plain = set(plain)
            out.append([{"kind": KINDS[k], "start": a, "stop": b, "plain": (a, k, b) in plain} for a, k, b in spans])
        return [out]

    return add_columns(df, FIELDS, work, text_col)


def digest(found: DataFrame) -> DataFrame:
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    plain = F.filter("pii", lambda s: s["plain"])

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["plain"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text(plain), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))

