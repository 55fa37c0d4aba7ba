"""Main text of web pages as the maximum-scoring subsequence of their words and tags.

A page is a sequence of tokens: each word scores by the element that it stands in, usually above zero, each tag below. Weights are log odds
of lying within the content, counted over labelled pages: those that mark their content by exactly one article or main element. One linear
scan finds the contiguous run of the highest sum. Left out of it are elements that by the meaning of their tag hold no main text, and boxes whose
name (a class, id or role) speaks against content by its weight: counts of words in boxes of that name, by whether they stand inside or outside marked
content. Names made of FURNITURE are taken to have held PRIOR words outside before any page is read, which counted words inside outweigh. On a page that marks its content, marked words score above zero and others below.

Training reads about `labelled_pages` pages, of which only the counts of tokens and box names with `least_words` words or more reach the driver; what is rarer has its default weight. Extraction is one scan without
a shuffle, linear in a page's length whatever its markup.

Cases: null and empty pages give an empty text; unclosed and stray tags close by nesting as far as they can; a quote that is not closed ends with
its tag; a tag that the page's end cuts off is dropped; without labelled pages default weights hold; repeated rows get equal results; an empty
table gives no rows; columns of the results' names are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, sampled

#: Pages that weights are fitted on, and words or tags of a kind that they hold at least for a weight of its own.
LABELLED, LEAST_WORDS = 400, 10
#: Words outside content that a box of a furniture name is taken to have held before any page is read, and the log odds below which a box is left out.
PRIOR, LEFT_OUT = 50, -1.5
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Elements within a line of text, those without content, those whose inside is no markup of the page, and those that never hold main text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
SKIPPED = RAW | frozenset(("noscript", "template", "svg", "iframe", "object"))
NEVER = frozenset("head title nav header footer aside form button select option textarea menu dialog input audio video canvas".split())
CONTENT = frozenset(("article", "main"))
#: Where a search for an open paragraph or item ends.
BOUNDS = frozenset("ul ol div article section td".split())
#: Words that name furniture of a page, and words that say nothing about what a box holds.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification popup modal overlay dialog alert newsletter "
    "subscribe subscription signup share sharing social sidebar sidebars related recommended recommendations comment comments commentlist respond replies disqus breadcrumb breadcrumbs nav navbar navigation menu menus "
    "footer header masthead toolbar pagination pager widget widgets login search complementary contentinfo".split()
)
NEUTRAL = frozenset(
    "box boxes list lists wrapper wrap area section sections container containers content inner outer left right top bottom main item items block blocks bar unit slot group panel pane row col column region zone form link links "
    "post posts articles stories button buttons icon icons text title heading label thread space placeholder primary secondary site page global mobile desktop sticky fixed floating float".split()
)


def furniture(name: str) -> bool:
    """Whether a box's name is made of words for furniture, with neutral ones at most: sidebar-left is, market-share is not."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
    return any(p in FURNITURE for p in parts) and all(p in FURNITURE or p in NEUTRAL for p in parts)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    names: list[str]
    inside: bool  # of marked content
    holds: bool = False  # marked content


@dataclass(slots=True)
class Page:
    """Elements, the first of them the page, and tokens: (tag or None, text or None, element)."""

    elements: list[Element]
    tokens: list[tuple[str | None, str | None, int]] = field(default_factory=list)
    marked: str | None = None


def scan(page: str):
    """(tag, attributes, text) of each piece: a start tag with its attributes, an end tag as /tag, or text. Each character is looked at a bounded number of times."""
    n, at, absent = len(page), 0, set()
    last = page.rfind(">")

    def find(pattern: re.Pattern | str, start: int) -> int:
        # what is found nowhere after one place is found nowhere after a later one
        if pattern in absent:
            return -1
        if isinstance(pattern, str):
            found = page.find(pattern, start)
        else:
            m = pattern.search(page, start)
            found = m.start() if m else -1
        if found < 0:
            absent.add(pattern)
        return found

    def tag_end(start: int) -> int:
        """Place of the sign that ends a start tag; a quoted value may hold it, if its quote is closed before a space, a slash or the tag's end."""
        while True:
            m = STOP.search(page, start)
            if not m or m[0] == ">":
                return m.start() if m else -1
            quote = m[0][-1]
            close = find(quote, m.end())
            inner = page.find(">", m.end(), close if close >= 0 else n)
            if inner >= 0 and (close < 0 or (close + 1 < n and page[close + 1] not in " \t\r\n\f/>")):
                return inner
            if close < 0:
                return -1
            start = close + 1

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield None, None, page[at:]
            return
        if lt > at:
            yield None, None, page[at:lt]
        head = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            stop = find("-->", lt + 2)
            at = stop + 3 if stop >= 0 else n
        elif page.startswith("<![CDATA[", lt):
            stop = find("]]>", lt)
            at = stop + 3 if stop >= 0 else n
        elif head in ("!", "?"):
            at = page.find(">", lt) + 1 if lt < last else n
        elif head == "/" and page[lt + 2 : lt + 3].isalpha():
            if lt > last:
                return
            at = page.find(">", lt) + 1
            yield "/" + NAME.match(page, lt + 2)[0].lower(), "", None
        elif head.isalpha() and head.isascii():
            stop = tag_end(lt + 1) if lt < last else -1
            if stop < 0:
                return
            name = NAME.match(page, lt + 1, stop)[0]
            tag, at = name.lower(), stop + 1
            if tag in SKIPPED:
                end = find(END[tag], at)
                if end >= 0 or tag in RAW:
                    close = page.find(">", end) if end >= 0 else -1
                    at = close + 1 if close >= 0 else n
            else:
                yield tag, page[lt + 1 + len(name) : stop], None
        else:
            yield None, None, "<"
            at = lt + 1


STOP = re.compile(r">|=\s*[\"']")
END = {t: re.compile(rf"</{t}(?![a-z0-9])", re.IGNORECASE) for t in SKIPPED}


def read(page: str) -> Page:
    """The elements and tokens of a page."""
    found = Page([Element("", 0, [], False)])
    elements, stack, opened, marks = found.elements, [0], Counter(), []
    pieces = list(scan(page))
    tags = {tag for tag, _, _ in pieces if tag in CONTENT}
    found.marked = "article" if "article" in tags else "main" if tags else None

    def close(depth: int) -> None:
        for e in stack[depth:]:
            opened[elements[e].tag] -= 1
        del stack[depth:]
        while marks and marks[-1] >= depth:
            marks.pop()

    for tag, attributes, text in pieces:
        if text is not None:
            found.tokens.append((None, html.unescape(text), stack[-1]))
            continue
        if tag[0] == "/":
            if opened[tag[1:]]:
                depth = len(stack) - 1
                while elements[stack[depth]].tag != tag[1:]:
                    depth -= 1
                close(depth)
            found.tokens.append((tag, None, stack[-1]))
            continue
        if tag in ("p", "li"):  # an open paragraph or item ends where the next one begins
            for depth in reversed(marks[-2:]):
                below = elements[stack[depth]].tag
                if below == tag:
                    close(depth)
                if below == tag or below in BOUNDS or tag == "p":
                    break
        names = [x for a in ATTRIBUTE.findall(attributes) for x in next(filter(None, a), "").split()] if "=" in attributes else []
        parent = stack[-1]
        e = Element(tag, parent, names, elements[parent].inside or tag == found.marked)
        elements.append(e)
        if tag == found.marked:
            up = parent
            while up and not elements[up].holds:
                elements[up].holds = True
                up = elements[up].parent
        found.tokens.append((tag, None, len(elements) - 1))
        if tag not in VOID and not attributes.endswith("/"):
            if tag in BOUNDS or tag in ("p", "li"):
                marks.append(len(stack))
            stack.append(len(elements) - 1)
            opened[tag] += 1
    return found


def left_out(page: Page, against) -> list[bool]:
    """Of each element, whether it holds no main text: by its tag, by a name that is against, or since its parent does not."""
    out = [False]
    for e in page.elements[1:]:
        titled = e.inside and e.tag != page.marked
        never = e.tag in NEVER and not (e.tag == "header" and titled)
        if not never and e.names and not e.holds and e.tag not in CONTENT and e.tag not in ("html", "body"):
            never = any(against(x) and not (titled and x.lower() == "header") for x in e.names)
        out.append(out[e.parent] or never)
    return out


def places(page: Page) -> list[str]:
    """For each element, the kind of the words that stand in it: by the nearest block, and links apart."""
    kinds = ["word in page"]
    for e in page.elements[1:]:
        if e.tag == "a":
            kinds.append(kinds[e.parent] if kinds[e.parent].endswith(" link") else kinds[e.parent] + " link")
        else:
            kinds.append(kinds[e.parent] if e.tag in INLINE else f"word in {e.tag}")
    return kinds


def counts(page: str | None) -> tuple[Counter, Counter]:
    """Of a page that marks its content by one element, the tokens inside and outside it, and the words in its boxes; of others, none.

    What holds no main text by its tag is not counted; words in boxes of furniture names outside the content count for the box alone.
    """
    inner, outer = Counter(), Counter()
    if not page:
        return inner, outer
    found = read(page)
    if sum(e.tag in CONTENT for e in found.elements) != 1:
        return inner, outer
    never, named, kinds = left_out(found, lambda x: False), left_out(found, furniture), places(found)
    words = [[0, 0] for _ in found.elements]  # outside and inside content, of an element and then of all below it
    for tag, text, e in found.tokens:
        if never[e]:
            continue
        inside = found.elements[e].inside
        to = inner if inside else outer
        if tag:
            to[tag] += 1
            continue
        n = len(text.split())
        words[e][inside] += n
        if inside or not named[e]:
            to[kinds[e]] += n
    for e in range(len(words) - 1, 0, -1):  # what is below comes later
        element = found.elements[e]
        words[element.parent][0] += words[e][0]
        words[element.parent][1] += words[e][1]
        if not (element.holds or element.tag in CONTENT or element.tag in ("html", "body")):
            for x in {x.lower() for x in element.names}:
                outer[f"box {x}"] += words[e][0]
                inner[f"box {x}"] += words[e][1]
    return inner, outer


def weights_of(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Log odds of each kind of token and of each box's name, tags below zero."""
    tokens = [r for r in rows if not r[0].startswith("box ")]
    total_in, total_out = sum(r[1] for r in tokens) + 1, sum(r[2] for r in tokens) + 1
    found = {}
    for kind, inner, outer in rows:
        odds = math.log((inner + 1) / (total_in + 2)) - math.log((outer + 1) / (total_out + 2))
        if kind.startswith("box "):
            found[kind] = box_odds(kind[4:], inner, outer)
        else:
            found[kind] = max(-4.0, min(2.0, odds)) if kind.startswith("word in") else max(-2.5, min(-0.1, odds))
    return found


def box_odds(name: str, inner: int = 0, outer: int = 0) -> float:
    return math.log((inner + 1) / (outer + 1 + (PRIOR if furniture(name) else 0)))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and stop of the contiguous run of the highest sum above zero, the first of equal ones; (0, 0) if there is none."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, span = total, (begin, i + 1)
    return span


def scored(page: Page, weights: dict[str, float], out: list[bool]) -> list[float]:
    """The score of each token."""
    kinds, scores = places(page), []
    for tag, text, e in page.tokens:
        inside = page.elements[e].inside
        if out[e]:
            # within marked content it is passed over
            score = 0.0 if inside else -0.5 * (len(text.split()) if tag is None else 1)
        elif tag:
            score = -0.1 if inside else weights.get(tag, -0.7)
        else:
            word = weights.get(kinds[e], 1.0)
            word = word if page.marked is None else max(word, 0.5) if inside else min(word, -0.5)
            score = word * len(text.split())
        scores.append(score)
    return scores


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best run of tokens."""
    if not page:
        return ""
    found, known = read(page), {}

    def against(name: str) -> bool:
        name_low = name.lower()
        if name not in known:
            odds = weights.get(f"box {name_low}")
            known[name] = (box_odds(name) if odds is None else odds) < LEFT_OUT
        return known[name]

    out = left_out(found, against)
    begin, stop = best_run(scored(found, weights, out))
    blocks, line = [], []
    for tag, text, e in found.tokens[begin:stop]:
        if tag is None:
            if not out[e]:
                line.append(text)
        elif tag.removeprefix("/") not in INLINE:
            blocks.append("".join(line))
            line = []
    blocks.append("".join(line))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def learn(pages: DataFrame, html_col: str = "html", labelled_pages: int = LABELLED, least_words: int = LEAST_WORDS) -> dict[str, float]:
    """Weights from a bounded sample of pages."""
    share = min(1.0, labelled_pages / max(pages.count(), 1))
    picked = pages.select(F.col(html_col).alias("html")).filter(sampled("html", share)).distinct()

    def count(values):
        out = []
        for page in values:
            inner, outer = counts(page)
            out.append([{"kind": k, "inner": inner[k], "outer": outer[k]} for k in inner | outer])
        return [out]

    kind = pa.struct([("kind", pa.string()), ("inner", pa.int64()), ("outer", pa.int64())])
    counted = add_columns(picked, [("kinds", "array<struct<kind:string,inner:long,outer:long>>", pa.list_(kind))], count, "html").select(F.inline("kinds"))
    often = counted.groupBy("kind").agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer")).filter(F.col("inner") + F.col("outer") >= least_words)
    return weights_of(sorted(tuple(r) for r in often.collect()))


def extract_main_text(df: DataFrame, html_col: str = "html", labelled: DataFrame | None = None, labelled_pages: int = LABELLED, least_words: int = LEAST_WORDS) -> DataFrame:
    """df with `text`, the main text of each page, and n_chars, its code points."""
    weights = df.sparkSession.sparkContext.broadcast(learn(df if labelled is None else labelled, html_col, labelled_pages, least_words))
    found = add_columns(df, [("text", "string", pa.string())], lambda pages: [[extract(p, weights.value) for p in pages]], html_col)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
