"""Main text of hard pages, the scan for the best run against all runs, and time that grows with length only."""

import random
import time

import pytest

from twinframe.llm import html


def test_best_run_against_all_runs():
    rng = random.Random(21)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 25))]
        begin, stop = html.best_run(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[begin:stop]) == max([0.0, *every])
        assert (begin, stop) == (0, 0) or sum(scores[begin:stop]) > 0


PIECES = ["<a", "<x ", "<p>", "</p>", "<b>", "</i>", "<div class='ad'>", "</div>", '<a href="', "<a href='x>t ", "<svg>", "<![CDATA[", "<!--", "<!", "</", "<", ">", '"', "=", "&amp;", "<li>", "</script", "<script>", "word "]


@pytest.mark.parametrize("piece", PIECES)
def test_long_malformed_pages(piece):
    page = piece * 100_000
    began = time.process_time()
    for end in ("", ">", "</p>"):
        html.extract(page + end, {})
    assert time.process_time() - began < 10


def test_any_mixture_is_read():
    rng = random.Random(22)
    for _ in range(2000):
        page = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        html.counts(page)
        assert isinstance(html.extract(page, {}), str)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h1>Head</h1><section class="market-share"><p>one two</p></section><p id="search-results">three four</p></article>', "Head one two three four"),
        ('<article><p>one</p><div class="comment-list"><p>so nice</p></div><p>two</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>', "one two a b 1 2"),
        ('<article><p>one two</p><aside>' + "side " * 500 + "</aside><p>three</p></article>", "one two three"),
        ('<article><a href="x>text here</a><p class="y">more text</p></article>', "text here more text"),
        ('<article><a title="a > b" href=\'x\'>text</a> on</article><p>foot', "text on"),
        ("<main><header><h1>Title</h1></header><p>body &lt;i&gt; text</p><form><label>Name</label></form></main>", "Title body <i> text"),
        ("<body class='has-sidebar'><div class='sidebar-right layout'><article><p>kept words</p></article></div><div class='sidebar-right'>gone words</div>", "kept words"),
        ("<p>cut off <a href=", "cut off"),
        ("3 < 4 and 4 > 3", "3 < 4 and 4 > 3"),
        ("<p>one<script>var a = '<p>two</p>';</script> three<style>p{}</style></p>", "one three"),
    ],
)
def test_pages(page, text):
    assert html.extract(page, {}) == text


def test_names_are_judged_by_counts():
    word = "word " * 200
    page = f'<body><div class="bar">{word}</div><article><div class="promo-text">{word}</div><p>{word}</p></article><div class="related-posts">{word}</div>'
    inner, outer = html.counts(page)
    assert outer["box bar"] == 200 and inner["box bar"] == 0 and (inner["box promo-text"], outer["box promo-text"]) == (200, 0) and inner["word in p"] == 200
    weights = html.weights_of([(k, inner[k], outer[k]) for k in inner | outer])
    assert weights["box bar"] < html.LEFT_OUT and weights["box related-posts"] < html.LEFT_OUT
    assert html.box_odds("ad", 5000, 0) > html.LEFT_OUT > html.box_odds("ad")
    bare = '<div class="bar">one two</div><p>three four five</p><p class="foo">six seven</p>'
    assert html.extract(bare, weights) == "three four five six seven"


LISTED = ("comment", "comments", "notice", "alert", "share-list", "social", "respond", "menu", "zone-respond", "related-posts", "login-form")


def test_counted_words_overrule_the_listed_names(spark):
    rng = random.Random(23)
    names = [f"c{i}" for i in range(3000)]  # more class names than any ranking of a crawl would keep

    def page(i, marked):
        body = "".join(f'<div class="{x}"><p>{" ".join(f"in{i}" for _ in range(20))}</p></div>' for x in LISTED[i % 5 :: 5]) + f"<p>{'plain ' * 80}</p>"
        odd = "".join(f'<div class="{rng.choice(names)}">out</div>' for _ in range(20))
        return f'<body>{odd}<div class="qzz">{"junk " * 60}</div>' + (f"<article>{body}</article>" if marked else f"<div>{body}</div>") + f'<div class="sidebar">{"side " * 30}</div></body>'

    labelled = spark.createDataFrame([(page(i, True),) for i in range(300)], "html string")
    held_out = spark.createDataFrame([(i, page(i, False)) for i in range(300, 320)], "page_id long, html string")
    weights = html.learn(labelled)
    assert all(weights[f"box {x}"] > html.LEFT_OUT for x in LISTED) and weights["box qzz"] < html.LEFT_OUT and weights["box sidebar"] < html.LEFT_OUT
    for r in html.extract_main_text(held_out, labelled=labelled).collect():
        i = r["page_id"]
        assert r["text"] == " ".join([" ".join([f"in{i}"] * 20)] * len(LISTED[i % 5 :: 5]) + ["plain"] * 80), r["text"][:300]
    assert html.extract('<div class="comments">one</div><p>two three</p>', {}) == "two three"  # a name that was never counted
