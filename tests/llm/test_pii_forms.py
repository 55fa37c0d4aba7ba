"""Each disguise alone in a text, so that nothing else opens the rewriting."""

import pytest

from twinframe.llm import pii

CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to jane at example.com now", "email", "jane at example.com"),
        ("schreib an jane arroba example.com", "email", "jane arroba example.com"),
        ("call plus 49 151 23456789 now", "phone", "plus 49 151 23456789"),
        *((f"paid {CARD.replace(' ', c)} then", "card", CARD.replace(" ", c)) for c in "\u2013\u2014\u00a0"),
        *((f"call +49{c}151{c}23456789 now", "phone", f"+49{c}151{c}23456789") for c in "\u2013\u2014\u00a0"),
        ("call +1\u00a0(555)\u2013555\u20131234 now", "phone", "+1\u00a0(555)\u2013555\u20131234"),
        ("paid " + "\u2013".join("４１１１ １１１１ １１１１ １１１１".split()), "card", "\u2013".join("４１１１ １１１１ １１１１ １１１１".split())),
        ("mail joe@site\u00b7org now", "email", "joe@site\u00b7org"),
        ("host 10\u00b70\u00b70\u00b71 up", "ip", "10\u00b70\u00b70\u00b71"),
        ("plus four\u2013nine\u2013one\u2013five\u2013one\u2013two\u2013three\u2013four\u2013five\u2013six", "phone", "plus four\u2013nine\u2013one\u2013five\u2013one\u2013two\u2013three\u2013four\u2013five\u2013six"),
    ],
)
def test_form_alone(text, kind, found):
    _, spans = pii.all_spans(text)
    a = text.index(found)
    assert (a, pii.KINDS.index(kind), a + len(found)) in spans


@pytest.mark.parametrize("text", ["see joe@site.org\u2014then go", "from 1914\u20131918", "joe@site.org \u00b7 Berlin", "two plus 3 at home"])
def test_ordinary_signs_add_nothing(text):
    plain, spans = pii.all_spans(text)
    assert spans == plain


@pytest.mark.parametrize(
    "text",
    [
        "Meet me @ noon.Then go", "He sat at home.The dog slept.", "we are at this point in time", "at one point the talks at that point it failed", "open at 5 point 5", "look at some point on the line",
        "Tickets @ 5.Doors open", "two plus two at the end of dot matrix printers", "She works at Acme.Inc has offices", "arrive at dot or later", "at no point did we stop at any point to rest",
    ],
)
def test_prose_adds_nothing(text):
    plain, spans = pii.all_spans(text)
    assert spans == plain


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("ask jane @ example.com.Then go", "jane @ example.com"), ("ask jane at example point com now", "jane at example point com"), ("ask jane at mail point example point org now", "jane at mail point example point org"),
        ("ask JANE AT EXAMPLE DOT COM now", "JANE AT EXAMPLE DOT COM"), ("ask jane [at] example [dot] test now", "jane [at] example [dot] test"),
    ],
)
def test_addresses_beside_prose(text, found):
    _, spans = pii.all_spans(text)
    assert [(k, text[a:b]) for a, k, b in spans] == [(0, found)]
