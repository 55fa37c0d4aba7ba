"""Long and dense texts: time grows with length, results stay those of the short ones."""

import random
import time

import pytest

from twinframe.llm import pii


@pytest.mark.parametrize("piece", [" ", "  (", "( ", "[ at ", " at ", "a at b ", "1 ", "one ", "+1", "a@", "@ ", "a@b.c ", "1.2.3.4 ", "joe [at] site [dot] org ", "plus ", "dot ", "a dot b ", " ", "４"])
def test_time_grows_with_length(piece):
    text = piece * (400_000 // len(piece)) + "(.)"
    began = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - began < 20


def test_dense_text_is_the_sum_of_its_parts():
    parts = ["mail joe@site.org", "or joe [at] site [dot] org", "or 10 dot 0 dot 0 dot 1", "or 10.0.0.1", "call +49 151 2345 6789"]
    plain, spans, at = [], [], 0
    for _ in range(300):
        for part in parts:
            p, s = pii.all_spans(part)
            plain += [(a + at, k, b + at) for a, k, b in p]
            spans += [(a + at, k, b + at) for a, k, b in s]
            at += len(part) + 3
    text = " ; ".join(parts * 300)
    assert pii.all_spans(text) == (plain, spans)


def test_added_spans_against_pairs():
    """The rule for added spans, pair by pair."""
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a@b.co", " at ", "c.de", " [at] ", "1.2.3.4", " dot ", "x", " ", "５", "0", "."]) for _ in range(rng.randint(1, 14)))
        plain, spans = pii.all_spans(text)
        want = list(plain)
        for x in pii.disguised_spans(text):
            same = [y for y in plain if y[1] == x[1] and not (y[2] <= x[0] or x[2] <= y[0])]
            if all(x != y and x[0] <= y[0] and y[2] <= x[2] for y in same):
                want.append(x)
        assert spans == sorted(want)
