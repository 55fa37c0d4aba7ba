"""Base spans against the patterns themselves, scores against a plain restatement, clashing columns and long texts."""

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from twinframe.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def pieces(rng):
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return rng.choice([
        " ", "\n", "é", "😀", "password", 'PassWd"', "secret", "token", "api_key", "APIKEY", "=", " : ", "'", key("0123456789abcdef", rng.choice([5, 31, 32, 40])), "AKIA" + key(string.ascii_uppercase + string.digits, rng.choice([3, 11, 12, 16])),
        key(string.ascii_letters + string.digits + "+/", rng.choice([7, 8, 19, 20, 30])), "a_word/and-more", secrets.BLANK, ".",
    ])


def test_base_spans_equal_the_patterns(spark, monkeypatch):
    rng = random.Random(31)
    texts = ["".join(pieces(rng) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [("token=abcdefgh1 " * 300)]
    for fold in (64, 3):
        monkeypatch.setattr(secrets, "FOLD", fold)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in secrets.find_secrets(df).collect():
            spans = [(s["start"], s["kind_no"], s["stop"]) for s in r["secret_spans"]]
            fixed = [s for s in spans if s[1] < 3]
            assert fixed == base(texts[r["doc_id"]]) and spans == sorted(spans)
            assert all(texts[r["doc_id"]][s["start"] : s["stop"]] == s["hit"] for s in r["secret_spans"])
            for a, k, b in spans:
                assert k < 3 or all(b <= x or y <= a for x, _, y in fixed)


def test_stretches_against_all_stretches(spark):
    table = secrets.ratio_table(secrets.labelled_samples(spark, spark.createDataFrame([], "text string")))
    rng = random.Random(32)
    tokens = ["".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randint(2, 40))) for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(secrets.best_stretch(F.col("t"), table)).collect()]
    place = {c: i for i, c in enumerate(secrets.ALPHABET)}
    for t, best in zip(tokens, got, strict=True):
        pairs = [table[place[a] * len(secrets.ALPHABET) + place[b]] - secrets.DRIFT for a, b in zip(t, t[1:])]
        every = [math.fsum(pairs[i:j]) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)]
        assert best == pytest.approx(max([0.0, *every]))


def test_keys_are_found_and_names_are_not(spark):
    rng = random.Random(33)
    letters = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (24, 28, 32, 40) for _ in range(50)]
    behind = [f"credentials/customer/production/service/{k}" for k in keys]
    words = secrets.WORDS.split()
    names = ["_".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + "_" + str(rng.randint(1, 999)) for _ in range(200)]
    paths = ["/".join(rng.choice(words).capitalize() for _ in range(rng.randint(3, 9))) + f"/v{rng.randint(1, 9)}" for _ in range(200)]
    texts = [f"see {t} now" for t in [*keys, *behind, *names, *paths]]
    found = {r["doc_id"]: len(r["secret_spans"]) for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    share = lambda a, b: sum(found[i] > 0 for i in range(a, b)) / (b - a)
    assert share(0, 200) >= 0.95 and share(200, 400) >= 0.95
    assert share(400, 800) == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh1", "a", "b", "c", "d")], "doc_id long, text string, secret_spans string, _text string, base string, row string")
    (r,) = secrets.find_secrets(df).collect()
    assert [s["start"] for s in r["secret_spans"]] == [0] and (r["_text"], r["base"], r["row"]) == ("b", "c", "d")


def test_long_runs_and_many_spans(spark):
    rng = random.Random(34)
    run = "".join(rng.choice(secrets.ALPHABET) for _ in range(100_000))
    many = "password=hunter22 " * 3_000
    got = secrets.redact(secrets.find_secrets(spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string"))).collect()
    assert {r["doc_id"]: len(r["secret_spans"]) for r in got} == {1: 1, 2: 3_000}
    assert {r["doc_id"]: r["text"] for r in got} == {1: "[SECRET]", 2: "[SECRET] " * 3_000}
