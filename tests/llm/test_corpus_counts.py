"""Source divergence, licence scan and collocations against plain Python on small tables."""

import re
from collections import Counter

import duckdb
import pytest

from twinframe.llm import collocations, divergence, licences, queries
from twinframe.llm.licence_texts import NAMES, PHRASES, TEMPLATES
from twinframe.llm.words import Words, fold, slices

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = TEMPLATES["mit"][0]


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, rank string")


def sql_rows(name, rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    found = db.sql(queries.ORACLES[name])
    return sorted(map(str, (dict(zip(found.columns, r, strict=True)) for r in found.fetchall())))


def spark_rows(df, columns):
    return sorted(str({c: r[c] for c in columns}) for r in df.collect())


DIVERGENCE = ["lang", "source", "part", "item", "value", "rank"]
MIXED = (
    [("one Two two ünder a-b 3 x", "en", "s1"), ("two three", "en", "s2"), (None, "en", "s3"), ("", None, None), ("two one", "en", "s2")] * 6
    + [("zwei drei", "de", "s1"), ("drei", "de", None), ("vier", "de", "s2")] * 10 + [("rare", "fr", "s1"), ("words", "fr", "s2")] + [("alone " * 40, "xx", "s9")] * 12
)


@pytest.mark.parametrize("rows", [MIXED, [], [("a b", "en", "s1")], MIXED[:5]])
def test_divergence_against_sql(spark, rows):
    got = divergence.audit_sources(docs(spark, rows))
    assert got.columns == DIVERGENCE
    assert spark_rows(got, DIVERGENCE) == sql_rows("op11_divergence_audit", rows)


def test_divergence_of_groups_without_terms_is_that_of_zero_counts(spark):
    rows = [("one two two", "en", "s1")] * 10 + [(None, "en", "s2"), ("", "en", "s3")]
    found = {(r["source"], r["item"]): r["value"] for r in divergence.audit_sources(docs(spark, rows)).filter("part = 'pair'").collect()}
    p = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 4)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    assert found["s2", "s3"] == 0 and found["s1", "s2"] == found["s2", "s1"] == f(p(10, 30), p(0, 0)) + f(p(20, 30), p(0, 0))


def test_long_texts_count_as_one_document(spark, monkeypatch):
    text = ("alpha beta " * 3 + "gamma\n") * 50
    table = fold(divergence.APART)
    whole = Words(text.encode().translate(table))
    parts = list(slices(text.encode().translate(table), 100))
    assert sum(len(Words(p)) for p, _ in parts) == len(whole) and len(parts) > 5 and sum(n for _, n in parts) == len(text)
    rows = [(text * 900, "en", "s1")] + [("alpha", "en", "s2")] * 9  # above two chunks
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 100_000)
    assert spark_rows(divergence.audit_sources(docs(spark, rows)), DIVERGENCE) == sql_rows("op11_divergence_audit", rows)


COLLOCATIONS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
PHRASED = (
    [("New York is new. York,new york\tcity  of new york city hall", "en", "s")] * 31 + [("a a a a a a", "en", "s")] * 9 + [(None, "en", "s"), ("", None, None), ("öl ÖL öl; öl", None, "s")] * 30
    + [("x y z", "fr", "s")] * 29 + [("san francisco bay area wide", "de", "s")] * 40 + [("bay area san francisco", "de", "s")] * 7
)


def brute_collocations(rows, least, top, cover=80):
    n, f = Counter(), {}
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w, lang = re.findall(r"[^ \t]+", piece), "und" if lang is None else lang
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        for phrase, a in counts.items():
            w = phrase.split(" ")
            if not (1 < len(w) and a >= least):
                continue
            if any(f" {phrase} " in f" {other} " and other != phrase and b >= least and 100 * b >= cover * a for other, b in counts.items() if other.count(" ") > phrase.count(" ")):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[" ".join(w[:j])] + counts[" ".join(w[j:])]), j, counts[" ".join(w[:j])], counts[" ".join(w[j:])]) for j in range(1, len(w)))
            kept.append((-score, -a, phrase.encode(), left, right))
        out += [{"lang": lang, "rank": i, "phrase": p.decode(), "a": -a, "l": x, "r": y, "n": n[lang], "score": -s} for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("rows", [PHRASED, []])
def test_collocations_against_sql_and_brute_force(spark, rows):
    got = collocations.collocations(docs(spark, rows))
    assert got.columns == COLLOCATIONS
    assert spark_rows(got, COLLOCATIONS) == sql_rows("op13_collocations", rows) == brute_collocations(rows, 30, 2000)


def test_collocations_of_other_thresholds(spark):
    got = collocations.collocations(docs(spark, PHRASED), least=300, top=3)  # counts of four bytes
    assert spark_rows(got, COLLOCATIONS) == brute_collocations(PHRASED, 300, 3)
    got = collocations.collocations(docs(spark, PHRASED), least=5, top=4)
    assert spark_rows(got, COLLOCATIONS) == brute_collocations(PHRASED, 5, 4)


def test_slices_of_a_long_text_lose_no_phrase():
    import numpy as np

    folded = ("new york city hall of. new york\tof the " * 40).encode().translate(fold(collocations.APART, collocations.BREAKS))
    every = np.full(collocations.BUCKETS // 8, 255, np.uint8)

    def counts(parts, k):
        total = Counter()
        for part, own in parts:
            phrases, _, n = collocations.chunk_counts(part, own, np.uint64(1), k, every, every, None)
            total.update(dict(zip(map(str, phrases), n.tolist(), strict=True)))
        return total

    for k in range(1, 5):
        assert counts([(folded, len(folded))], k) == counts(list(slices(folded, 37, reach=3)), k)


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min(places, default=[None])[0], max(places, default=[None])[0], ",".join(sorted({label for _, label in places}))


LICENSED = [
    None, "", "...", "mit license", "MIT-License; the Apache License of the GNU  General Public License, gnu general public", "CC BY-NC 4.0 cc by cc by", "Ömit license mit licence", "permit license cc", MIT, "x " * 50 + MIT + " y" * 50,
    MIT.replace("modify", "alter").replace("sublicense", ""), MIT[:60], "of the software and to the software", TEMPLATES["gpl"][0] + " " + TEMPLATES["apache"][0], "mit license\n" * 3, TEMPLATES["bsd"][0][:-100],
]


def test_licences_base_against_brute_force_and_labels_of_notices(spark):
    found = licences.digest(licences.find_licences(docs(spark, [(t, "en", "s") for t in LICENSED]).withColumnRenamed("rank", "spans"))).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found] == [brute_base(t) for t in LICENSED]
    labels = [r["labels"] for r in found]
    assert labels == ["", "", "", "mit", "apache,gpl,mit", "cc-by", "", "", "mit", "mit", "mit", "", "", "apache,gpl", "mit", "bsd"]
    scores = [r["score"] for r in found]
    assert scores[:3] == [0.0] * 3 and scores[8] == scores[9] == 1.0 and 0.9 < scores[10] < 1 and 0 < scores[15] < 1
    assert licences.find_licences(docs(spark, [])).count() == 0


def test_licence_spans_and_slices(monkeypatch):
    scanner = licences.Scanner(PHRASES, NAMES, TEMPLATES, licences.ANCHOR, licences.GAP, licences.COVER)
    text = "word " * 70 + MIT + " mit license " + "other " * 90 + TEMPLATES["isc"][0] + " gnu general public license"
    whole = scanner.scan([text, None, text])
    assert whole[0] == whole[2] and whole[1][0] == 0
    spans = whole[0][6]
    words = licences.words_of(text)
    assert [(s[0], s[2] - s[1]) for s in spans] == [("mit", len(licences.words_of(MIT))), ("mit", 2), ("isc", len(licences.words_of(TEMPLATES["isc"][0]))), ("gpl", 4)]
    assert words[spans[0][1] : spans[0][2]] == licences.words_of(MIT)
    for most in (37, 300, 1100):
        monkeypatch.setattr(licences, "CHUNK_BYTES", most)
        monkeypatch.setattr(licences.slices, "__defaults__", (most, *licences.slices.__defaults__[1:]))
        assert scanner.scan([text, None, text]) == whole


def test_matching_statistics_against_all_stretches():
    import random

    rng = random.Random(3)
    sequences = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(6)]
    automaton = licences.Automaton(sequences)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(30):
        text = [rng.randrange(1, 5) for _ in range(25)]
        for i, (state, length) in enumerate(automaton.walk(text)):
            longest = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in known))
            assert length == longest
            if length:
                stretch = text[i + 1 - length : i + 1]
                assert sorted(automaton.ends[state]) == sorted((k, e) for k, s in enumerate(sequences) for e in range(length, len(s) + 1) if s[e - length : e] == stretch)
