"""Phrases against a count of everything."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import collocations as co

from .oracle import same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q, b in f.items() if len(q) > len(p) and b >= least and 100 * b >= 80 * a]
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out |= {(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}
    return out


def run(spark, docs, top):
    df = spark.createDataFrame([(t, la, 0, "x") for t, la in docs], "text string, lang string, rank int, phrase string").repartition(3)
    return {tuple(r) for r in co.collocations(df, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "x", "yy", "ü", "ÄB", "#", "a-b", "\x00", " ", "q1", "q2", "q3", "q4", "q5"]
    passage = "one two three four five six"
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary[: rng.randrange(2, len(vocabulary))]) for _ in range(rng.randrange(30))]
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words) + 1), passage)
        docs.append(("".join(w + rng.choice([" ", "  ", "\t", ". ", " ", "\n", " ", "\x0b", " "]) for w in words), rng.choice(["en", "en", "fr", None, "und"])))
    return docs + [(None, "en"), ("", None), (".", "fr"), ("long " * 20_000 + "tail", "de"), ("alone", "es")]


@pytest.mark.parametrize(("seed", "first", "top"), [(1, 1, 7), (2, 2, 40), (3, 1, 2000)])
def test_rounds_settle_every_place(spark, monkeypatch, seed, first, top):
    monkeypatch.setattr(co, "LEAST", 3)
    monkeypatch.setattr(co, "FIRST", first)
    monkeypatch.setattr(co, "STEP", 2)
    docs = made(seed)
    assert run(spark, docs, top) == brute(docs, 3, top)


def test_a_full_field_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(co, "LEAST", 3)
    monkeypatch.setattr(co, "bit_field", lambda phrases, m, real=co.bit_field: real(phrases, m) | 255)
    docs = made(4)
    assert run(spark, docs, 25) == brute(docs, 3, 25)


def test_numbers_keep_the_text(spark, monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 100)
    monkeypatch.setattr(co, "LEAST", 3)
    docs = made(5)
    assert run(spark, docs, 10) == brute(docs, 3, 10)


def test_no_rows(spark):
    assert run(spark, [(None, None)], 5) == set()
    df = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(df).count() == 0


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_sql_says_the_same(spark, name):
    assert same(co.collocations(spark.read.parquet(f"/root/testdata/{name}/documents.parquet")), co.COLLOCATIONS_SQL, f"/root/testdata/{name}")


def test_products_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    known = spark.createDataFrame([("en", "a", big), ("en", "b", big)], "lang string, phrase string, f long")
    found = spark.createDataFrame([("en", "a b", 2, big - 1)], "lang string, phrase string, m int, f long")
    row = co.scored(found, known).first()
    assert (row.score, row.l, row.bound) == (2_000_000 * (big - 1) // (2 * big), big, 2_000_000 * (big - 1) // (2 * big - 1))
