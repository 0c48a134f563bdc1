"""Phrase mining against counting every phrase, and the automaton against its definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillmill.llm import phrases
from quillmill.llm.queries import op12_phrases

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, most=3, least=10, top=2000, percent=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), longer in found.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * longer >= percent * found[lang, w[i:j]]:
                    gone.add((lang, w[i:j]))
    out = {}
    for (lang, w), a in found.items():
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        if (lang, w) not in gone:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "A", "é", "日本", "x-y", "q r", "d", "e"]
    return [(rng.choice(["en", "en", "en", None, "und", "de"]), None if rng.random() < 0.05 else "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!?"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("most", "least", "shard", "pairs"), [(3, 10, 1 << 20, 1000), (3, 3, 200, 0), (4, 2, 500, 1000), (5, 2, 90, 0), (2, 5, 300, 1000)])
def test_against_counting(spark, most, least, shard, pairs):
    rows = texts(most * least, 60)
    df = spark.createDataFrame([(i, lang, t, "clash") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    assert got(phrases.mine_phrases(df, most, least, 25, 50, pairs, shard)) == plain(rows, most, least, 25)


def test_query_on_given_table(spark, sf):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got(op12_phrases(spark, sf)) == plain(rows)


def test_odd_rows_and_empty_table(spark, odd):
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    assert got(phrases.mine_phrases(odd)) == plain(rows)
    assert phrases.mine_phrases(odd.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    a = 3_000_000_000
    words = spark.createDataFrame([("en", 1, "x", a), ("en", 1, "y", a + 1)], "lang string, length int, phrase string, f long")
    pairs = spark.createDataFrame([("en", 2, "x y", a)], "lang string, length int, phrase string, f long")
    original = phrases.phrase_counts
    try:
        phrases.phrase_counts = lambda *_: (words, pairs)
        assert [tuple(r) for r in phrases.mine_phrases(words).collect()] == [("en", 1, "x y", a, a, a + 1, 2 * a + 1, 1_000_000 * a * a // (a * (a + 1)))]
    finally:
        phrases.phrase_counts = original


def test_states_are_classes_of_ends():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 400).astype(np.int32)
    piece = np.sort(rng.integers(0, 20, 400))
    automaton = phrases.PhraseAutomaton(ids, piece, 4)
    ends = {}
    for i in range(400):
        for m in range(1, 5):
            if i - m + 1 >= 0 and piece[i - m + 1] == piece[i]:
                ends.setdefault(tuple(ids[i - m + 1 : i + 1]), []).append(i)
    classes = {}
    for w, at in ends.items():
        classes.setdefault(tuple(at), []).append(len(w))
    states = [(int(h), int(low), int(c), int(e)) for parts in automaton.states() for h, low, c, e in zip(*parts, strict=True)]
    assert sorted((max(m), min(m), len(at)) for at, m in classes.items()) == sorted(s[:3] for s in states)
    for m in range(1, 5):
        e, c = automaton.substrings(m)
        assert {tuple(ids[x - m + 1 : x + 1]): int(n) for x, n in zip(e, c, strict=True)} == {w: len(at) for w, at in ends.items() if len(w) == m}
