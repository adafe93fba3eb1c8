"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import periodic_runs as P
from corpusloom.llm.recompression import Grammar


def plain_runs(words):
    """(start, length, period) by start and period, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def with_repeats(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            a, p = rng.randrange(n), rng.randint(1, n // 6)
            for i in range(a + p, a + rng.randint(0, n - a)):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("questions", [5, P.QUESTIONS])
def test_random_texts(monkeypatch, questions):
    monkeypatch.setattr(P, "QUESTIONS", questions)
    rng = random.Random(questions)
    for _ in range(120):
        texts = [with_repeats(rng, rng.choice([0, 3, 6, 20, 60, 200]), rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(1, 9))]
        found = P.find_runs([np.array(t, np.int64) for t in texts])
        for text, runs in zip(texts, found, strict=True):
            assert list(zip(*[x.tolist() for x in runs], strict=True)) == plain_runs(text)


def test_grammar_answers_every_pair():
    rng = random.Random(3)
    for kinds in (1, 2, 3, 30):
        text = [-1, *with_repeats(rng, 70, kinds), -2, *with_repeats(rng, 40, kinds), -3]
        grammar = Grammar.of(np.array(text))
        x, y = np.triu_indices(len(text), 1)

        def plain(i, j):
            k = 0
            while j + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            return k

        assert grammar.common(x, y).tolist() == [plain(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert all(len(a.symbols) < len(b.symbols) for a, b in zip(grammar.levels[1:], grammar.levels, strict=False))


def answer(doc_id, text):
    """The row that the query owes for one document."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_on_the_small_tables_and_on_awkward_rows(spark, place):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in with_repeats(rng, rng.choice([5, 40, 150]), rng.choice([2, 4, 40])))) for i in range(150)]
    rows += [(None, "a b " * 9), (None, None), (3, None), (3, ""), (4, " \t\n"), (5, "x" * 5000 + "\x0b" + "  é é é é é é"), (5, "one"), (6, "z " * 4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.withColumns({c: F.lit("x") for c in ("id", "runs", "best", "collapsed", "n_words")}).write.parquet(f"{place}/documents.parquet")
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in P.op12_periodic_runs(spark, place).collect()), key=key) == sorted((answer(*r) for r in rows), key=key)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    expected = sorted((answer(*r) for r in small.collect() if len(r.text.split()) < 1500), key=key)
    assert len(expected) > 150
    got = {tuple(r) for r in P.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert set(expected) <= got
    assert P.periodic_runs(docs.filter("false")).count() == 0
