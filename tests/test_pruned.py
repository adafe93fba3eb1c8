"""Pruned top-k over stored blocks against scoring every match."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical, pruned, ranking
from corpusloom.plans import catalog
from corpusloom.plans import search as plan

SHAPE = "uri string, layer string, root string, path string, stat_key string, fingerprint string, title string, body string, topics array<string>, v int"


def some_notes(spark, rng, ids, v=0):
    """Words of very different frequency; ``w0`` stands in nearly every note."""
    rows = []
    for i in ids:
        words = [f"w{min(int(rng.paretovariate(0.6)) - 1, 400)}" for _ in range(rng.choice([0, 3, 20, 60]))]
        rows.append((f"u{i:04}", "project", "/r", f"/r/{i}", f"{v}", f"{v}-{i}", "t", " ".join(words), [f"t{i % 3}"], v))
    return spark.createDataFrame(rows, SHAPE).repartition(4)


def some_queries(spark, rng):
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.4)) - 1, 420)}" for _ in range(rng.choice([1, 2, 8, 25]))) for _ in range(30)]
    return spark.createDataFrame(list(enumerate([*texts, "nowhere", "w0 w0"])), "query_id int, text string")


def best(scores, k):
    return sorted((r.query_id, r["rank"], r.uri, round(r.score, 7)) for r in ranking.top_k(scores, k).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK", 20)
    monkeypatch.setattr(pruned, "PLAIN_ROWS", 0)


@pytest.mark.parametrize("k", [1, 8])
def test_equals_scoring_every_match(spark, small_blocks, k):
    rng = random.Random(k)
    notes, queries = some_notes(spark, rng, range(600)), some_queries(spark, rng)
    posts = lexical.postings(lexical.note_terms(notes)).cache()
    stats, counts = lexical.corpus_stats(lexical.note_lengths(notes)), lexical.term_frequencies(posts)
    blocks = pruned.build_blocks(posts, stats, counts).cache()
    assert blocks.agg(F.max("size")).first()[0] <= 60 and blocks.agg(F.sum("size")).first()[0] == posts.count()
    terms = lexical.query_terms(queries)
    every = lexical.bm25(terms, posts, stats, counts)
    found = pruned.pruned_scores(terms, blocks, stats, counts, k)
    assert best(found, k) == best(every, k)
    # The other way for batches of few matches.
    asked = pruned.asked_terms(terms, stats, counts)
    assert best(pruned.score_matches(asked, blocks, lambda posts: posts, lambda pairs: pairs), k) == best(every, k)
    assert found.count() < every.count() / 2


def test_snapshots_topics_and_changed_means(spark, small_blocks, place):
    rng = random.Random(9)
    root = f"{place}/catalog"
    mounted = spark.createDataFrame([("/r",)], "root string")
    notes = some_notes(spark, rng, range(300)).cache()
    catalog.refresh(notes, root, mounted, mounted)
    # Half is rewritten, far longer than before, and some notes go.
    fresh = some_notes(spark, rng, range(0, 280, 2), 1).withColumn("body", F.concat_ws(" ", "body", F.repeat(F.lit("w1 w2 pad "), 40))).cache()
    after = notes.where("int(substr(uri, 2)) % 2 = 1").unionByName(fresh).cache()
    stored, _ = catalog.refresh(after, root, mounted, mounted)
    assert not stored.full
    queries = some_queries(spark, rng)
    asked = plan.read_directives(queries.withColumn("text", F.when(F.col("query_id") % 2 == 0, F.concat("text", F.lit(" topic:t1"))).otherwise(F.col("text"))))
    for mode in ("prefer", "only"):
        wanted = asked.withColumn("mode", F.lit(mode))
        shape = lambda hits: sorted((r.query_id, r["rank"], r.uri, round(r.score, 7)) for r in hits.collect())
        assert shape(plan.lexical_route(wanted, after, 8, stored.index())) == shape(plan.lexical_route(wanted, after, 8))
    counted = {r.term: r.df for r in lexical.term_frequencies(lexical.postings(lexical.note_terms(after))).collect()}
    assert {r.term: r.df for r in stored.frequencies().collect()} == counted
