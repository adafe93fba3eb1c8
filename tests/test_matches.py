"""Batches scored match by match: bounded tasks, and the answers of scoring from postings."""

import test_pruned
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions import text
from corpusloom.operators import lexical, pruned


def test_matches_are_scored_in_tasks_of_bounded_pairs(spark, monkeypatch):
    monkeypatch.setattr(pruned, "TASK_PAIRS", 50)
    notes = spark.createDataFrame([(f"u{i}", f"t{i % 7}", f"common w{i % 5} w{i % 11} straße") for i in range(100)], "uri string, title string, body string")
    queries = spark.createDataFrame([(i, f"common w{i} strasse absent") for i in range(10)], "query_id int, text string")
    posts = lexical.postings(lexical.note_terms(notes)).cache()
    stats, counts = lexical.corpus_stats(lexical.note_lengths(notes)), lexical.term_frequencies(posts)
    terms, blocks = lexical.query_terms(queries), pruned.build_blocks(posts, stats, counts)
    found = pruned.pruned_scores(terms, blocks, stats, counts, 8)
    assert found.rdd.getNumPartitions() == 20
    rows = lambda scores: sorted((r.query_id, r.uri, round(r.score, 7)) for r in scores.collect())
    assert rows(found) == rows(lexical.bm25(terms, posts, stats, counts)) and found.count() == 1000


def test_titles_and_folds_of_odd_texts(spark):
    raw = [None, "", " \n ", "plain #1\nmore", "a\n# Head \nb", "#x\n", "　first second"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = rows.select("i", md.title_of(F.col("raw")).alias("t"), md.body_of(F.col("raw")).alias("b")).orderBy("i").collect()
    assert [r.t for r in got] == ["untitled", "untitled", "untitled", "plain #1", "Head", "#x", "first"]
    assert [r.b for r in got] == [None, "", "", "plain #1\nmore", "a\n\nb", "#x", "first second"]
    folded = spark.createDataFrame([(c, w) for c, w in text.FOLDS.items()], "c string, w string")
    assert folded.where(text.fold(F.concat(F.lit("Aé"), "c")) != F.concat(F.lit("aé"), "w")).count() == 0


def test_snapshots_scored_match_by_match(spark, monkeypatch, place):
    monkeypatch.setattr(pruned, "BLOCK", 20)
    test_pruned.test_snapshots_topics_and_changed_means(spark, None, place)
