import math
import random

import pytest

from pyspark.sql import functions as F

from corpusloom.operators import lexical, ranking, vector


def route(spark, items):
    return spark.createDataFrame([("q", u, i, float(s)) for i, (u, s) in enumerate(items)], "query_id string, uri string, position int, score double")


def fused(spark, vec, lex):
    v, l = (ranking.first_occurrences(route(spark, r)) for r in (vec, lex))
    return {r.uri: (r.score, r.methods) for r in ranking.fuse(v, l).collect()}


def test_repeats_do_not_move_ranks(spark):
    out = fused(spark, [("a", 1), ("a", 1), ("b", 1)], [("z", 1)])
    assert out["b"][0] == pytest.approx(1 / 62) and out["b"][1] == ["vector"]


def test_agreement_scales_with_lexical_strength_only(spark):
    out = fused(spark, [("a", 1e9), ("b", 1)], [("b", 4), ("a", 1)])
    assert out["a"][0] == pytest.approx(1 / 61 + 1 / 62 / 4) and out["b"][0] == pytest.approx(1 / 61 + 1 / 62)
    assert fused(spark, [("a", 1), ("b", 1)], [("b", 40), ("a", 10)])["a"][0] == pytest.approx(out["a"][0])
    assert out["a"][1] == ["vector", "lexical"]


@pytest.mark.parametrize("bad", [0.0, -1.0, math.nan, math.inf])
def test_unusable_lexical_scores_keep_only_their_rank_vote(spark, bad):
    out = fused(spark, [("a", 1), ("b", 1)], [("a", bad), ("b", 2)])
    assert out["a"][0] == pytest.approx(1 / 61) and out["b"][0] == pytest.approx(2 / 62)


def test_flat_lexical_scores_are_plain_fusion(spark):
    out = fused(spark, [("a", 1), ("b", 1)], [("b", 3), ("a", 3)])
    assert out["a"][0] == pytest.approx(1 / 61 + 1 / 62) == out["b"][0]


def test_vector_tiles_equal_brute_force(spark):
    rng = random.Random(7)
    vec = [(f"u{i % 40:02d}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [("zero", [0.0] * 5)]
    que = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(9)]
    vectors = spark.createDataFrame(vec, "uri string, vector array<double>")
    queries = spark.createDataFrame(que, "query_id long, vector array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1)
    expected = {}
    for q, a in que:
        best = {}
        for u, b in vec:
            best[u] = max(best.get(u, -2), round(cos(a, b), 9))
        expected[q] = [u for u, _ in sorted(best.items(), key=lambda e: (-e[1], e[0]))[:6]]
    for tiles in ((1000, 1000), (7, 2)):
        rows = vector.vector_topk(queries, vectors, 6, *tiles).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append(r.uri)
        assert got == expected


def test_topics_prefer_reorders_and_only_filters(spark):
    scores = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.9), ("p", "a", 1.0)], "query_id string, uri string, score double")
    topics = spark.createDataFrame([("b", "t")], "uri string, topic string")
    wanted = spark.createDataFrame([("q", "t")], "query_id string, topic string")
    boosted = ranking.top_k(ranking.boost_preferred(scores, topics, wanted), 5).where("query_id = 'q'").orderBy("rank").collect()
    assert [r.uri for r in boosted] == ["b", "a"]
    assert {(r.query_id, r.uri) for r in ranking.only_topics(scores, topics, wanted).collect()} == {("q", "b"), ("p", "a")}


def test_topics_over_pairs(spark):
    scores = spark.createDataFrame([(q, f"n{u}", float(u)) for q in range(3) for u in range(4)], "query_id int, uri string, score double")
    topics = spark.createDataFrame([("n0", "a"), ("n1", "a"), ("n1", "b"), ("n2", "b")], "uri string, topic string")
    wanted = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b")], "query_id int, topic string")
    fits = {(0, "n0"), (0, "n1"), (0, "n2"), (1, "n1"), (1, "n2")}
    kept = {(r.query_id, r.uri) for r in ranking.only_topics(scores, topics, wanted).collect()}
    assert kept == fits | {(2, f"n{u}") for u in range(4)}
    boosted = ranking.boost_preferred(scores, topics, wanted).collect()
    assert len(boosted) == 12 and all(r.score == float(r.uri[1]) * (1.25 if (r.query_id, r.uri) in fits else 1.0) for r in boosted)


def test_texts_are_tokenised_once_and_pairs_stay_where_they_are(spark):
    notes = spark.createDataFrame([(f"n{i}", "t", f"alpha beta w{i} alpha") for i in range(20)] + [("e", "", "")], "uri string, title string, body string")
    queries = spark.createDataFrame([(1, "alpha w3"), (2, "beta w5 w6")], "query_id int, text string")
    topics = notes.select("uri", F.lit("x").alias("topic"))
    found = ranking.top_k(ranking.only_topics(lexical.lexical_search(queries, notes), topics, queries.select("query_id", F.lit("x").alias("topic"))), 3)
    rows = found.collect()
    assert {(r.query_id, r.uri) for r in rows if r["rank"] == 1} == {(1, "n3"), (2, "n5")}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(query_id#" in plan and not any("query_id" in line and "uri" in line for line in plan.split("\n") if "hashpartitioning" in line)
    assert "ReusedExchange" in plan or plan.count("hashpartitioning(uri") <= 2


def test_tasks_grow_with_the_pairs(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lexical.score_tasks(spark.range(200), spark.range(1000)) == usual
    assert lexical.score_tasks(spark.range(200), spark.range(3_000_000)) == 600
