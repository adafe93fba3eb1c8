"""Top-k per query, route clean-up and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Float sums depend on the order of their terms, so ranks compare rounded scores.
RANK_DIGITS = 9
# Rank constant of the fusion votes, boost of a preferred topic.
RANK_CONSTANT = 60
TOPIC_BOOST = 1.25


def ranked(scores: DataFrame, key: str = "query_id", tie: str = "uri") -> DataFrame:
    """All rows with their rank per query by (-score, tie)."""
    order = Window.partitionBy(key).orderBy(F.round("score", RANK_DIGITS).desc(), tie)
    return scores.withColumn("rank", F.row_number().over(order))


def top_k(scores: DataFrame, k: int, key: str = "query_id", tie: str = "uri") -> DataFrame:
    """The k best rows per query by (-score, tie), with their rank.

    Spark limits each map task to k rows per query before the shuffle
    (WindowGroupLimit), so a query that matches everything stays cheap.
    """
    return ranked(scores, key, tie).where(F.col("rank") <= k)


def first_occurrences(route: DataFrame) -> DataFrame:
    """Drop repeats of a uri within a query, keep the route's order, re-rank without gaps.

    route(query_id, uri, position, score): a repeat never moves the ranks behind it.
    Repeats are combined map-side; a route is as long as its caller asked for.
    """
    first = route.groupBy("query_id", "uri").agg(F.min_by(F.struct("position", "score"), "position").alias("hit"))
    flat = first.select("query_id", "uri", F.col("hit.position").alias("position"), F.col("hit.score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("position", "uri")
    return flat.withColumn("rank", F.row_number().over(order)).drop("position")


def best_per_uri(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "uri").agg(F.max("score").alias("score"))


def fuse(vector: DataFrame | None, lexical: DataFrame) -> DataFrame:
    """Fuse two ranked routes(query_id, uri, rank, score) into one scored list.

    Each route votes 1/(60+rank). The stronger vote counts in full; agreement adds the
    weaker vote scaled by the lexical score relative to the query's best finite positive
    one. Vector score units are never used. Without a vector route the votes are the
    lexical ones.
    """
    if vector is None:
        vote = (F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))).alias("score")
        return lexical.select("query_id", "uri", vote, F.array(F.lit("lexical")).alias("methods"))
    usable = F.when((F.col("score") > 0) & ~F.isnan("score") & (F.col("score") != float("inf")), F.col("score"))
    left = vector.select("query_id", "uri", (F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))).alias("vector_vote"))
    right = lexical.select(
        "query_id", "uri", (F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))).alias("lexical_vote"), usable.alias("lexical_score")
    )
    best = right.groupBy("query_id").agg(F.max("lexical_score").alias("best_score"))
    both = F.col("vector_vote").isNotNull() & F.col("lexical_vote").isNotNull()
    agreement = F.coalesce(F.col("lexical_score") / F.col("best_score"), F.lit(0.0))
    return (
        left.join(right, ["query_id", "uri"], "full_outer")
        .join(best, "query_id", "left")
        .select(
            "query_id",
            "uri",
            (
                F.greatest("vector_vote", "lexical_vote")
                + F.when(both, F.least("vector_vote", "lexical_vote") * agreement).otherwise(0.0)
            ).alias("score"),
            F.filter(
                F.array(
                    F.when(F.col("vector_vote").isNotNull(), F.lit("vector")), F.when(F.col("lexical_vote").isNotNull(), F.lit("lexical"))
                ),
                lambda m: m.isNotNull(),
            ).alias("methods"),
        )
    )


def prefers(topics: Column, wanted: Column) -> Column:
    """Caseless: does the note carry one of the wanted topics?"""
    return F.coalesce(F.arrays_overlap(F.transform(topics, F.lower), F.transform(wanted, F.lower)), F.lit(False))


def _with_topics(scores: DataFrame, note_topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """``scores`` with ``fits`` (the note carries a topic its query wants) and ``asking``.

    The topics of a note are one thin row, hashed where the scores of the note already are:
    the pairs of queries and notes are neither shuffled nor sorted nor listed twice.
    """
    held = note_topics.groupBy("uri").agg(F.collect_set("topic").alias("held"))
    asked = wanted.groupBy("query_id").agg(F.collect_set("topic").alias("asked"))
    joined = scores.join(held.hint("shuffle_hash"), "uri", "left").join(asked, "query_id", "left")
    fits = F.coalesce(F.arrays_overlap("held", "asked"), F.lit(False)).alias("fits")
    return joined.select(*scores.columns, fits, F.col("asked").isNotNull().alias("asking"))


def boost_preferred(scores: DataFrame, note_topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Preference reorders and never hides: score x 1.25 where a wanted topic matches.

    scores(query_id, uri, score), note_topics(uri, topic), wanted(query_id, topic).
    """
    judged = _with_topics(scores, note_topics, wanted).withColumn("preferred", F.when(F.col("fits"), F.lit(True)))
    return judged.withColumn("score", F.col("score") * F.when(F.col("fits"), TOPIC_BOOST).otherwise(1.0)).drop("fits", "asking")


def only_topics(scores: DataFrame, note_topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keep hits that carry a topic their query asks for; queries that ask none keep all.

    Topics are looked up for the hits, so a topic of very many notes never meets all the
    queries that ask for it.
    """
    return _with_topics(scores, note_topics, wanted).where(F.col("fits") | ~F.col("asking")).drop("fits", "asking")
