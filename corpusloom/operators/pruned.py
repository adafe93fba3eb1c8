"""Exact top-k over stored posting blocks that reads and scores only what can win.

Postings of one term are stored in blocks of like weight, each with the best weight that
it can give (``peak``). For a batch of queries:

1. the best blocks of every term give partial scores; the notes that lead them are scored
   in full, and the k-th best of these is the score to beat (``floor``) of the query;
2. a query's terms stand by the best that they can give. A note whose first matching term
   is t gains at most the weight of its block of t plus the best of the terms behind t, so
   only blocks where that sum reaches the floor name candidates. Terms whose tail sum stays
   below it, the common ones, name none;
3. candidates are scored in full: of every term only the block that would hold the note
   is opened.

Every note that can be among the k best is a candidate, and scores are complete, so ranks
equal those of scoring every match. What is gathered per query follows its candidates.

A batch of up to ``PLAIN_ROWS`` matches, known from the document frequencies, is scored match
by match, as bounds then cost more than they save; the answer is the same. With the postings
at hand such a batch asks for no blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lexical import SENT_TERMS, TASK_PAIRS
from corpusloom.operators.ranking import RANK_DIGITS
from corpusloom.session import materialize

# Postings of a term with more notes than this are split by the note's hash as well.
BLOCK = 512
# Blocks per unit of weight; weights lie between 0 and 2.2.
STEPS = 5
FIRST_BLOCKS = 2
PLAIN_ROWS = 5_000_000_000
SHORTLIST = 4
# Bounds are compared with this slack, as ranks compare scores of RANK_DIGITS digits.
SLACK = 10.0 ** -(RANK_DIGITS - 2)

Pairs = Callable[[DataFrame], DataFrame]


def _relative(tf: Column, doc_len: Column, mean: Column) -> Column:
    """Term frequency relative to the note's length: weights grow with it alone."""
    return tf / (0.25 + 0.75 * doc_len / mean)


def _weight(relative: Column) -> Column:
    return 2.2 * relative / (relative + 1.2)


def _part(uri: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(uri), parts).cast("int")


def build_blocks(posts: DataFrame, stats: DataFrame, frequencies: DataFrame) -> DataFrame:
    """posts(uri, term, tf, doc_len) -> (term, parts, part, step, peak, mean, size, posts).

    A term of few notes is one block per step of weight; others are dealt into ``parts`` by
    a hash of the note, so no block grows with the corpus.
    """
    # Only terms of many notes need their count; all others are one part.
    common = frequencies.where(F.col("df") > BLOCK).select("term", F.ceil(F.col("df") / BLOCK).cast("long").alias("parts"))
    # Up to ``SENT_TERMS`` of them are sent; postings then pass one exchange, dealt by their part.
    sent = F.broadcast if common.count() <= SENT_TERMS else lambda rows: rows
    sized = posts.join(sent(common), "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mean = stats.select("avg_len").scalar()
    rated = sized.withColumn("mean", mean).withColumn("relative", _relative(F.col("tf"), F.col("doc_len"), F.col("mean")))
    step = F.when(F.col("parts") > 1, F.floor(_weight(F.col("relative")) * STEPS)).otherwise(0).cast("int")
    placed = rated.withColumn("part", _part(F.col("uri"), F.col("parts"))).withColumn("step", step)
    return (
        placed.repartition("term", "part")
        .groupBy("term", "parts", "part", "step")
        .agg(
            F.max("relative").alias("peak"), F.first("mean").alias("mean"), F.count(F.lit(1)).alias("size"),
            F.collect_list(F.struct("uri", "tf", "doc_len")).alias("posts"),
        )
        .sortWithinPartitions("term", "step")
    )


def asked_terms(terms_by_query: DataFrame, stats: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(query_id, term, idf, mean) of the terms that occur; mean is the average length."""
    facts = stats.select(F.struct("n_notes", "avg_len")).scalar()
    idf = F.log(1 + (F.col("facts.n_notes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    joined = terms_by_query.join(frequencies, "term").withColumn("facts", facts)
    return joined.select("query_id", "term", idf.alias("idf"), F.col("facts.avg_len").alias("mean"))


def _opened(blocks: DataFrame, live: Pairs) -> DataFrame:
    """(term, uri, tf, doc_len, bound) of blocks that were chosen."""
    keep = [c for c in ("snapshot", "bound") if c in blocks.columns]
    return live(blocks.select("term", *keep, F.inline("posts")))


def score_pairs(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, live: Pairs) -> DataFrame:
    """Full scores of (query_id, uri) pairs, opening only blocks that may hold them."""
    layout = blocks.select("term", "parts").distinct()
    needs = pairs.select("query_id", "uri").join(asked, "query_id")
    keys = needs.select("term", "uri").distinct().join(layout, "term").select("term", "parts", _part(F.col("uri"), F.col("parts")).alias("part")).distinct()
    found = _opened(blocks.join(keys, ["term", "parts", "part"], "left_semi"), live)
    weight = F.col("idf") * _weight(_relative(F.col("tf"), F.col("doc_len"), F.col("mean")))
    return needs.join(found, ["term", "uri"]).groupBy("query_id", "uri").agg(F.sum(weight).alias("score"))


def candidates(
    asked: DataFrame, blocks: DataFrame, k: int, live: Pairs = lambda posts: posts, allowed: Pairs = lambda pairs: pairs, gain: float = 1.0
) -> DataFrame:
    """(query_id, uri) pairs that can be among the k best of their query.

    ``live`` drops postings that are no longer valid, ``allowed`` drops pairs that a query
    does not want; ``gain`` is the most by which a score may be multiplied afterwards.
    """
    # A later snapshot may have another mean length: weights then grow by at most this ratio.
    terms = asked.groupBy("term").agg(F.first("idf").alias("idf"), F.first("mean").alias("now"))
    stretched = F.col("peak") * F.greatest(F.lit(1.0), F.col("now") / F.col("mean"))
    heads = blocks.drop("posts").join(terms, "term").withColumn("bound", F.col("idf") * _weight(stretched))
    best = Window.partitionBy("term").orderBy(F.desc("bound"), "parts", "part", "step")
    key = [c for c in ("term", "parts", "part", "step", "snapshot") if c in blocks.columns]
    first = heads.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST_BLOCKS)
    weight = F.col("idf") * _weight(_relative(F.col("tf"), F.col("doc_len"), F.col("mean")))
    partial = _opened(blocks.join(first.select(*key), key, "left_semi"), live).join(asked, "term")
    partial = allowed(partial.groupBy("query_id", "uri").agg(F.sum(weight).alias("score")))

    def kth(scores: DataFrame, n: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "uri")
        return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)

    shortlist = materialize(kth(partial, SHORTLIST * k).select("query_id", "uri"), "shortlist")
    known = kth(score_pairs(shortlist, asked, blocks, live), k)
    floors = known.where(F.col("place") == k).select("query_id", (F.col("score") - SLACK).alias("floor"))

    # What the terms behind this one can give at most, in the order of their best blocks.
    tops = heads.groupBy("term").agg(F.max("bound").alias("top"))
    behind = Window.partitionBy("query_id").orderBy(F.desc("top"), "term").rowsBetween(1, Window.unboundedFollowing)
    rated = asked.join(tops, "term").withColumn("rest", F.coalesce(F.sum("top").over(behind), F.lit(0.0)))
    rated = rated.join(floors, "query_id", "left").withColumn("need", F.coalesce(F.col("floor") / gain, F.lit(0.0)) - F.col("rest"))
    naming = materialize(rated.where(F.col("top") >= F.col("need")).select("query_id", "term", "need"), "naming")
    # A block is opened once, if any query needs it, and then meets only those that do.
    least = naming.groupBy("term").agg(F.min("need").alias("least"))
    chosen = heads.join(least, "term").where(F.col("bound") >= F.col("least")).select(*key, "bound")
    named = _opened(blocks.join(chosen, key), live).join(naming, "term").where(F.col("bound") >= F.col("need"))
    return allowed(named.select("query_id", "uri").distinct())


def pruned_scores(
    terms_by_query: DataFrame, blocks: DataFrame | Callable[[], DataFrame], stats: DataFrame, frequencies: DataFrame, k: int,
    live: Pairs = lambda posts: posts, allowed: Pairs = lambda pairs: pairs, gain: float = 1.0, posts: DataFrame | None = None,
) -> DataFrame:
    """(query_id, uri, score) of all notes that can be among the k best of their query.

    ``blocks`` may be a function that gives them; valid ``posts``(uri, term, tf, doc_len) serve
    batches that are scored match by match.
    """
    asked = asked_terms(terms_by_query, stats, frequencies)
    matches = terms_by_query.join(frequencies, "term").agg(F.sum("df")).first()[0] or 0
    if matches <= PLAIN_ROWS and posts is not None:
        return score_matches(asked, None, live, allowed, stats, posts)
    blocks = blocks if isinstance(blocks, DataFrame) else blocks()
    if matches <= PLAIN_ROWS:
        return score_matches(asked, blocks, live, allowed, stats)
    asked = materialize(asked, "asked")
    pairs = materialize(candidates(asked, blocks, k, live, allowed, gain), "candidates")
    return score_pairs(pairs, asked, blocks, live).where("score > 0")


def score_matches(
    asked: DataFrame, blocks: DataFrame | None, live: Pairs, allowed: Pairs, stats: DataFrame | None = None, posts: DataFrame | None = None
) -> DataFrame:
    """Full scores of every match. A posting weighs the same for every query, so postings
    are weighed first and pass one exchange by note; they meet the queries behind it, where
    a task holds about ``TASK_PAIRS`` sums, if ``stats`` tell the number of notes, and nothing
    else is shuffled. Up to ``SENT_TERMS`` query terms are sent to the postings, in ``posts`` or
    in their blocks, which else would be shuffled."""
    asked = materialize(asked, "asked")
    n_queries, n_asked = asked.agg(F.count_distinct("query_id"), F.count(F.lit(1))).first()
    sent = F.broadcast if n_asked <= SENT_TERMS else lambda rows: rows
    usual = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_notes = stats.first()["n_notes"] if stats else 0
    tasks = max(usual, -(-n_queries * n_notes // TASK_PAIRS))
    terms = asked.groupBy("term").agg(F.first("idf").alias("idf"), F.first("mean").alias("mean"))
    if posts is None:
        posts = _opened(blocks.join(sent(terms.select("term")), "term", "left_semi"), live)
    found = posts.join(sent(terms), "term")
    weight = F.col("idf") * _weight(_relative(F.col("tf"), F.col("doc_len"), F.col("mean")))
    weighed = found.select("uri", "term", weight.alias("weight")).repartition(tasks, "uri")
    scores = weighed.join(sent(asked.select("query_id", "term")), "term").groupBy("query_id", "uri").agg(F.sum("weight").alias("score"))
    return allowed(scores.where("score > 0"))
