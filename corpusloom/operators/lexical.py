"""Term statistics and BM25 for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions.text import let, merge_term_counts, term_counts, token_count, tokens

# Alias weight, field weights of the catalog ranking.
ALIAS_WEIGHT = 0.5
FIELD_WEIGHTS = {"title": 2.0, "body": 1.0, "aliases": 0.5}
# Pairs of queries and notes that one task scores, and the most query terms whose counts
# are sent to all tasks; with more of them Spark chooses the join.
TASK_PAIRS = 1_000_000
SENT_TERMS = 200_000


def query_terms(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """queries(query_id, text) -> (query_id, term): distinct terms; the first ``limit`` on request."""
    distinct = F.array_distinct(tokens(F.col("text")))
    kept = F.slice(distinct, 1, limit) if limit else distinct
    return queries.select("query_id", F.explode_outer(kept).alias("term")).where("term is not null")


def note_terms(notes: DataFrame, weights: dict[str, float] | None = None, marked: bool = False) -> DataFrame:
    """One row per note: uri, layer, terms array<struct<term, tf, doc_len>>; if ``marked``,
    with a last entry of the empty term, which stands for the note itself.

    Counting happens inside the row, so no shuffle and no skew: a term that occurs in
    every note is only a short array entry here. The length sits in each entry, so that
    exploding the array carries nothing but the id along.
    """
    has_aliases = "aliases" in notes.columns
    weights = weights or {"title": 1.0, "body": 1.0, "aliases": ALIAS_WEIGHT}
    alias_words = lambda: tokens(F.array_join(md.scoped_aliases(F.col("aliases"), F.col("topics")), "\n"))
    if weights["title"] == weights["body"]:
        text = term_counts(tokens(F.concat_ws("\n", "title", "body")))
        parts = [(text, weights["body"])]
    else:
        parts = [(term_counts(tokens(F.col(name))), weights[name]) for name in ("title", "body")]
    plain = parts[0][0] if len(parts) == 1 and parts[0][1] == 1.0 else merge_term_counts(parts)
    if has_aliases:
        with_aliases = merge_term_counts([*parts, (term_counts(alias_words()), weights["aliases"])])
        counted = F.when(F.size("aliases") > 0, with_aliases).otherwise(plain)
    else:
        counted = plain
    keep = [c for c in ("uri", "layer") if c in notes.columns]

    def with_length(terms):
        total = F.aggregate(terms, F.lit(0.0), lambda n, t: n + t["tf"])
        entry = lambda term, tf, n: F.struct(term.alias("term"), tf.alias("tf"), n.alias("doc_len"))
        own = lambda n: F.transform(terms, lambda t: entry(t["term"], t["tf"], n))
        mark = lambda n: F.array(entry(F.lit(""), F.lit(0.0), n))
        return let(total, lambda n: F.concat(own(n), mark(n)) if marked else own(n))

    return notes.select(*keep, let(counted, with_length).alias("terms"))


def note_lengths(notes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(uri, doc_len) by counting matches only; equals ``note_terms`` without its arrays."""
    weights = weights or {"title": 1.0, "body": 1.0, "aliases": ALIAS_WEIGHT}
    length = token_count(F.col("title")) * weights["title"] + token_count(F.col("body")) * weights["body"]
    if "aliases" in notes.columns:
        joined = F.array_join(md.scoped_aliases(F.col("aliases"), F.col("topics")), "\n")
        length = length + F.when(F.size("aliases") > 0, token_count(joined) * weights["aliases"]).otherwise(0.0)
    return notes.select("uri", length.cast("double").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_notes, total_len, avg_len (1.0 for an empty corpus)."""
    total = F.coalesce(F.sum("doc_len"), F.lit(0.0))
    mean = total / F.greatest(F.count(F.lit(1)), F.lit(1))
    return lengths.agg(
        F.count(F.lit(1)).alias("n_notes"), total.alias("total_len"), F.when(mean == 0, 1.0).otherwise(mean).alias("avg_len")
    )


def postings(terms: DataFrame) -> DataFrame:
    keep = [c for c in ("uri", "layer") if c in terms.columns]
    # The outer form: a plain inline() makes Spark test size(terms) > 0 below the scan,
    # which would tokenise every note twice.
    return terms.select(*keep, F.inline_outer("terms")).where("term is not null")


def term_frequencies(posts: DataFrame) -> DataFrame:
    """Document frequency per term; the count combines map-side, so hot terms are cheap."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def score_tasks(queries: DataFrame, notes: DataFrame) -> int:
    """Tasks for the scores of a batch: as many as keep the pairs of each bounded."""
    usual = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-queries.count() * notes.count() // TASK_PAIRS))


def bm25(terms_by_query: DataFrame, posts: DataFrame, stats: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(query_id, uri, score) for every note sharing a term with a query.

    posts(uri, term, tf, doc_len). With stored ``frequencies`` the postings are read once.
    Without, the matched postings pass one exchange on uri that both the counting and
    the scoring reuse; uris spread evenly however hot a term is, and the score sum needs
    no further exchange. Other joins are left to Spark, which broadcasts only below its
    size threshold and splits skewed terms otherwise.
    """
    matched = posts.select("uri", "term", "tf", "doc_len").join(terms_by_query.select("term").distinct(), "term", "left_semi")
    if frequencies is None:
        matched = matched.repartition("uri")
        frequencies = _counted(matched, terms_by_query)
    return _scored(terms_by_query, matched, stats, frequencies)


def _counted(matched: DataFrame, terms_by_query: DataFrame) -> DataFrame:
    """Notes per term. It reads all columns, so that it shares the exchange of the scoring.

    There is a row per query term; up to ``SENT_TERMS`` they are sent to the postings, which
    else would be shuffled by term and their scores once more.
    """
    counts = matched.groupBy("term").agg(F.count_if((F.col("tf") >= 0) & (F.col("doc_len") >= 0)).alias("df"))
    return F.broadcast(counts) if terms_by_query.select("term").distinct().count() <= SENT_TERMS else counts


def _scored(terms_by_query: DataFrame, matched: DataFrame, stats: DataFrame, frequencies: DataFrame) -> DataFrame:
    facts = stats.select(F.struct("n_notes", "avg_len")).scalar()
    idf = F.log(1 + (F.col("facts.n_notes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("doc_len") / F.col("facts.avg_len"))
    # A posting weighs the same for every query, so weigh first and fan out after.
    weighed = (
        matched.join(frequencies, "term")
        .withColumn("facts", facts)
        .select("uri", "term", (idf * F.col("tf") * 2.2 / norm).alias("weight"))
    )
    return (
        weighed.join(terms_by_query, "term")
        .groupBy("query_id", "uri")
        .agg(F.sum("weight").alias("score"))
        .where("score > 0")
    )


def lexical_search(queries: DataFrame, notes: DataFrame, weights: dict[str, float] | None = None, limit: int | None = None) -> DataFrame:
    """BM25 straight from notes, without stored postings.

    Texts are tokenised once: the exchange that frequencies and scores share also carries a
    row per note, of the empty term, from which number and mean length of the notes come.
    """
    terms = query_terms(queries, limit)
    named = terms.select("term").distinct()
    wanted = named.unionByName(named.sparkSession.range(1).select(F.lit("").alias("term")))
    posts = postings(note_terms(notes, weights, marked=True)).select("uri", "term", "tf", "doc_len")
    matched = posts.join(wanted, "term", "left_semi").repartition(score_tasks(queries, notes), "uri")
    own = (F.col("term") == "") & (F.col("tf") >= 0)
    lengths = matched.select(F.when(own, F.col("doc_len")).alias("doc_len"))
    total, n = F.coalesce(F.sum("doc_len"), F.lit(0.0)), F.count("doc_len")
    mean = total / F.greatest(n, F.lit(1))
    stats = lengths.agg(n.alias("n_notes"), F.when(mean == 0, 1.0).otherwise(mean).alias("avg_len"))
    return _scored(terms, matched, stats, _counted(matched, terms))
