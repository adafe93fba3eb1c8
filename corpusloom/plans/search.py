"""From a batch of text queries to fused, source-bound results in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions.text import tokens
from corpusloom.operators import lexical, pruned, ranking
from corpusloom.operators.excerpts import DEFAULT_QUERY_CHARS, MAX_RESULTS, excerpts
from corpusloom.operators.vector import vector_topk
from corpusloom.session import materialize

# How far each route reads beyond the wanted results.
FETCH_FACTOR, MIN_FETCH = 4, 16


@dataclass(frozen=True)
class Index:
    """Stored search tables of one catalog snapshot (see ``plans.catalog``); ``blocks`` stores
    the posting blocks when they are first asked for."""

    postings: DataFrame
    stats: DataFrame
    frequencies: DataFrame | None = None
    blocks: Callable[[], DataFrame] | None = None
    valid: Callable[[DataFrame], DataFrame] = lambda posts: posts


def fetch_size(limit: int) -> tuple[int, int]:
    if limit < 1:
        raise ValueError("limit must be positive")
    cap = min(limit, MAX_RESULTS)
    return cap, max(cap * FETCH_FACTOR, MIN_FETCH)


def read_directives(queries: DataFrame, selection: dict | None = None) -> DataFrame:
    """queries(query_id, text) -> (query_id, text, topics, mode); blank texts are dropped."""
    default = None
    if selection:
        topics = [t for t in selection.get("topics", []) if isinstance(t, str)]
        default = F.struct(
            F.array(*[F.lit(t) for t in topics]).cast("array<string>").alias("topics"), F.lit(selection.get("mode", "prefer")).alias("mode")
        )
    return (
        queries.where(md.strip(F.col("text")) != "")
        .select("query_id", md.query_directives(F.col("text"), default).alias("d"))
        .select("query_id", "d.text", F.transform("d.topics", F.lower).alias("topics"), "d.mode")
    )


def known_layers(layers: list[str] | None) -> list[str]:
    """Unknown names are ignored; none at all means every layer."""
    return [name for name in (layers or md.LAYERS) if name in md.LAYERS]


def active_release(notes: DataFrame, pointer: DataFrame | None) -> DataFrame:
    """Drop imported shared notes that are outside the one active release.

    pointer(root_uri) has one row; imported notes are shared ones without a root.
    """
    imported = (F.col("layer") == "shared") & (F.col("root") == "")
    if pointer is None:
        return notes.where(~imported)
    prefix = pointer.agg(F.concat(F.rtrim(F.max("root_uri"), F.lit("/")), F.lit("/"))).scalar()
    return notes.where(~imported | F.startswith("uri", prefix))


def valid_hits(hits: DataFrame, notes: DataFrame, layers: list[str], active_prefix: str = "") -> DataFrame:
    """Vector hits whose note exists in a searched layer, or that belong to the active release."""
    known = notes.select("uri", F.col("layer").alias("note_layer"))
    in_release = F.startswith("uri", F.lit(active_prefix)) if active_prefix else F.lit(False)
    layer = F.coalesce("note_layer", md.layer_from_uri(F.col("uri")), F.lit("shared"))
    own_shared = F.contains("uri", F.lit(f"/{md.SHARED_FOLDER}/"))
    return (
        hits.join(known, "uri", "left")
        .where((F.col("note_layer").isNotNull() | in_release) & layer.isin(*layers))
        .where((layer != "shared") | F.col("note_layer").isNull() | own_shared | in_release)
        .drop("note_layer")
    )


def lexical_route(asked: DataFrame, notes: DataFrame, fetch: int, index: Index | None = None) -> DataFrame:
    """Ranked lexical hits (query_id, uri, score, rank) after topic rules."""
    wanted = asked.select("query_id", "mode", F.explode("topics").alias("topic"))
    topics = notes.select("uri", F.explode(F.array_distinct(F.transform("topics", F.lower))).alias("topic"))
    only = lambda pairs: ranking.only_topics(pairs, topics, wanted.where("mode = 'only'"))
    terms = lexical.query_terms(asked)
    if index is None:
        kept = only(lexical.lexical_search(asked, notes))
    elif index.blocks is not None:
        pool = notes.select("uri")
        live = lambda posts: index.valid(posts).join(pool, "uri", "left_semi")
        posts = index.postings.join(pool, "uri", "left_semi")
        kept = pruned.pruned_scores(terms, index.blocks, index.stats, index.frequencies, fetch, live, only, ranking.TOPIC_BOOST, posts)
    else:
        posts = index.postings.join(notes.select("uri"), "uri", "left_semi")
        kept = only(lexical.bm25(terms, posts, index.stats, index.frequencies))
    return ranking.top_k(ranking.boost_preferred(kept, topics, wanted).drop("preferred"), fetch)


def search(
    queries: DataFrame,
    notes: DataFrame,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    layers: list[str] | None = None,
    limit: int = 8,
    selection: dict | None = None,
    index: Index | None = None,
    active_prefix: str = "",
    query_chars: int = DEFAULT_QUERY_CHARS,
) -> DataFrame:
    """queries(query_id, text) -> ranked, source-bound results.

    Without vectors the lexical route stands alone, as when a vector index is missing.
    Ranks are settled on ids first; bodies are joined only for the kept hits.
    """
    cap, fetch = fetch_size(limit)
    chosen = known_layers(layers)
    pool = notes.where(F.col("layer").isin(*chosen))
    asked = read_directives(queries, selection)
    lexical_hits = lexical_route(asked, pool, fetch, index)
    if vectors is not None and query_vectors is not None:
        route = vector_topk(query_vectors, vectors.select("uri", "vector"), fetch)
        route = valid_hits(route, notes, chosen, active_prefix).withColumnRenamed("rank", "position")
        vector_hits = ranking.first_occurrences(route)
    else:
        vector_hits = None
    ranked = ranking.fuse(vector_hits, lexical_hits)
    # A few rows per query that three later steps read: written once, not ranked again.
    fused = materialize(ranking.top_k(ranked, cap), "hits")
    wanted = asked.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("wanted"))
    quoted = excerpts(fused, wanted, pool, query_chars)
    described = pool.select("uri", "layer", "title", "topics", "conditions")
    return quoted.join(fused.select("query_id", "uri", "score", "methods"), ["query_id", "uri"]).join(described, "uri")


def query_status(queries: DataFrame, results: DataFrame, vectors_ready: bool, incomplete: bool = False) -> DataFrame:
    """One row per query: number of results and the degraded / incomplete flags."""
    counted = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    return queries.select("query_id").join(counted, "query_id", "left").select(
        "query_id",
        F.coalesce("results", F.lit(0)).alias("results"),
        F.lit(incomplete or not vectors_ready).alias("degraded"),
        F.lit(not vectors_ready).alias("unavailable"),
        F.lit(incomplete).alias("incomplete"),
    )
