"""Exact vector search in bounded tiles, vector table audits, index freshness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import RANK_DIGITS, top_k

TILE_VECTORS = 20_000
TILE_QUERIES = 2_000


def _tiles(df: DataFrame, key: str, size: int) -> int:
    return max(1, -(-df.count() // size))


def usable(vector) -> F.Column:
    """A vector that can be ranked: present, not empty, every number finite.
    ``audit_vectors`` counts the others."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int, tile_vectors: int = TILE_VECTORS, tile_queries: int = TILE_QUERIES
) -> DataFrame:
    """Exact cosine top-k per query: (query_id, uri, score, rank).

    queries(query_id, vector), vectors(uri, vector); a uri may own several vectors and
    keeps its best score. Both sides are hashed into tiles of bounded size and every
    vector tile meets every query tile once, as a grouped Arrow job that multiplies two
    small matrices and returns only its k best per query. Nothing is broadcast or
    collected, and no pair row leaves a task.
    """
    vectors, queries = vectors.where(usable(F.col("vector"))), queries.where(usable(F.col("vector")))
    rows, cols = _tiles(vectors, "uri", tile_vectors), _tiles(queries, "query_id", tile_queries)
    left = vectors.select(
        F.col("uri"),
        "vector",
        F.pmod(F.xxhash64("uri"), F.lit(rows)).alias("row"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"),
    )
    right = queries.select(
        F.col("query_id"),
        "vector",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("row"),
        F.pmod(F.xxhash64("query_id"), F.lit(cols)).alias("col"),
    )
    query_type = dict(queries.dtypes)["query_id"]

    def unit(series: pd.Series) -> np.ndarray:
        matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in series])
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def tile(vec: pd.DataFrame, que: pd.DataFrame) -> pd.DataFrame:
        if vec.empty or que.empty:
            return pd.DataFrame({name: pd.Series(dtype=object) for name in ("query_id", "uri", "score")})
        scores = unit(que["vector"]) @ unit(vec["vector"]).T
        # Best score per uri first, then the k best uris: ties follow the uri order.
        order = np.argsort(vec["uri"].to_numpy(), kind="stable")
        uris, starts = np.unique(vec["uri"].to_numpy()[order], return_index=True)
        best = np.maximum.reduceat(scores[:, order], starts, axis=1)
        picked = np.argsort(-np.round(best, RANK_DIGITS), axis=1, kind="stable")[:, :k]
        return pd.DataFrame(
            {
                "query_id": np.repeat(que["query_id"].to_numpy(), picked.shape[1]),
                "uri": uris[picked].ravel(),
                "score": np.take_along_axis(best, picked, axis=1).ravel(),
            }
        )

    local = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInPandas(
        tile, f"query_id {query_type}, uri string, score double"
    )
    return top_k(local.groupBy("query_id", "uri").agg(F.max("score").alias("score")), k)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key. Sums per (key, position) combine map-side, so a key that
    owns a third of all vectors sends one partial row per task and position."""
    flat = vectors.select(key, F.posexplode("vector").alias("at", "x"))
    means = flat.groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One entry per dimension: the array is as long as a vector.
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("vector")
    )


def vector_text(vector) -> F.Column:
    """Canonical text of a vector: the shortest text of a float names exactly one value."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")


def vector_hash(vector) -> F.Column:
    return F.sha2(vector_text(vector), 256)


def audit_vectors(vectors: DataFrame, keys: list[str], dimension: int) -> DataFrame:
    """One row of facts: counts, wrong dimensions, non-finite values, repeated keys."""
    per_key = vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.coalesce(F.size("vector"), F.lit(-1)) != dimension).cast("int")).alias("wrong"),
        F.sum(
            F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("int")
        ).alias("bad"),
    )
    return per_key.agg(
        F.sum("n").alias("records"),
        F.count(F.lit(1)).alias("keys"),
        F.sum((F.col("n") > 1).cast("int")).alias("repeated_keys"),
        F.sum("wrong").alias("wrong_dimension"),
        F.sum(F.coalesce("bad", F.lit(0))).alias("not_finite"),
    )


def compare_vectors(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Records that differ between two vector tables: keys and a reason."""
    left = expected.select(*keys, vector_hash(F.col("vector")).alias("expected_hash"))
    right = actual.select(*keys, vector_hash(F.col("vector")).alias("actual_hash"))
    reason = (
        F.when(F.col("actual_hash").isNull(), F.lit("missing"))
        .when(F.col("expected_hash").isNull(), F.lit("unexpected"))
        .when(F.col("actual_hash") != F.col("expected_hash"), F.lit("value_differs"))
    )
    return left.join(right, keys, "full_outer").select(*keys, reason.alias("reason")).where("reason is not null")


def index_freshness(notes: DataFrame, ledger: DataFrame, vectors: DataFrame, model: str, readable_roots: DataFrame) -> DataFrame:
    """What the vector index needs: (uri, action) with action in upsert / repair / unchanged / delete.

    notes(uri, path, file_sha256), ledger(uri, path, root, sha256, model), vectors(uri).
    A ledger row without a note is a delete only when its root was readable in this
    scan; otherwise its state is unknown and it stays.
    """
    stored = ledger.select("uri", F.col("path").alias("led_path"), F.col("root").alias("led_root"), F.col("sha256").alias("led_sha"), F.col("model").alias("led_model"))
    present = vectors.select("uri").distinct().withColumn("has_vector", F.lit(True))
    readable = readable_roots.select(F.col("root").alias("led_root")).distinct().withColumn("readable", F.lit(True))
    same = (F.col("led_sha") == F.col("file_sha256")) & (F.col("led_path") == F.col("path")) & (F.col("led_model") == model)
    action = (
        F.when(F.col("file_sha256").isNull(), F.when(F.col("readable"), F.lit("delete")).otherwise(F.lit("unknown")))
        .when(~F.coalesce(same, F.lit(False)), F.lit("upsert"))
        .when(F.col("has_vector").isNull(), F.lit("repair"))
        .otherwise(F.lit("unchanged"))
    )
    return (
        notes.select("uri", "path", "file_sha256")
        .join(stored, "uri", "full_outer")
        .join(present, "uri", "left")
        .join(readable, "led_root", "left")
        .select("uri", action.alias("action"))
    )
