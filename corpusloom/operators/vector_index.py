"""Stored vectors in tiles with angle bounds: exact cosine top-k that leaves tiles unread.

Vectors are dealt to sampled centres and, inside a centre, to rings by their angle to it.
A tile is one ring of one centre; what it holds lies between two angles from the centre, so
by the triangle inequality no vector in it is nearer to a query than the gap between these
angles and the query's own angle to the centre. A first pass reads the most promising tiles
of every query and gives the score to beat; a second pass reads only tiles that can reach it.

How much is left unread depends on the vectors: much where they form clusters, nothing
where all directions are alike. The answer is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ranking import RANK_DIGITS, top_k
from corpusloom.operators.vector import TILE_QUERIES, TILE_VECTORS, usable
from corpusloom.session import materialize

# Centres, and rings per centre: their product bounds the table of tiles, which every task
# that weighs queries holds (24 bytes a tile, 6 MB), and the centres (2 MB at 64 numbers).
MAX_CENTRES = 4096
RING = 0.05
# Scores compare as rounded numbers, and angles lose digits near 0 and pi: a bound may err
# by this much without a tile being left out.
SLACK = 1e-7 + 10.0**-RANK_DIGITS


@dataclass(frozen=True)
class VectorIndex:
    """``vectors(uri, vector, centre, ring)`` stored by centre; ``tiles(centre, ring, n, low, high)``."""

    vectors: DataFrame
    tiles: DataFrame
    centres: np.ndarray


def unit(series: pd.Series) -> np.ndarray:
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in series])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def build_index(vectors: DataFrame, path: str, tile_vectors: int = TILE_VECTORS) -> None:
    """Write ``vectors(uri, vector)`` as an index below ``path``.

    Vectors that cannot be ranked are left out, as in ``vector_topk``. One centre for every
    ``tile_vectors`` vectors, at most ``MAX_CENTRES``, drawn by a hash of the uri; all vectors
    are dealt. A vector of zeros has no angle and stands at a right angle to all.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(usable(F.col("vector"))).select("uri", "vector")
    wanted = min(MAX_CENTRES, max(1, -(-vectors.count() // tile_vectors)))
    # At most MAX_CENTRES vectors come to the driver. Copies of one vector are one centre.
    drawn = vectors.orderBy(F.xxhash64("uri", F.lit("centre")), "uri").limit(wanted).toPandas()
    centres = np.unique(unit(drawn["vector"]), axis=0) if len(drawn) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cosines = np.clip(unit(batch["vector"]) @ shared.value.T, -1, 1)
                nearest = cosines.argmax(axis=1)
                angle = np.arccos(cosines[np.arange(len(batch)), nearest])
                yield batch.assign(centre=nearest.astype(np.int32), ring=(angle / RING).astype(np.int32), angle=angle)

    kind = vectors.schema["vector"].dataType.simpleString()
    dealt = vectors.mapInPandas(deal, f"uri string, vector {kind}, centre int, ring int, angle double")
    # A centre that draws a third of all vectors is written by as many tasks as any other rows.
    dealt.write.partitionBy("centre").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors") if wanted and len(centres) else dealt
    tiles = stored.groupBy("centre", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    tiles.coalesce(1).write.parquet(f"{path}/tiles")
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "centre int, vector array<double>").coalesce(1).write.parquet(f"{path}/centres")


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    centres = spark.read.parquet(f"{path}/centres").orderBy("centre").toPandas()
    matrix = np.vstack(centres["vector"]) if len(centres) else np.zeros((0, 1))
    tiles = spark.read.parquet(f"{path}/tiles")
    if not len(centres):
        empty = spark.createDataFrame([], "uri string, vector array<double>, ring int, angle double, centre int")
        return VectorIndex(empty, tiles, matrix)
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), tiles, matrix)


def _gaps(queries: np.ndarray, centres: np.ndarray, tiles: pd.DataFrame) -> np.ndarray:
    """Smallest angle between each query and anything in each tile."""
    angle = np.arccos(np.clip(queries @ centres.T, -1, 1))[:, tiles["centre"].to_numpy()]
    return np.maximum(np.maximum(angle - tiles["high"].to_numpy(), tiles["low"].to_numpy() - angle), 0)


def _scored(index: VectorIndex, queries: DataFrame, wanted: DataFrame, k: int, tile_queries: int) -> DataFrame:
    """(query_id, uri, score): the k best of every wanted (query_id, centre, ring).

    Tiles and the queries that want them meet in blocks of bounded size; only centres that
    somebody wants are read.
    """
    counts = wanted.groupBy("centre", "ring").agg(F.count("*").alias("asking"))
    # One row for each tile at most.
    asked = materialize(counts.join(index.tiles.select("centre", "ring", "n"), ["centre", "ring"]), "asked")
    centres = [r.centre for r in asked.select("centre").distinct().collect()]
    sized = asked.select(
        "centre",
        "ring",
        F.ceil(F.col("n") / TILE_VECTORS).alias("rows"),
        F.ceil(F.col("asking") / tile_queries).alias("cols"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    row, col = F.pmod(F.xxhash64("uri"), F.col("rows")), F.pmod(F.xxhash64("query_id"), F.col("cols"))
    read = index.vectors.where(F.col("centre").isin(centres)).join(sized, ["centre", "ring"])
    left = read.select("centre", "ring", "uri", "vector", row.alias("row"), every("cols").alias("col"))
    asking = wanted.join(sized, ["centre", "ring"]).join(queries, "query_id")
    right = asking.select("centre", "ring", "query_id", "vector", col.alias("col"), every("rows").alias("row"))

    def tile(vec: pd.DataFrame, que: pd.DataFrame) -> pd.DataFrame:
        if vec.empty or que.empty:
            return pd.DataFrame({name: pd.Series(dtype=object) for name in ("query_id", "uri", "score")})
        scores = unit(que["vector"]) @ unit(vec["vector"]).T
        uris, place = np.unique(vec["uri"].to_numpy(), return_inverse=True)
        best = np.full((len(que), len(uris)), -np.inf)
        np.maximum.at(best, (slice(None), place), scores)
        picked = np.argsort(-np.round(best, RANK_DIGITS), axis=1, kind="stable")[:, :k]
        ids = np.repeat(que["query_id"].to_numpy(), picked.shape[1])
        return pd.DataFrame({"query_id": ids, "uri": uris[picked].ravel(), "score": np.take_along_axis(best, picked, axis=1).ravel()})

    keys = ["centre", "ring", "row", "col"]
    kind = dict(queries.dtypes)["query_id"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, f"query_id {kind}, uri string, score double")


def _best(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores.groupBy("query_id", "uri").agg(F.max("score").alias("score")), k)


def wanted_tiles(index: VectorIndex, queries: DataFrame, k: int, second: bool) -> DataFrame:
    """Tiles (query_id, centre, ring) of the first or the second pass.

    The first takes the nearest tiles until they hold ``4 * k`` vectors. The second takes the
    others that could give a score of ``beat``, a column of ``queries`` (null: all others).
    Only tiles to be read leave a task.
    """
    tiles = index.tiles.toPandas()
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, tiles))
    kind = dict(queries.dtypes)["query_id"]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, tiles = shared.value
        centre, ring, n = (tiles[c].to_numpy() for c in ("centre", "ring", "n"))
        for batch in batches:
            # A few queries at a time: gaps are queries x tiles numbers.
            for start in range(0, len(batch) if len(tiles) else 0, 64):
                part = batch.iloc[start : start + 64]
                gaps = _gaps(unit(part["vector"]), centres, tiles)
                order = np.argsort(gaps, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1) - n[order]
                chosen = np.empty(gaps.shape, bool)
                np.put_along_axis(chosen, order, held < 4 * k, axis=1)
                if second:
                    beat = part["beat"].fillna(-2.0).to_numpy()[:, None]
                    chosen = ~chosen & (np.cos(np.minimum(gaps, np.pi)) >= beat - SLACK)
                query, tile = np.nonzero(chosen)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[query], "centre": centre[tile], "ring": ring[tile]})

    return queries.mapInPandas(weigh, f"query_id {kind}, centre int, ring int")


def indexed_topk(index: VectorIndex, queries: DataFrame, k: int, tile_queries: int = TILE_QUERIES, opened: list | None = None) -> DataFrame:
    """Exact cosine top-k per query: (query_id, uri, score, rank), equal to ``vector_topk``.

    ``queries(query_id, vector)`` have one row per id. ``opened`` receives how many (query,
    tile) pairs were read and how many there are. Queries that cannot be ranked, and an
    empty index, have no rows.
    """
    queries = materialize(queries.where(usable(F.col("vector"))).select("query_id", "vector"), "queries")
    first = materialize(wanted_tiles(index, queries, k, False), "first_tiles")
    seen = materialize(_scored(index, queries, first, k, tile_queries), "first_scores")
    # Fewer than k uris so far: nothing to beat yet.
    beat = _best(seen, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("beat"))
    second = materialize(wanted_tiles(index, queries.join(beat, "query_id", "left"), k, True), "second_tiles")
    if opened is not None:
        opened.append((first.count() + second.count(), queries.count() * index.tiles.count()))
    return _best(seen.unionByName(_scored(index, queries, second, k, tile_queries)), k)
