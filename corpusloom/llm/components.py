"""Connected components of an edge table, wholly distributed.

Large-star and small-star rounds in turn: every vertex points its larger neighbours, then
its smaller ones, at the smallest vertex it knows, until each component is a star. Every
step is an aggregation with map-side combine and a join that adaptive execution can split,
so a hub that touches a third of all edges is no hot task; every round is written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize


def _toward_smallest(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """For pairs (u, v): each v (or each larger v) to the smallest of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u")
    moved = moved.filter(F.col("v") > F.col("u")) if only_larger else moved
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out if only_larger else out.union(least.select("u", F.col("m").alias("v")))


def _measure(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return row.n, row.s or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex on an edge; the component is its smallest vertex.

    Edges that hold a null or join a vertex with itself are ignored.
    """
    larger, smaller = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(larger, smaller)
    now = materialize(now.distinct(), "edges")
    before = None
    while (size := _measure(now)) != before:
        before = size
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        raised = _toward_smallest(both, True).filter("u != v").distinct()
        now = materialize(_toward_smallest(raised, False).filter("u != v").distinct(), "edges")
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
