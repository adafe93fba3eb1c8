"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each level every child
draws ``-ln(u) / weight`` with ``u`` hashed from the row's key, the level and the child,
and the smallest draw wins: children are chosen in proportion to their weights. When the
weight of one child changes, rows move only into or out of that child; below an unchanged
child nothing moves. A shard that joins in a region of its own therefore takes rows only
into itself, which is how ``layout`` grows beyond its founding shards.

The weights of a region and a rack are the sums of what lies below them.

Null keys are one key. Null text counts no bytes and has checksum 0. Repeated rows share
a shard and get slots of their own. Extra columns are ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.native import aside, table
from corpusloom.session import materialize

SHARDS = 16
SPAN = 2.0**52


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, founding: int = SHARDS, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Founding shards fill racks and regions; each later shard opens its own region."""
    leaves = [Leaf(s, s // (per_rack * racks), s // per_rack) for s in range(min(shards, founding))]
    first = 1 + max(leaf.region for leaf in leaves)
    return leaves + [Leaf(s, first + s - founding, s) for s in range(founding, shards)]


def _totals(leaves: list[Leaf], level: str) -> dict[int, float]:
    totals: dict[int, float] = {}
    for leaf in leaves:
        totals[getattr(leaf, level)] = totals.get(getattr(leaf, level), 0.0) + leaf.weight
    return totals


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{level}/{node}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / SPAN
    return F.struct((-F.log(u) / weight).alias("draw"), F.lit(node).alias("node"))


def _choose(key: Column, level: str, weights: dict[int, float]) -> Column:
    draws = [_draw(key, level, node, weight) for node, weight in sorted(weights.items())]
    return F.array_min(F.array(*draws))["node"] if len(draws) > 1 else F.lit(next(iter(weights)))


def _descend(node: Column, children: dict[int, Column]) -> Column:
    out = None
    for value, below in children.items():
        out = F.when(node == value, below) if out is None else out.when(node == value, below)
    return out


def assign(df: DataFrame, key: Column, leaves: list[Leaf], name: str = "shard") -> DataFrame:
    """``df`` with the leaf that each row's key descends to."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    regions = _totals(leaves, "region")
    within = {r: [x for x in leaves if x.region == r] for r in regions}
    racks = {x.rack: [y for y in leaves if y.rack == x.rack] for x in leaves}
    df, back = aside(df, "_region", "_rack")
    df = df.withColumn("_region", _choose(text, "region", regions))
    df = df.withColumn("_rack", _descend(F.col("_region"), {r: _choose(text, "rack", _totals(below, "rack")) for r, below in within.items()}))
    shard = _descend(F.col("_rack"), {r: _choose(text, "shard", _totals(below, "shard")) for r, below in racks.items()})
    return df.withColumn(name, shard.cast("int")).drop("_region", "_rack").withColumnsRenamed(back)


def number_rows(df: DataFrame, shard: str = "shard", digits: int = 3) -> DataFrame:
    """``df`` with ``slot``: gapless from 0 within each shard, whatever its size.

    Equal rows are first counted per input partition, then hash buckets (``16**digits`` a
    shard) are numbered in parallel and shifted by the rows of the buckets before them.
    """
    df, back = aside(df, "_part", "_n", "_order", "_bucket", "_rows", "_shift", "_start")
    columns = df.columns
    order = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    counted = df.groupBy(*columns, F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_n"))
    counted = materialize(counted.withColumn("_order", F.substring(order, 1, 16)).withColumn("_bucket", F.substring("_order", 1, digits)), "slots")
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counted.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_rows"))
    buckets = buckets.select(shard, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(shard, "_bucket").orderBy("_order", "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_start", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(buckets, [shard, "_bucket"])
    first = F.col("_shift") + F.col("_start")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot")).withColumnsRenamed(back)


def op9_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(thin, F.col("doc_id"), layout(SHARDS))
    grown = assign(placed, F.col("doc_id"), layout(SHARDS + 1), "grown_shard")
    return number_rows(grown).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_choice(level: str, nodes: dict[int, float]) -> str:
    if len(nodes) == 1:
        return str(next(iter(nodes)))
    draw = "-ln((CAST('0x' || substr(md5(k || '/{0}/{1}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {2}"
    rows = [f"{{'d': {draw.format(level, n, w)}, 'n': {n}}}" for n, w in sorted(nodes.items())]
    return f"list_min([{', '.join(rows)}]).n"


def _sql_tree(leaves: list[Leaf], source: str, name: str) -> str:
    regions = _totals(leaves, "region")
    racks = " ".join(f"WHEN {r} THEN {_sql_choice('rack', _totals([x for x in leaves if x.region == r], 'rack'))}" for r in regions)
    shards = " ".join(f"WHEN {r} THEN {_sql_choice('shard', _totals([x for x in leaves if x.rack == r], 'shard'))}" for r in sorted({x.rack for x in leaves}))
    return f"""
{name}_region AS (SELECT *, {_sql_choice('region', regions)} AS region FROM {source}),
{name}_rack AS (SELECT * EXCLUDE region, CASE region {racks} END AS rack FROM {name}_region),
{name}_tree AS (SELECT * EXCLUDE rack, CAST(CASE rack {shards} END AS INTEGER) AS {name} FROM {name}_rack)"""


ORACLE_SQL = f"""
WITH byte_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b::UBIGINT] || range(8)::UBIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS steps
), raw AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
), listed AS (
  SELECT doc_id, k, len(h) // 2 + 1 AS size, [4294967295::UBIGINT] || list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)) AS bs FROM raw
), summed AS (
  SELECT doc_id, k, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(bs, lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32
  FROM listed, byte_table
),{_sql_tree(layout(SHARDS), 'summed', 'shard')},{_sql_tree(layout(SHARDS + 1), 'shard_tree', 'grown_shard')},
ordered AS (
  SELECT *, md5('{{"doc_id":' || k || ',"size":' || size || ',"text_crc32":' || text_crc32 || ',"shard":' || shard || ',"grown_shard":' || grown_shard || '}}') AS o FROM grown_shard_tree
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(o, 1, 16)) - 1 AS slot, grown_shard FROM ordered
"""
