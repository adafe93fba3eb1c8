"""Manifests stored as trees of hashes, and compared from the root down.

A stored manifest keeps its rows and every level of its digest tree: leaves by the first
five hex digits of sha256(path), nodes by the first two, one root. The root is the digest
that ``corpus_digest`` gives. Two manifests are compared level by level, and only what
lies below unequal nodes is opened: rows and leaves are stored in the order of their
nodes, in small row groups, so a filter on nodes skips all others. Cost follows the changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.snapshots import DIGEST_LEVELS, diff, fold_level, manifest_line, node_line
from corpusloom.session import materialize

LEAF, NODE = DIGEST_LEVELS
# Up to so many leaves are named in the filter of the row scan; beyond, they are joined.
MAX_NAMED = 1000
# A list of more values is not pushed to the file reader, so longer ones are split.
PUSHED = 10
GROUP_BYTES = 1 << 18
CHANGES = "path string, before string, after string, change string"


@dataclass(frozen=True)
class ManifestTree:
    spark: SparkSession
    root: str

    def digest(self) -> str | None:
        """The root; None for a manifest without rows."""
        row = self.spark.read.schema("digest string").parquet(f"{self.root}/digest").first()
        return row["digest"] if row else None

    def nodes(self) -> DataFrame:
        """(node, digest), at most 256 rows."""
        return self.spark.read.schema("node string, digest string").parquet(f"{self.root}/nodes")

    def leaves(self, nodes: list[str]) -> DataFrame:
        """(leaf, digest) below some nodes."""
        stored = self.spark.read.schema("node string, leaf string, digest string").parquet(f"{self.root}/leaves")
        return stored.where(_among("node", nodes)).select("leaf", "digest")

    def rows(self) -> DataFrame:
        """(path, sha256, leaf) of the whole manifest."""
        return self.spark.read.schema("path string, sha256 string, leaf string").parquet(f"{self.root}/rows")


def _among(column: str, names: list[str]) -> Column:
    """``isin`` in pieces that the file reader can use to skip row groups."""
    ordered, found = sorted(names), F.lit(False)
    for at in range(0, len(ordered), PUSHED):
        found = found | F.col(column).isin(ordered[at : at + PUSHED])
    return found


def store(rows: DataFrame, root: str) -> ManifestTree:
    """Write rows(path, sha256), each path once, with all levels of their tree."""
    spark = rows.sparkSession
    put = lambda df, name: df.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{root}/{name}")
    keyed = rows.select("path", "sha256", F.left(F.sha2("path", 256), F.lit(LEAF)).alias("leaf"))
    put(keyed.repartitionByRange("leaf").sortWithinPartitions("leaf"), "rows")
    tree = ManifestTree(spark, root)
    node = F.left("leaf", F.lit(NODE)).alias("node")
    leaves = fold_level(tree.rows(), [node, F.col("leaf")], "path", manifest_line("path", "sha256"))
    put(leaves.repartitionByRange("leaf").sortWithinPartitions("leaf"), "leaves")
    stored = spark.read.schema("node string, leaf string, digest string").parquet(f"{root}/leaves")
    put(fold_level(stored, [F.col("node")], "leaf", node_line("leaf")).coalesce(1), "nodes")
    put(fold_level(tree.nodes(), [F.lit("").alias("all")], "node", node_line("node")).select("digest"), "digest")
    return tree


def _unequal(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    found = diff(before, after, name, "digest")
    return found.where(F.col("change") != "unchanged").select(name)


@dataclass(frozen=True)
class Comparison:
    """``changes``: (path, before, after, change) of all rows that differ; ``opened``: the
    leaves that were unequal, and the rows of either side below them."""

    changes: DataFrame
    leaves: DataFrame | None
    opened: tuple[DataFrame, DataFrame] | None


def compare(before: ManifestTree, after: ManifestTree) -> Comparison:
    spark = after.spark
    none = Comparison(spark.createDataFrame([], CHANGES), None, None)
    if before.digest() == after.digest():
        return none
    # At most 256 names.
    nodes = [r[0] for r in _unequal(before.nodes(), after.nodes(), "node").collect()]
    leaves = materialize(_unequal(before.leaves(nodes), after.leaves(nodes), "leaf"), "leaves")
    named = [r[0] for r in leaves.limit(MAX_NAMED + 1).collect()]

    def below(tree: ManifestTree) -> DataFrame:
        if len(named) <= MAX_NAMED:
            return tree.rows().where(_among("leaf", named))
        return tree.rows().join(leaves, "leaf", "left_semi")

    old, new = below(before), below(after)
    changes = diff(old, new, "path", "sha256").where(F.col("change") != "unchanged")
    return Comparison(changes, leaves, (old, new))


def verify(declared: ManifestTree, actual: ManifestTree) -> DataFrame:
    """Violations (path, rule) of the files found against a declared manifest."""
    rule = F.when(F.col("change") == "removed", F.lit("missing_file")).when(F.col("change") == "added", F.lit("unmanaged_file")).otherwise(F.lit("body_changed"))
    return compare(declared, actual).changes.select("path", rule.alias("rule"))


def follow(applied: str | None, previous: ManifestTree, current: ManifestTree) -> tuple[str, DataFrame]:
    """How a consumer that applied the manifest of this digest catches up, and with what.

    ``reuse``: nothing to do; ``delta``: the changes from the previous manifest; ``full``:
    every row, because the consumer stands on another manifest.
    """
    spark = current.spark
    if applied == current.digest():
        return "reuse", spark.createDataFrame([], CHANGES)
    if applied is not None and applied == previous.digest():
        return "delta", compare(previous, current).changes
    whole = current.rows().select("path", F.lit(None).cast("string").alias("before"), F.col("sha256").alias("after"), F.lit("added").alias("change"))
    return "full", whole
