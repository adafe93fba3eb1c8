"""Manifest rows as JSON lines, with a fixed schema and their digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.snapshots import corpus_digest
from corpusloom.plans.export import ROW


def write_manifest(rows: DataFrame, path: str) -> None:
    columns = [field.split(" ")[0] for field in ROW.split(", ")]
    rows.select(*columns).write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows with exactly the declared fields; anything malformed is refused, not dropped."""
    return spark.read.schema(ROW).option("mode", "FAILFAST").json(path)


def digest(rows: DataFrame) -> DataFrame:
    return corpus_digest(rows, "path", "sha256")
