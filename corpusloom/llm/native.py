"""Column expressions shared by the operators of this package; all built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six characters that separate words.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+", -1), "")


def row_key(*columns: str) -> Column:
    """One value per distinct row content, null-safe: joins on it survive repeated
    and null ids. Two 32-hex-digit halves would be needed for adversarial input only."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def aside(df: DataFrame, *inside: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that are named like one ``inside`` an operator renamed, and the
    names to give back to its result."""
    taken, moved = {c.lower() for c in df.columns} | {c.lower() for c in inside}, {}
    for name in df.columns:
        if name.lower() in {c.lower() for c in inside}:
            other = name
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
            moved[name] = other
    return df.withColumnsRenamed(moved), {other: name for name, other in moved.items()}
