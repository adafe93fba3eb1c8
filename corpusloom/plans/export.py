"""Verified public exports: rows, digests, changes, generations, checks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions.redaction import PROFILE, Allowlist
from corpusloom.functions.text import lines
from corpusloom.operators import snapshots
from corpusloom.operators.redact import public_projection

ROW = "path string, size long, sha256 string, source_sha256 string, input_sha256 string, metadata_size long, metadata_sha256 string"
SHA = "^[0-9a-f]{64}$"


def public_rows(notes: DataFrame, includes: list[str], allow: Allowlist | None = None) -> DataFrame:
    """Selected notes projected to public rows with text, metadata and hashes.

    Aliases whose recorded hash is stale were dropped when the note was built; aliases
    mined from the text are added behind the remaining ones.
    """
    chosen = F.lit(False)
    for folder in includes:
        chosen = chosen | F.startswith("relative_path", F.lit(folder.rstrip("/") + "/"))
    mined = F.transform(
        F.array_except(md.mined_aliases(lines(F.col("raw"))), F.transform("aliases", lambda a: a["text"])),
        lambda t: F.struct(t.alias("text"), F.lit("related").alias("relation"), F.array().cast("array<string>").alias("scope")),
    )
    selected = notes.where(chosen).select("uri", F.col("relative_path").alias("path"), "raw", "conditions", F.concat("aliases", mined).alias("aliases"), "topics")
    inputs = selected.select("uri", F.sha2("raw", 256).alias("input_sha256"))
    metadata = F.to_json(F.struct("conditions", F.struct("aliases", "topics", "source_sha256").alias("retrieval")))
    return (
        public_projection(selected, allow)
        .withColumn("metadata", metadata)
        .join(inputs, "uri")
        .select(
            "path",
            F.octet_length("text").cast("long").alias("size"),
            F.sha2("text", 256).alias("sha256"),
            "source_sha256",
            "input_sha256",
            F.octet_length("metadata").cast("long").alias("metadata_size"),
            F.sha2("metadata", 256).alias("metadata_sha256"),
            "text",
            "metadata",
            "blocked",
            "reason",
        )
    )


def export_changes(previous: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, change, renamed_from): a rename stays listed as added and removed too."""
    whole = F.sha2(F.concat_ws("\0", "size", "sha256", "source_sha256", "input_sha256", "metadata_size", "metadata_sha256"), 256)
    changes = snapshots.diff(previous.withColumn("row", whole), rows.withColumn("row", whole), "path", "row")
    moved = snapshots.renames(snapshots.diff(previous, rows, "path", "input_sha256"), "path")
    return changes.where("change <> 'unchanged'").join(
        moved.select(F.col("renamed_to").alias("path"), "renamed_from"), "path", "left"
    ).select("path", "change", F.when(F.col("change") == "added", F.col("renamed_from")).alias("renamed_from"))


@dataclass(frozen=True)
class Export:
    status: str
    snapshot: str | None
    generation: str | None
    problems: DataFrame | None = None


def export_notes(notes: DataFrame, root: str, includes: list[str], allow: Allowlist | None = None) -> Export:
    """Write one public generation, all or nothing; the pointer row moves last.

    One blocked note keeps the previous generation, an unchanged snapshot writes nothing.
    """
    spark = notes.sparkSession
    generation = uuid.uuid4().hex
    staged = f"{root}/generations/{generation}"
    public_rows(notes, includes, allow).write.parquet(staged)
    rows = spark.read.parquet(staged)
    problems = rows.where("blocked").select("path", "reason")
    if not problems.isEmpty():
        return Export("incomplete", None, None, problems)
    salt = F.lit("\0".join([PROFILE, *sorted(includes)]))
    whole = F.sha2(F.concat_ws("\0", "size", "sha256", "source_sha256", "input_sha256", "metadata_size", "metadata_sha256", salt), 256)
    digest = snapshots.corpus_digest(rows.withColumn("row", whole), "path", "row").first()
    snapshot = digest["digest"] if digest else ""
    current = current_export(spark, root)
    if current is not None and current["snapshot"] == snapshot:
        return Export("unchanged", snapshot, current["generation"])
    pointer = spark.createDataFrame([(generation, snapshot, current["snapshot"] if current else None)], "generation string, snapshot string, previous string")
    pointer.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/pointer")
    return Export("prepared", snapshot, generation)


def current_export(spark, root: str):
    """The latest pointer row, or None before the first export."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{root}/pointer").orderBy(F.desc("written_at")).first()


def verify_export(declared: DataFrame, actual: DataFrame, includes: list[str]) -> DataFrame:
    """Violations (path, rule) of declared manifest rows against the files found.

    actual(path, size, sha256, source_sha256, metadata_size, metadata_sha256). Colliding
    names are found by counting lower-cased names, not by comparing files pairwise.
    """
    inside = F.lit(False)
    for folder in includes:
        inside = inside | F.startswith("path", F.lit(folder.rstrip("/") + "/"))
    found = actual.select("path", *[F.col(c).alias(f"now_{c}") for c in ("size", "sha256", "source_sha256", "metadata_size", "metadata_sha256")], F.lit(True).alias("is_file"))
    crowded = declared.groupBy(F.lower("path").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("collides", F.lit(True)).drop("n")
    joined = (
        declared.withColumn("is_declared", F.lit(True)).join(found, "path", "full_outer").withColumn("name", F.lower("path")).join(crowded, "name", "left")
    )
    known, there = F.col("is_declared").isNotNull(), F.col("is_file").isNotNull()
    both = known & there
    hashes = F.lit(True)
    for column in ("sha256", "source_sha256", "input_sha256", "metadata_sha256"):
        hashes = hashes & F.coalesce(F.col(column).rlike(SHA), F.lit(False))
    rules = {
        "unmanaged_file": ~known,
        "missing_file": ~there,
        "path_outside_includes": known & ~(inside & md.is_safe_relative(F.col("path")) & F.lower("path").endswith(".md")),
        "name_collision": known & F.col("collides"),
        "malformed_hash": known & ~hashes,
        "size_out_of_bounds": known & ~(F.col("size").between(0, md.MAX_NOTE_BYTES) & F.col("metadata_size").between(0, md.MAX_SIDECAR_BYTES)),
        "body_changed": both & ~((F.col("size") == F.col("now_size")) & (F.col("sha256") == F.col("now_sha256"))),
        "metadata_changed": both & ~((F.col("metadata_size") == F.col("now_metadata_size")) & (F.col("metadata_sha256") == F.col("now_metadata_sha256"))),
        "source_hash_differs": both & (F.col("source_sha256") != F.col("now_source_sha256")),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return joined.select("path", F.explode(broken).alias("rule"))


def verify_release(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """Violations of a release content list: rows absent, with another hash, or repeated."""
    counted = entries.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("low"), F.max("sha256").alias("high"))
    rule = (
        F.when(F.col("n").isNull(), F.lit("missing_entry"))
        .when(F.col("sha256").isNull(), F.lit("undeclared_entry"))
        .when((F.col("low") != F.col("sha256")) | (F.col("high") != F.col("sha256")), F.lit("hash_differs"))
    )
    return declared.select("path", "sha256").join(counted, "path", "full_outer").select("path", rule.alias("rule")).where("rule is not null")
