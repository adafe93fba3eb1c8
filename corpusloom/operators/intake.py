"""Import decisions against a journal, and the notes an import renders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSER_VERSION = "0.1"


def item_fingerprint(content_hash: Column, revision: Column, options: Column) -> Column:
    """What must stay equal for an item to count as unchanged."""
    return F.sha2(F.to_json(F.struct(content_hash.alias("raw"), revision.alias("revision"), options.alias("options"), F.lit(PARSER_VERSION).alias("parser"))), 256)


def intake_plan(items: DataFrame, journal: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """(source_id, item_key, action): unchanged / convert / preserved.

    items(source_id, item_key, fingerprint), journal(source_id, item_key, fingerprint,
    complete, output_sha256), outputs(source_id, item_key, sha256) as they are now. An
    output that is not exactly what the journal wrote belongs to its maintainer and is
    preserved, forced or not.
    """
    old = journal.select("source_id", "item_key", F.col("fingerprint").alias("old_print"), "complete", F.col("output_sha256").alias("written"), F.lit(True).alias("known"))
    now = outputs.select("source_id", "item_key", F.col("sha256").alias("now"))
    owned = F.col("written").eqNullSafe(F.col("now"))
    same = (F.col("old_print") == F.col("fingerprint")) & F.col("complete") & F.lit(not force)
    action = (
        F.when(F.col("known") & ~owned, F.lit("preserved"))
        .when(F.col("known").isNull() & F.col("now").isNotNull(), F.lit("preserved"))
        .when(F.coalesce(same, F.lit(False)), F.lit("unchanged"))
        .otherwise(F.lit("convert"))
    )
    key = ["source_id", "item_key"]
    return items.select(*key, "fingerprint").join(old, key, "left").join(now, key, "left").select(*key, "fingerprint", action.alias("action"))


def intake_outcome(plan: DataFrame, converted: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one status row per source, missing items).

    converted(source_id, item_key, ok, complete). The cursor of a source moves only when
    nothing failed, nothing was preserved and every item is complete; only then are
    journal items that were not seen reported as missing. They are never deleted.
    """
    key = ["source_id", "item_key"]
    done = plan.join(converted, key, "left")
    failed = (F.col("action") == "convert") & ~F.coalesce(F.col("ok") & F.col("complete"), F.lit(False))
    status = done.groupBy("source_id").agg(
        F.sum((F.col("action") == "unchanged").cast("int")).alias("unchanged"),
        F.sum(((F.col("action") == "convert") & F.coalesce("ok", F.lit(False))).cast("int")).alias("converted"),
        F.sum((F.col("action") == "preserved").cast("int")).alias("preserved"),
        F.sum(failed.cast("int")).alias("failed"),
    )
    status = status.withColumn("complete", (F.col("failed") == 0) & (F.col("preserved") == 0)).withColumn(
        "status", F.when(F.col("complete"), F.lit("ok")).otherwise(F.lit("partial"))
    )
    missing = (
        journal.select(*key).join(plan.select(*key), key, "left_anti").join(status.where("complete").select("source_id"), "source_id", "left_semi")
    )
    return status, missing


SPANS = "array<struct<line_start:int,line_end:int,sha256:string>>"


def render_import(items: DataFrame) -> DataFrame:
    """Rendered import notes: header, extraction warnings, body; spans move by the header.

    items(item_key, name, location, raw_sha256, revision, warnings array<string>, text,
    spans array<struct<line_start, line_end, sha256>>).
    """
    warnings = F.array_distinct(F.coalesce("warnings", F.array().cast("array<string>")))
    head = F.concat(
        F.lit("# "),
        F.regexp_replace("name", r"[\r\n]+", " "),
        F.lit("\n\nOriginal source: "),
        F.col("location"),
        F.lit("\n\nSource SHA256: `"),
        F.col("raw_sha256"),
        F.lit("`\n\n"),
        F.when(F.coalesce("revision", F.lit("")) != "", F.concat(F.lit("Source revision: `"), "revision", F.lit("`\n\n"))).otherwise(F.lit("")),
        F.when(
            F.size(warnings) > 0,
            F.concat(F.lit("## Extraction scope\n\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n"), F.lit("\n\n")),
        ).otherwise(F.lit("")),
    )
    rendered = items.withColumn("head", head).withColumn("offset", F.length("head") - F.length(F.translate("head", "\n", "")))
    return rendered.select(
        "item_key",
        F.concat("head", F.regexp_replace("text", r"\s+$", ""), F.lit("\n")).alias("note"),
        F.transform(
            "spans",
            lambda s: F.struct(
                (s["line_start"] + F.col("offset")).alias("line_start"), (s["line_end"] + F.col("offset")).alias("line_end"), s["sha256"].alias("sha256")
            ),
        ).alias("spans"),
    )
