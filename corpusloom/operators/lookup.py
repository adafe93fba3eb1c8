"""Batched note lookup by reference or exact title."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md

UNKNOWN = "No document with this ref in the consulted layers. That is 'unknown'."


def explain(refs: DataFrame, notes: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """refs(ref) -> (ref, found, uri, title, layer, meaning), one row per distinct ref.

    Keys are tried in order: uri, path, relative path, slug, file name, file stem.
    Each note offers its few keys once and only offers matching a ref survive.
    """
    pool = notes if layers is None else notes.where(F.col("layer").isin(*layers))
    name = F.substring_index("path", "/", -1)
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("priority"), key.alias("key"))
            for i, key in enumerate(
                (F.col("uri"), F.col("path"), F.col("relative_path"), F.col("slug"), name, F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
            )
        ]
    )
    wanted = refs.select(md.strip(F.col("ref")).alias("ref")).distinct()
    offers = pool.select("uri", "title", "layer", F.inline(keys)).join(wanted.withColumnRenamed("ref", "key"), "key", "left_semi")
    # min_by combines map-side: a name shared by many notes stays one row per task.
    best = offers.groupBy("key").agg(F.min_by(F.struct("uri", "title", "layer"), F.struct("priority", "uri")).alias("hit"))
    return wanted.join(best, wanted["ref"] == best["key"], "left").select(
        "ref",
        F.col("hit").isNotNull().alias("found"),
        F.col("hit.uri").alias("uri"),
        F.col("hit.title").alias("title"),
        F.col("hit.layer").alias("layer"),
        F.when(F.col("hit").isNull(), F.when(F.col("ref") == "", F.lit("ref is required")).otherwise(F.lit(UNKNOWN))).alias("meaning"),
    )


def title_matches(titles: DataFrame, notes: DataFrame, limit: int = 8) -> DataFrame:
    """titles(layer, title) -> the first ``limit`` notes by path, with an incomplete flag.

    The rank filter lets Spark cut each task to limit+1 rows per title before the
    shuffle, so one title shared by a third of all notes is no hot spot.
    """
    order = Window.partitionBy("layer", "title").orderBy("path")
    near = (
        notes.select("layer", "title", "path", "uri", "slug")
        .join(titles.select("layer", "title").distinct(), ["layer", "title"], "left_semi")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit + 1)
    )
    flag = F.max("rank").over(Window.partitionBy("layer", "title")) > limit
    return near.withColumn("incomplete", flag).where(F.col("rank") <= limit)


def note_by_title(titles: DataFrame, notes: DataFrame) -> DataFrame:
    """One note per title: the one whose identity derives from the title, else the first by path."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    wanted = md.note_slug(F.col("title"))
    canonical = ((F.col("slug") == wanted) | (stem == wanted)).cast("int")
    trimmed = notes.withColumn("title", md.strip(F.col("title")))
    return (
        trimmed.join(titles.select("layer", "title").distinct(), ["layer", "title"], "left_semi")
        .groupBy("layer", "title")
        .agg(F.min_by("uri", F.struct(-canonical, F.col("path"))).alias("uri"))
    )
