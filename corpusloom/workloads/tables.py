"""Given tables and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.markdown import ALIAS_TYPE
from corpusloom.session import spread
from corpusloom.sources.notes import notes_from_texts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micro(value, scale: float = 1e6):
    """A rounded double that any engine reproduces bit by bit: a whole number divided once."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column * scale).cast("long") / F.lit(scale)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return notes_from_texts(documents(spark, folder))


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def aliased_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with one search phrase made of language and source, scoped to the language."""
    phrase = F.struct(
        F.concat_ws(" ", F.get("topics", F.lit(0)), F.get("topics", F.lit(1)), F.lit("notes")).alias("text"),
        F.lit("related").alias("relation"),
        F.array(F.get("topics", F.lit(0))).alias("scope"),
    )
    return notes(spark, folder).withColumn("aliases", F.array(phrase).cast(ALIAS_TYPE))


def markdown_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document wrapped into a structured note with conditions, a table, a fence,
    links to its neighbour, its source's site and a code file, and a symbol mention."""
    d = documents(spark, folder)
    ident = F.col("doc_id").cast("string")
    raw = F.concat(
        F.lit("# Note "), ident, F.lit("\n\nSee [next](doc-"), (F.col("doc_id") + 1).cast("string"), F.lit(".md#L1-L2), [home](https://Site.example/"),
        F.col("source"), F.lit("/#top) and [code](../../code/lib/"), F.col("source"), F.lit("/m"), ident, F.lit(".py#L3-L4) for `run_"), ident,
        F.lit("`.\n\n## Conditions\n- language: "), F.col("lang"), F.lit("\n- origin: "), F.col("source"),
        F.lit("\n- checked: unknown\n\n| Key | Value |\n|---|---|\n| chars | "), F.col("n_chars").cast("string"),
        F.lit(" |\n\n```text\n[not](a-link.md)\n```\n\n## Text\n"), F.col("text"), F.lit("\n"),
    )
    return d.select(
        F.concat(F.lit("note://resources/project/doc-"), ident, F.lit(".md")).alias("uri"),
        F.concat(F.lit("/corpus/project/doc-"), ident, F.lit(".md")).alias("path"),
        raw.alias("raw"),
        "doc_id",
        "lang",
        "source",
    )


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """One small module per document, importing from its neighbour."""
    ident = F.col("doc_id").cast("string")
    code = F.concat(
        F.lit("from lib."), F.col("source"), F.lit(".m"), (F.col("doc_id") + 1).cast("string"), F.lit(" import other\n\ndef run_"), ident,
        F.lit("(x):\n    return helper(other(x))\n\ndef helper(y):\n    return len(y)\n"),
    )
    return documents(spark, folder).select(
        F.lit("corpus").alias("source_id"),
        F.concat(F.lit("lib/"), F.col("source"), F.lit("/m"), ident, F.lit(".py")).alias("path"),
        F.encode(code, "UTF-8").alias("content"),
        "doc_id",
        "lang",
    )
