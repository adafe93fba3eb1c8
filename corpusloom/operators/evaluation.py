"""Retrieval metrics, summaries and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold

PERCENTILE_BUCKETS = 65_536


def invalid_cases(cases: DataFrame, qrels: DataFrame) -> DataFrame:
    """(case_id, problem) for cases an evaluation must refuse."""
    named = cases.select(F.coalesce(F.col("case_id").cast("string"), F.lit("")).alias("case_id"), F.trim(F.coalesce("query", F.lit(""))).alias("query"))
    repeated = named.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("query")).alias("shortest"))
    bad_case = repeated.where((F.col("n") > 1) | (F.col("case_id") == "") | (F.col("shortest") == 0)).select(
        "case_id", F.lit("cases need unique ids and nonempty queries").alias("problem")
    )
    grade = F.col("grade")
    bad_grade = qrels.where(grade.isNull() | F.isnan(grade) | (grade < 0) | (grade > 4)).select(
        F.col("case_id").cast("string"), F.lit("grades must be finite numbers from 0 to 4").alias("problem")
    )
    return bad_case.unionByName(bad_grade).distinct()


def case_metrics(results: DataFrame, qrels: DataFrame, limit: int) -> DataFrame:
    """(case_id, labels, recall, mrr, ndcg) for cases with a positive label.

    results(case_id, rank, uri). A repeated hit keeps its rank but gains nothing.
    """
    positive = qrels.where("grade > 0").groupBy("case_id", "uri").agg(F.max(F.col("grade").cast("double")).alias("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    found = (
        results.where(F.col("rank") <= limit)
        .groupBy("case_id", "uri")
        .agg(F.min("rank").alias("rank"))
        .join(positive, ["case_id", "uri"])
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.min("rank").alias("first"),
            F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"),
        )
    )
    # Only the best ``limit`` labels form the ideal list; the rank filter cuts each task
    # to that many rows per case before the shuffle.
    at = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "uri"))
    ideal = (
        positive.withColumn("at", at).where(F.col("at") <= limit).groupBy("case_id").agg(F.sum(gain / F.log2(F.col("at") + 1)).alias("idcg"))
    )
    labels = positive.groupBy("case_id").agg(F.count(F.lit(1)).alias("labels"))
    zero = F.lit(0.0)
    return (
        labels.join(ideal, "case_id")
        .join(found, "case_id", "left")
        .select(
            "case_id",
            "labels",
            F.coalesce(F.col("hits") / F.col("labels"), zero).alias("recall"),
            F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
            F.coalesce(F.col("dcg") / F.col("idcg"), zero).alias("ndcg"),
        )
    )


def label_cases(cases: DataFrame, metrics: DataFrame, hit_counts: DataFrame) -> DataFrame:
    """Every case with its metrics and its role: scored, no_evidence or unlabelled."""
    role = (
        F.when(F.col("labels") > 0, F.lit("scored")).when(F.col("no_evidence"), F.lit("no_evidence")).otherwise(F.lit("unlabelled"))
    )
    return (
        cases.join(metrics, "case_id", "left")
        .join(hit_counts, "case_id", "left")
        .withColumn("role", role)
        .withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    )


def summary_columns() -> list[Column]:
    is_role = lambda name: (F.col("role") == name).cast("int")
    scored = lambda name: F.avg(F.when(F.col("role") == "scored", F.col(name))).alias(name)
    return [
        F.count(F.lit(1)).alias("queries"),
        F.sum(is_role("scored")).alias("scored_queries"),
        F.sum(is_role("unlabelled")).alias("unlabelled_queries"),
        scored("recall"),
        scored("mrr"),
        scored("ndcg"),
        F.avg(F.when(F.col("role") == "no_evidence", (F.col("n_hits") == 0).cast("double"))).alias("no_evidence_abstention"),
        F.sum(F.col("incomplete").cast("int")).alias("incomplete_queries"),
        F.max("elapsed_ms").alias("max_ms"),
        F.sum("output_bytes").alias("output_bytes"),
    ]


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """evidence(case_id, valid): one row per result, NULL where it could not be checked."""
    return evidence.groupBy("case_id").agg(
        F.count("valid").alias("checked"), F.sum(F.col("valid").cast("long")).alias("proven"), F.sum(F.col("valid").isNull().cast("long")).alias("unknown")
    )


def evidence_columns() -> list[Column]:
    """Over cases with the columns of ``evidence_counts``; NULL accuracy without a check."""
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return [
        (F.sum("proven") / F.when(total("checked") > 0, total("checked"))).alias("evidence_accuracy"),
        total("checked").alias("evidence_checked"),
        total("unknown").alias("evidence_unknown"),
    ]


LATENCIES = {"p50_ms": 0.5, "p95_ms": 0.95}


def summarize(cases: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row overall (category NULL) and one per category.

    Without ``evidence`` nothing counts as checked. Latencies are nearest-rank percentiles.
    """
    none = cases.sparkSession.createDataFrame([], "case_id string, valid boolean")
    counted = cases.join(evidence_counts(none if evidence is None else evidence), "case_id", "left")
    # Cases without a category are one; only the total has none.
    named = counted.withColumn("category", F.coalesce("category", F.lit("unspecified")))
    rows = named.rollup("category").agg(*summary_columns(), *evidence_columns())
    timed = named.select(F.explode(F.array(F.struct(F.lit(True).alias("whole")), F.struct(F.lit(False).alias("whole")))).alias("of"), "category", "elapsed_ms")
    timed = timed.select(F.when(~F.col("of.whole"), F.col("category")).alias("category"), "elapsed_ms")
    key = F.concat_ws(":", F.col("category").isNull().cast("string"), "category").alias("part")
    found = nearest_rank(timed.select(key, "elapsed_ms"), "part", "elapsed_ms", list(LATENCIES.values()))
    ranks = found.groupBy("part").agg(*[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(name) for name, q in LATENCIES.items()])
    return rows.withColumn("part", key).join(ranks, "part", "left").drop("part")


def nearest_rank(values: DataFrame, group: str, value: str, quantiles: list[float], buckets: int = PERCENTILE_BUCKETS) -> DataFrame:
    """Exact nearest-rank percentiles: the ceil(n*q)-th smallest value per group.

    Values are counted into equal-width buckets (map-side combine), the bucket holding
    each wanted rank is found on the counts, and only that bucket's distinct values are
    ordered. A group with a third of all rows therefore never sits in one task.
    """
    clean = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    bounds = clean.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    slot = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (buckets - 1))).otherwise(F.lit(0))
    placed = clean.join(bounds.select("g", "lo", "hi"), "g").select("g", "v", slot.cast("long").alias("slot"))
    counts = placed.groupBy("g", "slot").agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.partitionBy("g").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = bounds.select("g", "n", F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("quantile")).select(
        "g", "quantile", F.greatest(F.lit(1), F.least("n", F.ceil(F.col("n") * F.col("quantile")))).alias("target")
    )
    cumulative = counts.withColumn("cum", F.sum("c").over(up_to))
    target = (
        cumulative.join(wanted, "g")
        .where((F.col("cum") >= F.col("target")) & (F.col("cum") - F.col("c") < F.col("target")))
        .select("g", "slot", "quantile", (F.col("target") - (F.col("cum") - F.col("c"))).alias("within"))
    )
    in_slot = placed.join(target, ["g", "slot"]).groupBy("g", "quantile", "within", "v").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("g", "quantile").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        in_slot.withColumn("cum", F.sum("c").over(order))
        .where(F.col("cum") >= F.col("within"))
        .groupBy("g", "quantile")
        .agg(F.min("v").alias("value"))
        .withColumnRenamed("g", group)
    )


def context_coverage(expected: DataFrame, results: DataFrame) -> DataFrame:
    """expected(case_id, term), results(case_id, excerpt, conditions map) -> (case_id, term, covered)."""
    said = results.select(
        "case_id", fold(F.concat(F.coalesce("excerpt", F.lit("")), F.coalesce(F.to_json("conditions"), F.lit("")))).alias("text")
    )
    return (
        expected.join(said, "case_id", "left")
        .groupBy("case_id", "term")
        .agg(F.coalesce(F.bool_or(F.contains("text", fold(F.col("term")))), F.lit(False)).alias("covered"))
    )
