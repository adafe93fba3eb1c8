"""The calls a user needs, DataFrame in and DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.functions import markdown as md
from corpusloom.operators import evaluation, snapshots
from corpusloom.operators.excerpts import verify_evidence
from corpusloom.operators.health import health_findings as health
from corpusloom.operators.lookup import explain
from corpusloom.operators.relations import affected_notes, backlinks
from corpusloom.operators.relations import build_edges as relations
from corpusloom.plans.catalog import build, refresh
from corpusloom.plans.export import export_notes as export
from corpusloom.plans.export import verify_export, verify_release
from corpusloom.plans.search import query_status, search
from corpusloom.streaming.capture import merge_titles

__all__ = [
    "affected_notes", "backlinks", "build", "capture", "evaluate", "explain", "export", "health", "query_status", "refresh",
    "relations", "search", "sync_feed", "verify_evidence", "verify_export", "verify_release",
]


def capture(events: DataFrame, notes: DataFrame) -> DataFrame:
    """Apply captures(title, body, received, ...) to candidate notes of the same shape:
    the latest body per title wins and fields a capture leaves out stay. Captures without
    a title or a body are refused rows and change nothing."""
    usable = (md.strip(events["title"]) != "") & (md.strip(events["body"]) != "")
    keep = tuple(c for c in notes.columns if c not in ("title", "body", "received"))
    return merge_titles(notes, events.where(usable).select(*notes.columns), keep=keep)


def evaluate(results: DataFrame, cases: DataFrame, qrels: DataFrame, limit: int = 8, evidence: DataFrame | None = None) -> DataFrame:
    """Per category and overall: metrics of results(case_id, rank, uri) against
    qrels(case_id, uri, grade), and of evidence(case_id, valid), one row per result.
    cases(case_id, category, query, no_evidence, incomplete, elapsed_ms, output_bytes).
    Malformed cases or grades stop the evaluation."""
    if limit < 1:
        raise ValueError("limit must be positive")
    problems = evaluation.invalid_cases(cases, qrels).take(3)
    if problems:
        raise ValueError("; ".join(f"{p.case_id}: {p.problem}" for p in problems))
    counts = results.where(results["rank"] <= limit).groupBy("case_id").count().withColumnRenamed("count", "n_hits")
    return evaluation.summarize(evaluation.label_cases(cases, evaluation.case_metrics(results, qrels, limit), counts), evidence)


def sync_feed(journal: DataFrame, actual: DataFrame, incoming: DataFrame) -> DataFrame:
    """What applying a feed would do, all or nothing: see ``snapshots.three_way``."""
    return snapshots.three_way(journal, actual, incoming)
