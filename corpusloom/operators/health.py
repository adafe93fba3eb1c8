"""Review hints: exact duplicates, age, changed link targets, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.markdown import strict_epoch
from corpusloom.functions.text import strip, unix_newlines
from corpusloom.operators.structure import plain_links

DAY = 86_400


def duplicate_keys(notes: DataFrame) -> DataFrame:
    """(uri, path, duplicate_key): text, conditions, status and evidence must all agree."""
    entries = F.array_sort(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,string>"))))
    context = F.to_json(F.struct(entries.alias("conditions"), "status", "evidence"))
    key = F.sha2(F.concat(strip(unix_newlines(F.col("raw"))), F.lit("\0"), context), 256)
    return notes.where("body <> ''").select("uri", "path", key.alias("duplicate_key"))


def duplicate_groups(notes: DataFrame) -> DataFrame:
    """(duplicate_key, copies) for texts held by at least two distinct paths.

    Paths combine per (key, path) first, so a group of very many copies is counted, never
    gathered; its members are rows of ``duplicate_members``.
    """
    paths = duplicate_keys(notes).groupBy("duplicate_key", "path").agg(F.min("uri").alias("uri"))
    return paths.groupBy("duplicate_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_members(notes: DataFrame) -> DataFrame:
    """One row per member of a duplicate group. The join sends only keys; Spark splits a
    hot key's members over several tasks because the group side has one row per key."""
    keys = duplicate_keys(notes)
    return keys.join(duplicate_groups(notes), "duplicate_key").select("duplicate_key", "uri", "path", "copies")


def recorded_age(notes: DataFrame) -> DataFrame:
    """(uri, recorded, basis): the zoned capture time, else the file's modification time."""
    captured = strict_epoch(F.col("captured_at"))
    return notes.select(
        "uri",
        F.coalesce(captured, F.unix_micros("modified") / F.lit(1_000_000.0)).alias("recorded"),
        F.when(captured.isNotNull(), F.lit("captured_at")).otherwise(F.lit("file_modified_at")).alias("basis"),
    )


def age_findings(ages: DataFrame, now: float, max_age_days: int = 180) -> DataFrame:
    """Rows whose recorded time plus the allowed days is not after ``now`` (inclusive)."""
    if max_age_days < 1:
        raise ValueError("max_age_days must be a positive integer")
    return ages.where(F.col("recorded") + max_age_days * DAY <= now)


def local_links(notes: DataFrame) -> DataFrame:
    """(uri, raw_sha256, link, target): relative links resolved against the note's folder."""
    base = F.regexp_replace("path", "[^/]*$", "")
    # Scheme, host, absolute or backslash targets are not local files of the corpus.
    rows = notes.select("uri", F.sha2("raw", 256).alias("raw_sha256"), base.alias("base"), F.explode_outer(plain_links(F.col("body"))).alias("link"))
    name = F.try_url_decode(F.replace(F.regexp_extract("link", r"^[^?#]*", 0), F.lit("+"), F.lit("%2B")))
    relative = F.col("link").isNotNull() & ~F.col("link").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|/)") & (name != "") & ~F.contains(name, F.lit("\\"))
    return rows.where(relative).select("uri", "raw_sha256", "link", normal_path(F.concat("base", name)).alias("target"))


def normal_path(path):
    """Lexical ``.`` and ``..`` resolution of an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # A path has few parts, so folding them into a stack is cheap.
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(stack, "/"))


def link_drift(notes: DataFrame, files: DataFrame, baseline: DataFrame) -> DataFrame:
    """(uri, link, target, observed, current, outcome) per local link.

    files(path, sha256) are the readable targets, baseline(uri, raw_sha256, link, sha256)
    the first observations. The outcome is new / same / changed / unavailable; a baseline
    holds only for the note bytes it was taken with and never advances.
    """
    current = files.select(F.col("path").alias("target"), F.col("sha256").alias("current"))
    first = baseline.select("uri", "raw_sha256", "link", F.col("sha256").alias("observed"))
    outcome = (
        F.when(F.col("current").isNull(), F.lit("unavailable"))
        .when(F.col("observed").isNull(), F.lit("new"))
        .when(F.col("observed") != F.col("current"), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return (
        local_links(notes)
        .join(current, "target", "left")
        .join(first, ["uri", "raw_sha256", "link"], "left")
        .withColumn("outcome", outcome)
    )


def next_baseline(drift: DataFrame) -> DataFrame:
    kept = F.coalesce("observed", "current")
    return drift.select("uri", "raw_sha256", "link", kept.alias("sha256")).where("sha256 is not null")


def health_findings(notes: DataFrame, now: float, max_age_days: int = 180, drift: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """All findings in one shape: (kind, status, uri, detail)."""
    found = [
        duplicate_members(notes).select(
            F.lit("exact_duplicate").alias("kind"), F.lit("review_hint").alias("status"), "uri", F.col("duplicate_key").alias("detail")
        ),
        age_findings(recorded_age(notes), now, max_age_days).select(
            F.lit("age_review").alias("kind"), F.lit("review_hint").alias("status"), "uri", F.col("basis").alias("detail")
        ),
    ]
    if drift is not None:
        kinds = F.when(F.col("outcome") == "changed", F.lit("linked_source_changed")).otherwise(F.lit("linked_source_unavailable"))
        status = F.when(F.col("outcome") == "changed", F.lit("review_hint")).otherwise(F.lit("unknown"))
        found.append(
            drift.where(F.col("outcome").isin("changed", "unavailable")).select(
                kinds.alias("kind"), status.alias("status"), "uri", F.col("link").alias("detail")
            )
        )
    if gaps is not None:
        found.append(gaps.select("kind", F.lit("unknown").alias("status"), "uri", "detail"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def health_summary(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per kind with the overall status: partial as soon as anything is unknown."""
    unknown = findings.agg(F.coalesce(F.bool_or(F.col("status") == "unknown"), F.lit(False))).scalar()
    total = notes.agg(F.count(F.lit(1))).scalar()
    return findings.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("findings")).select(
        "kind", "status", "findings", total.alias("documents"), F.when(unknown, F.lit("partial")).otherwise(F.lit("ok")).alias("overall")
    )
