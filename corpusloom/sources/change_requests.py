"""Landed change-request JSON -> one pinned Markdown note per change request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["repo", "number"]
UNBOUNDED = (1 << 31) - 2
# Sentences of the note.
PATCH_NOTE = "API patch excerpt (the pinned file is the complete-source reference):"
SCOPE_NOTE = (
    "This records PR claims, discussion and API patch excerpts. It is not execution evidence. "
    "Large or binary diffs may be omitted by GitHub; use the pinned source links above."
)


def _pinned(kind: str, sha: str, name: Column) -> Column:
    quoted = F.replace(F.url_encode(name), F.lit("%2F"), F.lit("/"))
    quoted = F.replace(F.replace(quoted, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"Pinned {kind}: "), F.col("repo_url"), F.lit("/blob/"), F.col(sha), F.lit("/"), quoted)


def _first(items: DataFrame, order: list, limit: int) -> DataFrame:
    """Each request's list, up to one row beyond the bound, which marks overflow."""
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return items.withColumn("at", at).where(F.col("at") <= limit + 1)


def _section(rows: DataFrame, limit: int, name: str) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= limit, F.struct("at", "block")))), lambda r: r["block"]), "\n"
        ).alias(name),
        F.max((F.col("at") > limit).cast("int")).alias(f"{name}_over"),
        F.sum((F.col("at") <= limit).cast("int")).alias(f"{name}_seen"),
    )


def change_request_notes(
    requests: DataFrame, files: DataFrame, comments: DataFrame, reviews: DataFrame, max_items: int | None = None, site: str = "https://github.com"
) -> DataFrame:
    """One row per request: name, text, location, complete flag.

    requests(repo, number, title, state, merged, body, base_sha, head_sha, changed_files);
    files(repo, number, position, filename, previous_filename, status, additions,
    deletions, patch); comments and reviews(repo, number, position, html_url,
    updated_at, login, body). With ``max_items`` a note lists that many files and
    contributions of each kind at most, and says so by ``complete``.
    """
    max_items = UNBOUNDED if max_items is None else max_items
    pins = requests.select(*KEY, "base_sha", "head_sha", F.concat(F.lit(site + "/"), F.col("repo")).alias("repo_url"))
    listed = _first(files, ["position"], max_items).join(pins, KEY)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.col("filename")),
        F.lit(""),
        F.format_string("Status: %s; +%d / -%d", "status", "additions", "deletions"),
        F.lit(""),
        F.when(
            F.coalesce("patch", F.lit("")) != "",
            F.concat(F.lit(PATCH_NOTE + "\n\n````diff\n"), F.col("patch"), F.lit("\n````\n")),
        ),
        F.when(F.col("status") != "removed", _pinned("head", "head_sha", F.col("filename"))),
        F.when(F.col("status") != "added", _pinned("base", "base_sha", F.coalesce("previous_filename", "filename"))),
        F.lit(""),
    )
    file_text = _section(listed.withColumn("block", block), max_items, "file_text")

    def spoken(items: DataFrame, group: int) -> DataFrame:
        return _first(items, ["position"], max_items).withColumn("group", F.lit(group))

    said = spoken(comments, 0).unionByName(spoken(reviews, 1)).join(pins, KEY)
    said = said.withColumn(
        "block",
        F.concat_ws(
            "\n",
            F.concat(F.lit("### "), F.coalesce("html_url", F.concat("repo_url", F.lit("/pull/"), "number"))),
            F.lit(""),
            F.concat(F.lit("Updated: "), F.coalesce("updated_at", F.lit("None")), F.lit("; author: "), F.coalesce("login", F.lit("unknown"))),
            F.lit(""),
            F.when(F.coalesce("body", F.lit("")) == "", F.lit("(Empty)")).otherwise(F.col("body")),
            F.lit(""),
        ),
    )
    over = said.groupBy(*KEY).agg(F.max((F.col("at") > max_items).cast("int")).alias("talk_over"))
    talk = (
        said.where(F.col("at") <= max_items)
        .withColumn("at", F.struct("group", "at"))
        .groupBy(*KEY)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda r: r["block"]), "\n").alias("talk_text"))
    )
    joined = requests.join(pins.select(*KEY, "repo_url"), KEY).join(file_text, KEY, "left").join(talk, KEY, "left").join(over, KEY, "left")
    url = F.concat(F.col("repo_url"), F.lit("/pull/"), F.col("number"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("title")),
        F.lit(""),
        F.concat(F.lit("Source: "), url),
        F.concat(F.lit("State: "), F.col("state"), F.lit("; merged: "), F.initcap(F.coalesce(F.col("merged"), F.lit(False)).cast("string"))),
        F.concat(F.lit("Base revision: `"), F.col("base_sha"), F.lit("`")),
        F.concat(F.lit("Head revision: `"), F.col("head_sha"), F.lit("`")),
        F.lit("\n## PR description\n"),
        F.when(F.coalesce("body", F.lit("")) == "", F.lit("(No description)")).otherwise(F.col("body")),
        F.lit("\n## Changed files\n"),
        F.col("file_text"),
        F.lit("## Discussion and review\n"),
        F.col("talk_text"),
        F.lit("## Scope of this snapshot\n\n" + SCOPE_NOTE),
    )
    seen = F.coalesce("file_text_seen", F.lit(0))
    return joined.select(
        F.concat("repo", F.lit("#"), "number").alias("key"),
        F.concat(F.substring_index("repo", "/", -1), F.lit("-pr-"), "number", F.lit(".md")).alias("name"),
        text.alias("text"),
        url.alias("location"),
        (
            (F.coalesce("file_text_over", F.lit(0)) == 0)
            & (F.coalesce("talk_over", F.lit(0)) == 0)
            & (seen >= F.coalesce("changed_files", seen))
        ).alias("complete"),
    )
