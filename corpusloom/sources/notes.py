"""Note scans: Markdown files with sidecars, or any table of texts, as one shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions.text import content_hash, unix_newlines

SIDECAR = (
    "title string, slug string, uri string, status string, source map<string,string>, "
    "conditions map<string,string>, evidence string, captured_at string, retrieval string"
)
# Aliases arrive as plain strings or objects, scopes as strings or lists.
RETRIEVAL = "source_sha256 string, aliases array<string>, topics array<string>"
ALIAS = "text string, relation string, scope string"


@dataclass(frozen=True)
class Mount:
    """One readable root folder of a layer."""

    layer: str
    root: str


def scan_files(spark: SparkSession, root: str, glob: str, limit: int) -> DataFrame:
    """Files below a root: path, relative_path, length, modification time, content.

    ``content`` is NULL above the size limit, so an oversized file is never decoded.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    )
    folder = F.lit(root.rstrip("/").removeprefix("file:"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.select(
        plain.alias("path"),
        F.substr(plain, F.length(folder) + 2).alias("relative_path"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
        F.when(F.col("length") <= limit, F.col("content")).alias("content"),
    )


def scan_notes(spark: SparkSession, mounts: list[Mount]) -> DataFrame:
    """All Markdown files of the mounts with their sidecar text, one row per note file."""
    parts = []
    for mount in mounts:
        notes = scan_files(spark, mount.root, "*.md", md.MAX_NOTE_BYTES)
        sides = scan_files(spark, mount.root, "*.meta.json", md.MAX_SIDECAR_BYTES).select(
            F.regexp_replace("path", r"\.meta\.json$", "").alias("stem"),
            F.decode("content", "UTF-8").alias("sidecar"),
            F.col("length").alias("sidecar_bytes"),
            F.col("modified").alias("sidecar_modified"),
        )
        parts.append(
            notes.withColumn("stem", F.regexp_replace("path", r"\.md$", ""))
            .join(sides, "stem", "left")
            .select(
                F.lit(mount.layer).alias("layer"),
                F.lit(mount.root).alias("root"),
                "path",
                "relative_path",
                "length",
                "modified",
                F.decode("content", "UTF-8").alias("raw"),
                "sidecar",
                "sidecar_bytes",
                "sidecar_modified",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parse_aliases(raw: Column) -> Column:
    """array of alias JSON values -> array<struct<text, relation, scope>>."""

    def one(item: Column) -> Column:
        obj = F.from_json(item, ALIAS)
        scope = obj["scope"]
        return F.when(
            item.startswith("{"),
            F.struct(
                obj["text"].alias("text"),
                obj["relation"].alias("relation"),
                F.when(scope.startswith("["), F.from_json(scope, "array<string>"))
                .when(md.strip(scope) != "", F.array(scope))
                .otherwise(F.array().cast("array<string>"))
                .alias("scope"),
            ),
        ).otherwise(
            F.struct(item.alias("text"), F.lit("related").alias("relation"), F.array().cast("array<string>").alias("scope"))
        )

    return F.transform(F.coalesce(raw, F.array().cast("array<string>")), one)


def build_notes(scanned: DataFrame, uri_root: str = md.URI_ROOT) -> DataFrame:
    """Scanned text plus sidecar -> notes; unreadable sidecar JSON counts as empty."""
    meta = scanned.withColumn("meta", F.from_json("sidecar", SIDECAR, {"mode": "PERMISSIVE"}))
    retrieval = F.from_json(F.col("meta.retrieval"), RETRIEVAL)
    canonical = md.uri_for(F.col("layer"), F.col("relative_path"), uri_root)
    text = meta.withColumn("source_sha256", content_hash(F.col("raw"))).withColumn("given", retrieval)
    bound = md.bind_enrichment(
        F.when(
            F.col("given").isNotNull(),
            F.struct(
                F.col("given.source_sha256").alias("source_sha256"),
                parse_aliases(F.col("given.aliases")).alias("aliases"),
                F.col("given.topics").alias("topics"),
            ),
        ),
        F.col("source_sha256"),
    )
    present = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return text.withColumn("retrieval", bound).select(
        "layer",
        "root",
        "path",
        "relative_path",
        F.when(F.col("layer") == "shared", canonical).otherwise(F.coalesce(present(F.col("meta.uri")), canonical)).alias("uri"),
        canonical.alias("canonical_uri"),
        F.coalesce(present(F.col("meta.title")), md.title_of(F.col("raw"))).alias("title"),
        F.coalesce(present(F.col("meta.slug")), F.regexp_replace("relative_path", r"(?i)\.md$", "")).alias("slug"),
        md.body_of(F.col("raw")).alias("body"),
        "raw",
        "source_sha256",
        present(F.col("meta.status")).alias("status"),
        md.clean_mapping(F.col("meta.source")).alias("source"),
        md.clean_conditions(F.col("meta.conditions")).alias("conditions"),
        F.col("meta.evidence").alias("evidence"),
        F.col("meta.captured_at").alias("captured_at"),
        F.col("retrieval.aliases").alias("aliases"),
        F.col("retrieval.topics").alias("topics"),
        F.col("retrieval.ignored").alias("enrichment_ignored"),
        "length",
        "modified",
        F.concat_ws(
            ":", F.unix_micros("modified"), "length", F.coalesce(F.unix_micros("sidecar_modified"), F.lit(-1)), F.coalesce("sidecar_bytes", F.lit(-1))
        ).alias("stat_key"),
        F.sha2(F.concat(F.coalesce("raw", F.lit("")), F.lit("\0"), F.coalesce("sidecar", F.lit(""))), 256).alias("fingerprint"),
    )


def check_identity(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split notes into accepted rows and error rows (uri, path, reason).

    Duplicated URIs are found by a count per URI with map-side combine, so one URI
    held by very many files costs no more than any other.
    """
    shared = notes.groupBy("uri").count().where("count > 1").select("uri", F.lit(True).alias("collides"))
    judged = notes.join(shared, "uri", "left").withColumn(
        "reason",
        F.when(F.col("raw").isNull(), F.lit("unreadable_or_over_size"))
        .when(F.col("uri") != F.col("canonical_uri"), F.lit("identity_disagrees_with_mount"))
        .when(F.col("collides"), F.lit("two_sources_share_one_uri")),
    )
    accepted = judged.where(F.col("reason").isNull()).drop("reason", "collides")
    return accepted, judged.where(F.col("reason").isNotNull()).select("uri", "path", "reason")


def notes_from_texts(documents: DataFrame, uri_root: str = md.URI_ROOT) -> DataFrame:
    """A table (doc_id, text, lang, source) in note shape: one layer per source."""
    by_number = F.element_at(
        F.array(*[F.lit(name) for name in md.LAYERS]), F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(3)) + 1
    )
    # A text without a source has a layer, but neither path nor uri.
    layer = F.coalesce(by_number, F.lit(md.LAYERS[-1]))
    relative = F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id"), F.lit(".md"))
    raw = F.col("text")
    return documents.select(
        layer.alias("layer"),
        F.concat(F.lit("/corpus/"), layer).alias("root"),
        F.concat(F.lit("/corpus/"), layer, F.lit("/"), relative).alias("path"),
        relative.alias("relative_path"),
        F.when(relative.isNotNull(), md.uri_for(layer, relative, uri_root)).alias("uri"),
        md.title_of(raw).alias("title"),
        F.regexp_replace(relative, r"\.md$", "").alias("slug"),
        md.body_of(raw).alias("body"),
        raw.alias("raw"),
        content_hash(raw).alias("source_sha256"),
        F.lit(None).cast("string").alias("status"),
        F.create_map(F.lit("language"), F.col("lang")).alias("conditions"),
        F.lit(None).cast("string").alias("evidence"),
        F.array().cast(md.ALIAS_TYPE).alias("aliases"),
        F.array("lang", "source").alias("topics"),
        F.octet_length(raw).alias("length"),
        F.col("doc_id"),
    )


# File formats an intake reads.
SUPPORTED_SUFFIXES = (".md", ".markdown", ".txt", ".html", ".htm", ".pdf", ".docx", ".xlsx", ".pptx", ".png", ".jpg", ".jpeg", ".webp")


def _glob_regex(pattern: str) -> str:
    out = []
    i = 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            negated = pattern[i + 1] == "!"
            inner = "".join("\\" + c if c in "\\[]&^" else c for c in pattern[i + 1 + negated : close])
            out.append("[" + "^" * negated + inner + "]")
            i = close
        else:
            out.append("\\" + char if char in r"\.^$+{}()|[]" else char)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def is_selected(path: Column, patterns: list[str] | None = None, suffixes: tuple[str, ...] = SUPPORTED_SUFFIXES) -> Column:
    """Supported suffix, and any of: glob match, exact name, literal folder prefix."""
    supported = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)).isin(*suffixes)
    if not patterns:
        return supported
    chosen = F.lit(False)
    for pattern in patterns:
        chosen = chosen | path.rlike(_glob_regex(pattern)) | (path == pattern) | path.startswith(pattern.rstrip("/") + "/")
    return supported & chosen


def unique_by(df: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """First row per key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
