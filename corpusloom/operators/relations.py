"""Link and mention edges between notes and code, backlinks, affected notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.markdown import normal_url
from corpusloom.operators.health import normal_path
from corpusloom.operators.structure import code_spans, links
from corpusloom.session import materialize

WEB = r"(?i)^https?:"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
INVALID = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[\[\]]"
VALID_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\[\]]*@)?\[[0-9A-Fa-f:.]+\](?::\d*)?(?:[/?#]|$)"
LINE_ANCHOR = r"^L(\d+)(?:-L?(\d+))?$"


def metadata_links(notes: DataFrame) -> DataFrame:
    """(uri, line NULL, target, field): addresses and path-like fields of source and evidence."""
    flat = notes.select("uri", F.explode("source").alias("key", "target")).withColumn("field", F.concat(F.lit("source."), "key"))
    by_name = F.substring_index("field", ".", -1).isin("path", "file", "url", "uri", "href")
    return flat.where(by_name | F.col("target").rlike(r"^(?:https?://|file://|note://|/)")).select(
        "uri", F.lit(None).cast("int").alias("line"), "target", "field"
    )


def address_owners(notes: DataFrame) -> DataFrame:
    """(address, owner): notes that record a web address as their source."""
    sources = notes.select(F.col("uri").alias("owner"), F.explode(F.map_values("source")).alias("value"))
    return sources.where(F.col("value").rlike(WEB)).select(normal_url(F.col("value")).alias("address"), "owner").distinct()


def link_targets(notes: DataFrame, found: DataFrame, code_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolve found(uri, line, target, field) in priority order; returns (edges, gaps).

    Order: exact note URI, another note's source address, a pinned remote code file, a
    local note path, a local code file. Several matches make one ambiguous edge each.
    Every stage is an equi-join on one key that adaptive execution may split, so an address
    that very many notes record or link is spread over tasks.
    """
    own = notes.select("uri", F.col("path").alias("own_path"))
    bad = F.col("target").rlike(INVALID) & ~F.col("target").rlike(VALID_HOST)
    gaps = found.where(bad).select("uri", F.lit("invalid_link").alias("kind"), "line")
    web = F.col("target").rlike(WEB)
    raw_path = F.try_url_decode(F.replace(F.regexp_extract(F.regexp_replace("target", r"^file://(?:localhost)?", ""), r"^[^?#]*", 0), F.lit("+"), F.lit("%2B")))
    base = F.regexp_replace("own_path", "[^/]*$", "")
    is_local = ~F.col("target").rlike(SCHEME) | F.col("target").startswith("file:")
    local = F.when(
        is_local,
        F.when(raw_path == "", F.col("own_path"))
        .when(F.startswith(raw_path, F.lit("/")), normal_path(raw_path))
        .otherwise(normal_path(F.concat(base, raw_path))),
    )
    if "at" not in found.columns:
        found = found.withColumn("at", F.lit(0))
    asked = (
        found.where(~bad)
        .groupBy("uri", "line", "target", "field")
        .agg(F.min("at").alias("at"))
        .join(own, "uri")
        .select(
            "uri",
            "line",
            "target",
            "field",
            "at",
            F.coalesce(F.try_url_decode(F.replace(F.regexp_extract("target", r"#(.*)$", 1), F.lit("+"), F.lit("%2B"))), F.lit("")).alias("fragment"),
            F.when(web, normal_url(F.col("target"))).alias("address"),
            local.alias("local"),
        )
        .withColumn("link_id", F.sha2(F.concat_ws("\0", "uri", F.coalesce("line", F.lit(0)), "target", F.coalesce("field", F.lit(""))), 256))
    )
    # Links are found once; five resolution stages and the final join read them.
    asked = materialize(asked, "links")
    empty = F.lit(None).cast("string")
    by_uri = notes.select(F.col("uri").alias("target"), F.col("uri").alias("hit"))
    by_source = address_owners(notes).select("address", F.col("owner").alias("hit"))
    by_path = notes.select(F.col("path").alias("local"), F.col("uri").alias("hit"))
    record = F.struct(empty.alias("source_id"), empty.alias("source_path"), empty.alias("source_sha256"), F.lit(None).cast("int").alias("line_count"))
    stages = [
        (asked.join(by_uri, "target"), 0, record),
        (asked.join(by_source, "address").where("hit <> uri"), 1, record),
        (asked.join(by_path, "local"), 3, record),
    ]
    if code_files is not None:
        code = code_files.select(
            F.concat(F.lit("code:"), "source_id", F.lit(":"), "path").alias("hit"),
            F.struct("source_id", F.col("path").alias("source_path"), F.col("content_sha256").alias("source_sha256"), "line_count").alias("record"),
            normal_path(F.concat("root", F.lit("/"), "path")).alias("local"),
            F.concat(F.lit("https://github.com/"), "repository", F.lit("/blob/"), "revision", F.lit("/"), "path").alias("address"),
        )
        stages += [
            (asked.join(code.drop("local"), "address"), 2, F.col("record")),
            (asked.join(code.drop("address"), "local"), 4, F.col("record")),
        ]
    hits = None
    for rows, priority, rec in stages:
        part = rows.select("link_id", "hit", F.lit(priority).alias("priority"), rec.alias("record"))
        hits = part if hits is None else hits.unionByName(part)
    hits = materialize(hits, "link-hits")
    best = hits.groupBy("link_id").agg(F.min("priority").alias("priority"))
    # A remote code file wins over notes that share its address.
    best = best.join(hits.where("priority = 2").select("link_id").distinct().withColumn("pinned", F.lit(True)), "link_id", "left").select(
        "link_id", F.when(F.col("pinned") & (F.col("priority") == 1), 2).otherwise(F.col("priority")).alias("priority")
    )
    chosen = hits.join(best, ["link_id", "priority"])
    counts = chosen.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))
    resolved = asked.join(chosen.join(counts, "link_id"), "link_id", "left")
    status = (
        F.when(F.col("n") == 1, F.lit("resolved"))
        .when(F.col("n") > 1, F.lit("ambiguous"))
        .when(F.col("address").isNotNull(), F.lit("external_unchecked"))
        .when(F.col("local").isNotNull(), F.lit("outside_snapshot"))
        .otherwise(F.lit("unresolved"))
    )
    first = F.regexp_extract("fragment", LINE_ANCHOR, 1)
    second = F.regexp_extract("fragment", LINE_ANCHOR, 2)
    low, high = first.cast("long"), F.when(second == "", first).otherwise(second).cast("long")
    anchored = F.col("fragment").rlike(LINE_ANCHOR) & F.col("record.line_count").isNotNull()
    fragment_status = (
        F.when(F.col("fragment") == "", F.lit("none"))
        .when(~F.coalesce(anchored, F.lit(False)), F.lit("unchecked"))
        .when((low >= 1) & (low <= high) & (high <= F.col("record.line_count")), F.lit("verified"))
        .otherwise(F.lit("outside_snapshot"))
    )
    edges = resolved.select(
        F.col("uri").alias("source"),
        F.coalesce("hit", "address", "local", "target").alias("target"),
        F.when(F.col("priority").isin(2, 4), F.lit("explicit_code_link")).otherwise(F.lit("explicit_link")).alias("kind"),
        status.alias("status"),
        "fragment",
        fragment_status.alias("fragment_status"),
        "line",
        "field",
        F.col("record.source_id").alias("source_id"),
        F.col("record.source_path").alias("source_path"),
        empty.alias("symbol_id"),
        "at",
    )
    return edges, gaps


def symbol_mentions(notes: DataFrame, symbols: DataFrame, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """Code spans that name a symbol exactly; returns (edges, gaps).

    symbols(source_id, symbol_id, name, qualified_name, path). Candidates are cut to
    ``limit`` per symbol name before the join, so a name with very many definitions never
    multiplies with its mentions; the full count still decides the gap.
    """
    named = symbols.select(
        "source_id", "symbol_id", "path", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("mention")
    ).where("mention <> ''")
    order = Window.partitionBy("mention").orderBy("source_id", "symbol_id")
    offered = named.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)
    counts = named.groupBy("mention").agg(F.count(F.lit(1)).alias("candidates"))
    said = code_spans(notes).select("uri", "line", F.trim("mention").alias("mention"))
    edges = (
        said.distinct()
        .join(offered, "mention")
        .select(
            F.col("uri").alias("source"),
            F.concat(F.lit("code:"), "source_id", F.lit(":"), "symbol_id").alias("target"),
            F.lit("symbol_candidate").alias("kind"),
            F.lit("candidate").alias("status"),
            F.lit("").alias("fragment"),
            F.lit("none").alias("fragment_status"),
            "line",
            F.lit(None).cast("string").alias("field"),
            "source_id",
            F.col("path").alias("source_path"),
            "symbol_id",
            F.lit(0).alias("at"),
        )
    )
    gaps = said.join(counts.where(F.col("candidates") > limit), "mention").select(
        "uri", F.lit("symbol_candidates_clipped").alias("kind"), "line"
    )
    return edges, gaps


def build_edges(notes: DataFrame, code_files: DataFrame | None = None, symbols: DataFrame | None = None, symbol_limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """All relation edges of the notes, one per (source, target, kind, line, field), and gaps.

    Of several links in one line to one target, the one that stands first is kept.
    """
    found = links(notes, positions=True).withColumn("field", F.lit(None).cast("string"))
    if "source" in notes.columns:
        found = found.unionByName(metadata_links(notes).withColumn("at", F.lit(0)))
    else:
        notes = notes.withColumn("source", F.lit(None).cast("map<string,string>"))
    edges, gaps = link_targets(notes, found, code_files)
    if symbols is not None:
        more, clipped = symbol_mentions(notes, symbols, symbol_limit)
        edges, gaps = edges.unionByName(more), gaps.unionByName(clipped)
    key = ["source", "target", "kind", "line", "field"]
    rest = F.struct(*[c for c in edges.columns if c not in (*key, "at")])
    first = edges.groupBy(*key).agg(F.min_by(rest, F.struct("at", "fragment", "source_id", "symbol_id")).alias("first"))
    return first.select(*key, "first.*").select(*[c for c in edges.columns if c != "at"]), gaps


def limited(rows: DataFrame, limit: int, order: list, per: str | None = None) -> DataFrame:
    """The first ``limit`` rows (per key) with a truncated flag; one row beyond the limit is read."""
    keys = [per] if per else [F.lit(0)]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    near = rows.withColumn("at", at).where(F.col("at") <= limit + 1)
    return near.withColumn("truncated", F.max("at").over(Window.partitionBy(*keys)) > limit).where(F.col("at") <= limit)


def backlinks(edges: DataFrame, targets: DataFrame, limit: int = 40) -> DataFrame:
    """targets(ref) -> edges whose target, symbol or source path is the ref, limited per ref."""
    keys = F.array_distinct(F.filter(F.array("target", "symbol_id", "source_path"), lambda k: k.isNotNull()))
    hits = edges.withColumn("ref", F.explode(keys)).join(targets.select("ref").distinct(), "ref", "left_semi")
    return limited(hits, limit, ["source", "line", "target"], "ref")


def affected_notes(edges: DataFrame, changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per note and reason: (document, source_path, change, relation, target, line).

    changes(source_id, path, state) with state changed / removed / unknown, and
    symbols(source_id, symbol_id) that changed. An edited file touches every file link but
    only the mentions of its changed symbols.
    """
    state = changes.select("source_id", F.col("path").alias("source_path"), "state")
    changed = symbols.select("source_id", "symbol_id").distinct().withColumn("symbol_changed", F.lit(True))
    judged = edges.where("source_id is not null").join(state, ["source_id", "source_path"], "left").join(changed, ["source_id", "symbol_id"], "left")
    unchanged_symbol = (F.col("kind") == "symbol_candidate") & (F.col("state") == "changed") & F.col("symbol_changed").isNull()
    return judged.where((F.col("state").isNotNull() | F.col("symbol_changed").isNotNull()) & ~F.coalesce(unchanged_symbol, F.lit(False))).select(
        F.col("source").alias("document"),
        "source_path",
        F.coalesce("state", F.lit("symbol_changed")).alias("change"),
        F.col("kind").alias("relation"),
        "target",
        "line",
    )
