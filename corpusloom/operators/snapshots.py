"""Digests, diffs, conflict checks and incremental maintenance of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGEST_LEVELS = (5, 2)


def manifest_line(key: str, value: str) -> Column:
    return F.concat(F.col(key), F.lit("\0"), F.col(value), F.lit("\n"))


def node_line(node: str) -> Column:
    return manifest_line(node, "digest")


def fold_level(rows: DataFrame, groups: list[Column], name: str, text: Column) -> DataFrame:
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col(name), text.alias("line")))), lambda r: r["line"]))
    return rows.groupBy(*groups).agg(F.sha2(joined, 256).alias("digest"))


def corpus_digest(rows: DataFrame, key: str = "path", value: str = "sha256", levels: tuple[int, ...] = DIGEST_LEVELS, per: tuple[str, ...] = ()) -> DataFrame:
    """One hash over all (key, value) rows of any number, as a tree of hashes; one for each
    combination of the ``per`` columns.

    Rows group by the leading hex digits of sha256(key), each group hashes its lines in
    key order, and the group hashes are hashed again level by level. Keys are unique, so
    groups are even and small at every level and no task sees the whole table. The default
    has 16^5 leaves: a billion rows make groups of about a thousand lines.
    """
    own = [F.col(c) for c in per]
    keyed = rows.select(*own, F.col(key), F.col(value), F.sha2(F.col(key), 256).alias("hex"))
    current = fold_level(keyed, [*own, F.left("hex", F.lit(levels[0])).alias("node")], key, manifest_line(key, value))
    for width in (*levels[1:], 0):
        parent = F.left("node", F.lit(width)).alias("parent")
        current = fold_level(current, [*own, parent], "node", node_line("node")).withColumnRenamed("parent", "node")
    return current.select(*own, "digest")


def manifest_digest(rows: DataFrame, *keys: str, path: str = "path", value: str = "sha256") -> DataFrame:
    """Digest and number of files of each manifest, of any size."""
    digests = corpus_digest(rows, path, value, per=keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
    return digests.join(counts, list(keys)) if keys else digests.crossJoin(counts)


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change): added / removed / updated / unchanged."""
    old = before.select(key, F.col(value).alias("before"), F.lit(True).alias("was"))
    new = after.select(key, F.col(value).alias("after"), F.lit(True).alias("is_now"))
    change = (
        F.when(F.col("was").isNull(), F.lit("added"))
        .when(F.col("is_now").isNull(), F.lit("removed"))
        .when(F.col("before").eqNullSafe(F.col("after")), F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    return old.join(new, key, "full_outer").select(key, "before", "after", change.alias("change"))


def renames(changes: DataFrame, key: str) -> DataFrame:
    """Removed and added rows with one content, when exactly one of each has it.

    Contents are counted with map-side combine before the join, so thousands of copies
    of one text never pair up. Renamed rows stay listed as added and removed too.
    """

    def single(change: str, content: str, name: str) -> DataFrame:
        return (
            changes.where(F.col("change") == change)
            .groupBy(F.col(content).alias("content"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(name))
            .where("n = 1")
            .drop("n")
        )

    return single("removed", "before", "renamed_from").join(single("added", "after", "renamed_to"), "content")


def three_way(journal: DataFrame, actual: DataFrame, incoming: DataFrame, key: str = "name", value: str = "hash") -> DataFrame:
    """Rows (name, conflict, changed, missing, applied) of an all-or-nothing update.

    Any name whose actual state differs from the journal is a conflict, and one conflict
    keeps every change from being applied. The gate is a one-row subquery.
    """
    parts = [df.select(key, F.col(value).alias(name)) for df, name in ((journal, "old"), (actual, "now"), (incoming, "new"))]
    joined = parts[0].join(parts[1], key, "full_outer").join(parts[2], key, "full_outer")
    known = F.col("old").isNotNull() | F.col("new").isNotNull()
    judged = joined.where(known).select(
        key,
        (~F.col("old").eqNullSafe(F.col("now"))).alias("conflict"),
        (~F.col("old").eqNullSafe(F.col("new"))).alias("changed"),
        F.col("new").isNull().alias("missing"),
    )
    gate = judged.agg(F.max("conflict").alias("any_conflict")).scalar()
    return judged.withColumn("applied", F.col("changed") & ~gate)


def missing_rows(recorded: DataFrame, seen: DataFrame, scans: DataFrame, key: str, scope: str) -> DataFrame:
    """Recorded rows not seen by their scope's scan, only where that scan was complete."""
    complete = scans.where("complete").select(scope).distinct()
    return recorded.join(complete, scope, "left_semi").join(seen.select(key).distinct(), key, "left_anti")


def replace_collection(catalog: DataFrame, supplied: DataFrame) -> DataFrame:
    """A supplied shared collection is complete: it replaces every earlier imported row.

    Imported rows are the shared ones without a mounted root; local rows stay.
    """
    imported = (F.col("layer") == "shared") & (F.col("root") == "")
    fresh = supplied.where("layer = 'shared'").withColumn("root", F.lit(""))
    local = catalog.where(~imported).join(fresh.select("uri"), "uri", "left_anti")
    return local.unionByName(fresh.select(*catalog.columns))


def retention(versions: DataFrame, keep: int) -> DataFrame:
    """versions(collection, version_id, activated_at, active) -> rows with keep / prune.

    The newest ``keep`` inactive versions are a top list, cut per task before the shuffle;
    everything else is pruned by a join, so a collection may hold any number of versions.
    """
    valid = F.col("version_id").rlike("^v[0-9a-f]{12}$")
    rows = versions.where(F.col("active") | valid).select("collection", "version_id", "active", "activated_at")
    order = Window.partitionBy("collection").orderBy(F.desc(F.coalesce("activated_at", F.lit(0.0))), F.desc("version_id"))
    newest = (
        rows.where(~F.col("active")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= max(keep, 0)).select("collection", "version_id", F.lit(True).alias("recent"))
    )
    decision = F.when(F.col("active") | F.col("recent"), F.lit("keep")).otherwise(F.lit("prune"))
    return rows.join(newest, ["collection", "version_id"], "left").select("collection", "version_id", decision.alias("decision"))


def refresh_plan(listing: DataFrame, catalog: DataFrame, readable_roots: DataFrame, mounted_roots: DataFrame, force: bool = False) -> DataFrame:
    """What a refresh must do per note: (uri, action).

    listing(uri, root, path, stat_key, fingerprint), catalog(uri, root, path, stat_key,
    fingerprint). Equal stat keys skip the note; an equal fingerprint only updates the
    stat key; a moved binding is parsed again. A catalog row is deleted when its root is
    no longer mounted, or was readable in this scan without listing it. Rows under an
    unreadable root are carried.
    """
    new = listing.select(
        "uri", F.col("path").alias("new_path"), F.col("stat_key").alias("new_stat"), F.col("fingerprint").alias("new_print"), F.lit(True).alias("listed")
    )
    old = catalog.select(
        "uri", "root", F.col("path").alias("old_path"), F.col("stat_key").alias("old_stat"), F.col("fingerprint").alias("old_print"), F.lit(True).alias("known")
    )
    readable = readable_roots.select("root").distinct().withColumn("readable", F.lit(True))
    mounted = mounted_roots.select("root").distinct().withColumn("mounted", F.lit(True))
    same_binding = F.col("new_path") == F.col("old_path")
    action = (
        F.when(
            F.col("listed").isNull(),
            F.when((F.col("root") != "") & F.col("mounted").isNull(), F.lit("delete"))
            .when(F.col("readable"), F.lit("delete"))
            .otherwise(F.lit("carry")),
        )
        .when(F.col("known").isNull(), F.lit("insert"))
        .when(same_binding & (F.col("new_stat") == F.col("old_stat")) & F.lit(not force), F.lit("unchanged"))
        .when(same_binding & (F.col("new_print") == F.col("old_print")), F.lit("touch"))
        .otherwise(F.lit("update"))
    )
    return (
        new.join(old, "uri", "full_outer")
        .join(readable, "root", "left")
        .join(mounted, "root", "left")
        .select("uri", action.alias("action"))
    )


def refresh_report(plan: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of counts; ``partial`` when any source could not be used."""
    count = lambda *names: F.sum(F.col("action").isin(*names).cast("int"))
    failed = errors.agg(F.count(F.lit(1))).scalar()
    return plan.agg(
        count("insert", "update", "touch", "unchanged").alias("scanned"),
        count("insert", "update").alias("parsed"),
        count("touch", "unchanged").alias("unchanged"),
        count("delete").alias("deleted"),
    ).select("*", failed.alias("errors"), F.when(failed > 0, F.lit("partial")).otherwise(F.lit("ready")).alias("status"))


def delta_mode(consumer: DataFrame, catalog: DataFrame) -> DataFrame:
    """How a consumer may apply the latest refresh: reuse / delta / full.

    consumer(consumer, applied_snapshot, model), catalog(previous_snapshot, snapshot,
    status, model): a delta continues only from exactly the snapshot applied last.
    """
    latest = catalog.select(F.struct("previous_snapshot", "snapshot", "status", "model")).scalar()
    usable = (F.col("latest.status") == "ready") & F.col("latest.snapshot").isNotNull() & (F.col("model") == F.col("latest.model"))
    continuous = F.col("applied_snapshot") == F.col("latest.previous_snapshot")
    same = continuous & (F.col("applied_snapshot") == F.col("latest.snapshot"))
    return consumer.withColumn("latest", latest).select(
        "consumer",
        F.when(F.coalesce(usable & same, F.lit(False)), F.lit("reuse"))
        .when(F.coalesce(usable & continuous, F.lit(False)), F.lit("delta"))
        .otherwise(F.lit("full"))
        .alias("mode"),
    )
