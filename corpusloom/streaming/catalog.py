"""A file stream that keeps a catalog current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans import catalog


def catalog_stream(notes: DataFrame, root: str, checkpoint: str):
    """Apply arriving notes to the catalog below ``root`` in micro-batches.

    A batch only lists what arrived, so it never proves an absence: no root counts as
    readable and rows the batch does not mention are carried. The stream's checkpoint
    remembers which files were applied.
    """

    def apply(batch: DataFrame, _: int) -> None:
        order = F.struct("modified", "path")
        others = [c for c in batch.columns if c != "uri"]
        newest = batch.groupBy("uri").agg(F.max_by(F.struct(*others), order).alias("row")).select("uri", "row.*").select(*batch.columns)
        none = newest.select("root").where(F.lit(False))
        mounted = newest.select("root").distinct()
        stored = catalog.latest(newest.sparkSession, root)
        if stored is not None:
            mounted = mounted.unionByName(stored.entries().select("root").distinct())
        catalog.refresh(newest, root, readable_roots=none, mounted_roots=mounted)

    query = notes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
