"""A table of one row per key, kept current by a stream at the cost of what arrives.

The stream is a stateful aggregation in update mode; its state, one row per key, lives in
the RocksDB state store of the checkpoint. A micro-batch hands out the rows of the keys it
touched, and these are appended as one folder. Reading folds the rows of a key over all
folders with the same aggregation, so a folder written twice, or a stream started anew
over a table that exists, changes nothing.

Folders merge like the digits of a counter: a folder is folded into the one before it
when that one is not at least ``GROWTH`` times as large. There are only a few folders at
any time, and a row is rewritten a few times in its life, however large the table gets. A
list of the current folders is published last; folders that the two latest lists do not
name are removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROWTH = 2
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LIST = "place int, folder string, rows long"

Fold = Callable[[DataFrame], DataFrame]


class KeyedTable:
    """``fold`` aggregates rows to one per key; folding folded rows again must be right."""

    def __init__(self, spark: SparkSession, root: str, fold: Fold):
        self.spark, self.root, self.fold = spark, root, fold

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _lists(self) -> list[int]:
        """Numbers of the lists that are complete, in order."""
        files, path = self._at("lists")
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and files.exists(self._at(f"lists/{n}/_SUCCESS")[1]))

    def folders(self, number: int | None = None) -> list[tuple[str, int]]:
        """(folder, rows) of the current table, oldest first; a handful."""
        lists = self._lists()
        if number is None and not lists:
            return []
        rows = self.spark.read.schema(_LIST).parquet(f"{self.root}/lists/{lists[-1] if number is None else number}").collect()
        return [(r.folder, r.rows) for r in sorted(rows, key=lambda r: r.place)]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/data/{f}" for f in folders])

    def read(self) -> DataFrame | None:
        """One row per key; None before the first batch."""
        current = self.folders()
        return self.fold(self._read([f for f, _ in current])) if current else None

    def _put(self, rows: DataFrame, folder: str) -> tuple[str, int]:
        rows.write.mode("overwrite").parquet(f"{self.root}/data/{folder}")
        return folder, self._read([folder]).count()

    def append(self, batch: DataFrame, name: str) -> None:
        """Add the rows of a batch; a batch of the same name takes the place of the first."""
        current = [entry for entry in self.folders() if entry[0] != name]
        current.append(self._put(batch, name))
        while len(current) > 1 and current[-2][1] < GROWTH * current[-1][1]:
            pair = [f for f, _ in current[-2:]]
            current[-2:] = [self._put(self.fold(self._read(pair)), f"merged-{uuid.uuid4().hex}")]
        lists = self._lists()
        number = lists[-1] + 1 if lists else 0
        rows = [(i, folder, n) for i, (folder, n) in enumerate(current)]
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists/{number}")
        self._clean([*lists[-1:], number])

    def _clean(self, named: list[int]) -> None:
        wanted = {f for number in named for f, _ in self.folders(number)}
        for place, keep in (("data", wanted), ("lists", {str(n) for n in named})):
            files, path = self._at(place)
            for status in files.listStatus(path):
                if status.getPath().getName() not in keep:
                    files.delete(status.getPath(), True)


def run(rows: DataFrame, table: KeyedTable, checkpoint: str):
    """Fold a stream into the table until its input is used up; returns the finished query."""
    spark = table.spark
    # Batches of one checkpoint are numbered; those of another must not take their places.
    origin = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = (
            table.fold(rows)
            .writeStream.outputMode("update")
            .foreachBatch(lambda batch, number: table.append(batch, f"batch-{origin}-{number}"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_STORE, before)
    query.awaitTermination()
    return query
