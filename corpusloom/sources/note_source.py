"""Folders of notes as a Spark data source, in batch and as a stream.

    spark.dataSource.register(NoteSource)
    spark.read.format("notes").option("layer", "shared").load("/corpus/shared")

A row is a Markdown file with its sidecar (``x.md`` with ``x.meta.json``), in the columns of
``scan_notes``, so ``build_notes`` takes it as it is. The sidecar is paired by its path while
files are listed: reading needs no join and no second scan. Partitions are planned by size
(``partitionBytes``), so one task reads many small notes or a few large ones.

Files of any file system that pyarrow opens are read (plain paths, ``file:``, ``hdfs:``, ``s3:``).
Listing holds a path and two numbers per file on the driver, as Spark's own file sources do.
Links are not followed. A note above its size limit has null ``raw``, a sidecar above its limit
null ``sidecar``; neither is opened. Empty files are notes with empty text. Bytes that are no UTF-8 become replacement characters.

The stream takes files in the order of their modification times, a sidecar counting for its
note: a note comes again when either changes. A file is taken once it is ``settle`` seconds
old (2 by default), so that none with an earlier time can still turn up. Removed files are not
reported.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusloom.functions.markdown import MAX_NOTE_BYTES, MAX_SIDECAR_BYTES

NOTE, SIDECAR = ".md", ".meta.json"
PARTITION_BYTES = 64 * 1024 * 1024
# What opening a file costs, in bytes read meanwhile.
OPEN_COST = 256 * 1024
SETTLE = 2.0
SCHEMA = (
    "layer string, root string, path string, relative_path string, length long, modified timestamp, "
    "raw string, sidecar string, sidecar_bytes long, sidecar_modified timestamp"
)
_TIME = pa.timestamp("us", tz="UTC")
_ARROW = pa.schema(
    [("layer", pa.string()), ("root", pa.string()), ("path", pa.string()), ("relative_path", pa.string()), ("length", pa.int64())]
    + [("modified", _TIME), ("raw", pa.string()), ("sidecar", pa.string()), ("sidecar_bytes", pa.int64()), ("sidecar_modified", _TIME)]
)
BATCH_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Entry:
    """A note file, and its sidecar where there is one (sizes in bytes, times in microseconds)."""

    relative_path: str
    length: int
    modified: int
    sidecar_bytes: int | None = None
    sidecar_modified: int | None = None

    @property
    def changed(self) -> int:
        return max(self.modified, self.sidecar_modified or 0)

    @property
    def cost(self) -> int:
        sidecar = 0 if self.sidecar_bytes is None else OPEN_COST + self.sidecar_bytes
        return OPEN_COST + self.length + sidecar


class NotePartition(InputPartition):
    def __init__(self, entries: list[Entry]):
        self.entries = entries


def list_notes(root: str) -> list[Entry]:
    """Notes below ``root`` in the order of their paths."""
    files, base = pafs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    real = os.path.realpath(base) if isinstance(files, pafs.LocalFileSystem) else None
    notes, sides = {}, {}
    for info in files.get_file_info(pafs.FileSelector(base, recursive=True)):
        name = info.path[len(base) + 1 :]
        kind = notes if name.endswith(NOTE) else sides if name.endswith(SIDECAR) else None
        if kind is None or info.type != pafs.FileType.File:
            continue
        if real is not None and os.path.realpath(info.path) != f"{real}/{name}":
            continue
        kind[name.removesuffix(NOTE).removesuffix(SIDECAR)] = (name, info.size, info.mtime_ns // 1000)
    found = []
    for stem, (name, size, modified) in sorted(notes.items()):
        _, side_bytes, side_modified = sides.get(stem, (None, None, None))
        found.append(Entry(name, size, modified, side_bytes, side_modified))
    return found


def plan(entries: list[Entry], partition_bytes: int) -> list[NotePartition]:
    """Entries in turn, cut where a partition would cost more than ``partition_bytes``."""
    out, cost = [], 0
    for entry in entries:
        if not out or cost + entry.cost > partition_bytes:
            out.append(NotePartition([]))
            cost = 0
        out[-1].entries.append(entry)
        cost += entry.cost
    return out


class _Notes:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("notes need a folder: load(path)")
        self.root, self.layer = options["path"].rstrip("/"), options.get("layer", "project")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.settle = float(options.get("settle", SETTLE))

    def planned(self, entries: list[Entry]) -> list[NotePartition]:
        # Spark wants a partition even where there is nothing to read.
        return plan(entries, self.partition_bytes) or [NotePartition([])]

    def read(self, partition: NotePartition) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(self.root)
        base = base.rstrip("/")

        def text(name: str, size: int | None, limit: int) -> str | None:
            if size is None or size > limit:
                return None
            with files.open_input_stream(f"{base}/{name}") as stream:
                return stream.read().decode("utf-8", "replace")

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        moment = lambda micros: None if micros is None else datetime.fromtimestamp(micros // 1_000_000, UTC).replace(microsecond=micros % 1_000_000)
        rows, held = [], 0
        for entry in partition.entries:
            name = entry.relative_path
            rows.append(
                {
                    "layer": self.layer,
                    "root": self.root,
                    "path": f"{base}/{name}",
                    "relative_path": name,
                    "length": entry.length,
                    "modified": moment(entry.modified),
                    "raw": text(name, entry.length, MAX_NOTE_BYTES),
                    "sidecar": text(name.removesuffix(NOTE) + SIDECAR, entry.sidecar_bytes, MAX_SIDECAR_BYTES),
                    "sidecar_bytes": entry.sidecar_bytes,
                    "sidecar_modified": moment(entry.sidecar_modified),
                }
            )
            held += entry.cost - OPEN_COST
            if held > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class NoteReader(_Notes, DataSourceReader):
    def partitions(self) -> list[NotePartition]:
        return self.planned(list_notes(self.root))


class NoteStreamReader(_Notes, DataSourceStreamReader):
    """Offsets are modification times in microseconds: a batch holds what changed after its
    start and up to its end."""

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        settled = int((time.time() - self.settle) * 1_000_000)
        return {"until": max([e.changed for e in list_notes(self.root) if e.changed <= settled], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[NotePartition]:
        return self.planned([e for e in list_notes(self.root) if start["until"] < e.changed <= end["until"]])


def write_notes(notes: DataFrame, root: str) -> None:
    """Write notes(relative_path, raw, sidecar) as files below ``root``, where their task is.

    A null ``raw`` writes no note, a null ``sidecar`` no sidecar. A task that runs again
    writes the same files again; paths are distinct.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(root)
        folders = set()

        def put(name: str, text: str | None) -> int:
            if text is None:
                return 0
            path = f"{base.rstrip('/')}/{name}"
            folder = path.rpartition("/")[0]
            if folder not in folders:
                files.create_dir(folder, recursive=True)
                folders.add(folder)
            with files.open_output_stream(path) as stream:
                stream.write(text.encode("utf-8"))
            return 1

        for batch in batches:
            written = 0
            for row in batch.to_pylist():
                name = row["relative_path"]
                written += put(name, row["raw"]) + put(name.removesuffix(NOTE) + SIDECAR, row["sidecar"])
            yield pa.RecordBatch.from_pydict({"written": [written]}, schema=pa.schema([("written", pa.int64())]))

    rows = notes.select("relative_path", "raw", "sidecar").mapInArrow(write, "written long")
    rows.write.format("noop").mode("overwrite").save()


class NoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NoteReader:
        return NoteReader(self.options)

    def streamReader(self, schema) -> NoteStreamReader:
        return NoteStreamReader(self.options)
