"""The data source of note folders against the scan by file tables."""

import json
import os

from corpusloom.sources import note_source
from corpusloom.sources.note_source import NoteSource, list_notes, plan
from corpusloom.sources.notes import Mount, scan_notes


def write(root, name, text, at):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as stream:
        stream.write(text.encode() if isinstance(text, str) else text)
    os.utime(path, (at, at))


def fill(root):
    for i in range(40):
        write(root, f"d{i % 3}/n{i}.md", f"# Note {i}\r\n\r\nté{i}\n", 1000 + i)
        if i % 2:
            write(root, f"d{i % 3}/n{i}.meta.json", json.dumps({"title": f"T{i}"}), 1000.25 + i)
    write(root, "big.md", "x" * (4 * 1024 * 1024 + 1), 900)
    write(root, "empty.md", "", 900)
    write(root, "odd [1] #.md", "# Odd\n", 900)
    write(root, "lonely.meta.json", "{}", 900)
    write(root, "readme.txt", "no note", 900)


def test_reads_what_the_scan_reads(spark, place):
    fill(place)
    spark.dataSource.register(NoteSource)
    df = spark.read.format("notes").option("layer", "shared").option("partitionBytes", 3_000_000).load(place)
    assert df.rdd.getNumPartitions() > 2
    names = ["layer", "relative_path", "length", "modified", "raw", "sidecar", "sidecar_bytes", "sidecar_modified", "path"]
    by = lambda rows: {r[1]: r for r in rows}
    ours, scanned = by(cells(df, names)), by(cells(scan_notes(spark, [Mount("shared", place)]), names))
    # Spark's file tables leave out files of no bytes.
    assert set(ours) == set(scanned) | {"empty.md"} and len(ours) == 43
    assert {n: ours[n] for n in scanned if "[" not in n} == {n: r for n, r in scanned.items() if "[" not in n}
    assert ours["odd [1] #.md"][4] == "# Odd\n" and ours["big.md"][4] is None and ours["empty.md"][4] == ""
    assert spark.read.format("notes").load(f"file://{place}").count() == 43


def cells(frame, names):
    return [tuple(r) for r in frame.select(*names).collect()]


def test_links_and_empty_folders(spark, place):
    write(place, "in/a.md", "# A\n", 10)
    write(place, "out/b.md", "# B\n", 10)
    os.symlink(f"{place}/out/b.md", f"{place}/in/b.md")
    os.symlink(f"{place}/out", f"{place}/in/linked")
    assert [e.relative_path for e in list_notes(f"{place}/in")] == ["a.md"]
    os.makedirs(f"{place}/none")
    spark.dataSource.register(NoteSource)
    assert spark.read.format("notes").load(f"{place}/none").count() == 0


def test_partitions_are_cut_by_size(place):
    fill(place)
    entries = list_notes(place)
    parts = plan(entries, 1_500_000)
    assert [e for p in parts for e in p.entries] == entries
    assert all(len(p.entries) == 1 or sum(e.cost for e in p.entries) <= 1_500_000 for p in parts)
    assert len(plan(entries, 1 << 40)) == 1 and plan([], 1) == []


def test_stream_takes_each_change_once(spark, place):
    root = f"{place}/notes"
    write(root, "a.md", "# A\n", 1000)
    write(root, "b.md", "# B\n", 1001)
    spark.dataSource.register(NoteSource)

    def advance():
        stream = spark.readStream.format("notes").load(root)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/sink")
        query.awaitTermination()
        return sorted((r.relative_path, r.sidecar or "") for r in spark.read.schema(note_source.SCHEMA).parquet(f"{place}/sink").collect())

    assert advance() == [("a.md", ""), ("b.md", "")]
    assert advance() == [("a.md", ""), ("b.md", "")]
    write(root, "b.meta.json", "{}", 1002)
    write(root, "c.md", "# C\n", 1003)
    assert advance() == [("a.md", ""), ("b.md", ""), ("b.md", "{}"), ("c.md", "")]
