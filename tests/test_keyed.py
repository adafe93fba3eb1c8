"""Streams into tables of one row per key: restarts, replays and what a batch writes."""

import json
import os
import random

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.streaming import capture

FOLDER = "/root/testdata/sf0.001"

SCHEMA = "title string, body string, received long, status string"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def deliver(place, name, rows):
    os.makedirs(f"{place}/in", exist_ok=True)
    with open(f"{place}/in/{name}.json", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(dict(zip(("title", "body", "received", "status"), r, strict=True))) + "\n" for r in rows)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_titles_follow_the_batch_meaning_over_restarts(spark, place):
    rng = random.Random(2)
    given, grown = [], []
    stream = lambda: spark.readStream.schema(SCHEMA).json(f"{place}/in")
    table = capture.titles(spark, f"{place}/titles", ("status",))
    for n in range(6):
        # One large delivery, then small ones; every run starts the query anew.
        rows = [(f"t{rng.randrange(3000)}", rng.choice(["", f"b{rng.random()}" * 20]), rng.randrange(100), rng.choice([None, f"s{n}"])) for _ in range(4000 if n == 0 else 20)]
        given += rows
        deliver(place, n, rows)
        capture.update_stream(stream(), f"{place}/titles", f"{place}/progress", ("status",))
        grown.append(size(f"{place}/titles/data"))
        batch = capture.latest_titles(capture.with_body(spark.createDataFrame(given, SCHEMA)), keep=("status",))
        assert sorted(tuple(r) for r in table.read().collect()) == sorted(tuple(r) for r in batch.collect())
    # The large folder was written once; later batches and their merges are small beside it.
    assert table.folders()[0][0].startswith("batch-") and grown[-1] - grown[0] < grown[0] / 2
    assert len(table.folders()) <= 4 and len(os.listdir(f"{place}/titles/lists")) <= 3


def test_a_lost_checkpoint_and_a_repeated_batch_change_nothing(spark, place):
    rows = [(f"t{i % 7}", f"b{i}", i, "s" if i < 3 else None) for i in range(50)]
    deliver(place, 1, rows)
    stream = lambda: spark.readStream.schema(SCHEMA).json(f"{place}/in")
    capture.update_stream(stream(), f"{place}/titles", f"{place}/progress", ("status",))
    table = capture.titles(spark, f"{place}/titles", ("status",))
    before = sorted(tuple(r) for r in table.read().collect())
    capture.update_stream(stream(), f"{place}/titles", f"{place}/another", ("status",))
    table.append(spark.createDataFrame(before, SCHEMA), "batch-again")
    table.append(spark.createDataFrame(before, SCHEMA), "batch-again")
    assert sorted(tuple(r) for r in table.read().collect()) == before


def test_capture_reads_nothing_that_was_stored(spark, place):
    text = "a message that is long enough to keep: {}"
    event = lambda n, t: {"client": "codex", "payload": json.dumps({"hook_event_name": "Stop", "last_assistant_message": text.format(n), "session_id": f"s{t}"}), "received": t}
    os.makedirs(f"{place}/in")
    stream = lambda: spark.readStream.schema("client string, payload string, received long").json(f"{place}/in")
    run = lambda: capture.capture_stream(capture.final_messages(stream()), f"{place}/out", f"{place}/progress")
    for n, events in enumerate([[event(i, 10 + i) for i in range(400)], [event(3, 1), event(500, 2)], [event(3, 0)]]):
        with open(f"{place}/in/{n}.json", "w", encoding="utf-8") as out:
            out.writelines(json.dumps(e) + "\n" for e in events)
        query = run()
        # The source is all that a batch scans.
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(events)
    table = capture.captured(spark, f"{place}/out")
    kept = {r.text: r.received for r in table.read().collect()}
    assert len(kept) == 401 and kept[text.format(3)] == 13 and kept[text.format(500)] == 2
    # Each later batch stored the keys it touched, nothing else.
    assert table.folders()[0][1] == 400 and sum(n for _, n in table.folders()) <= 403
    assert spark.read.parquet(f"{place}/out/data/{table.folders()[0][0]}").where(F.col("received") < 10).isEmpty()


@pytest.mark.parametrize("name", ["captured_summaries", "latest_bodies", "streamed_catalog"])
@pytest.mark.parametrize("parts", [1, 3])
def test_streamed_queries_read_tables_of_part_files(spark, con, place, name, parts):
    for table in ("documents", "conversations"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").repartition(parts).write.parquet(f"{place}/{table}.parquet")
    problem, n = compare(entry.queries()[name](spark, place), con, entry.oracle_sql()[name])
    assert problem is None and n > 0, problem
