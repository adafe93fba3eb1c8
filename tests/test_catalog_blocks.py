"""Posting blocks of a stored catalog: stored by the first batch that needs them, never stale."""

import os
import random

from pyspark.sql import functions as F
from test_pruned import some_notes, some_queries

from corpusloom.operators import pruned
from corpusloom.plans import catalog
from corpusloom.plans import search as plan


def test_blocks_are_stored_when_first_needed_and_made_anew_after_compaction(spark, place, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK", 20)
    rng, root = random.Random(3), f"{place}/catalog"
    mounted = spark.createDataFrame([("/r",)], "root string")
    notes = some_notes(spark, rng, range(200)).cache()
    fresh = some_notes(spark, rng, range(0, 180, 2), 1).cache()
    after = notes.where("int(substr(uri, 2)) % 2 = 1").unionByName(fresh).cache()
    asked = plan.read_directives(some_queries(spark, rng))
    folders = lambda: sorted(os.listdir(f"{root}/blocks")) if os.path.exists(f"{root}/blocks") else []

    def hits(index, pool, plain_rows):
        monkeypatch.setattr(pruned, "PLAIN_ROWS", plain_rows)
        return sorted((r.query_id, r["rank"], r.uri, round(r.score, 7)) for r in plan.lexical_route(asked, pool, 8, index).collect())

    catalog.refresh(notes, root, mounted, mounted)
    stored, _ = catalog.refresh(after, root, mounted, mounted)
    expected = hits(None, after, 0)
    # Few matches are scored from the stored terms.
    assert hits(stored.index(), after, 10**9) == expected and folders() == []
    assert hits(stored.index(), after, 0) == expected and folders() == ["snapshot=1", "snapshot=2"]
    # Compaction puts all valid terms into the snapshot; its blocks follow.
    assert catalog.retain(spark, root, 1) == [2] and folders() == []
    whole = catalog.latest(spark, root)
    assert whole.full and hits(whole.index(), after, 0) == expected and folders() == ["snapshot=2"]
    assert whole.blocks().agg(F.sum("size")).first()[0] == whole.postings().count()
