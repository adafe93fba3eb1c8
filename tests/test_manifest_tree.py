"""Stored hash trees against a comparison of all rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.snapshots import corpus_digest, diff
from corpusloom.plans import manifest_tree as trees


def manifest(spark, n, changed=(), gone=(), added=()):
    rows = [(f"d/{i}.md", f"{i}-{int(i in changed)}") for i in range(n) if i not in gone] + [(f"new/{i}.md", "x") for i in added]
    return spark.createDataFrame(rows, "path string, sha256 string")


def plain(before, after):
    return sorted(tuple(r) for r in diff(before, after, "path", "sha256").where("change <> 'unchanged'").collect())


@pytest.mark.parametrize("named", [0, trees.MAX_NAMED])
def test_changes_equal_a_full_comparison(spark, place, monkeypatch, named):
    monkeypatch.setattr(trees, "MAX_NAMED", named)
    a, b = manifest(spark, 3000), manifest(spark, 3000, changed={7, 8, 2999}, gone={5}, added=range(3))
    before, after = trees.store(a, f"{place}/a"), trees.store(b, f"{place}/b")
    assert before.digest() == corpus_digest(a).first().digest
    assert sorted(tuple(r) for r in trees.compare(before, after).changes.collect()) == plain(a, b)


def test_one_changed_file_opens_its_leaf_only(spark, place):
    a, b = manifest(spark, 20_000), manifest(spark, 20_000, changed={4711})
    before, after = trees.store(a, f"{place}/a"), trees.store(b, f"{place}/b")
    found = trees.compare(before, after)
    assert [r.path for r in found.changes.collect()] == ["d/4711.md"]
    leaf = before.rows().where("path = 'd/4711.md'").first().leaf
    assert [r.leaf for r in found.leaves.collect()] == [leaf]
    for side in found.opened:
        # No row below an equal leaf comes out of the filter, and the scan skips most row groups.
        assert {r.leaf for r in side.collect()} == {leaf}
        scan = side._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().get("numOutputRows").get().value() < 20_000 / 5


def test_equal_and_empty_manifests(spark, place):
    a = manifest(spark, 100)
    one, same, empty = (trees.store(df, f"{place}/{i}") for i, df in enumerate((a, a.repartition(3), a.where("false"))))
    equal = trees.compare(one, same)
    assert equal.leaves is None and equal.changes.count() == 0
    assert empty.digest() is None and trees.compare(empty, empty).changes.count() == 0
    assert trees.compare(one, empty).changes.where("change = 'removed'").count() == 100
    assert trees.compare(empty, one).changes.where("change = 'added'").count() == 100


def test_consumers_catch_up(spark, place):
    first, second = (trees.store(manifest(spark, 50, changed=c), f"{place}/{i}") for i, c in enumerate(((), {3})))
    mode, rows = trees.follow(first.digest(), first, second)
    assert mode == "delta" and [r.path for r in rows.collect()] == ["d/3.md"]
    assert trees.follow(second.digest(), first, second)[0] == "reuse"
    mode, rows = trees.follow(None, first, second)
    assert mode == "full" and rows.where(F.col("change") == "added").count() == 50
