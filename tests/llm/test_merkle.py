"""The Merkle manifest against a plain loop over sorted rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(hashes):
    """Root and, per leaf, the siblings as (left, right) texts of each step."""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, spot in enumerate(at):
            run = level[spot // 8 * 8 : spot // 8 * 8 + 8]
            proofs[i].append(("".join(run[: spot % 8]), "".join(run[spot % 8 + 1 :])))
        at, level = [s // 8 for s in at], [digest("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], proofs


def expected(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of rows of COLUMNS, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [(g, sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))) for g in order]
    built = [plain_tree([leaf(r) for r in members]) for _, members in trees]
    root, upper = plain_tree([b[0] for b in built])
    out = []
    for (_, members), (subroot, lower), above in zip(trees, built, upper):
        for row, below in zip(members, lower):
            steps = below + above
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf((*row[:4], text))
            for left, right in steps:
                folded = digest(left + folded + right)
            out.append((row[0], leaf(row), subroot, root, digest("".join(a + b for a, b in steps)), folded))
    return sorted(out, key=str)


def found(df):
    out = df.select("doc_id", merkle.hexed(F.col("hash")), "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.coalesce("altered", "hash"), F.col("proof")))
    return sorted((tuple(r) for r in out.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(sizes, seed):
    rng, rows = random.Random(seed), []
    for lang, n in sizes:
        rows += [(rng.choice([None, *range(n)]), rng.choice(["web", None]), lang, rng.choice([None, 5]), rng.choice([None, "", "Some TEXT é", "ABC", "x" * 9000])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        [("en", 1)],
        [("en", 8)],
        [(None, 9)],
        [("en", 75), ("fr", 1), (None, 3), ("", 8)],
        [(f"l{i}", 1 + i % 11) for i in range(70)],
    ],
)
def test_equals_a_plain_loop(spark, sizes):
    rows = rows_of(sizes, len(sizes))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = ["tree", "at", "hash", "part", "line", "level", "seg", "up_at", "altered", "n"]
    clashing = docs.withColumns({c: F.lit("x") for c in names})
    assert found(merkle.manifest(clashing)) == expected(rows)


def test_large_tables_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_BROADCAST", 3)
    rows = rows_of([("en", 150), ("de", 20), ("x", 1), (None, 64), ("q", 2)], 5)
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4))) == expected(rows)


def test_equal_rows_and_empty_table(spark):
    rows = [(7, "a", "en", 1, "Same")] * 40
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
