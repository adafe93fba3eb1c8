"""Near-duplicates by a chosen-path similarity join over minhashed shingle sets.

Every distinct set has ``COORDINATES`` minhashes. Each of ``TREES`` independent trees
deals all sets into nodes by one chosen minhash. A node of at most ``LEAF`` sets is
compared exhaustively; a larger one branches again: about ``BRANCHES`` further
coordinates are chosen by a hash of its path, and its sets go to one child for each. After
``DEPTH`` levels what is still too large is compared exhaustively in pairs of blocks.

A pair of similarity J meets in a tree with probability about J, so eight trees lose a
pair at 0.85 with probability 0.15**8 (3e-7) where nodes are small; a lower threshold has
more trees (ten at 0.80), so that it loses no more.

Comparing in a leaf takes two steps. Minhash agreement first joins what might be linked
(``agreement``, more than five standard deviations below the threshold: 28 of 48 at 0.85
lose a pair with probability 2e-6, 24 at 0.80 with 8e-7) into clusters; then the full shingle sets of each cluster (of each leaf, where a cluster
exceeds ``LEAF``) are compared exactly. A task holds ``MEMBERS`` shingles of a group: heavier
ones are compared in pairs of blocks, each block with every other and with itself. Only spanning edges leave a task, never all pairs,
and sets found equal are one vertex from the start.

No words (null, empty or blank text): an empty set, linked with nothing. Fewer words than
a shingle: the whole sequence is the one shingle. Repeated rows and copies share a set and
a component; a component without any id is null. Extra columns are ignored by
``group_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.native import aside, table
from corpusloom.session import materialize

SHINGLE = 5
# Percent: the similarity from which op2 links; ``group_duplicates`` takes others.
THRESHOLD = 85
COORDINATES = 48
TREES = 8
LEAF = 4096
# 64 MB of shingle hashes in a group; one text may hold more.
MEMBERS = 8_000_000
BRANCHES = 4
DEPTH = 4
DEVIATIONS = 5.25

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return (x ^ (x >> np.uint64(27))) * _MIX


_SEEDS = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _MIX)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    n = len(tokens)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    width = min(SHINGLE, n)
    if not n:
        return hashed
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out + hashed[i : n - width + 1 + i])
    return np.unique(out)


def minhashes(found: np.ndarray) -> np.ndarray:
    """The minhash of each coordinate, cut to 32 bits."""
    return np.array([(_mix(found ^ seed).min() >> np.uint64(32)) for seed in _SEEDS], np.uint32).view(np.int32)


def agreement(threshold: int) -> int:
    """How many minhashes agree at least in a pair that might be linked."""
    j = threshold / 100
    return int(np.ceil(COORDINATES * j - DEVIATIONS * np.sqrt(COORDINATES * j * (1 - j))))


def trees_for(threshold: int) -> int:
    """Trees that lose a pair at ``threshold`` no more often than ``TREES`` one at 85."""
    return int(np.ceil(TREES * np.log(1 - THRESHOLD / 100) / np.log(1 - threshold / 100)))


def linked(a: int, b: int, common: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether sets of sizes a and b with that many common members are linked."""
    return 100 * common >= threshold * (a + b - common)


def _describe(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, text_hash, n_shingles, sid, minhashes) of every row."""

    @F.pandas_udf("n long, sid string, sig array<int>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for value in texts:
                found = shingles(value)
                rows.append((len(found), xxhash.xxh3_128_hexdigest(found.tobytes()), minhashes(found)) if len(found) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "sid", "sig"])

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), describe(text).alias("d"))
    return rows.select("id", "text_hash", F.col("d.n").alias("n_shingles"), F.col("d.sid").alias("sid"), F.col("d.sig").alias("sig"))


def _sized(rows: DataFrame) -> DataFrame:
    """(node, sid) with the size of the node; nodes of one set are gone."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(sizes, "node")


def leaves(sets: DataFrame, trees: int = TREES, leaf: int = LEAF, branches: int = BRANCHES, depth: int = DEPTH) -> DataFrame:
    """(node, sid): nodes of at most about ``leaf`` sets in which all pairs are compared.

    ``sets(sid, sig)`` holds distinct sets.
    """
    root = F.transform(F.slice("sig", 1, trees), lambda value, tree: F.xxhash64(tree, value))
    rows = materialize(_sized(sets.select("sid", F.explode(root).alias("node"))), "nodes")
    done = rows.filter(F.col("n") <= leaf).select("node", "sid")
    for _ in range(depth):
        large = rows.filter(F.col("n") > leaf)
        if large.isEmpty():
            return done
        share = int(1000 * branches)
        chosen = F.transform(
            "sig",
            lambda value, i: F.when(F.pmod(F.xxhash64("node", i), F.lit(1000 * COORDINATES)) < share, F.xxhash64("node", i, value)),
        )
        below = large.select("node", "sid").join(sets, "sid").select("sid", F.explode(F.array_compact(chosen)).alias("node"))
        rows = materialize(_sized(below), "nodes")
        done = done.union(rows.filter(F.col("n") <= leaf).select("node", "sid"))
    # Still large: every pair of blocks is a node of its own.
    blocks = F.ceil(F.col("n") * 2 / leaf)
    own = F.pmod(F.xxhash64("sid"), blocks)
    rest = rows.filter(F.col("n") > leaf).select("sid", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    return done.union(rest.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "sid"))


def _by_group(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by ``key``."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, end in zip([0, *cuts[:-1]], cuts, strict=False):
            yield batch.iloc[start:end]
        rest = batch.iloc[cuts[-1] if len(cuts) else 0 :]
    if rest is not None and len(rest):
        yield rest


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def _candidates(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Spanning edges of the sets in a node of which ``least`` minhashes agree."""
    a, b = [], []
    for group in _by_group(batches, "node"):
        sids, sigs = group["sid"].to_numpy(), np.stack(group["sig"].to_numpy())
        waiting = np.arange(len(sids))
        while len(waiting) > 1:
            first, waiting = waiting[0], waiting[1:]
            frontier = [first]
            while frontier and len(waiting):
                near = (sigs[waiting] == sigs[frontier.pop()]).sum(axis=1) >= least
                frontier.extend(waiting[near])
                a.extend([sids[first]] * int(near.sum()))
                b.extend(sids[waiting[near]])
                waiting = waiting[~near]
        if len(a) > 50_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": a, "b": b}, dtype=object)


def spanning_links(sids: np.ndarray, sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[str, str]]:
    """Edges that join exactly the sets connected by links among the given ones."""
    sizes = np.array([len(s) for s in sets])
    members, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    edges, waiting = [], np.arange(len(sids))
    while len(waiting) > 1:
        first, waiting = waiting[0], waiting[1:]
        frontier = [first]
        tokens = np.concatenate([flat[starts[i] : starts[i + 1]] for i in waiting])
        begins = np.concatenate([[0], np.cumsum(sizes[waiting])[:-1]])
        kept = len(waiting)
        place = np.arange(kept)
        alive = np.ones(kept, bool)
        while frontier and alive.any():
            i = frontier.pop()
            if alive.sum() * 2 < kept:
                waiting = waiting[alive]
                kept, alive = len(waiting), np.ones(len(waiting), bool)
                tokens = np.concatenate([flat[starts[j] : starts[j + 1]] for j in waiting])
                begins = np.concatenate([[0], np.cumsum(sizes[waiting])[:-1]])
                place = np.arange(kept)
            mark = np.zeros(len(members), np.int32)
            mark[flat[starts[i] : starts[i + 1]]] = 1
            common = np.add.reduceat(mark[tokens], begins)
            near = alive & linked(sizes[i], sizes[waiting], common, threshold)
            for j in waiting[place[near]]:
                edges.append((sids[first], sids[j]))
                frontier.append(j)
            alive &= ~near
        waiting = waiting[alive]
    return edges


def _verified(batches: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    for group in _by_group(batches, "node"):
        if len(group) > 1:
            edges = spanning_links(group["sid"].to_numpy(), [np.frombuffer(s, np.uint64) for s in group["members"]], threshold)
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])


def lighter(groups: DataFrame, members: int) -> DataFrame:
    """(node, sid) of ``groups(node, sid, n_shingles)``: each pair of a node's sets is in some
    node, and a node holds about ``members`` shingles at most."""
    light = groups.select("node", "sid")
    heavy = groups.groupBy("node").agg(F.sum("n_shingles").alias("weight")).filter(F.col("weight") > members)
    heavy = materialize(heavy.select("node", F.ceil(F.col("weight") * 2 / members).alias("blocks")), "heavy")
    if heavy.isEmpty():
        return light
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = light.join(heavy, "node").select("node", "sid", own.alias("own"), other.alias("other"))
    pair = F.concat_ws(":", "node", F.least("own", "other"), F.greatest("own", "other"))
    return light.join(heavy, "node", "left_anti").union(rows.select(pair.alias("node"), "sid"))


def find_links(
    docs: DataFrame, described: DataFrame, id_column: str, text: str, leaf: int = LEAF, threshold: int = THRESHOLD, members_most: int = MEMBERS, **tree
) -> DataFrame:
    """(a, b): spanning edges between the distinct sets of linked documents."""
    sets = described.filter("n_shingles > 0").groupBy("sid").agg(F.min(F.struct("id", "text_hash")).alias("row"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    sets = materialize(sets.select("sid", "row.id", "row.text_hash", "sig", "n_shingles"), "sets")
    tree = {"trees": trees_for(threshold)} | tree
    nodes = materialize(leaves(sets.select("sid", "sig"), leaf=leaf, **tree), "leaves")
    least = agreement(threshold)
    candidates = _grouped(nodes.join(sets.select("sid", "sig"), "sid"), "node").mapInPandas(lambda batches: _candidates(batches, least), "a string, b string")
    clusters = materialize(components(candidates), "clusters")

    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    sized = clusters.join(sizes, "component")
    together = sized.filter(F.col("n") <= leaf).select(F.col("component").alias("node"), F.col("vertex").alias("sid"))
    apart = nodes.join(sized.filter(F.col("n") > leaf).select(F.col("vertex").alias("sid")), "sid").select(F.col("node").cast("string"), "sid")
    groups = together.union(apart).distinct().join(sets.select("sid", "n_shingles"), "sid").select("node", "sid", "n_shingles")
    groups = lighter(materialize(groups, "groups"), members_most)

    @F.pandas_udf("binary")
    def members(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t).tobytes())

    wanted = sets.select("sid", "id", "text_hash").join(groups.select("sid").distinct(), "sid")
    source = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    full = source.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash")))
    full = full.groupBy("sid").agg(F.first("_text").alias("_text")).select("sid", members("_text").alias("members"))
    return _grouped(groups.join(full, "sid"), "node").mapInPandas(lambda batches: _verified(batches, threshold), "a string, b string")


def group_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", leaf: int = LEAF, threshold: int = THRESHOLD, **tree) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) of every row of ``docs``."""
    described = materialize(_describe(docs, id_column, text), "described")
    joined = components(find_links(docs, described, id_column, text, leaf, threshold, **tree)).select(F.col("vertex").alias("sid"), "component")
    smallest = described.filter("n_shingles > 0").groupBy("sid").agg(F.min("id").alias("smallest"))
    named = smallest.join(joined, "sid", "left").select("sid", "smallest", F.coalesce("component", "sid").alias("component"))
    named = materialize(named, "named")
    lowest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    answer = described.select("id", "text_hash", "n_shingles", "sid").join(named.join(lowest, "component").select("sid", "component_id"), "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return answer.select("id", "text_hash", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, with its own columns: the one of the smallest id."""
    kept = group_duplicates(docs, id_column, text, threshold=threshold).filter("kept").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    docs, back = aside(docs, "_text_hash", "_id", "_hash")
    hashed = docs.withColumn("_text_hash", F.xxhash64(text))
    same = hashed[id_column].eqNullSafe(kept["_id"]) & (hashed["_text_hash"] == kept["_hash"])
    return hashed.join(kept, same, "left_semi").dropDuplicates([id_column, "_text_hash"]).drop("_text_hash").withColumnsRenamed(back)


def op2_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
