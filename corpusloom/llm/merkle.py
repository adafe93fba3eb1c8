"""Merkle manifest of a dataset: leaves, subtree roots, one root, and a proof per row.

Every row is a leaf. The rows of one group stand in order; while more than one node is
left, every eight neighbours (the last run may be shorter) become their parent. What is
left of a group is its subroot, and the subroots, in order, are combined in the same way
to the root.

Proofs by pointer jumping: each node first points to its parent and holds the segment
(siblings to the left, siblings to the right) of that step. In every round a node joins
the node it points to, takes over its pointer and appends its segments, so the distance
doubles until all leaves point beyond the root. Leaves are nobody's target: only inner
nodes, an eighth of all, are ever looked up, and they are written once per round.

Rows are put in order by range partitions numbered inside, so neither a group that holds
most rows nor a repeated id is gathered in one task. Runs hold eight nodes at most.

Null ids and groups come first in their order; a null value has the leaf part ``-``.
Equal rows are leaves of their own, side by side. Texts of any length are hashed where
they are read. An empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import let
from corpusloom.llm.native import table
from corpusloom.session import materialize

RUN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# A target table of at most so many nodes (segments below 4 KB each) is broadcast.
MAX_BROADCAST = 4096
# monotonically_increasing_id() holds the partition above this many bits, the line below.
LINE_BITS = 33
TOP = -1
BEYOND = -2

_HASH = "struct<left:binary,right:binary>"


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(values: list[Column]) -> Column:
    """Digest (binary) of the values: ``-`` for null, else byte count, ``:`` and value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))

    return _digest(F.concat(*[part(v) for v in values]))


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf digest (binary) and its proof; hex text."""
    climbed = F.aggregate(proof, start, lambda h, s: _digest(F.concat(hexed(s["left"]), hexed(h), hexed(s["right"]))))
    return hexed(climbed)


def proof_digest(proof: Column) -> Column:
    """One digest over the siblings of all steps, left to right, as hex text."""
    siblings = F.transform(proof, lambda s: F.concat(hexed(s["left"]), hexed(s["right"])))
    return F.sha2(F.array_join(siblings, ""), 256)


def _broadcastable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def place(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Positions from 0 inside each group, by ``order`` (nulls first), and group sizes.

    Returns the rows with ``part`` and ``line``, and per (part, group) the ``shift`` that
    turns a line into a position, with ``n``, the size of the group. A last, arbitrary
    order column lets the range bounds split even equal rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]] + [F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(dealt.drop("tie").withColumn("spot", F.monotonically_increasing_id()), "placed")
    placed = placed.select(*rows.columns, F.shiftright("spot", LINE_BITS).alias("part"), F.col("spot").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).alias("line"))
    blocks = placed.groupBy("part", group).agg(F.min("line").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    blocks = blocks.select("part", group, shift.alias("shift"), F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    return placed, materialize(blocks, "blocks")


def positions(placed: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """``placed`` with the columns of ``blocks`` and ``at``, the position in the group."""
    right = blocks.withColumnsRenamed({"part": "part_", group: "group_"})
    joined = placed.join(_broadcastable(right), (F.col("part") == F.col("part_")) & F.col(group).eqNullSafe(F.col("group_")))
    return joined.withColumn("at", F.col("line") + F.col("shift")).drop("line", "shift", "part_", "group_")


def climb(nodes: DataFrame, carried: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """Combine runs level by level. ``nodes``: tree, at, n, hash and the carried columns.

    Returns the pointers of each level that has a parent (tree, level, at, the carried
    columns at level 0, seg, up_tree, up_level, up_at) and the root of every tree.
    ``most`` is the largest n. A pointer to a root names it as node (TOP, 0, tree).
    """
    levels, roots, level = [], [nodes.filter("n = 1").select("tree", "hash")], 0
    while most > 1:
        kept = ["hash", *(carried if level == 0 else [])]
        child = F.struct((F.col("at") % RUN).cast("int").alias("pos"), *kept)
        up = F.floor(F.col("at") / RUN).cast("long")
        runs = nodes.filter("n > 1").groupBy("tree", up.alias("up"), "n").agg(F.sort_array(F.collect_list(child)).alias("kids"))
        runs = materialize(runs, f"level{level}")
        last = F.col("n") <= RUN
        side = lambda part: F.aggregate(part, F.lit(bytearray()), lambda a, k: F.concat(a, k["hash"]))
        step = lambda k: F.array(
            F.struct(
                side(F.slice("kids", F.lit(1), k["pos"])).alias("left"),
                side(F.filter("kids", lambda o: o["pos"] > k["pos"])).alias("right"),
            )
        )
        spread = runs.select(
            "tree", "up",
            F.when(last, F.lit(TOP)).otherwise(F.col("tree")).alias("up_tree"),
            F.when(last, F.lit(0)).otherwise(F.lit(level + 1)).alias("up_level"),
            F.when(last, F.col("tree").cast("long")).otherwise(F.col("up")).alias("up_at"),
            F.explode(F.transform("kids", lambda k: F.struct(k.alias("kid"), step(k).alias("seg")))).alias("one"),
        )
        levels.append(
            spread.select(
                "tree", F.lit(level).alias("level"), (F.col("up") * RUN + F.col("one.kid.pos")).alias("at"),
                *[F.col(f"one.kid.{c}").alias(c) for c in kept], F.col("one.seg").alias("seg"), "up_tree", "up_level", "up_at",
            )
        )
        joined = F.array_join(F.transform("kids", lambda k: hexed(k["hash"])), "")
        nodes = runs.select("tree", F.col("up").alias("at"), F.ceil(F.col("n") / RUN).cast("long").alias("n"), _digest(joined).alias("hash"))
        roots.append(nodes.filter("n = 1").select("tree", "hash"))
        most, level = -(-most // RUN), level + 1
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, materialize(out, "roots")


POINTER = ["seg", "up_tree", "up_level", "up_at"]


def jump(pointers: DataFrame, targets: DataFrame) -> DataFrame:
    """One round: every pointer that names a target takes over the target's pointer."""
    right = targets.select(
        F.col("tree").alias("tree_"), F.col("level").alias("level_"), F.col("at").alias("at_"), *[F.col(c).alias(f"{c}_") for c in POINTER]
    )
    on = (F.col("up_tree") == F.col("tree_")) & (F.col("up_level") == F.col("level_")) & (F.col("up_at") == F.col("at_"))
    found = F.col("tree_").isNotNull()
    moved = {c: F.when(found, F.col(f"{c}_")).otherwise(F.col(c)) for c in POINTER[1:]}
    moved["seg"] = F.when(found, F.concat("seg", "seg_")).otherwise(F.col("seg"))
    joined = pointers.join(_broadcastable(right), on, "left").withColumns(moved)
    return joined.select(*pointers.columns)


def prove(rows: DataFrame, group: str, order: list[str], carried: list[str]) -> DataFrame:
    """Subroot, root and proof of every leaf.

    ``rows`` holds ``hash`` (the leaf digest, binary), the group, the order columns and
    the carried ones, and nothing else. Returns the carried columns with ``hash``,
    ``subroot`` and ``root`` (hex) and ``proof`` (array of left and right siblings).
    """
    placed, blocks = place(rows, group, order)
    # One row per group; its own order gives the number of its tree.
    groups = blocks.groupBy(group).agg(F.max("n").alias("n")).withColumn("all", F.lit(0))
    ranked, whole = place(groups, "all", [group])
    trees = positions(ranked, whole.drop("n"), "all").select(group, F.col("at").cast("int").alias("tree"))
    trees = trees.withColumnRenamed(group, "named")
    blocks = materialize(blocks.join(_broadcastable(trees), F.col(group).eqNullSafe(F.col("named"))).drop("named"), "trees")
    counts = blocks.agg(F.max("n"), F.max("tree") + 1).first()
    most, count = counts[0] or 0, counts[1] or 0

    leaves = positions(placed, blocks, group).select("tree", "at", "n", "part", "hash", *carried)
    below, subroots = climb(leaves, ["part", *carried], most)
    tops = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").cast("long").alias("at"), F.lit(count).cast("long").alias("n"), "hash")
    above, root = climb(tops, [], count)
    root = root.first()
    root_hex = root["hash"].hex() if root else None

    # Beyond the root a pointer is spread over its own position, so that no later join
    # meets one hot key.
    def ended(level: DataFrame) -> DataFrame:
        done = F.col("up_tree") == TOP
        return level.withColumns({"up_tree": F.when(done & (F.col("up_level") == 0), F.lit(BEYOND)).otherwise(F.col("up_tree"))}).drop("hash")

    inner = [x.drop("hash") for x in below[1:]] + [ended(x) for x in above]
    if not above:
        # A single group: its subroot is the root.
        alone = tops.select("tree", F.lit(0).alias("level"), "at", F.lit(None).cast(f"array<{_HASH}>").alias("seg"))
        inner.append(alone.withColumns({"seg": F.array().cast(f"array<{_HASH}>"), "up_tree": F.lit(BEYOND), "up_level": F.lit(0), "up_at": F.col("at")}))
    single = leaves.filter("n = 1").select(
        "tree", F.lit(0).alias("level"), "at", "hash", "part", *carried, F.array().cast(f"array<{_HASH}>").alias("seg"),
        F.lit(TOP).alias("up_tree"), F.lit(0).alias("up_level"), F.col("tree").cast("long").alias("up_at"),
    )
    pointers = single.unionByName(below[0]) if below else single
    nodes = inner[0]
    for more in inner[1:]:
        nodes = nodes.unionByName(more)
    reach, height = 1, len(below) + len(above)
    while True:
        targets = materialize(nodes.filter((F.col("tree") == TOP) | (F.col("level") >= reach)), f"reach{reach}")
        pointers = _scatter(jump(pointers, targets))
        reach *= 2
        if reach > height:
            break
        nodes = jump(targets, targets)

    out = pointers.select("tree", "part", "hash", *carried, F.col("seg").alias("proof"))
    ends = subroots.select(F.col("tree").alias("tree_"), hexed(F.col("hash")).alias("subroot"))
    if count <= MAX_BROADCAST:
        out = out.join(F.broadcast(ends), F.col("tree") == F.col("tree_"))
    else:
        # By (part, tree): as even as the parts, however large one group is.
        ends = blocks.select(F.col("part").alias("part_"), F.col("tree").alias("tree__")).join(ends, F.col("tree__") == F.col("tree_"))
        out = out.join(ends, (F.col("tree") == F.col("tree__")) & (F.col("part") == F.col("part_")))
    return out.select(*carried, "hash", "subroot", F.lit(root_hex).cast("string").alias("root"), "proof")


def _scatter(pointers: DataFrame) -> DataFrame:
    return pointers.withColumn("up_at", F.when(F.col("up_tree") == BEYOND, -1 - F.col("at")).otherwise(F.col("up_at")))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the id's checksum."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of a documents table: its leaf, subroot, root, proof and ``altered``, the
    leaf after tampering (the leaf itself where nothing was tampered with)."""
    values = {c: F.col(c) for c in COLUMNS}
    other = values | {"text": tampered(F.col("doc_id"), F.col("text"))}
    thin = docs.select("doc_id", "lang", leaf(list(values.values())).alias("hash"), leaf(list(other.values())).alias("altered"))
    thin = materialize(thin.withColumn("altered", F.when(F.col("altered") != F.col("hash"), F.col("altered"))), "leaves")
    return prove(thin, "lang", ["doc_id", "hash"], ["doc_id", "altered"])


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    proven = manifest(table(spark, sf_dir, "documents"))
    start = F.coalesce("altered", "hash")
    out = proven.select("doc_id", hexed(F.col("hash")).alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(start, F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_levels(levels: int, source: str, group: str, prefix: str) -> str:
    """CTEs that combine runs of eight, level by level; lone nodes pass unchanged."""
    out = [f"{prefix}0 AS (SELECT {group} AS g, spot, hash, count(*) OVER (PARTITION BY {group}) AS n FROM {source})"]
    for k in range(levels):
        out.append(
            f"{prefix}_run{k} AS (SELECT g, spot // {RUN} AS up, any_value(n) AS n, list(hash ORDER BY spot) AS hs FROM {prefix}{k} GROUP BY g, spot // {RUN})"
        )
        out.append(
            f"{prefix}{k + 1} AS (SELECT g, up AS spot, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS hash, (n + {RUN - 1}) // {RUN} AS n FROM {prefix}_run{k})"
        )
    return ",\n".join(out)


def _sql_steps(levels: int, prefix: str, source: str, at: str, group: str, out: str) -> str:
    """CTEs that carry each leaf (spot, folded, sibs) through the runs of a tree."""
    parts, before = [], source
    for k in range(levels):
        kids = f"r.hs[1:p.{at} % {RUN}]", f"r.hs[p.{at} % {RUN} + 2:]"
        parts.append(
            f"{out}{k} AS (SELECT p.* REPLACE (p.{at} // {RUN} AS {at}, "
            f"CASE WHEN r.n > 1 THEN sha256(array_to_string({kids[0]} || [p.folded] || {kids[1]}, '')) ELSE p.folded END AS folded, "
            f"CASE WHEN r.n > 1 THEN p.sibs || array_to_string({kids[0]} || {kids[1]}, '') ELSE p.sibs END AS sibs) "
            f"FROM {before} p JOIN {prefix}_run{k} r ON p.{group} = r.g AND p.{at} // {RUN} = r.up)"
        )
        before = f"{out}{k}"
    return ",\n".join(parts)


# Levels that the SQL spells out: 8**7 leaves per group and 8**2 groups.
_DEPTH, _WIDTH = 7, 2
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_PART.format(c) for c in COLUMNS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH byte_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b::UBIGINT] || range(8)::UBIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS steps
), marked AS (
  SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1))::UBIGINT),
    lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) AS BIGINT) + 1])), 4294967295::UBIGINT) % 3 = 0 AS hit
  FROM documents, byte_table
), hashed AS (SELECT *, sha256({_LEAF}) AS leaf FROM marked),
changed AS (SELECT * REPLACE (CASE WHEN hit THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END AS text) FROM hashed),
leaves AS (
  SELECT doc_id, leaf, sha256({_LEAF}) AS folded, '' AS sibs, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM changed
), leaf_nodes AS (SELECT tree, spot, leaf AS hash FROM leaves),
{_sql_levels(_DEPTH, 'leaf_nodes', 'tree', 'low')},
top_nodes AS (SELECT 0 AS tree, g AS spot, hash FROM low{_DEPTH}),
{_sql_levels(_WIDTH, 'top_nodes', 'tree', 'top')},
{_sql_steps(_DEPTH, 'low', 'leaves', 'spot', 'tree', 'step')},
risen AS (SELECT doc_id, leaf, folded, sibs, tree AS spot, 0 AS whole, tree FROM step{_DEPTH - 1}),
{_sql_steps(_WIDTH, 'top', 'risen', 'spot', 'whole', 'rise')}
SELECT r.doc_id, r.leaf, s.hash AS subroot, t.hash AS root, sha256(r.sibs) AS proof_sha256, r.folded AS folded_root, r.folded = t.hash AS verified
FROM rise{_WIDTH - 1} r JOIN low{_DEPTH} s ON s.g = r.tree CROSS JOIN top{_WIDTH} t
"""
