"""Substring dedup with fixed-block anchors.

A run of ``WINDOW`` words that two documents share holds a whole block of ``BLOCK`` words
of either document, wherever it starts, if blocks do not overlap and a window is as long
as two of them. So the blocks of all documents are the index, and every rolling window of
``BLOCK`` words of every document probes it. Around the hits, windows of ``WINDOW`` words
are compared by 96-bit hashes of their words; consecutive ones make up the maximal
repeats. A word goes if it lies in a window that also starts in a document of a smaller id.

Texts are dealt once into groups of about ``GROUP_BYTES``, by a hash of the row. A group
sends each of its distinct hashes once, so a passage that a third of all documents share
costs one message per group, and gets back what concerns it: first the block hashes found
elsewhere, then the windows that start earlier. Messages are sorted hashes, written as differences.

Null and blank texts have no words. Null ids sort behind all others. Rows of one id never
shorten each other, so repeated rows get equal answers. A text shorter than a window is
kept whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.native import table

WINDOW = 50
BLOCK = WINDOW // 2
GROUP_BYTES = 12_000_000
# An anchor keeps so many bits beyond those of the number of groups: about one in 2**14
# windows then meets a block by chance, which costs comparisons but changes nothing.
ANCHOR_BITS = 31
LAST_ID = (1 << 63) - 1

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return (x ^ (x >> np.uint64(29))) * _M1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, from hashes of runs of half the length."""
    if width == 1:
        return _mix(hashes + np.uint64(1))
    half = width // 2
    shorter = _runs(hashes, half)
    n = len(hashes) - width + 1
    out = _mix(shorter[:n] * _M1 + shorter[half : half + n] + np.uint64(width))
    return _mix(out + hashes[width - 1 : width - 1 + n]) if width % 2 else out


def _block_hashes(words: list[bytes]) -> np.ndarray:
    return _runs(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), BLOCK)


def _window_hashes(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window, from those of its halves."""
    a, b = blocks[:-BLOCK], blocks[BLOCK:]
    second = _mix((a ^ _M2) * _M2 + b * _M1) >> np.uint64(32)
    return _mix(a * _M1 + b).view(np.int64), second.astype(np.uint32).view(np.int32)


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, all in as many bytes as the largest one takes."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    steps = np.zeros((len(narrow), 8), np.uint8)
    steps[:, : data[0]] = narrow
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _documents(group: pa.Table):
    """(id, words) of each document of a group; null ids are the last."""
    for row, text in zip(group.column("id").to_pylist(), group.column("text"), strict=True):
        yield (LAST_ID if row is None else row), _words(text.as_py())


def _bits(groups: int) -> int:
    return min(64, ANCHOR_BITS + groups.bit_length())


def _anchors(blocks: np.ndarray, bits: int) -> np.ndarray:
    return blocks >> np.uint64(64 - bits)


def _send(buckets: int):
    bits = _bits(buckets)

    def send(group: pa.Table) -> pa.Table:
        """Per bucket: the distinct anchors of the group, those it holds twice, and its blocks."""
        probes, blocks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, words in _documents(group):
            if len(words) >= WINDOW:
                found = _anchors(_block_hashes(words), bits)
                probes.append(found)
                blocks.append(found[::BLOCK])
        every, times = np.unique(np.concatenate(probes), return_counts=True)
        twice, index = every[times > 1], np.unique(np.concatenate(blocks))
        out: dict[str, list] = {"bucket": [], "g": [], "probes": [], "twice": [], "blocks": []}
        bounds = np.array([(k << bits) // buckets for k in range(buckets)], np.uint64)
        parts = [(values, np.append(np.searchsorted(values, bounds), len(values))) for values in (every, twice, index)]
        for bucket in range(buckets):
            lists = [values[at[bucket] : at[bucket + 1]] for values, at in parts]
            if len(lists[0]):
                out["bucket"].append(bucket)
                out["g"].append(group.column("g")[0].as_py())
                for name, values in zip(("probes", "twice", "blocks"), lists, strict=True):
                    out[name].append(_pack(values - bounds[bucket]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("probes", pa.binary()), ("twice", pa.binary()), ("blocks", pa.binary())]))

    return send


def _answer(messages: pa.Table) -> pa.Table:
    """For each group the anchors that are a block somewhere and occur more than once.

    Within a bucket, a range of the hash, anchors are counted from its start.
    """
    bucket = messages.column("bucket")[0].as_py()
    groups = messages.column("g").to_pylist()
    probes = [_unpack(x.as_py()) for x in messages.column("probes")]
    index = np.unique(np.concatenate([_unpack(x.as_py()) for x in messages.column("blocks")]))
    times = np.zeros(len(index), np.int64)

    def places(values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(index, values)
        at[at == len(index)] = 0
        return at[index[at] == values] if len(index) else at[:0]

    for values in probes:
        times[places(values)] += 1
    for x in messages.column("twice"):
        times[places(_unpack(x.as_py()))] += 1
    shared = times > 1
    out: dict[str, list] = {"g": [], "bucket": [], "anchors": []}
    for g, values in zip(groups, probes, strict=True):
        at = places(values)
        if shared[at].any():
            out["g"].append(g)
            out["bucket"].append(bucket)
            out["anchors"].append(_pack(index[at[shared[at]]]))
    return pa.table(out, schema=pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.binary())]))


def _candidates(buckets: int):
    bits = _bits(buckets)
    return lambda group, answers: _candidate_windows(group, answers, buckets, bits)


def _candidate_windows(group: pa.Table, answers: pa.Table, buckets: int, bits: int) -> pa.Table:
    """Distinct windows around the hits, each with its first and last document in the group."""
    schema = pa.schema([("g", pa.int32()), ("a", pa.int64()), ("b", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
    if not answers.num_rows or not group.num_rows:
        return schema.empty_table()
    starts = [np.uint64((k << bits) // buckets) for k in answers.column("bucket").to_pylist()]
    shared = np.unique(np.concatenate([start + _unpack(x.as_py()) for start, x in zip(starts, answers.column("anchors"), strict=True)]))
    columns: list[list[np.ndarray]] = [[], [], []]
    for row, words in _documents(group):
        if len(words) < WINDOW:
            continue
        blocks = _block_hashes(words)
        anchors = _anchors(blocks, bits)
        at = np.searchsorted(shared, anchors)
        at[at == len(shared)] = 0
        hit = np.concatenate([[0], np.cumsum(shared[at] == anchors)])
        # A window at p holds the anchors that start at p to p + BLOCK.
        spots = np.flatnonzero(hit[BLOCK + 1 :] > hit[: -BLOCK - 1])
        if len(spots):
            a, b = _window_hashes(blocks)
            for column, values in zip(columns, (a[spots], b[spots], np.full(len(spots), row)), strict=True):
                column.append(values)
    if not columns[0]:
        return schema.empty_table()
    a, b, row = (np.concatenate(c) for c in columns)
    order = np.lexsort((row, b, a))
    a, b, row = a[order], b[order], row[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    last = np.append(first[1:], len(a)) - 1
    g = np.full(len(first), group.column("g")[0].as_py(), np.int32)
    return pa.table([g, a[first], b[first], row[first], row[last]], schema=schema)


def _covered(words: list[bytes], row: int, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which words lie in a window that also starts in a document of a smaller id."""
    covered = np.zeros(len(words) + 1, np.int32)
    if len(words) >= WINDOW and len(a):
        wa, wb = _window_hashes(_block_hashes(words))
        at, end = np.searchsorted(a, wa), np.searchsorted(a, wa, "right")
        hit = np.zeros(len(wa), bool)
        while (open_ := at < end).any():  # more than once only where two windows share one of their hashes
            k = at[open_]
            hit[open_] |= (b[k] == wb[open_]) & (low[k] < row)
            at = at + open_
        np.add.at(covered, np.flatnonzero(hit), 1)
        np.add.at(covered, np.flatnonzero(hit) + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


def _finish(group: pa.Table, earlier: pa.Table) -> pa.Table:
    """Counts and the digest of what is kept of each document of a group."""
    order = np.argsort(earlier.column("a").to_numpy(), kind="stable") if earlier.num_rows else np.zeros(0, np.int64)
    a, b, low = (earlier.column(c).to_numpy()[order] for c in ("a", "b", "low"))
    out: dict[str, list] = {"id": group.column("id").to_pylist(), "n_words": [], "n_removed": [], "kept": []}
    for row, words in _documents(group):
        gone = _covered(words, row, a, b, low)
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
        out["n_words"].append(len(words))
        out["n_removed"].append(len(words) - len(kept))
        out["kept"].append(b" ".join(kept).decode("utf-8"))
    return pa.table(out, schema=pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))


def _finish_digest(group: pa.Table, earlier: pa.Table) -> pa.Table:
    full = _finish(group, earlier)
    digest = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in full.column("kept")]
    return full.drop_columns(["kept"]).append_column("kept_sha256", pa.array(digest, pa.string()))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; the digest instead of ``kept`` on request."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = 1 + total // group_bytes
    dealt = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), F.pmod(F.xxhash64(id_column, text), F.lit(groups)).cast("int").alias("g"))
    by_group = dealt.groupBy("g")
    messages = by_group.applyInArrow(_send(groups), "bucket int, g int, probes binary, twice binary, blocks binary")
    answers = messages.groupBy("bucket").applyInArrow(_answer, "g int, bucket int, anchors binary")
    windows = by_group.cogroup(answers.groupBy("g")).applyInArrow(_candidates(groups), "g int, a long, b int, low long, high long")
    # A group has one row per window, so no window has more rows than there are groups.
    first = windows.withColumn("least", F.min("low").over(Window.partitionBy("a", "b")))
    earlier = first.filter("least < high").select("g", "a", "b", F.col("least").alias("low"))
    last, kind = (_finish_digest, "kept_sha256 string") if digest else (_finish, "kept string")
    return by_group.cogroup(earlier.groupBy("g")).applyInArrow(last, f"id long, n_words long, n_removed long, {kind}")


def op5_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")
