"""Periodic runs: stretches that repeat one short sequence of words again and again.

A run is a maximal stretch of words with smallest period q (words q apart are equal),
at least ``MIN_LENGTH`` words and ``MIN_COPIES`` periods long. Such a stretch covers
``MIN_COPIES`` neighbouring points of the grid 0, q, 2q, ..., so for every period only
grid points with equal words are candidates; the longest common extensions to both
sides of a candidate, answered by the recompression grammar, give the whole stretch. A
stretch that several periods fit belongs to the smallest.

The work stays in the row's task: no shuffle, no state between rows. A task handles
texts of like length together, ``BATCH_BYTES`` at a time; a longer text is a batch of
its own, and candidates are answered ``QUESTIONS`` at a time. Words are numbered inside
the batch, so they are compared exactly.

Null and empty texts have no words and no runs. Repeated rows and null ids get answers
of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from corpusloom.functions.text import let
from corpusloom.llm.native import table
from corpusloom.llm.recompression import Grammar

MIN_LENGTH = 6
MIN_COPIES = 4
BATCH_BYTES = 3_000_000
QUESTIONS = 500_000

RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))

Prepare = Callable[[object, list[bytes]], list[bytes]]


def _candidates(words: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of grid points whose next MIN_COPIES - 1 neighbours hold their word.

    ``words`` is the batch in one array, ``begin`` and ``sizes`` the texts, longest first.
    """
    places, periods, held = [], [], 0
    for q in range(1, int(sizes[0]) // MIN_COPIES + 1):
        fit = np.searchsorted(-sizes, -max(MIN_LENGTH, MIN_COPIES * q), side="right")
        if not fit:
            break
        points = (sizes[:fit] - 1) // q - (MIN_COPIES - 2)
        ends = np.cumsum(points)
        at = np.repeat(begin[:fit] - q * (ends - points), points) + q * np.arange(ends[-1])
        for k in range(1, MIN_COPIES):
            at = at[words[at] == words[at + k * q]]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held > QUESTIONS:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per stretch, with its smallest period, by start and period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, with where each begins. Marks stand between them: no two
    places beyond a text's ends are ever equal."""
    parts = [np.array([-1])]
    for i, text in enumerate(texts):
        parts += [text, np.array([-i - 2])]
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.concatenate(parts).astype(np.int64), 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))


class _Asked:
    """Extensions inside the texts that have candidates; their grammar is built once."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.texts, self.docs = texts, np.zeros(0, np.int64)

    def stretches(self, doc: np.ndarray, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in the text, of the longest stretch with this period around a place."""
        docs = np.unique(doc)
        if not np.isin(docs, self.docs).all():
            self.docs = docs
            words, self.begin = _joined([self.texts[i] for i in docs])
            self.last = len(words) - 1
            self.grammar = Grammar.of(words)
            self.mirrored = self.grammar.mirrored()
        begin = self.begin[np.searchsorted(self.docs, doc)]
        at = place + begin
        ahead = self.grammar.common(at, at + period)
        behind = self.mirrored.common(self.last - (at - 1), self.last - (at + period - 1))
        return place - behind, place + period + ahead


def find_runs(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of the runs of each text, given as numbers from 0 on."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= MIN_LENGTH]
    if not len(order):
        return found
    ordered = [texts[i] for i in order]
    words, begin = _joined(ordered)
    owner = np.repeat(np.arange(len(order)), sizes[order] + 1)
    asked, kept = _Asked(ordered), []
    for at, period in _candidates(words, begin, sizes[order]):
        doc = owner[at - 1]
        start, end = asked.stretches(doc, at - begin[doc], period)
        long = end - start >= np.maximum(MIN_LENGTH, MIN_COPIES * period)
        kept.append(_smallest(start[long] + begin[doc[long]], end[long] + begin[doc[long]], period[long]))
    if not kept:
        return found
    start, end, period = _smallest(*[np.concatenate([k[i] for k in kept]) for i in range(3)])
    doc = owner[start - 1]
    bounds = np.searchsorted(doc, np.arange(len(order) + 1))
    for i, text in enumerate(order):
        one = slice(bounds[i], bounds[i + 1])
        found[text] = (start[one] - begin[i], end[one] - start[one], period[one])
    return found


def collapse(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The words that no run repeats: the first period of every run stays."""
    start, length, period = runs
    if not len(start):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like length, at most BATCH_BYTES together unless one alone is longer."""
    order = np.argsort(-sizes, kind="stable")
    begin, held = 0, 0
    for i, row in enumerate(order):
        if i > begin and held + sizes[row] > BATCH_BYTES:
            yield order[begin:i]
            begin, held = i, 0
        held += sizes[row]
    if begin < len(order):
        yield order[begin:]


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    flat = pa.array([w for words in texts for w in words], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(t) for t in texts])[:-1])


def _task(prepare: Prepare | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
            for rows in _batches(sizes):
                words = [(texts[int(r)].as_py() or b"").split() for r in rows]
                if prepare:
                    words = [prepare(ids[int(r)].as_py(), w) for r, w in zip(rows, words, strict=True)]
                runs = find_runs(_numbered(words)) if any(words) else [(np.zeros(0, np.int64),) * 3] * len(rows)
                columns = [pa.array(np.concatenate([r[i] for r in runs]), pa.int64()) for i in range(3)]
                offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["start", "length", "period"])),
                        pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prepare: Prepare | None = None) -> DataFrame:
    """Per row: ``id``, ``n_words``, its ``runs`` (start, length, period; by start, then
    period) and ``collapsed``, the words that are left, joined by one space.

    ``prepare`` may change the words (bytes) of a row before they are searched.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    schema = StructType([source.schema["id"], StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", BinaryType())])
    return source.mapInArrow(_task(prepare), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's planted periods: a tenth of all ids repeats a stretch of its own words."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=planted)
    # Ratios of numbers below 2**27 differ by more than a double's rounding.
    rank = lambda r: F.struct((-(r["length"] / r["period"])).alias("ratio"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = let(F.transform("runs", rank), lambda ranked: F.array_min(ranked))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
