"""Benchmark decontamination with spaced seeds.

Test items and documents become lists of lower-cased words of letters and digits. Fixed
masks pick some positions of a window and ignore the others; windows of both sides with
equal hashes under one mask are a hit even if the ignored words differ. Hits of a
document and an item on one diagonal are one candidate, whose aligned words are then
compared: every equal word scores one, every other word costs one, and the best run must
score ``MIN_SCORE`` (or ``SHORT_SHARE`` of an item that is shorter).

Only hits leave the row they were found in. The hashes of the items are broadcast in
blocks of at most ``MAX_BROADCAST`` rows; a larger benchmark takes several passes over the
documents with the same result.

Null and empty texts have no words and match nothing; items shorter than a window match as
a whole, without ignored words. Repeated rows and repeated items count once; null ids are
ids. Ties between items are all reported. Extra columns are ignored by ``find_leaks`` and
kept by ``drop_leaks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.native import table

# The masks; 1 keeps a position, 0 ignores it.
MASKS = ("11101011", "11010111", "10111101")
SPAN = len(MASKS[0])
MIN_SCORE = 10
SHORT_SHARE = 0.7
MAX_BROADCAST = 500_000
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(tokens: Column, at: Column, shapes: list[tuple[int, ...]]) -> Column:
    """Hash of the kept words of each shape at position ``at``; null beyond the end."""
    out = []
    for number, kept in enumerate(shapes):
        value = F.xxhash64(F.lit(number), *[F.get(tokens, at + i) for i in kept])
        out.append(F.when(at + kept[-1] < F.size(tokens), value))
    return F.array(*out)


def _items(benchmark: DataFrame, id_column: str, text: str) -> DataFrame:
    distinct = benchmark.select(F.col(id_column).alias("item_id"), F.col(text).alias("_text")).distinct()
    items = distinct.select("item_id", F.xxhash64("_text").alias("item_hash"), words(F.col("_text")).alias("item_words"))
    return items.filter(F.size("item_words") > 0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_hash, item_id, score, start, matched): documents that hold an item or part of one."""
    items = _items(benchmark, item_id, item_text)
    # Items below a window's length get one shape of their own: all their words.
    short = sorted(r.n for r in items.select(F.size("item_words").alias("n")).filter(F.col("n") < SPAN).distinct().collect())
    shapes = [tuple(i for i, c in enumerate(mask) if c == "1") for mask in MASKS] + [tuple(range(n)) for n in short]
    size = F.size("item_words")
    fits = F.array(*[(size >= SPAN) if k < len(MASKS) else (size == short[k - len(MASKS)]) for k in range(len(shapes))])
    seeds = items.select("item_id", "item_hash", size.alias("length"), fits.alias("fits"), "item_words", F.explode(F.sequence(F.lit(0), size - 1)).alias("spot"))
    seeds = seeds.select("item_id", "item_hash", "length", "spot", "fits", F.posexplode(_hashes(F.col("item_words"), F.col("spot"), shapes)).alias("shape", "hash"))
    seeds = seeds.filter(F.col("hash").isNotNull() & F.get("fits", F.col("shape"))).drop("fits", "shape")
    blocks = max(1, -(-seeds.count() // MAX_BROADCAST))

    at = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("words"))
    at = at.filter(F.size("words") > 0).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i"))
    at = at.select("id", "text_hash", "words", "i", F.explode(_hashes(F.col("words"), F.col("i"), shapes)).alias("hash"))

    diagonal = F.col("i") - F.col("spot")
    first = F.greatest(diagonal, F.lit(0))
    aligned = F.slice("words", first + 1, F.col("length") - (first - diagonal))

    def hits(block: int) -> DataFrame:
        part = seeds.filter(F.pmod(F.xxhash64("item_id", "item_hash"), F.lit(blocks)) == block) if blocks > 1 else seeds
        found = at.join(F.broadcast(part), "hash")
        return found.groupBy("id", "text_hash", "item_id", "item_hash", diagonal.alias("start")).agg(F.first(aligned).alias("aligned"))

    found = reduce(DataFrame.unionByName, [hits(b) for b in range(blocks)])
    theirs = items.select(F.col("item_id").alias("_item"), F.col("item_hash").alias("_hash"), "item_words")
    both = found.join(theirs, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_hash")))
    # Words before the document's first word count as unequal.
    lead = F.greatest(-F.col("start"), F.lit(0))
    equal = F.transform("item_words", lambda w, i: F.coalesce((i >= lead) & (w == F.get("aligned", i - lead)), F.lit(False)))

    def run(flags: Column) -> Column:
        zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

        def add(s: Column, same: Column) -> Column:
            now = F.greatest(s["now"] + F.when(same, 1).otherwise(-1), F.lit(0))
            return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

        matched = F.size(F.filter(flags, lambda f: f))
        return F.struct(F.aggregate(flags, zero, add)["best"].alias("score"), matched.alias("matched"))

    scored = both.withColumn("_r", let(equal, run)).select("id", "text_hash", "item_id", F.size("item_words").alias("length"), F.col("_r.score").alias("score"), "start", F.col("_r.matched").alias("matched"))
    scored = scored.filter(F.col("score") >= F.least(F.lit(MIN_SCORE), F.ceil(F.col("length") * SHORT_SHARE)))
    best = F.max_by(F.struct("score", "start", "matched"), F.struct("score", -F.col("start"))).alias("_b")
    return scored.groupBy("id", "text_hash", "item_id").agg(best).select("id", "text_hash", "item_id", "_b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, with their own columns."""
    leaks = find_leaks(docs, benchmark, id_column, text).select("id", "text_hash").distinct()
    same = docs[id_column].eqNullSafe(leaks["id"]) & (F.xxhash64(docs[text]) == leaks["text_hash"])
    return docs.join(leaks, same, "left_anti")


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("id").alias("doc_id"), "item_id", "score", "start", "matched").distinct()
