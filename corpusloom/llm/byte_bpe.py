"""Byte-level BPE with Spark's higher-order functions.

A text is cut into pieces by the tokenizer's pattern. The bytes of a piece become an array
with one number for each token, which starts as the one-byte tokens: the rank of the token
joined with the next one, its place in the piece and its id. ``aggregate`` folds that array:
each step takes the least number, which is the leftmost adjacent pair of the lowest rank,
joins the two tokens and reads two new ranks from a constant rank map. A constant of map type
is searched from end to end, so the rank map is one array in which the pairs of a left token
stand at its own offset plus the right token. Constants of megabytes are scalar subqueries:
their values never enter the text of a plan.

Distinct pieces are folded once for the corpus where that pays: pieces are counted over all
documents, the most frequent ones (at most ``HOT_WORDS`` pieces of at most ``HOT_BYTES``
bytes, so their table has a bound) are folded in one small job and looked up in a constant
of buckets, each a map of a few pieces, and every other piece is folded in the row where it
occurs. The answer does not depend on that choice.

Decoding looks up the bytes of every id and joins them, in hexadecimal digits, once.

Null text is empty: no tokens, nothing decoded. Text of any length is one row; folding a
single unbroken piece takes time with the square of its length, as pieces have no inner
bound. Repeated rows get equal answers; extra columns pass through.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.native import aside, table
from corpusloom.session import materialize

RANKS = "byte_bpe_multi_50k.tiktoken"
HOT_WORDS = 100_000
HOT_BYTES = 48
HOT_COUNT = 4
BUCKETS = 1 << 16
# A number of a piece: rank of the pair that starts here, place in the piece, id of the token.
RANK, PLACE = 1 << 47, 1 << 16
# Sorts behind every rank, and is no id.
NONE = 0xFFFF
CUT = "\ue002"


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by token bytes, and the pattern that cuts texts, in Java's notation."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Read a rank file; ``pattern`` is in the notation where ``\\s`` is Unicode blank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) >= 0xFFFF:
            raise ValueError("ids must fit into two bytes")
        return cls(ranks, pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}"))


def _rank_map(pairs: dict[tuple[int, int], int], single: list[int]) -> tuple[np.ndarray, int]:
    """The rank map as one array, and where its part for bytes begins.

    First come the offsets of all left tokens; then, for each byte and the next byte or the
    end (256), the number a piece starts with; then the pairs, each with its rank and its left
    token, which tells whether a place belongs to that token.
    """
    rows: dict[int, list[int]] = {}
    for left, right in pairs:
        rows.setdefault(left, []).append(right)
    draw = np.random.default_rng(0)
    offsets, size = np.zeros(NONE + 1, np.int64), NONE + 1
    taken, numbers = np.zeros(size + NONE + 1, bool), {}
    # Long rows first; where none of some offsets has all its places free, the array grows.
    for left, right in sorted(rows.items(), key=lambda row: -len(row[1])):
        columns = np.array(right)
        while True:
            tries = draw.integers(0, size, 256)
            free = ~taken[tries[:, None] + columns].any(axis=1)
            if free.any():
                break
            size += size // 16
            taken = np.concatenate([taken, np.zeros(size + NONE + 1 - len(taken), bool)])
        offsets[left] = at = tries[free.argmax()]
        taken[at + columns] = True
        numbers.update({int(at) + r: pairs[left, r] * RANK + left for r in right})
    byte_pairs = [pairs.get((a, b), NONE) * RANK + a for a in single for b in [*single, NONE]]
    begin = len(offsets) + len(byte_pairs)
    # No left token: any place, as every place names another one.
    places = np.full(len(taken), NONE * RANK + NONE, np.int64)
    places[list(numbers)] = list(numbers.values())
    return np.concatenate([offsets + begin, byte_pairs, places]), len(offsets)


def _literal(values: list[str]) -> Column:
    """A literal array of strings: the optimizer folds the split once."""
    return F.split(F.lit(CUT.join(values)), CUT, -1)


class Codec:
    """Encoding and decoding expressions for one vocabulary."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary):
        self.spark, self.vocabulary = spark, vocabulary
        ranks = vocabulary.ranks
        self.tokens = [""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.tokens[rank] = token.hex()
        # Every way to join two tokens to a token.
        pairs = {(left, right): rank for token, rank in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None}
        numbers, self.bytes = _rank_map(pairs, [ranks.get(bytes([b]), 0) for b in range(256)])
        self.pairs = self._constant(pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), pa.array(numbers)))

    def _constant(self, value: pa.Array) -> Column:
        """A value of some megabytes that the plan names but does not spell out: every plan
        that Spark describes, logs and keeps would hold a copy of a literal."""
        row = self.spark.createDataFrame(pa.table({"value": value})).coalesce(1)
        return materialize(row, "ranks").scalar()

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.vocabulary.pattern), F.lit(0))

    def _fold(self, piece: Column, table: Column) -> Column:
        """Ids of one piece, joined by commas.

        The state is an array with a number for each token. It begins and ends with a number
        that joins nothing, so that every pair has both neighbours.
        """
        edge = F.lit(NONE * RANK + NONE)
        ident = lambda number: number.bitwiseAND(NONE)

        def paired(number: Column, left: Column, right: Column) -> Column:
            """A token's number beside another next token; ``number`` is its place and id."""
            # Read twice: to bind a value costs more than to look it up.
            entry = F.get(table, (F.get(table, left.cast("int")) + right).cast("int"))
            return number + F.when(ident(entry) == left, entry - left).otherwise(F.lit(NONE * RANK))

        def step(state: Column, _: Column) -> Column:
            def joined(around: Column) -> Column:
                before, best, after = F.get(around, F.lit(0)), F.get(around, F.lit(1)), F.get(around, F.lit(3))
                new, at = F.shiftright(best, 47), F.array_position(state, best).cast("int")
                two = F.array(
                    paired(before.bitwiseAND(RANK - 1), ident(before), new),
                    paired(best.bitwiseAND(RANK - PLACE) + new, new, ident(after)),
                )
                return F.concat(F.slice(state, F.lit(1), at - 2), two, F.slice(state, at + 2, F.size(state)))

            best = F.array_min(state)
            # The pair with the tokens before and after it.
            around = F.slice(state, F.array_position(state, best).cast("int") - 1, F.lit(4))
            return F.when(best < NONE * RANK, let(around, joined)).otherwise(state)

        def whole(codes: Column) -> Column:
            first = lambda c, i: F.get(table, c * 257 + F.coalesce(F.get(codes, i + 1), F.lit(256)) + self.bytes) + i.cast("long") * PLACE
            start = F.concat(F.array(edge), F.transform(codes, first), F.array(edge))
            folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(codes) - 1, F.lit(1))), start, step)
            return F.array_join(F.transform(F.filter(folded, lambda e: e != edge), lambda e: ident(e).cast("string")), ",")

        # One character, U+0000 to U+00FF, for each UTF-8 byte.
        letters = F.split(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), "")
        return let(F.transform(letters, F.ascii), whole)

    def known_pieces(self, docs: DataFrame, text: str = "text", most: int = HOT_WORDS) -> Column:
        """Known pieces with their ids (whole tokens, and frequent pieces) in buckets by the
        hash of the piece, as one constant that Spark puts together."""
        piece = F.explode(self.pieces(F.col(text))).alias("piece")
        counts = docs.select(piece).groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_COUNT)
        counts = materialize(counts.filter(F.octet_length("piece") <= HOT_BYTES).withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "pieces")
        # Steps of the count, at most 1,024 of them, decide where the frequent pieces end.
        room, least = most, 1 << 30
        for row in counts.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
            room -= row.words
            if room < 0:
                break
            least = row.step
        hot = counts.filter(F.col("step") >= least).repartition(self.spark.sparkContext.defaultParallelism).withColumn("pairs", self.pairs)
        folded = let(F.col("pairs"), lambda table: self._fold(F.col("piece"), table))
        whole = [(token.decode("utf-8", "replace"), rank) for token, rank in self.vocabulary.ranks.items()]
        whole = [(word, str(rank)) for word, rank in whole if word.encode() in self.vocabulary.ranks]
        tokens = self.spark.createDataFrame(pa.table({"piece": [w for w, _ in whole], "ids": [i for _, i in whole]}))
        # A piece that is a token is that token.
        known = hot.select("piece", folded.alias("ids"), F.lit(1).alias("source")).unionByName(tokens.withColumn("source", F.lit(0)))
        known = known.groupBy("piece").agg(F.min_by("ids", "source").alias("ids"))
        entries = F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("entries")
        filled = known.groupBy(F.hash("piece").bitwiseAND(BUCKETS - 1).alias("at")).agg(entries)
        every = self.spark.range(BUCKETS).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
        one = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "entries"))).alias("rows"))
        return materialize(one.select(F.transform("rows", lambda r: F.map_from_entries(r["entries"])).alias("buckets")), "known").scalar()

    def encode(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """``docs`` with ``name``: the ids joined by commas, and as an array."""

        def one(piece: Column, buckets: Column, table: Column) -> Column:
            bucket = F.get(buckets, F.hash(piece).bitwiseAND(BUCKETS - 1))
            return F.coalesce(bucket[piece], self._fold(piece, table))

        split = lambda j: F.struct(
            j.alias("joined"), F.when(j == "", F.array().cast("array<int>")).otherwise(F.split(j, ",", -1).cast("array<int>")).alias("ids")
        )
        # Each constant is named once, so it ends up inside the one expression and in no row.
        each = lambda table, buckets: F.transform(self.pieces(F.col(text)), lambda p: one(p, buckets, table))
        joined = F.array_join(let(F.col("_pairs"), lambda table: let(F.col("_known"), lambda buckets: each(table, buckets))), ",")
        held = docs.withColumns({"_pairs": self.pairs, "_known": self.known_pieces(docs, text)})
        return held.select(*docs.columns, let(joined, split).alias(name))

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids."""
        digits = let(_literal(self.tokens), lambda tokens: F.transform(ids, lambda i: F.get(tokens, i)))
        return F.unhex(F.array_join(digits, ""))


def encode(docs: DataFrame, codec: Codec, text: str = "text", name: str = "coded") -> DataFrame:
    """``docs`` with a struct of the comma-joined ids and the array of ids of each text."""
    docs, back = aside(docs, "_pairs", "_known")
    return codec.encode(docs, text, name).withColumnsRenamed(back)


def digests(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256."""
    codec = Codec(docs.sparkSession, vocabulary)
    docs, back = aside(docs, "_coded")
    ids = F.col("_coded.ids")
    results = {
        "n_tokens": F.size(ids).cast("long"),
        "ids_sha256": F.sha2("_coded.joined", 256),
        "decoded_sha256": F.sha2(codec.decode(ids), 256),
    }
    return encode(docs, codec, text, "_coded").withColumns(results).drop("_coded").withColumnsRenamed(back)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary.load(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, vocabulary).drop("text")
