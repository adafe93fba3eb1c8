"""Secret scan: named patterns, and character Markov models for what they do not name.

Patterns find assigned values, access keys and long hex strings. Besides, every unbroken
run of ``MIN_RUN`` or more key characters that mixes character classes is scored by two
models of character transitions, one of random strings and one of ordinary identifiers:
the log-likelihood ratio per character, beyond a threshold set on labelled strings that
were kept out of the counts, marks a run as ``random``.

Labels come from all texts: what the patterns find is random; words, and words joined by
``_ / -`` with at most four digits behind them, are ordinary, unless a pattern found them
too. Every ordinary word also stands for one identifier spelled with it (``wordWord``,
``word_word``, ``word2024`` and so on, by its checksum), as prose shows few of those.
Strings are made distinct before they are counted, so copies weigh nothing; counts cover
every distinct string but a tenth of them (by checksum), which sets the threshold. Only
the transition counts, bounded by the alphabet, and a histogram of scores reach the
driver. Scan and training use built-in expressions only.

Null and empty texts hold no spans. Spans are in code points, end exclusive; a run that
touches a span of a pattern is not reported again. Long texts and long runs are read in
full, in linear time. Repeated rows get equal answers, an empty table an empty result
(without labelled strings no run is reported). Input columns other than ``secrets`` pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.native import table
from corpusloom.session import materialize

# The three patterns, and the shortest value, key and hex string.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")

KEY = "A-Za-z0-9+/_=-"
MIN_RUN = 20
RUN = rf"(?<![{KEY}])[{KEY}]{{{MIN_RUN},}}+"
# A value of an assignment is a labelled random string if it is as long and mixes classes.
MIN_LABELLED = 16
MIN_WORD = 8
WORD = rf"(?<![{KEY}])(?=[{KEY}]{{{MIN_WORD}}})[A-Za-z]++(?:[_/-][A-Za-z]++)*+[0-9]{{0,4}}+(?![{KEY}])"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
START = len(ALPHABET)
# Part of the random model that is the same for every character, so that it also fits
# alphabets which the labelled strings do not show.
UNIFORM = 0.5
# Weight, in observed transitions, of the character frequencies behind each context.
BACKOFF = 50.0
HELD_OUT = 10
# At most this part of the ordinary strings kept out may score beyond the threshold, which
# is never below FLOOR: 20 characters then speak for random with odds of 22,000 to 1.
MISTAKEN = 0.001
FLOOR = 0.5
STEP = 0.01


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by (previous, next) character, and the threshold."""

    ratios: tuple[float, ...]
    threshold: float


def _running(values: Column, combine: Callable[[Column, Column], Column], zero: Column, block: int = 64) -> Column:
    """Prefix results, each including its own value, by blocks: near linear in the size."""
    size = F.size(values)
    fold = lambda part, start: F.aggregate(part, start, combine)

    def by_block(sums: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sums) - 1, F.lit(0))), lambda b: fold(F.slice(sums, 1, b), zero))

        def within(heads: Column) -> Column:
            def one(value: Column, i: Column) -> Column:
                b = F.floor(i / block).cast("int")
                return fold(F.slice(values, b * block + 1, i - b * block + 1), F.get(heads, b))

            return F.transform(values, one)

        return let(before, within)

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / block).cast("int"), F.lit(0))), lambda b: fold(F.slice(values, b * block + 1, block), zero))
    return let(blocks, by_block)


def _span(start: Column, kind: Column, end: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"), value.alias("value"))


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _places(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans, in order; ``value`` is the group kept."""
    none = F.array().cast(SPANS)

    def spans(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        gone = lambda i: F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))
        steps = F.transform(pieces, lambda p, i: F.length(p) + gone(i))
        starts = lambda s: _running(s, lambda a, b: a + b, F.lit(0))
        values = found if value == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
        built = lambda at: let(
            values, lambda v: F.transform(found, lambda m, i: _span(F.get(at, i), F.lit(kind), F.get(at, i) + F.length(m), F.get(v, i)))
        )
        return F.when(F.size(found) == 0, none).otherwise(let(let(steps, starts), built))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _classes(value: Column) -> Column:
    return value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int") + value.rlike("[0-9]").cast("int")


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind."""
    value = F.coalesce(text, F.lit(""))
    assigned = F.filter(_places(value, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= MIN_VALUE)
    return F.array_sort(F.concat(assigned, _places(value, ACCESS, 1), _places(value, HEX, 2)))


def ratio(value: Column, model_ratios: tuple[float, ...]) -> Column:
    """Log-likelihood ratio per character of a string over the key characters."""
    numbers = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")
    symbol = [ALPHABET.find(chr(c)) if chr(c) in ALPHABET else 0 for c in range(128)]
    begin = F.struct(F.lit(START).alias("before"), F.lit(0.0).alias("total"))

    def step(state: Column, char: Column) -> Column:
        now = F.get(numbers(symbol, "int"), F.ascii(char))
        return let(now, lambda n: F.struct(n.alias("before"), (state["total"] + F.get(numbers(model_ratios, "double"), state["before"] * len(ALPHABET) + n)).alias("total")))

    chars = F.filter(F.split(value, "", -1), lambda c: c != "")
    return F.aggregate(chars, begin, step, lambda s: s["total"]) / F.greatest(F.length(value), F.lit(1))


def random_spans(text: Column, base: Column, model: Model) -> Column:
    """Runs that the models call random and that touch no span of ``base``."""
    value = F.coalesce(text, F.lit(""))
    likely = F.filter(_places(value, RUN, 3), lambda s: (_classes(s["value"]) >= 2) & (ratio(s["value"], model.ratios) > model.threshold))

    def clear(runs: Column) -> Column:
        def merged(spans: Column) -> Column:
            ours = lambda s: s["kind"] < 3
            far = F.lit(2**31 - 1)
            ends = F.transform(spans, lambda s: F.when(ours(s), s["end"]).otherwise(F.lit(0)))
            starts = F.reverse(F.transform(spans, lambda s: F.when(ours(s), s["start"]).otherwise(far)))
            before = let(ends, lambda e: _running(e, lambda a, b: F.greatest(a, b), F.lit(0)))
            after = F.reverse(let(starts, lambda e: _running(e, lambda a, b: F.least(a, b), far)))
            alone = lambda b, a: F.filter(spans, lambda s, i: (s["kind"] == 3) & (F.get(b, i) <= s["start"]) & (F.get(a, i) >= s["end"]))
            return let(before, lambda b: let(after, lambda a: alone(b, a)))

        return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(let(F.array_sort(F.concat(base, runs)), merged))

    return let(likely, clear)


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct labelled strings of all texts: ``word`` and ``random``."""
    value = F.coalesce(F.col(text), F.lit(""))
    mixed = F.filter(F.regexp_extract_all(value, F.lit(ASSIGN), F.lit(1)), lambda v: (F.length(v) >= MIN_LABELLED) & (_classes(v) >= 2))
    found = [F.regexp_extract_all(value, F.lit(p), F.lit(0)) for p in (ACCESS, HEX)]
    mark = lambda words, random: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(random).alias("random")))
    words = F.regexp_extract_all(value, F.lit(WORD), F.lit(0))
    rows = docs.select(F.explode(F.concat(mark(F.concat(mixed, *found), 1), mark(words, 0))).alias("s")).select("s.word", "s.random")
    return rows.groupBy("word").agg(F.max("random").alias("random"))


def spelled(words: DataFrame) -> DataFrame:
    """``words`` and, for each ordinary word of letters, one identifier made of it."""
    word = F.col("word")
    title = F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.lower(F.substr(word, F.lit(2))))
    number = (F.crc32(F.reverse(word).cast("binary")) % 10_000).cast("string")
    forms = [F.concat(F.lower(word), title), F.concat(word, number), *[F.concat_ws(mark, word, word) for mark in "_-/."]]
    form = F.get(F.array(*forms), (F.crc32(word.cast("binary")) / HELD_OUT).cast("int") % len(forms))
    plain = (F.col("random") == 0) & word.rlike("^[A-Za-z]+$")
    return words.select(F.explode(F.when(plain, F.array(word, form)).otherwise(F.array(word))).alias("word"), "random", "held")


def transition_counts(words: DataFrame) -> DataFrame:
    """How often ``after`` follows ``before`` in strings of each label; "" is the start."""
    chars = F.filter(F.split("word", "", -1), lambda c: c != "")
    pairs = let(chars, lambda cs: F.transform(cs, lambda c, i: F.struct(F.coalesce(F.get(cs, i - 1), F.lit("")).alias("before"), c.alias("after"))))
    return words.select("random", F.explode(pairs).alias("p")).groupBy("random", "p.before", "p.after").count()


def _log_odds(counts: dict[tuple[str, str], int], uniform: float) -> list[float]:
    """Log-probabilities of every transition, row by row of ``before`` (start last)."""
    size = len(ALPHABET)
    after, before = Counter(), Counter()
    for (b, a), n in counts.items():
        after[a] += n
        before[b] += n
    total = sum(after.values())
    out = []
    for b in [*ALPHABET, ""]:
        for a in ALPHABET:
            plain = (after[a] + 1) / (total + size)
            learned = (counts.get((b, a), 0) + BACKOFF * plain) / (before[b] + BACKOFF)
            out.append(math.log(uniform / size + (1 - uniform) * learned))
    return out


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Both models and the threshold, from all labelled strings of the texts."""
    held = F.crc32(F.col("word").cast("binary")) % HELD_OUT == 0
    words = spelled(materialize(labelled(docs, text).withColumn("held", held), "labelled"))
    counts: dict[int, dict[tuple[str, str], int]] = {0: {}, 1: {}}
    # At most two labels times the square of the alphabet.
    for row in transition_counts(words.filter(~F.col("held"))).collect():
        counts[row["random"]][row["before"], row["after"]] = row["count"]
    random, plain = _log_odds(counts[1], UNIFORM), _log_odds(counts[0], 0.0)
    ratios = tuple(round(r - p, 6) for r, p in zip(random, plain, strict=True))
    scores = words.filter(F.col("held") & (F.col("random") == 0)).select(F.floor(ratio(F.col("word"), ratios) / STEP).alias("bin"))
    threshold = FLOOR
    bins = sorted(scores.groupBy("bin").count().collect(), key=lambda r: -r["bin"])
    left = MISTAKEN * sum(r["count"] for r in bins)
    for row in bins:
        left -= row["count"]
        if left < 0:
            threshold = max(FLOOR, (row["bin"] + 1) * STEP)
            break
    return Model(ratios, round(threshold, 6))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: struct of ``base`` and ``added`` spans (start, kind, end,
    value), where kind is a position in ``KINDS``."""
    found = let(base_spans(F.col(text)), lambda base: F.struct(base.alias("base"), random_spans(F.col(text), base, model).alias("added")))
    return docs.select(*[c for c in docs.columns if c != "secrets"], found.alias("secrets"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return scan(docs, fit(docs)).select(
        "doc_id", counted(0), counted(1), counted(2),
        F.sha2(_listed(F.col("secrets.base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("secrets.base", "secrets.added"))).alias("spans"),
    )
