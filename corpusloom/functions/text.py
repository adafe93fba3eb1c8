"""Column expressions over plain text: folding, tokens, hashes, whitespace.

Everything here is a built-in Spark expression, so it runs in the JVM next to the
scan and never needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that Unicode text handling treats as blank, and the
# subset that ends a line.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"

# Characters whose full case folding yields ASCII letters although
# lower() leaves them alone.
FOLDS = {
    "\u00df": "ss",
    "\u0149": "\u02bcn",
    "\u017f": "s",
    "\u01f0": "j\u030c",
    "\u1e96": "h\u0331",
    "\u1e97": "t\u0308",
    "\u1e98": "w\u030a",
    "\u1e99": "y\u030a",
    "\u1e9a": "a\u02be",
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\ufb05": "st",
    "\ufb06": "st",
}

# What counts as a word. Identifiers joined by ./+:- stay whole.
# U+0131 is the one non-ASCII letter a caseless [a-z] accepts after folding.
WORD = "[a-z0-9_\u0131]+(?:[./+:-][a-z0-9_\u0131]+)*"
HAN = "\u3400-\u9fff"
TOKEN = f"({WORD}|[{HAN}]+)"
# One match per token, without building any array: a Han run of n characters
# yields n-1 pairs, a lone Han character yields itself.
TOKEN_COUNT = f"{WORD}|[{HAN}](?=[{HAN}])|(?<![{HAN}])[{HAN}](?![{HAN}])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so that ``body`` may use it many times.

    A lambda variable is evaluated once per row, while a plain column reference
    may be inlined into every place that mentions it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column, block: int = 64) -> Column:
    """Prefix results of a fold, each including its own value; by blocks, so that long
    arrays take little more than linear time."""
    fold = lambda part, start: F.aggregate(part, start, combine)
    last = F.greatest(F.floor((F.size(values) - 1) / block).cast("int"), F.lit(0))

    def by_block(totals: Column) -> Column:
        heads = F.transform(totals, lambda _, b: fold(F.slice(totals, 1, b), zero))
        own = lambda i, b, before: fold(F.slice(values, b * block + 1, i - b * block + 1), F.get(before, b))
        return let(heads, lambda before: F.transform(values, lambda _, i: own(i, F.floor(i / block).cast("int"), before)))

    return let(F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(values, b * block + 1, block), zero)), by_block)


def match_ends(parts: Column, found: Column) -> Column:
    """Where each of the ``found`` matches of a pattern ends, in characters from 0, given
    the ``parts`` of the text between them: lengths in turn add up to positions."""
    steps = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
    return let(steps, lambda s: running(s, lambda a, b: a + b, F.lit(0)))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def rstrip(value: Column) -> Column:
    return F.rtrim(value, F.lit(BLANKS))


def lstrip(value: Column) -> Column:
    return F.ltrim(value, F.lit(BLANKS))


def unix_newlines(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_hash(value: Column) -> Column:
    """SHA-256 of the text with normalised newlines."""
    return F.sha2(unix_newlines(value), 256)


def fold(value: Column) -> Column:
    """Case folding as far as it can change tokens or caseless comparisons."""

    def folded(lowered: Column) -> Column:
        full = lowered
        for char, text in FOLDS.items():
            full = F.replace(full, F.lit(char), F.lit(text))
        # Substring searches run over bytes; a class of these characters tests each in turn.
        odd = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(char)) for char in FOLDS])
        return F.when(odd, full).otherwise(lowered)

    # The one letter that lower() spells with a mark, which would end a word; a plain i goes on.
    return let(F.lower(F.replace(value, F.lit("\u0130"), F.lit("i"))), folded)


def _pairs(word: Column) -> Column:
    return F.when(
        (F.length(word) > 1) & word.rlike(f"^[{HAN}]"),
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(2))),
    ).otherwise(F.array(word))


def tokens(value: Column) -> Column:
    """Search tokens in order: whole identifiers, and overlapping Han pairs."""
    return let(
        fold(value),
        lambda text: F.when(
            text.rlike(f"[{HAN}]"),
            F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), _pairs)),
        ).otherwise(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))),
    )


def token_count(value: Column) -> Column:
    """``size(tokens(value))`` without materialising the tokens."""
    han = lambda text: F.when(text.rlike(f"[{HAN}]"), F.regexp_count(text, F.lit(TOKEN_COUNT)))
    return let(fold(value), lambda text: han(text).otherwise(F.regexp_count(text, F.lit(WORD))))


def term_counts(words: Column) -> Column:
    """array<string> -> array<struct<term, tf>>, one entry per distinct term.

    Sort, then measure the runs: no explode and no shuffle, so postings leave the
    scan already counted however many notes share a term.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1))),
            lambda i: (i <= F.size(ordered))
            & ((i == 1) | (F.get(ordered, i - 1) != F.get(ordered, F.greatest(i - 2, F.lit(0))))),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, i: F.struct(
                    F.get(ordered, start - 1).alias("term"),
                    (F.coalesce(F.get(at, i + 1), F.size(ordered) + 1) - start).cast("double").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(words), runs)


def merge_term_counts(weighted: list[tuple[Column, float]]) -> Column:
    """Add several term-count arrays under weights; still one entry per term."""

    def scaled(counts: Column, weight: float) -> Column:
        return F.transform(counts, lambda c: F.struct(c["term"].alias("term"), (c["tf"] * F.lit(weight)).alias("tf")))

    rows = F.concat(*[scaled(counts, weight) for counts, weight in weighted])

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1))),
            lambda i: (i <= F.size(ordered))
            & ((i == 1) | (F.get(ordered, i - 1)["term"] != F.get(ordered, F.greatest(i - 2, F.lit(0)))["term"])),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, i: F.struct(
                    F.get(ordered, start - 1)["term"].alias("term"),
                    F.aggregate(
                        F.slice(ordered, start, F.coalesce(F.get(at, i + 1), F.size(ordered) + 1) - start),
                        F.lit(0.0),
                        lambda total, c: total + c["tf"],
                    ).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(rows), runs)


def lines(value: Column) -> Column:
    """Lines of a text with normalised newlines; a final line end adds no line."""
    parts = F.split(unix_newlines(value), "[" + LINE_ENDS.replace("\r", "") + "]", -1)
    # A text that ends in a line end (or is empty) splits off one empty last part.
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p),
    )


def excerpt(value: Column, limit: int = 240) -> Column:
    """Blank runs collapsed, cut to ``limit`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(value, f"[{BLANKS}]+", " "))
    return let(
        flat,
        lambda text: F.when(F.length(text) <= limit, text).otherwise(
            F.concat(rstrip(F.substring(text, 1, limit - 1)), F.lit("…"))
        ),
    )
