"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the row, so the operator is a single narrow
stage: nothing is shuffled, and a document of any length stays one row.

Null or blank text has no words, fails the base rule and is not kept. Ties and repeated
rows get equal answers; other columns pass through ``measure`` untouched. Columns of the
input that carry the name of a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.native import BLANK, aside, table, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[!?]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for on with as was at be this are from by or an "
    "de la le et les des un une en que qui pour dans du sur au est pas "
    "der die das und ist von zu den mit auf im ein eine für nicht sich "
    "el los y las se por con para del su como lo"
).split()

# (rule, measure, side, threshold, fewest words): the rule rejects a document whose
# measure lies on that side of the threshold.
RULES: tuple[tuple[str, str, str, float, int], ...] = (
    ("short words", "word_length", "below", 2.0, 0),
    ("long words", "word_length", "above", 20.0, 0),
    ("symbols", "symbol_ratio", "above", 0.1, 0),
    ("shouting", "shout_ratio", "above", 0.3, 0),
    ("no stop words", "stop_ratio", "below", 0.01, 50),
    ("repeated lines", "dup_line_ratio", "above", 0.4, 0),
)
MEASURES = ("word_length", "symbol_ratio", "shout_ratio", "stop_ratio", "dup_line_ratio")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "reasons", "kept", *MEASURES)


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words inside any ``width``-word window that occurs twice or more in the text.

    Windows are compared by 64-bit hashes chained over their words. Texts without a
    repeat stop after one set of hashes; only the others sort them.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spots(o: Column) -> Column:
            same = lambda i, j: F.get(o, i)["h"] == F.get(o, j)["h"]
            twins = F.filter(o, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.sort_array(F.transform(twins, lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(ordered, spots), total)

    hashes = F.transform(F.sequence(F.lit(1), F.size(tokens) - (width - 1)), lambda i: F.xxhash64(F.slice(tokens, i, width)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(tokens) > width, found).otherwise(F.lit(0).cast("long"))


def assess(text: Column, rules=RULES) -> Column:
    """Counts, ratios, the names of failed rules and the verdict, as one struct.

    The parts are bound inside one expression, so a filter on the verdict holds it once
    however many rules read a count.
    """
    value = F.coalesce(text, F.lit(""))
    named = lambda **parts: F.struct(*[c.alias(n) for n, c in parts.items()])

    def counted(split: Column) -> Column:
        tokens, lines = split["words"], split["lines"]
        return named(
            n_words=F.size(tokens).cast("long"),
            word_chars=F.length(F.translate(value, " \t\n\x0b\x0c\r", "")).cast("long"),
            n_symbols=F.regexp_count(value, F.lit(SYMBOLS)).cast("long"),
            n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            n_repeat_words=repeated_words(tokens),
            shouts=F.regexp_count(value, F.lit(SHOUTS)),
            stops=F.size(F.filter(tokens, lambda w: w.isin(*STOP_WORDS))),
            lines=F.size(lines),
        )

    def rated(c: Column) -> Column:
        share = lambda part, whole: c[part] / F.greatest(c[whole], F.lit(1))
        return named(
            **{n: c[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
            base_failed=(c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"]),
            word_length=share("word_chars", "n_words"),
            symbol_ratio=share("n_symbols", "n_words"),
            shout_ratio=share("shouts", "n_words"),
            stop_ratio=share("stops", "n_words"),
            dup_line_ratio=share("n_dup_lines", "lines"),
        )

    def judged(m: Column) -> Column:
        beyond = {"below": lambda c, t: c < t, "above": lambda c, t: c > t}
        failed = [F.when((m["n_words"] >= least) & beyond[side](m[name], F.lit(limit)), F.lit(rule)) for rule, name, side, limit, least in rules]
        kept = lambda reasons: named(reasons=reasons, kept=~m["base_failed"] & (F.size(reasons) == 0))
        return named(measures=m, verdict=let(F.array_compact(F.array(*failed)), kept))

    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(f"[^{BLANK[1:]}"))
    return let(named(words=words(text), lines=lines), lambda split: let(let(counted(split), rated), judged))


def measure(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with counts, ratios, the names of failed rules and the verdict ``kept``."""
    docs, back = aside(docs, "_assessed")
    source = docs.withColumn("_assessed", assess(F.col(text), rules))
    rest = [c for c in docs.columns if c not in RESULT]
    return source.select(*rest, "_assessed.measures.*", "_assessed.verdict.*").withColumnsRenamed(back)


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    return docs.filter(assess(F.col(text), rules)["verdict"]["kept"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "reasons", *MEASURES)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FAILS = " OR ".join(
    f"(n_words >= {least} AND {name} {'<' if side == 'below' else '>'} {limit})" for _, name, side, limit, least in RULES
)
ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), ranked AS (SELECT row_number() OVER () AS r, * FROM w),
grams AS (
  SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM ranked WHERE len(ws) > {WINDOW})
), twins AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), spots AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twins) GROUP BY r
), measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(list_sum([0] || list_transform(ws, lambda x: length(x))) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(regexp_replace(text, '[^!?]', '', 'g')) AS shouts,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM ranked LEFT JOIN spots USING (r)
), rated AS (
  SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, word_chars / greatest(n_words, 1) AS word_length,
         n_symbols / greatest(n_words, 1) AS symbol_ratio, shouts / greatest(n_words, 1) AS shout_ratio, stops / greatest(n_words, 1) AS stop_ratio,
         (len(ls) - len(list_distinct(ls))) / greatest(len(ls), 1) AS dup_line_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_FAILS}) AS kept FROM rated
"""
