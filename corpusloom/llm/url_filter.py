"""URL filter: ratio of two character language models.

Two Markov models of variable order, one of accepted and one of rejected addresses, are
counted over all labelled pages (a label is weak: ``REJECT_TERMS`` in the host) but a
tenth, kept out for the threshold. All counts stay, as a table of contexts, each with at most
96 symbols; a context backs off to shorter ones with Witten-Bell weights. An address is
judged by the difference of its two log-likelihoods per character against the threshold.

Every distinct gram of the addresses gets its log-ratio by joins, from the shortest suffix to
the longest, where at most 96 grams meet in a key. The most frequent grams (``FAST`` at most)
are broadcast; an address sums them where it is and gets the others by a join. Both ways
give the same values, and what is outside the broadcast is rare, so no key is hot.

Host and path rules go first: the longest fitting rule decides, and only addresses
without one are left to the models.

A null address, or one without ``://``, has empty host and path, which carry no evidence:
no rule fits and the verdict is ``allow``. The threshold is set on all addresses that were kept
out; if one label is missing there but both were counted, it is 0, where both models are
equally likely. If no counted address is rejected either (or none is accepted, or the
table is empty) the models cannot differ and everything without a rule is allowed. Repeated rows get equal answers; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.native import aside, table
from corpusloom.session import materialize

# Parts of host names that mark an address as rejected for training.
REJECT_TERMS = ("adult", "bets", "casino", "free-money", "gambl", "pills", "poker", "porn", "spam", "viagra", "xxx")

# Fixed values: (effect, host and path) of the address rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

ORDER = 4
FAST = 300_000
BINS = 1024
HELD_OUT = 10
ALPHABET = 96
OTHER = "\x7f"
START = "\x01"

SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    value = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(value, SHAPE, 1), UPPER, LOWER), F.regexp_extract(value, SHAPE, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its effect; null without one."""
    name = effect = None
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        effect = F.when(fits, kind) if effect is None else effect.when(fits, kind)
    return name, effect


def symbols(host: Column, path: Column) -> Column:
    """What the models read: printable ASCII kept, anything else one symbol."""
    return F.regexp_replace(F.concat(host, path), r"[^\x21-\x7e]", OTHER)


def _grams(rows: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of ``text``: it and the ``order`` symbols before it."""
    padded = rows.select(*keep, F.concat(F.lit(START * order), "text").alias("text")).filter(F.length("text") > order)
    at = padded.select(*keep, "text", F.explode(F.sequence(F.lit(order + 1), F.length("text"))).alias("i"))
    return at.select(*keep, F.substr("text", F.col("i") - order, F.lit(order + 1)).alias("gram"))


def count_contexts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(context, totals and distinct symbols of both labels, following) of
    ``labelled(text, label)``."""
    of = lambda label, n: F.sum(F.when(F.col("label") == label, n).otherwise(0))
    at = _grams(labelled, order, "label").groupBy("gram").agg(of("accept", 1).alias("a"), of("reject", 1).alias("r"))
    at = at.select("a", "r", F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substr("gram", k))).alias("gram"))
    counts = at.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    # At most ALPHABET rows meet in a context, whatever the size of the table.
    entry = F.struct(F.substr("gram", F.length("gram")).alias("symbol"), F.struct("a", "r").alias("n"))
    return counts.groupBy(F.substr("gram", F.lit(1), F.length("gram") - 1).alias("context")).agg(
        F.sum("a").alias("total_a"), F.count_if(F.col("a") > 0).alias("kinds_a"),
        F.sum("r").alias("total_r"), F.count_if(F.col("r") > 0).alias("kinds_r"),
        F.map_from_entries(F.collect_list(entry)).alias("following"),
    )


class Ratio:
    """Difference of two smoothed log-likelihoods per character, from a table of contexts."""

    def __init__(self, contexts: DataFrame, order: int = ORDER):
        self.contexts, self.order = contexts, order

    def steps(self, texts: DataFrame) -> DataFrame:
        """(gram, n, step): log-ratio and number of every gram of ``texts(text)``."""
        needed = materialize(_grams(texts, self.order).groupBy("gram").agg(F.count("*").alias("n")), "grams")
        below = None
        for k in range(1, self.order + 2):
            now = needed.select(F.substr("gram", F.lit(self.order + 2 - k)).alias("g")).distinct()
            known = self.contexts.filter(F.length("context") == k - 1)
            now = now.join(known, F.substr("g", F.lit(1), F.lit(k - 1)) == F.col("context"), "left")
            if below is None:
                now = now.withColumns({"below_a": F.lit(1.0 / ALPHABET), "below_r": F.lit(1.0 / ALPHABET)})
            else:
                now = now.join(below, F.substr("g", F.lit(2)) == F.col("shorter"))
            here = F.col("following")[F.substr("g", F.lit(k))]

            def mixed(x: str, here: Column = here) -> Column:
                p, total, kinds = F.col(f"below_{x}"), F.col(f"total_{x}"), F.col(f"kinds_{x}")
                return F.when(total > 0, (F.coalesce(here[x], F.lit(0)) + kinds * p) / (total + kinds)).otherwise(p)

            below = now.select(F.col("g").alias("shorter"), mixed("a").alias("below_a"), mixed("r").alias("below_r"))
        found = below.select(F.col("shorter").alias("gram"), (F.log("below_a") - F.log("below_r")).alias("step"))
        return materialize(needed.join(found, "gram"), "steps")

    def scored(self, rows: DataFrame, text: str, steps: DataFrame, fast: int | None = None) -> DataFrame:
        """``rows`` with ``_score``; ``steps`` cover the grams of their texts."""
        order, fast = self.order, FAST if fast is None else fast
        # The most frequent grams, by powers of two of their numbers.
        level = F.floor(F.log2("n"))
        sizes = sorted(((r.level, r.n) for r in steps.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
        held, least = 0, None
        for at, n in sizes:
            if held + n > fast:
                break
            held, least = held + n, at
        often = steps.filter(level >= least) if least is not None else steps.limit(0)
        shared = rows.sparkSession.sparkContext.broadcast(dict(zip(*often.select("gram", "step").toArrow().to_pydict().values(), strict=True)))

        @F.pandas_udf("total double, rest array<string>")
        def sums(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            step = shared.value
            for texts in batches:
                out = []
                for value in texts:
                    padded = START * order + value
                    grams = [padded[i : i + order + 1] for i in range(len(value))]
                    out.append((sum(step.get(g, 0.0) for g in grams), [g for g in grams if g not in step]))
                yield pd.DataFrame(out, columns=["total", "rest"])

        mean = lambda total: F.when(F.col(text) == "", 0.0).otherwise(total / F.length(text))
        summed = rows.withColumn("_sums", sums(text))
        whole = summed.withColumn("_score", mean(F.col("_sums.total"))).drop("_sums")
        if held == sum(n for _, n in sizes):
            return whole
        own = summed.filter(F.size("_sums.rest") > 0).select(F.col(text).alias("_open"), F.col("_sums.rest").alias("rest"))
        own = own.distinct().select("_open", F.posexplode("rest").alias("i", "gram")).join(steps.select("gram", "step"), "gram")
        # Summed in the order of the text, so that equal addresses have equal scores.
        inside = F.transform(F.array_sort(F.collect_list(F.struct("i", "step"))), lambda x: x["step"])
        own = own.groupBy("_open").agg(F.aggregate(inside, F.lit(0.0), lambda x, y: x + y).alias("_more"))
        open_ = summed.filter(F.size("_sums.rest") > 0).join(own, F.col(text) == F.col("_open"))
        open_ = open_.withColumn("_score", mean(F.col("_sums.total") + F.col("_more"))).drop("_sums", "_open", "_more")
        return summed.filter(F.size("_sums.rest") == 0).withColumn("_score", mean(F.col("_sums.total"))).drop("_sums").union(open_)

    def score(self, text: str) -> float:
        """The score of one address."""
        one = self.contexts.sparkSession.createDataFrame([(text,)], "text string")
        return self.scored(one, "text", self.steps(one)).first()._score


def threshold(scored: DataFrame) -> float | None:
    """Where accepted and rejected addresses of ``scored(score, label)`` part with the
    fewest errors, each class weighing the same; the middle of the gap, the lowest of
    several. None if one class is missing.

    Equal scores are one row; their running sums start anew in each bin of scores, from
    the sums of the bins before it.
    """
    of = lambda label: F.count_if(F.col("label") == label)
    rows = scored.groupBy("score").agg(of("accept").alias("a"), of("reject").alias("r"))
    rows = materialize(rows.withColumn("bin", F.floor(F.col("score") * BINS)), "kept_out")
    bins = sorted(tuple(x) for x in rows.groupBy("bin").agg(F.min("score"), F.sum("a"), F.sum("r")).collect())
    accepted, rejected = sum(x[2] for x in bins), sum(x[3] for x in bins)
    if not accepted or not rejected:
        return None
    before, a, r = [], 0, 0
    for (at, _, more_a, more_r), after in zip(bins, [*(x[1] for x in bins[1:]), None], strict=True):
        before.append((at, a, r, after))
        a, r = a + more_a, r + more_r
    starts = scored.sparkSession.createDataFrame(before, "bin long, a0 long, r0 long, after double")
    order = Window.partitionBy("bin").orderBy("score")
    passed = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost, caught = F.col("a0") + F.sum("a").over(passed), F.col("r0") + F.sum("r").over(passed)
    errors = lost.cast("decimal(38,0)") * rejected - caught.cast("decimal(38,0)") * accepted
    after = F.coalesce(F.lead("score").over(order), "after", F.col("score") + 2.0)
    least = rows.join(starts, "bin").select(F.struct(errors.alias("errors"), "score", after.alias("after")).alias("x")).agg(F.min("x").alias("x")).first().x
    # Nothing is better than letting all pass: below the lowest score.
    return (least.score + least.after) / 2 if least.errors < 0 else bins[0][1] - 1.0


def _labelled(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text, label) of ``pages(host, text)``: what is counted, and what is kept out."""
    spam = F.col("host").rlike("|".join(REJECT_TERMS))
    labelled = pages.filter(F.col("text") != "").select("text", F.when(spam, "reject").otherwise("accept").alias("label"))
    held_out = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(HELD_OUT)) == 0
    return labelled.filter(~held_out), labelled.filter(held_out)


def _calibrated(ratio: Ratio, kept_out: DataFrame, steps: DataFrame) -> float | None:
    found = threshold(ratio.scored(kept_out.distinct(), "text", steps).select(F.col("_score").alias("score"), "label"))
    if found is None and not ratio.contexts.filter("context = '' and total_a > 0 and total_r > 0").isEmpty():
        return 0.0
    return found


def _fitted(pages: DataFrame, order: int = ORDER) -> tuple[Ratio, float | None, DataFrame]:
    counted, kept_out = _labelled(pages)
    ratio = Ratio(materialize(count_contexts(counted, order), "contexts"), order)
    steps = ratio.steps(pages.select("text"))
    return ratio, _calibrated(ratio, kept_out, steps), steps


def fit(pages: DataFrame, order: int = ORDER) -> tuple[Ratio, float | None]:
    """Both models and the threshold, from ``pages(host, text)``."""
    return _fitted(pages, order)[:2]


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict."""
    pages, back = aside(pages, "_text", "_score", "_effect", "_sums", "_open", "_more")
    host, path = address_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path}).withColumn("_text", symbols(F.col("host"), F.col("path")))
    ratio, limit, steps = _fitted(parts.select("host", F.col("_text").alias("text")))

    name, effect = matching_rule(F.col("host"), F.col("path"), rules)
    judged = ratio.scored(parts, "_text", steps).withColumns({"score": F.col("_score"), "rule": name, "_effect": effect})
    rejected = F.lit(False) if limit is None else (F.col("_text") != "") & (F.col("score") < limit)
    verdict = F.coalesce("_effect", F.when(rejected, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("_text", "_effect", "_score").withColumnsRenamed(back)


def op1_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
