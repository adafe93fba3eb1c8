"""Language identification in two steps.

A linear support vector machine per family (one against the rest) predicts the language
family of a text; inside the family, one linear machine per pair of languages votes. All
machines read counts of hashed character 1- to 3-grams of the whole text.

The machines are fitted on a bounded sample of labelled documents (``MAX_SAMPLE``
altogether, shared evenly by the languages); prediction runs where the text is.

Null text, and text without a letter, is ``und`` with score 0; so is everything if nothing
could be learned. Ties go to the language that sorts first. Repeated rows get equal
answers and count once in the sample. Extra columns are ignored by the query.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.native import aside, table

# Closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "tr", "uz"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

UNKNOWN = "und"
MAX_SAMPLE = 2_000
BITS = 12
CHUNK = 1 << 20
HAS_LETTER = r"\p{L}"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the lower-cased text, scaled to length one.

    Everything that is not a letter is a blank. Long texts are counted in chunks that
    overlap by two characters, so memory does not grow with the text.
    """
    counts = np.zeros(1 << BITS, np.float64)
    for start in range(0, max(len(text), 1), CHUNK):
        head = min(start, 2)
        codes = np.frombuffer(text[start - head : start + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(_is_letter()[codes], codes, 32).astype(np.uint64)
        gram = np.zeros(len(codes), np.uint64)
        for size in (1, 2, 3):
            gram = gram[: len(codes) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :] + np.uint64(size)
            mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            fresh = mixed[max(0, head - size + 1) :]
            counts += np.bincount((fresh >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    norm = np.sqrt(counts @ counts)
    return (counts / norm if norm else counts).astype(np.float32)


def fit_machine(x: np.ndarray, positive: np.ndarray, epochs: int = 40, batch: int = 64, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Averaged stochastic subgradient descent on the hinge loss, classes weighing the same."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)) * len(y)
    w, mean, bias, mean_bias, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0
    random = np.random.default_rng(7)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            step += 1
            rate = 1.0 / (decay * (step + 1.0 / decay / 8))
            push = (share[rows] * y[rows] * (y[rows] * (x[rows] @ w + bias) < 1)).astype(np.float32)
            w = (1 - rate * decay) * w + (rate / len(rows)) * (push @ x[rows])
            bias += 0.1 * rate * float(push.mean())
            mean += (w - mean) / step
            mean_bias += (bias - mean_bias) / step
    return mean, mean_bias


class Identifier:
    """Family machines and, per family, one machine for each pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.family = {lang: FAMILY_OF.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(self.family.values()))
        own = np.array([self.family[lang] for lang in langs])
        told = np.array(langs)
        self.machines: list[tuple[str, str]] = []
        fitted = []
        if len(self.families) > 1:
            for family in self.families:
                self.machines.append(("family", family))
                fitted.append(fit_machine(x, own == family))
        for family in self.families:
            for a, b in itertools.combinations([lang for lang in self.langs if self.family[lang] == family], 2):
                rows = (told == a) | (told == b)
                self.machines.append((a, b))
                fitted.append(fit_machine(x[rows], told[rows] == a))
        self.weights = np.array([w for w, _ in fitted], np.float32).reshape(len(fitted), x.shape[1])
        self.biases = np.array([b for _, b in fitted], np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        margins = dict(zip(self.machines, self.weights @ features(text) + self.biases, strict=True)) if self.machines else {}
        sure = lambda m: 1.0 / (1.0 + np.exp(-4.0 * float(np.clip(m, -20, 20))))
        score = 1.0
        family = self.families[0]
        if len(self.families) > 1:
            family = max(self.families, key=lambda f: margins[("family", f)])
            score = sure(margins[("family", family)])
        rivals = [lang for lang in self.langs if self.family[lang] == family]
        wins = dict.fromkeys(rivals, 0.0)
        for a, b in itertools.combinations(rivals, 2):
            p = sure(margins[(a, b)])
            wins[a] += (p > 0.5) + p / len(self.langs)
            wins[b] += (p <= 0.5) + (1 - p) / len(self.langs)
        best = max(rivals, key=lambda lang: wins[lang])
        pairs = [sure(margins[(best, r)]) if (best, r) in margins else 1 - sure(margins[(r, best)]) for r in rivals if r != best]
        return best, float(min([score, *pairs]))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", size: int = MAX_SAMPLE) -> Identifier | None:
    """Fit on at most ``size`` labelled documents, the same number for each language."""
    spark = docs.sparkSession
    known = docs.filter(~held_out(F.col(id_column)) & F.col(lang).isNotNull() & F.col(text).rlike(HAS_LETTER))
    known = known.select(F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    languages = known.select("lang").distinct().count()
    if not languages:
        return None
    each = max(2, size // languages)
    order = Window.partitionBy("lang").orderBy(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), "hash")
    chosen = known.groupBy("id", "lang", "hash").agg(F.lit(1).alias("one")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each)
    kept = spark.createDataFrame([(r.id, r.hash, r.lang) for r in chosen.collect()], "id long, hash long, lang string")

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())

    same = known["id"].eqNullSafe(kept["id"]) & (known["hash"] == kept["hash"]) & (known["lang"] == kept["lang"])
    found = known.join(F.broadcast(kept), same).select(known["id"], known["hash"], known["lang"], "text")
    # Copies of a chosen row would make the sample larger than its bound.
    found = found.dropDuplicates(["id", "hash", "lang"]).select("id", "hash", "lang", vector("text").alias("v"))
    rows = sorted(found.collect(), key=lambda r: (r.lang, r.id is None, r.id or 0, r.hash))
    return Identifier(np.stack([np.frombuffer(r.v, np.float32) for r in rows]), [r.lang for r in rows])


def identify(docs: DataFrame, model: Identifier | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            rows = [(UNKNOWN, 0.0) if t is None else own.predict(t) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    docs, back = aside(docs, "_p")
    readable = F.when(F.col(text).rlike(HAS_LETTER), F.col(text))
    return docs.withColumn("_p", predict(readable)).withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p").withColumnsRenamed(back)


def op4_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    answers = identify(docs.select("doc_id", "text"), fit(docs))
    return answers.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
