"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions of the same k-grams
in a table of templates. A hit votes for the diagonal ``text position - template
position``; votes are added up per text, template and diagonal, neighbouring diagonals
(a few words inserted or lost) are merged, and a merged span is a find when the template
words it covers, each confirmed by comparing words, reach ``MIN_COVERAGE`` of the template.

The template table is fixed and small (``template_grams`` refuses more than
``MAX_TEMPLATE_GRAMS`` rows), so it is broadcast; texts never move, only hits do.

Null and empty texts have no words and no finds (score 0). Repeated rows are matched by id
and text and each get the full answer; null ids are ids. Ties between templates are all
reported. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.native import table

K = 3
BAND = 3
MIN_COVERAGE = 0.8
MAX_TEMPLATE_GRAMS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand consecutively.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Words of well-known license notices, lower case, without punctuation.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    """Lower case in which no word gains an ASCII letter it did not have in either case:
    the two non-ASCII characters that lower to ASCII are put out of the way first."""
    odd = text.contains("\u0130") | text.contains("\u212a")
    return F.lower(F.when(odd, F.translate(text, "\u0130\u212a", "\u0131\u0138")).otherwise(text))


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(template, label, length, base, k, spot, gram words, hash) of every template k-gram."""
    rows = []
    for number, (label, text) in enumerate([*phrases, *templates]):
        parts = text.split()
        k = min(K, len(parts))
        for spot in range(len(parts) - k + 1):
            rows.append((number, label, len(parts), number < len(phrases), k, spot, parts[spot : spot + k]))
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(rows)} template k-grams; the broadcast table holds {MAX_TEMPLATE_GRAMS}")
    kind = "template int, label string, length int, base boolean, k int, spot int, gram array<string>"
    return spark.createDataFrame(rows, kind).withColumn("hash", _hash(lambda i: F.get("gram", F.lit(i)), F.col("k")))


def _hash(word, k: Column) -> Column:
    """Hash of ``k`` words; ``word(i)`` gives the i-th."""
    out = None
    for size in range(1, K + 1):
        value = F.xxhash64(F.lit(size), *[word(i) for i in range(size)])
        out = F.when(k == size, value) if out is None else out.when(k == size, value)
    return out


def find_spans(docs: DataFrame, grams: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Merged diagonals (id, text_hash, template, label, base, first, last, coverage)."""
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())
    words = F.regexp_extract_all(lowered(F.col(text)), F.lit(WORD), F.lit(0))
    at = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), words.alias("words"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i")).filter(F.size("words") > 0)
    here = lambda d: F.get("words", F.col("i") + d)
    hashes = F.array(*[F.xxhash64(F.lit(k), *[here(d) for d in range(k)]) for k in sizes])
    hits = at.select("id", "text_hash", "i", here(0).alias("w0"), here(1).alias("w1"), here(2).alias("w2"), F.explode(hashes).alias("hash"))
    hits = hits.join(F.broadcast(grams), "hash")
    same = (F.col("gram")[0] == F.col("w0")) & (F.coalesce(F.get("gram", F.lit(1)) == F.col("w1"), F.col("k") < 2)) & (F.coalesce(F.get("gram", F.lit(2)) == F.col("w2"), F.col("k") < 3))
    hits = hits.filter(same)

    kind = ["id", "text_hash", "template", "label", "base", "length", "k"]
    votes = hits.groupBy(*kind, (F.col("i") - F.col("spot")).alias("diagonal")).agg(F.collect_set("spot").alias("spots"), F.min("i").alias("first"), F.max("i").alias("last"))
    # A phrase stands in one place only; a template may slip by a few words.
    order = Window.partitionBy(*kind).orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= BAND) & (F.col("first") - F.lag("last").over(order) <= F.col("length"))
    votes = votes.withColumn("begins", F.when(near & ~F.col("base"), 0).otherwise(1))
    votes = votes.withColumn("cluster", F.sum("begins").over(order))
    merged = votes.groupBy(*kind, "cluster").agg(F.flatten(F.collect_list("spots")).alias("spots"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s, s + F.col("k") - 1)))))
    return merged.withColumn("coverage", covered / F.col("length"))


def scan(docs: DataFrame, grams: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs``: word count, phrase places, labels and score."""
    spans = find_spans(docs, grams, id_column, text)
    base, found = F.col("base") & (F.col("coverage") == 1), F.col("coverage") >= least
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    finds = spans.groupBy("id", "text_hash").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(found).alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = F.regexp_count(lowered(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD)).cast("long")
    thin = docs.select(F.col(id_column), counted.alias("n_words"), F.xxhash64(text).alias("_hash"))
    both = thin.join(finds, thin[id_column].eqNullSafe(finds["id"]) & (thin["_hash"] == finds["text_hash"]), "left")
    blank = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return both.select(id_column, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", blank("base_labels", ""), blank("labels", ""), blank("score", 0.0))


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), template_grams(spark))
