"""Every operator on awkward rows: nulls, empty and long texts, repeats, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import block_anchors, byte_bpe, decontaminate, language_id, license_scan, merkle, periodic_runs, pseudonyms, quality_rules, secret_scan, set_join, shard_tree, url_filter

LONG = " ".join(f"word{i % 997} the of and" for i in range(30_000))
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "one two", "fr"), (4, "one two", "fr"), (None, "one two", "en"),
    (None, None, None), (5, "ONE two", "de"), (6, LONG, "en"), (7, LONG + " tail", "en"), (8, "....", "en"),
]
COUNT = len(ROWS)
VOCABULARY = byte_bpe.Vocabulary.load(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
# Names that operators use for their results or inside.
CLASH = (
    "kept", "hash", "words", "n", "sid", "node", "g", "_words", "n_replaced", "component_id", "label", "score", "lines", "_found", "_new", "_assessed", "_p", "_text",
    "_score", "_effect", "_sums", "_ids", "_joined", "_coded", "_text_hash", "_id", "_hash", "_region", "_rack", "_part", "_n", "_order", "secrets", "spans",
)
# Operators that pass the columns of their input on, and the names that hold their results.
PASSING = {
    "quality": {"kept"}, "language": {"score"}, "pseudonyms": {"n_replaced"}, "tokens": set(), "addresses": {"score"}, "secrets": {"secrets"}, "shards": set(),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({name: F.lit("x") for name in CLASH})


def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "two one"), (4, "word1 the of and word2 the of and word3 the of and word4")], "item_id long, text string")


RUNS = {
    "quality": lambda d: quality_rules.measure(d),
    "sharding": lambda d: shard_tree.number_rows(shard_tree.assign(d.select("doc_id"), d.doc_id, shard_tree.layout(16))),
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "licenses": lambda d: license_scan.scan(d, license_scan.template_grams(d.sparkSession)),
    "duplicates": lambda d: set_join.group_duplicates(d),
    "repeats": lambda d: block_anchors.remove_repeats(d),
    "pseudonyms": lambda d: pseudonyms.pseudonymise(d),
    "tokens": lambda d: byte_bpe.digests(d, VOCABULARY),
    "addresses": lambda d: url_filter.judge(d, "text"),
    "secrets": lambda d: secret_scan.scan(d, secret_scan.fit(d)),
    "shards": lambda d: shard_tree.number_rows(shard_tree.assign(d, d.doc_id, shard_tree.layout(16))),
    "runs": lambda d: periodic_runs.periodic_runs(d),
    "proofs": lambda d: merkle.manifest(d.withColumns({c: F.lit(None).cast("string") for c in ("source", "n_chars")})),
}
FILTERS = {
    "quality": lambda d: quality_rules.keep_good(d),
    "duplicates": lambda d: set_join.keep_one(d),
    "leaks": lambda d: decontaminate.drop_leaks(d, benchmark(d.sparkSession)),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_one_answer_per_row(docs, clashing, name):
    assert RUNS[name](docs).count() == COUNT
    assert RUNS[name](clashing).count() == COUNT
    assert RUNS[name](docs.filter("false")).count() == 0


@pytest.mark.parametrize("name", list(PASSING))
def test_columns_of_the_input_pass_unchanged(clashing, name):
    result = RUNS[name](clashing)
    passed = [c for c in CLASH if c not in PASSING[name]]
    assert set(clashing.columns) <= set(result.columns) and len(set(result.columns)) == len(result.columns)
    assert result.select(passed).distinct().collect() == [("x",) * len(passed)]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_pipeline_stages_on_awkward_tables(spark, docs, clashing, place, stage):
    name, run = stage
    benchmark(spark).write.parquet(f"{place}/benchmark.parquet")
    for given in (docs, clashing, docs.filter("false"), docs.withColumn("text", F.lit(None).cast("string"))):
        given = given.withColumn("source", F.lit("web"))
        result = run(spark, given, place)
        assert name == "tokens" or result.columns == given.columns
        assert result.count() <= given.count()
        if name not in ("tokens", "personal_data") or given.isEmpty():
            continue
        assert result.count() == given.count()


@pytest.mark.parametrize("name", list(FILTERS))
def test_filters_keep_the_columns(docs, clashing, name):
    assert FILTERS[name](docs).columns == docs.columns
    kept = FILTERS[name](clashing)
    assert kept.columns == clashing.columns
    assert kept.count() <= COUNT
    assert FILTERS[name](docs.filter("false")).count() == 0


def test_filters_decide_on_rows(docs):
    assert {r.doc_id for r in FILTERS["quality"](docs).collect()} <= {6, 7}
    kept = sorted((r.doc_id or 0, r.text) for r in FILTERS["duplicates"](docs).filter("text like 'one%' or text like 'ONE%'").collect())
    assert kept == [(4, "one two")]
    assert {6, 7}.isdisjoint({r.doc_id for r in FILTERS["leaks"](docs).collect()})


def test_null_and_empty_texts(docs):
    by = lambda df, key="doc_id": {r[key]: r for r in df.collect()}
    bpe = by(RUNS["tokens"](docs))
    assert bpe[1].n_tokens == bpe[2].n_tokens == 0 and bpe[1].decoded_sha256 == bpe[2].decoded_sha256
    languages = by(RUNS["language"](docs))
    assert languages[1].lang_pred == languages[8].lang_pred == "und" and languages[4].lang_pred != "und"
    repeats = by(RUNS["repeats"](docs), "id")
    assert repeats[1].n_words == 0 and repeats[7].n_removed > 100_000 and repeats[6].n_removed == 0
    assert by(RUNS["pseudonyms"](docs))[1].text is None
    groups = by(RUNS["duplicates"](docs), "id")
    assert groups[1].kept and groups[2].kept and groups[1].component_id == 1 and groups[5].component_id == 4
