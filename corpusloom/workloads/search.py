"""Ranking, retrieval and evaluation over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import evaluation, lexical, lookup, ranking, vector, vector_index
from corpusloom.operators.excerpts import verify_evidence
from corpusloom.plans import search as plan
from corpusloom.session import shared_folder
from corpusloom.workloads import sql as q
from corpusloom.workloads.tables import aliased_notes, benchmark_queries, micro, notes, table


def _rounded(df, *keys):
    return df.select(*keys, F.col("rank").cast("long").alias("rank"), micro("score").alias("score"))


def bm25_topk(spark, folder):
    scores = lexical.lexical_search(benchmark_queries(spark, folder), notes(spark, folder))
    return _rounded(ranking.top_k(scores, 8), "query_id", "uri")


BM25_TOPK = f"WITH {q.bm25()}, {q.ranked('scores', 8)} SELECT query_id, uri, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ranked"


def field_weighted_bm25(spark, folder):
    scores = lexical.lexical_search(benchmark_queries(spark, folder), aliased_notes(spark, folder), lexical.FIELD_WEIGHTS)
    return _rounded(ranking.top_k(scores, 8), "query_id", "uri")


_ALIAS = "lang || ' ' || source || ' notes'"
FIELD_WEIGHTED_BM25 = (
    f"WITH {q.bm25({'title': 2.0, 'body': 1.0, 'aliases': 0.5}, aliases=_ALIAS)}, "
    f"{q.ranked('scores', 8)} SELECT query_id, uri, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ranked"
)


def term_stats(spark, folder):
    posts = lexical.postings(lexical.note_terms(aliased_notes(spark, folder)))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


TERM_STATS = f"WITH {q.bm25(None, aliases=_ALIAS)} SELECT term, count(*) AS df, sum(tf) AS total_tf FROM postings GROUP BY term"


def corpus_stats(spark, folder):
    s = lexical.corpus_stats(lexical.note_lengths(aliased_notes(spark, folder)))
    return s.select("n_notes", "total_len", micro("avg_len").alias("avg_len"))


CORPUS_STATS = f"WITH {q.bm25(None, aliases=_ALIAS)} SELECT (SELECT count(*) FROM notes) AS n_notes, sum(doc_len) AS total_len, CAST(round(any_value(mean) * 1e6) AS BIGINT) / 1e6 AS avg_len FROM lengths, facts"


def layer_counts(spark, folder):
    chosen = plan.known_layers(["project", "candidate", "elsewhere"])
    return notes(spark, folder).where(F.col("layer").isin(*chosen)).groupBy("layer").agg(F.count(F.lit(1)).alias("notes"))


LAYER_COUNTS = f"WITH {q.NOTES} SELECT layer, count(*) AS notes FROM notes WHERE layer IN ('project', 'candidate') GROUP BY layer"


def _topics(spark, folder):
    n = notes(spark, folder)
    return n.select("uri", F.explode("topics").alias("topic"))


def _wanted(spark, folder):
    item = F.col("item_id")
    return table(spark, folder, "benchmark").select(item.alias("query_id"), F.concat(F.lit("src"), item % 20).alias("topic"))


def topic_only(spark, folder):
    scores = lexical.lexical_search(benchmark_queries(spark, folder), notes(spark, folder))
    kept = ranking.only_topics(scores, _topics(spark, folder), _wanted(spark, folder))
    return _rounded(ranking.top_k(kept, 8), "query_id", "uri")


TOPIC_ONLY = f"""WITH {q.bm25()}, kept AS (SELECT s.* FROM scores s JOIN notes n USING (uri) WHERE n.source = 'src' || query_id % 20),
{q.ranked('kept', 8)} SELECT query_id, uri, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ranked"""


def topic_prefer(spark, folder):
    scores = lexical.lexical_search(benchmark_queries(spark, folder), notes(spark, folder))
    boosted = ranking.boost_preferred(scores, _topics(spark, folder), _wanted(spark, folder))
    return _rounded(ranking.top_k(boosted, 8), "query_id", "uri")


TOPIC_PREFER = f"""WITH {q.bm25()}, kept AS (SELECT query_id, uri, score * CASE WHEN n.source = 'src' || query_id % 20 THEN 1.25 ELSE 1.0 END AS score
  FROM scores s JOIN notes n USING (uri)),
{q.ranked('kept', 8)} SELECT query_id, uri, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ranked"""


def lookup_refs(spark, folder):
    d = F.concat(F.lit("doc-"), F.col("doc_id"))
    ref = (
        F.when(F.col("toxic") == 1, F.concat(F.lit("absent-"), d))
        .when(F.col("quality") == 0, F.concat(F.lit(" "), d, F.lit(".md ")))
        .otherwise(d)
    )
    found = lookup.explain(table(spark, folder, "labels").select(ref.alias("ref")), notes(spark, folder))
    return found.select("ref", "found", "uri", "layer")


LOOKUP_REFS = f"""WITH {q.NOTES}, refs AS (SELECT DISTINCT CASE WHEN toxic = 1 THEN 'absent-doc-' || doc_id WHEN quality = 0 THEN 'doc-' || doc_id || '.md' ELSE 'doc-' || doc_id END AS ref FROM labels)
SELECT ref, uri IS NOT NULL AS found, uri, layer FROM refs LEFT JOIN notes ON ref IN ('doc-' || doc_id, 'doc-' || doc_id || '.md')"""


def title_matches(spark, folder):
    n = notes(spark, folder)
    found = lookup.title_matches(n.select("layer", "title"), n)
    return found.select("layer", F.sha2("title", 256).alias("title_sha256"), "path", F.col("rank").cast("long").alias("rank"), "incomplete")


TITLE_MATCHES = f"""WITH {q.NOTES}, r AS (SELECT layer, title, path, row_number() OVER w AS rank, count(*) OVER (PARTITION BY layer, title) > 8 AS incomplete
  FROM notes WINDOW w AS (PARTITION BY layer, title ORDER BY path))
SELECT layer, sha256(title) AS title_sha256, path, rank, incomplete FROM r WHERE rank <= 8"""


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("vec-"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("uri"), F.col("embedding").alias("vector"), "label"
    )


def _label_queries(spark, folder):
    v = _vectors(spark, folder)
    return vector.centroids(v, "label").select(F.col("label").cast("long").alias("query_id"), "vector")


def vector_topk(spark, folder):
    return _rounded(vector.vector_topk(_label_queries(spark, folder), _vectors(spark, folder), 16), "query_id", "uri")


def vector_index_topk(spark, folder):
    """The same answers from stored tiles, of which only those that can matter are read."""
    place = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build_index(_vectors(spark, folder).select("uri", "vector"), place, 500)
    found = vector_index.indexed_topk(vector_index.open_index(spark, place), _label_queries(spark, folder), 16)
    return _rounded(found, "query_id", "uri")


_CENTROIDS = """vecs AS (SELECT 'vec-' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS uri, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
flat AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM vecs),
centers AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM flat GROUP BY ALL) GROUP BY label),
nearness AS (SELECT query_id, uri, list_dot_product(c, v) / sqrt(list_dot_product(c, c) * list_dot_product(v, v)) AS score FROM centers, vecs)"""
VECTOR_TOPK = f"WITH {_CENTROIDS}, {q.ranked('nearness', 16)} SELECT query_id, uri, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ranked"


def vector_audit(spark, folder):
    v = table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")
    return vector.audit_vectors(v, ["vec_id"], 64)


VECTOR_AUDIT = """SELECT count(*) AS records, count(DISTINCT vec_id) AS keys, CAST(count(*) - count(DISTINCT vec_id) AS BIGINT) AS repeated_keys,
  CAST(sum(CAST(len(embedding) <> 64 AS INT)) AS BIGINT) AS wrong_dimension,
  CAST(sum(CAST(len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 AS INT)) AS BIGINT) AS not_finite FROM embeddings"""


def vector_differences(spark, folder):
    """Release vectors against an index that lost one label and perturbed another."""
    v = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    index = v.where("label <> 1").withColumn(
        "vector", F.when(F.col("label") == 2, F.transform("vector", lambda x: x + F.lit(0.5).cast("float"))).otherwise(F.col("vector"))
    )
    return vector.compare_vectors(v, index, ["vec_id"])


VECTOR_DIFFERENCES = "SELECT vec_id, CASE label WHEN 1 THEN 'missing' ELSE 'value_differs' END AS reason FROM embeddings WHERE label IN (1, 2)"


def index_freshness(spark, folder):
    """Ledger state by language: es never indexed, de edited since, fr indexed by another model;
    vectors of some sources are gone, and ledger rows of two roots have no note."""
    n = notes(spark, folder).select("uri", "path", "root", F.sha2("raw", 256).alias("file_sha256"), F.get("topics", F.lit(0)).alias("lang"), F.get("topics", F.lit(1)).alias("source"))
    held = n.where("lang <> 'es'").select(
        "uri", "path", "root",
        F.when(F.col("lang") == "de", F.sha2(F.col("uri"), 256)).otherwise(F.col("file_sha256")).alias("sha256"),
        F.when(F.col("lang") == "fr", F.lit("model-1")).otherwise(F.lit("model-2")).alias("model"),
    )
    gone = n.where("lang = 'de'").select(
        F.concat("uri", F.lit(".old")).alias("uri"), "path", F.when(F.col("source") == "src1", F.lit("/unreadable")).otherwise(F.col("root")).alias("root"),
        F.col("file_sha256").alias("sha256"), F.lit("model-2").alias("model"),
    )
    vectors = n.where("source <> 'src5'").select("uri")
    readable = n.select("root").distinct()
    return vector.index_freshness(n, held.unionByName(gone), vectors, "model-2", readable)


INDEX_FRESHNESS = f"""WITH {q.NOTES} SELECT uri, CASE WHEN lang IN ('es', 'de', 'fr') THEN 'upsert' WHEN source = 'src5' THEN 'repair' ELSE 'unchanged' END AS action FROM notes
UNION ALL SELECT uri || '.old', CASE WHEN source = 'src1' THEN 'unknown' ELSE 'delete' END FROM notes WHERE lang = 'de'"""


def hybrid_search(spark, folder):
    """Lexical hits fused with the vector route of the query's label centroid. Notes and
    vectors share an identity by number."""
    n = notes(spark, folder)
    queries = benchmark_queries(spark, folder)
    lexical_hits = ranking.top_k(lexical.lexical_search(queries, n), 32)
    vectors = table(spark, folder, "embeddings").join(n.select("doc_id", "uri"), F.col("vec_id") == F.col("doc_id")).select("uri", F.col("embedding").alias("vector"))
    near = vector.vector_topk(_label_queries(spark, folder), vectors, 32).withColumnRenamed("query_id", "label")
    mine = queries.select("query_id", F.pmod("query_id", F.lit(4)).alias("label"))
    route = mine.join(near, "label").select("query_id", "uri", F.col("rank").alias("position"), "score")
    fused = ranking.fuse(ranking.first_occurrences(route), lexical_hits)
    return _rounded(ranking.top_k(fused.withColumn("methods", F.array_join("methods", "+")), 8), "query_id", "uri", "methods")


HYBRID_SEARCH = f"""WITH {q.bm25()}, {q.ranked('scores', 32, 'lex')},
nvecs AS (SELECT uri, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN notes ON vec_id = doc_id),
flat AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
centers AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM flat GROUP BY ALL) GROUP BY label),
nearness AS (SELECT label AS query_id, uri, list_dot_product(c, v) / sqrt(list_dot_product(c, c) * list_dot_product(v, v)) AS score FROM centers, nvecs),
{q.ranked('nearness', 32, 'near')},
vec AS (SELECT b.item_id AS query_id, uri, rank FROM benchmark b JOIN near n ON n.query_id = b.item_id % 4),
best AS (SELECT query_id, max(score) AS top FROM lex GROUP BY query_id),
fused AS (
  SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.uri, l.uri) AS uri,
         CASE WHEN l.uri IS NULL THEN 'vector' WHEN v.uri IS NULL THEN 'lexical' ELSE 'vector+lexical' END AS methods,
         greatest(coalesce(1.0 / (60 + v.rank), 0), coalesce(1.0 / (60 + l.rank), 0))
           + CASE WHEN v.uri IS NOT NULL AND l.uri IS NOT NULL THEN least(1.0 / (60 + v.rank), 1.0 / (60 + l.rank)) * l.score / top ELSE 0 END AS score
  FROM vec v FULL JOIN lex l ON v.query_id = l.query_id AND v.uri = l.uri LEFT JOIN best b ON b.query_id = l.query_id
), {q.ranked('fused', 8)}
SELECT query_id, uri, methods, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ranked"""


def _event_routes(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("event_type").alias("query_id"), F.concat(F.lit("user-"), "user_id").alias("uri"), "value", "event_id"
    )
    first = e.select("query_id", "uri", F.col("event_id").alias("position"), F.col("value").alias("score"))
    strong = e.groupBy("query_id", "uri").agg(F.sum("value").alias("score"))
    return first, strong


def first_occurrences(spark, folder):
    """Events in arrival order as a route with very many repeats per user."""
    first, _ = _event_routes(spark, folder)
    r = ranking.first_occurrences(first)
    return r.select("query_id", "uri", F.col("rank").cast("long").alias("rank"), micro("score").alias("score"))


_FIRST = "SELECT event_type AS query_id, 'user-' || user_id AS uri, min(event_id) AS pos, arg_min(value, event_id) AS score FROM events GROUP BY ALL"
_ROUTE = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM ({_FIRST})"
FIRST_OCCURRENCES = f"SELECT query_id, uri, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ({_ROUTE})"


def rank_fusion(spark, folder):
    first, strong = _event_routes(spark, folder)
    fused = ranking.fuse(ranking.first_occurrences(first), ranking.ranked(strong))
    return _rounded(ranking.top_k(fused, 50), "query_id", "uri")


RANK_FUSION = f"""WITH vec AS (SELECT query_id, uri, rank FROM ({_ROUTE})),
sums AS (SELECT event_type AS query_id, 'user-' || user_id AS uri, sum(value) AS score FROM events GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uri) AS rank FROM sums), best AS (SELECT query_id, max(score) FILTER (score > 0) AS top FROM lex GROUP BY query_id),
fused AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.uri, l.uri) AS uri,
  greatest(coalesce(1.0 / (60 + v.rank), 0), coalesce(1.0 / (60 + l.rank), 0))
  + CASE WHEN v.uri IS NOT NULL AND score > 0 THEN least(1.0 / (60 + v.rank), 1.0 / (60 + l.rank)) * score / top ELSE 0 END AS score
  FROM vec v FULL JOIN lex l ON v.query_id = l.query_id AND v.uri = l.uri LEFT JOIN best b ON b.query_id = l.query_id), {q.ranked('fused', 50)}
SELECT query_id, uri, rank, CAST(round(score * 1e6) AS BIGINT) / 1e6 AS score FROM ranked"""


def search_results(spark, folder):
    """The whole query path; every quoted span is checked against its source."""
    n = notes(spark, folder)
    queries = benchmark_queries(spark, folder)
    results = plan.search(queries, n, limit=8)
    valid = verify_evidence(results, n)
    per_query = (
        results.select("query_id", "uri", "rank", F.length("excerpt").alias("n"))
        .join(valid, ["query_id", "uri"])
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.sum(F.col("valid").cast("long")).alias("valid_results"),
            (F.sum("n") <= plan.DEFAULT_QUERY_CHARS).alias("within_budget"),
            (F.max("n") <= 600).alias("within_result_budget"),
        )
    )
    return per_query


SEARCH_RESULTS = f"""WITH {q.bm25()}, {q.ranked('scores', 8)}
SELECT query_id, count(*) AS results, count(*) AS valid_results, true AS within_budget, true AS within_result_budget FROM ranked GROUP BY query_id"""


def search_hits(spark, folder):
    n = notes(spark, folder)
    asked = plan.read_directives(benchmark_queries(spark, folder))
    return _rounded(ranking.top_k(plan.lexical_route(asked, n, 32), 8), "query_id", "uri")


def _released(spark, folder):
    """Notes of which the shared English ones came with releases, one per source."""
    n = notes(spark, folder)
    imported = (F.col("layer") == "shared") & (F.get("topics", F.lit(0)) == "en")
    place = F.concat(F.lit("note://resources/shared/"), F.get("topics", F.lit(1)), F.lit("/"), "doc_id", F.lit(".md"))
    return n.withColumns({"uri": F.when(imported, place).otherwise(F.col("uri")), "root": F.when(imported, F.lit("")).otherwise(F.col("root"))})


def _pointer(spark, folder):
    return table(spark, folder, "documents").agg(F.concat(F.lit("note://resources/shared/"), F.max("source")).alias("root_uri"))


def active_notes(spark, folder):
    return plan.active_release(_released(spark, folder), _pointer(spark, folder)).select("uri", "layer")


_RELEASED = f"""{q.NOTES}, released AS (SELECT doc_id, layer, layer = 'shared' AND lang = 'en' AS imported,
  CASE WHEN layer = 'shared' AND lang = 'en' THEN 'note://resources/shared/' || source || '/' || doc_id || '.md' ELSE uri END AS uri FROM notes),
pointer AS (SELECT 'note://resources/shared/' || max(source) || '/' AS prefix FROM documents)"""
ACTIVE_NOTES = f"WITH {_RELEASED} SELECT uri, layer FROM released, pointer WHERE NOT imported OR starts_with(uri, prefix)"


def valid_hits(spark, folder):
    """A hit for every vector: on the note of its number, a deleted note, or a file of a release."""
    n = _released(spark, folder)
    prefix = _pointer(spark, folder).first()["root_uri"] + "/"
    v = table(spark, folder, "embeddings").select("vec_id", "label").join(n.select(F.col("doc_id").alias("vec_id"), "uri"), "vec_id", "left")
    gone = F.concat(F.lit("note://resources/project/gone-"), "vec_id", F.lit(".md"))
    off = F.concat(F.lit("note://resources/shared/src"), F.col("vec_id") % 20, F.lit("/off-"), "vec_id", F.lit(".md"))
    uri = F.when(F.col("vec_id") % 3 == 0, off).when(F.col("vec_id") % 3 == 1, gone).otherwise(F.coalesce("uri", gone))
    hits = v.select(F.col("label").cast("long").alias("query_id"), uri.alias("uri"))
    return plan.valid_hits(hits, n, ["project", "shared"], prefix).select("query_id", "uri")


VALID_HITS = f"""WITH {_RELEASED}, hits AS (SELECT CAST(label AS BIGINT) AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'note://resources/shared/src' || vec_id % 20 || '/off-' || vec_id || '.md'
    WHEN vec_id % 3 = 1 OR r.uri IS NULL THEN 'note://resources/project/gone-' || vec_id || '.md' ELSE r.uri END AS uri FROM embeddings LEFT JOIN released r ON vec_id = doc_id)
SELECT query_id, h.uri FROM hits h LEFT JOIN released r ON r.uri = h.uri, pointer
WHERE starts_with(h.uri, prefix) OR r.layer = 'project' OR (r.layer = 'shared' AND NOT r.imported)"""


def _cases(spark, folder):
    """Sources as cases: their notes by length as results, document labels as relevance."""
    d = table(spark, folder, "documents").select("doc_id", "source", "n_chars", "lang")
    results = ranking.top_k(
        d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("uri"), F.col("n_chars").cast("double").alias("score")), 20
    ).select(F.col("query_id").alias("case_id"), "uri", "rank")
    labels = table(spark, folder, "labels")
    qrels = labels.join(d, "doc_id").select(
        F.col("source").alias("case_id"), F.col("doc_id").alias("uri"), (F.col("quality") * 2 + (1 - F.col("toxic"))).cast("double").alias("grade")
    )
    return d, results, qrels


_CASES = """results AS (SELECT * FROM (SELECT source AS case_id, doc_id AS uri, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 8),
qrels AS (SELECT source AS case_id, doc_id AS uri, quality * 2 + (1 - toxic) AS grade FROM labels JOIN documents USING (doc_id)),
positive AS (SELECT * FROM qrels WHERE grade > 0),
found AS (SELECT case_id, count(*) AS hits, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM results JOIN positive USING (case_id, uri) GROUP BY case_id),
ideal AS (SELECT case_id, count(*) AS labels, sum(CASE WHEN pos <= 8 THEN (2 ** grade - 1) / log2(pos + 1) END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, uri) AS pos FROM positive) GROUP BY case_id),
metrics AS (SELECT case_id, labels, coalesce(hits / labels, 0) AS recall, coalesce(1.0 / first, 0) AS mrr, coalesce(dcg / idcg, 0) AS ndcg FROM ideal LEFT JOIN found USING (case_id))"""


def case_metrics(spark, folder):
    _, results, qrels = _cases(spark, folder)
    m = evaluation.case_metrics(results, qrels, 8)
    return m.select("case_id", "labels", *[micro(c).alias(c) for c in ("recall", "mrr", "ndcg")])


CASE_METRICS = f"WITH {_CASES} SELECT case_id, labels, CAST(round(recall * 1e6) AS BIGINT) / 1e6 AS recall, CAST(round(mrr * 1e6) AS BIGINT) / 1e6 AS mrr, CAST(round(ndcg * 1e6) AS BIGINT) / 1e6 AS ndcg FROM metrics"


def evaluation_summary(spark, folder):
    d, results, qrels = _cases(spark, folder)
    cases = d.groupBy(F.col("source").alias("case_id")).agg(
        F.min("lang").alias("category"), (F.min("n_chars") < 0).alias("no_evidence"), (F.max("n_chars") > 10_000).alias("incomplete"),
        F.avg("n_chars").alias("elapsed_ms"), F.sum("n_chars").alias("output_bytes"),
    )
    hits = results.where("rank <= 8").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_hits"))
    labelled = evaluation.label_cases(cases, evaluation.case_metrics(results, qrels, 8), hits)
    n = F.col("n_chars")
    checked = results.where("rank <= 8").join(d.select(F.col("doc_id").alias("uri"), "n_chars"), "uri")
    evidence = checked.select("case_id", F.when(n % 7 != 0, n % 5 != 0).alias("valid"))
    s = evaluation.summarize(labelled, evidence)
    return s.select(
        F.coalesce("category", F.lit("(all)")).alias("category"), "queries", "scored_queries", "unlabelled_queries", "incomplete_queries", "output_bytes",
        "evidence_checked", "evidence_unknown", *[micro(c).alias(c) for c in ("recall", "mrr", "ndcg", "max_ms", "p50_ms", "p95_ms", "evidence_accuracy")],
    )


_MICRO = "CAST(round({0} * 1e6) AS BIGINT) / 1e6"
EVALUATION_SUMMARY = f"""WITH {_CASES}, cases AS (SELECT source AS case_id, min(lang) AS category, max(n_chars) > 10000 AS incomplete, avg(n_chars) AS ms, sum(n_chars) AS bytes FROM documents GROUP BY source),
seen AS (SELECT case_id, sum(CASE WHEN n_chars % 7 <> 0 THEN 1 ELSE 0 END) AS checked, sum(CASE WHEN n_chars % 7 <> 0 AND n_chars % 5 <> 0 THEN 1 ELSE 0 END) AS proven,
  sum(CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END) AS unknown FROM results JOIN documents ON uri = doc_id GROUP BY case_id),
j AS (SELECT c.*, m.labels, m.recall, m.mrr, m.ndcg, checked, proven, unknown FROM cases c LEFT JOIN metrics m USING (case_id) LEFT JOIN seen USING (case_id)),
both_ AS (SELECT *, category AS part FROM j UNION ALL SELECT *, '(all)' FROM j),
timed AS (SELECT part, ms, row_number() OVER (PARTITION BY part ORDER BY ms) AS pos, count(*) OVER (PARTITION BY part) AS n FROM both_),
ranks AS (SELECT part, min(ms) FILTER (pos >= ceil(n * 0.5)) AS p50, min(ms) FILTER (pos >= ceil(n * 0.95)) AS p95 FROM timed GROUP BY part),
s AS (SELECT part AS category, count(*) AS queries, count(labels) AS scored_queries, count(*) - count(labels) AS unlabelled_queries,
  CAST(sum(CAST(incomplete AS INT)) AS BIGINT) AS incomplete_queries, CAST(sum(bytes) AS BIGINT) AS output_bytes,
  CAST(coalesce(sum(checked), 0) AS BIGINT) AS evidence_checked, CAST(coalesce(sum(unknown), 0) AS BIGINT) AS evidence_unknown,
  {', '.join(f"{_MICRO.format(f'avg({c})')} AS {c}" for c in ('recall', 'mrr', 'ndcg'))}, {_MICRO.format('max(ms)')} AS max_ms,
  {_MICRO.format('sum(proven) / sum(checked)')} AS evidence_accuracy FROM both_ GROUP BY part)
SELECT s.*, {_MICRO.format('p50')} AS p50_ms, {_MICRO.format('p95')} AS p95_ms FROM s JOIN ranks ON part = category"""


def nearest_rank(spark, folder):
    return evaluation.nearest_rank(table(spark, folder, "events"), "event_type", "value", [0.5, 0.95, 1.0])


NEAREST_RANK = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT unnest([0.5, 0.95, 1.0]) AS quantile)
SELECT event_type, CAST(quantile AS DOUBLE) AS quantile, value FROM r, q WHERE pos = greatest(1, CAST(ceil(n * quantile) AS BIGINT))"""


def context_coverage(spark, folder):
    """Do the notes of a source mention its own name, its language or a rare word?"""
    n = notes(spark, folder)
    results = n.select(F.get("topics", F.lit(1)).alias("case_id"), F.col("body").alias("excerpt"), "conditions")
    words = F.array(F.lit("LANGUAGE"), F.lit("token ="), F.lit("never said"))
    expected = results.select("case_id").distinct().select("case_id", F.explode(words).alias("term"))
    return evaluation.context_coverage(expected, results)


CONTEXT_COVERAGE = f"""WITH {q.NOTES}, t AS (SELECT unnest(['LANGUAGE', 'token =', 'never said']) AS term)
SELECT source AS case_id, term, bool_or(contains({q.fold("body || '{\"language\":\"' || lang || '\"}'")}, lower(term))) AS covered FROM notes, t GROUP BY ALL"""


QUERIES = {
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "field_weighted_bm25": (field_weighted_bm25, FIELD_WEIGHTED_BM25),
    "term_stats": (term_stats, TERM_STATS),
    "corpus_stats": (corpus_stats, CORPUS_STATS),
    "layer_counts": (layer_counts, LAYER_COUNTS),
    "topic_only": (topic_only, TOPIC_ONLY),
    "topic_prefer": (topic_prefer, TOPIC_PREFER),
    "lookup_refs": (lookup_refs, LOOKUP_REFS),
    "title_matches": (title_matches, TITLE_MATCHES),
    "vector_topk": (vector_topk, VECTOR_TOPK),
    "vector_index_topk": (vector_index_topk, VECTOR_TOPK),
    "vector_audit": (vector_audit, VECTOR_AUDIT),
    "vector_differences": (vector_differences, VECTOR_DIFFERENCES),
    "index_freshness": (index_freshness, INDEX_FRESHNESS),
    "hybrid_search": (hybrid_search, HYBRID_SEARCH),
    "first_occurrences": (first_occurrences, FIRST_OCCURRENCES),
    "rank_fusion": (rank_fusion, RANK_FUSION),
    "search_hits": (search_hits, BM25_TOPK),
    "search_results": (search_results, SEARCH_RESULTS),
    "active_notes": (active_notes, ACTIVE_NOTES),
    "valid_hits": (valid_hits, VALID_HITS),
    "case_metrics": (case_metrics, CASE_METRICS),
    "evaluation_summary": (evaluation_summary, EVALUATION_SUMMARY),
    "nearest_rank": (nearest_rank, NEAREST_RANK),
    "context_coverage": (context_coverage, CONTEXT_COVERAGE),
}
