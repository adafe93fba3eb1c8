"""No answer changes with the number of rows: what once was cut is whole."""

from pyspark.sql import functions as F

from corpusloom.operators import lexical, ranking, redact, relations, snapshots
from corpusloom.operators.vector import vector_topk

NOTE = "uri string, path string, raw string, source map<string,string>"


def test_every_owner_of_an_address_gets_an_edge(spark):
    owners = [(f"note://resources/project/o{i}.md", f"/c/o{i}.md", "x", {"url": "https://shared.example/page"}) for i in range(65)]
    notes = spark.createDataFrame([("note://resources/project/a.md", "/c/a.md", "[see](https://shared.example/page)", None), *owners], NOTE)
    edges, _ = relations.build_edges(notes)
    rows = edges.where("source like '%/a.md'").collect()
    assert len(rows) == 65 and {r.status for r in rows} == {"ambiguous"} and len({r.target for r in rows}) == 65


def test_the_first_of_two_anchors_in_a_line_stays(spark):
    notes = spark.createDataFrame([("note://resources/project/a.md", "/c/a.md", "[z](b.md#zeta) [a](b.md#alpha)", None), ("note://resources/project/b.md", "/c/b.md", "x", None)], NOTE)
    edges, _ = relations.build_edges(notes)
    assert [r.fragment for r in edges.collect()] == ["zeta"]


def test_manifest_of_any_size_has_a_digest(spark):
    rows = spark.range(1_100).select(F.lit("s").alias("source"), F.concat(F.lit("p"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    one = snapshots.manifest_digest(rows, "source").first()
    assert one.files == 1_100 and one.digest == snapshots.corpus_digest(rows).first().digest
    changed = rows.withColumn("sha256", F.when(F.col("path") == "p7", "0").otherwise(F.col("sha256")))
    assert snapshots.manifest_digest(changed, "source").first().digest != one.digest


def test_a_long_route_is_kept(spark):
    route = spark.range(400).select(F.lit(1).alias("query_id"), F.concat(F.lit("u"), F.col("id") % 200).alias("uri"), F.col("id").alias("position"), F.lit(1.0).alias("score"))
    assert ranking.first_occurrences(route).agg(F.max("rank"), F.count("*")).first() == (200, 200)


def test_all_terms_of_a_query_count(spark):
    query = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(50)))], "query_id int, text string")
    assert lexical.query_terms(query).count() == 50 and lexical.query_terms(query, 32).count() == 32


def test_public_metadata_is_masked_value_by_value(spark):
    schema = "uri string, path string, raw string, conditions map<string,string>, aliases array<struct<text:string,relation:string,scope:array<string>>>, topics array<string>"
    row = ("u", "a/b.md", "# T\n\nclean\n", {"10.1.2.3": "one", "10.1.2.4": "two", "plain": "http://alpha"}, [("http://beta", "related", []), ("bob:pw12345@h", None, [])], ["http://alpha", "bob:pw12345@h"])
    out = redact.public_projection(spark.createDataFrame([row], schema)).first()
    assert out.conditions == {"[redacted:ipv4-address]": "two", "plain": "http://alpha"}
    assert out.topics == ["http://alpha", "bob:pw12345@h"] and [a.text for a in out.aliases] == ["http://beta", "bob:pw12345@h"]


def test_vectors_that_cannot_be_ranked_are_left_out(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [float("nan"), 1.0]), ("d", []), ("e", [0.5, 0.5])], "uri string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id int, vector array<double>")
    assert [(r.query_id, r.uri) for r in vector_topk(queries, vectors, 5).orderBy("rank").collect()] == [(1, "a"), (1, "e")]
