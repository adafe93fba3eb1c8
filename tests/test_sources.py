import json
import os

from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash
from corpusloom.sources.notes import Mount, build_notes, check_identity, is_selected, scan_notes


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as stream:
        stream.write(text)


def test_scan_joins_sidecars_and_checks_identity(spark, place):
    shared, project = f"{place}/shared", f"{place}/project"
    raw = "# Title\r\n\r\nbody\r\n"
    digest = spark.range(1).select(content_hash(F.lit(raw)).alias("h")).first().h
    write(shared, "a/one.md", raw)
    write(shared, "a/one.meta.json", json.dumps({"uri": "note://resources/elsewhere.md", "status": "draft", "conditions": {"x": "1", "y": "unknown"}, "source": {"url": "https://a.example"}, "retrieval": {"source_sha256": digest, "aliases": ["plain", {"text": "obj", "scope": "t"}, {"text": "list", "scope": ["u", "v"]}, {"text": "bad", "scope": ["u", " "]}], "topics": ["t"]}}))
    write(project, "two.md", "no heading\nmore\n")
    write(project, "two.meta.json", "{not json")
    write(project, "three.md", "# Three\n\nx\n")
    write(project, "three.meta.json", json.dumps({"uri": "note://resources/project/two.md", "title": "Other"}))
    write(project, "big.md", "x" * (4 * 1024 * 1024 + 1))
    notes = build_notes(scan_notes(spark, [Mount("shared", shared), Mount("project", project)]))
    rows = {r.relative_path: r for r in notes.collect()}
    one = rows["a/one.md"]
    assert one.uri == "note://resources/shared/bootstrap/a/one.md" and one.title == "Title" and one.body == "body" and one.status == "draft"
    assert one.conditions == {"x": "1"} and one.source == {"url": "https://a.example"} and one.topics == ["t"] and one.enrichment_ignored is None
    assert [(a.text, a.scope) for a in one.aliases] == [("plain", []), ("obj", ["t"]), ("list", ["u", "v"])]
    assert rows["two.md"].title == "no heading" and rows["two.md"].body == "no heading\nmore" and rows["two.md"].status is None
    assert rows["three.md"].title == "Other" and rows["big.md"].raw is None
    accepted, errors = check_identity(notes)
    assert {r.relative_path for r in accepted.collect()} == {"a/one.md"}
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in errors.collect()} == {
        ("big.md", "unreadable_or_over_size"),
        ("three.md", "identity_disagrees_with_mount"),
        ("two.md", "two_sources_share_one_uri"),
    }


def test_selection(spark):
    names = ["a/x.md", "a/x.exe", "b/c/y.TXT", "b/cc.md", "z/[1].md", "q.md"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    chosen = lambda patterns: {r.p for r in df.where(is_selected(F.col("p"), patterns)).collect()}
    assert chosen(None) == {"a/x.md", "b/c/y.TXT", "b/cc.md", "z/[1].md", "q.md"}
    assert chosen(["a/*", "b/c/"]) == {"a/x.md", "b/c/y.TXT"}
    assert chosen(["?.md", "z/[[]1].md"]) == {"q.md", "z/[1].md"}
