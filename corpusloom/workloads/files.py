"""Notes as files: documents written as note folders with sidecars, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions.text import content_hash
from corpusloom.session import materialize, shared_folder
from corpusloom.sources.note_source import NoteSource, write_notes
from corpusloom.sources.notes import build_notes, check_identity
from corpusloom.workloads import sql as q
from corpusloom.workloads.tables import notes


def _filled(template: str, **values):
    """A text with ``@name`` replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"@{name}"), value)
    return out


def _with_sidecars(n):
    """One note of five has no sidecar, one a broken one, one overrides title and metadata,
    and two bring search phrases, for the text as it is and for another text."""
    override = (
        '{"title": "Sidecar @id", "status": "draft", "conditions": {"language": " @lang ", "origin": "unknown", "blank": "  "},'
        ' "source": {" url ": " https://@site.example/@id ", "via": "Unknown"}}'
    )
    phrases = (
        '{"retrieval": {"source_sha256": "@hash", "topics": [" @lang ", "@site", "@lang", " "],'
        ' "aliases": ["@lang notes", {"text": " @site file ", "relation": "same", "scope": "@lang"}, {"text": "none", "scope": ["@lang", ""]}]}}'
    )
    lang, site = F.get("topics", F.lit(0)), F.get("topics", F.lit(1))
    values = {"id": F.col("doc_id").cast("string"), "lang": lang, "site": site}
    kind = F.col("doc_id") % 5
    sidecar = (
        F.when(kind == 1, F.lit("{broken"))
        .when(kind == 2, _filled(override, **values))
        .when(kind == 3, _filled(phrases, hash=content_hash(F.col("raw")), **values))
        .when(kind == 4, _filled(phrases, hash=F.sha2("raw", 512), **values))
    )
    return n.select("layer", "relative_path", "raw", sidecar.alias("sidecar"))


def scanned_notes(spark, folder):
    place = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    given = _with_sidecars(notes(spark, folder))
    write_notes(given.select(F.concat_ws("/", "layer", "relative_path").alias("relative_path"), "raw", "sidecar"), place)
    spark.dataSource.register(NoteSource)
    scanned = None
    for layer in md.LAYERS:
        part = spark.read.format("notes").option("layer", layer).load(f"{place}/{layer}")
        scanned = part if scanned is None else scanned.unionByName(part)
    accepted, _ = check_identity(build_notes(materialize(scanned, "scanned")))
    pairs = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    alias = lambda a: F.concat_ws("|", a["text"], a["relation"], F.array_join(a["scope"], ","))
    return accepted.select(
        "layer",
        "uri",
        "title",
        "slug",
        "status",
        F.sha2("body", 256).alias("body_sha256"),
        "source_sha256",
        "length",
        pairs("conditions").alias("conditions"),
        pairs("source").alias("origin"),
        F.array_join(F.transform("aliases", alias), ";").alias("aliases"),
        F.array_join("topics", ";").alias("topics"),
        "enrichment_ignored",
    )


SCANNED_NOTES = f"""WITH {q.NOTES}
SELECT layer, uri, CASE WHEN doc_id % 5 = 2 THEN 'Sidecar ' || doc_id ELSE title END AS title, regexp_replace(relative_path, '\\.md$', '') AS slug,
       CASE WHEN doc_id % 5 = 2 THEN 'draft' END AS status, sha256(body) AS body_sha256, source_sha256, strlen(raw) AS length,
       CASE WHEN doc_id % 5 = 2 THEN 'language=' || lang ELSE '' END AS conditions,
       CASE WHEN doc_id % 5 = 2 THEN 'url=https://' || source || '.example/' || doc_id END AS origin,
       CASE WHEN doc_id % 5 = 3 THEN lang || ' notes|related|;' || source || ' file|same|' || lang ELSE '' END AS aliases,
       CASE WHEN doc_id % 5 = 3 THEN least(lang, source) || ';' || greatest(lang, source) ELSE '' END AS topics,
       CASE WHEN doc_id % 5 = 4 THEN 'source_changed' END AS enrichment_ignored
FROM notes WHERE strlen(raw) <= {md.MAX_NOTE_BYTES}"""

QUERIES = {"scanned_notes": (scanned_notes, SCANNED_NOTES)}
