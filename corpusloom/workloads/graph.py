"""Structure, links and code references over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions.html import html_to_text
from corpusloom.functions.text import lines
from corpusloom.operators import codemap, health, relations, structure
from corpusloom.session import materialize, spread
from corpusloom.workloads.tables import code_files, documents, markdown_notes, table


def page_blocks(spark, folder):
    """Blocks of the text that pages turn into: their headings, lists and paragraphs."""
    pages = spread(table(spark, folder, "pages")).select(F.col("page_id").alias("uri"), html_to_text()(F.col("html")).alias("t"))
    return structure.blocks(pages.select("uri", F.col("t.text").alias("raw"))).select(
        F.col("uri").alias("page_id"), "kind", "line_start", "line_end", F.array_join("section", " > ").alias("section")
    )


def note_blocks(spark, folder):
    b = structure.blocks(markdown_notes(spark, folder))
    return b.select(
        "uri", "kind", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"),
        F.array_join("section", " > ").alias("section"), "language", "closed",
    )


# The document text starts on line 19 and holds no heading, fence or table rule, so its
# blocks are its runs of nonblank lines.
NOTE_BLOCKS = r"""WITH t AS (SELECT doc_id, 'note://resources/project/doc-' || doc_id || '.md' AS uri, regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10), '[\n\x0b\x0c\x1c\x1d\x1e]') AS p FROM documents),
l AS (SELECT doc_id, uri, unnest(p) AS s, generate_subscripts(p, 1) + 18 AS line FROM t),
n AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM l WHERE trim(s, ' ' || chr(9) || chr(160)) <> ''),
fixed AS (SELECT * FROM (VALUES ('heading', 1, 1, ''), ('paragraph', 3, 3, ''), ('heading', 5, 5, ' > Conditions'), ('paragraph', 6, 8, ' > Conditions'),
  ('table', 10, 12, ' > Conditions'), ('code', 14, 16, ' > Conditions'), ('heading', 18, 18, ' > Text')) AS v(kind, line_start, line_end, tail))
SELECT uri, kind, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, 'Note ' || doc_id || tail AS section,
  CASE kind WHEN 'code' THEN 'text' END AS language, CASE kind WHEN 'code' THEN true END AS closed FROM t, fixed
UNION ALL SELECT uri, 'paragraph', min(line), max(line), 'Note ' || doc_id || ' > Text', NULL, NULL FROM n GROUP BY doc_id, uri, run"""


def note_conditions(spark, folder):
    c = structure.conditions(markdown_notes(spark, folder))
    return c.select("uri", "field", "value", F.col("line").cast("long").alias("line"), "origin")


NOTE_CONDITIONS = """SELECT 'note://resources/project/doc-' || doc_id || '.md' AS uri, 'language' AS field, lang AS value, CAST(6 AS BIGINT) AS line, 'markdown' AS origin FROM documents
UNION ALL SELECT 'note://resources/project/doc-' || doc_id || '.md', 'origin', source, 7, 'markdown' FROM documents"""


def note_links(spark, folder):
    found = structure.links(markdown_notes(spark, folder))
    return found.select("uri", F.col("line").cast("long").alias("line"), "target")


_NOTE = "'note://resources/project/doc-' || doc_id || '.md'"
_CODE = "'lib/' || source || '/m' || doc_id || '.py'"
NOTE_LINKS = f"""SELECT {_NOTE} AS uri, CAST(3 AS BIGINT) AS line, unnest(['doc-' || (doc_id + 1) || '.md#L1-L2', 'https://Site.example/' || source || '/#top', '../../code/' || {_CODE} || '#L3-L4']) AS target FROM documents"""


def note_mentions(spark, folder):
    return structure.code_spans(markdown_notes(spark, folder)).select("uri", F.col("line").cast("long").alias("line"), "mention")


NOTE_MENTIONS = f"SELECT {_NOTE} AS uri, CAST(3 AS BIGINT) AS line, 'run_' || doc_id AS mention FROM documents"


def mined_aliases(spark, folder):
    """Bullets under a search-phrase heading, repeated and bounded, per document."""
    d = documents(spark, folder)
    bullets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.concat(F.lit("- `"), F.col("lang"), F.lit(" "), i % 13, F.lit("`"))), "\n")
    raw = F.concat(F.lit("# A\n- no\n## Retrieval queries\n- "), F.col("source"), F.lit("\n"), bullets, F.lit("\n# B\n- no\n"), "text")
    return d.select("doc_id", F.array_join(md.mined_aliases(lines(raw)), ",").alias("aliases"))


MINED_ALIASES = """SELECT doc_id, source || ',' || array_to_string(list_transform(range(1, 12), lambda i: lang || ' ' || i), ',') AS aliases FROM documents"""


def _noted(spark, folder):
    notes = markdown_notes(spark, folder).withColumn("evidence", F.lit(None).cast("string"))
    site = F.concat(F.lit("https://site.example/"), "source")
    # The first note of each source and language records the site as its source; es notes their own page.
    first = notes.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    own = F.when(F.col("lang") == "es", F.create_map(F.lit("url"), F.concat(F.lit("https://es.example/"), "doc_id"))).when(
        F.col("first"), F.create_map(F.lit("home"), F.concat(site, F.lit("/")))
    )
    return notes.join(first, ["source", "lang", "doc_id"], "left").withColumn("source", own.cast("map<string,string>"))


def _code(spark, folder):
    return code_files(spark, folder).select(
        "source_id", "path", F.lit("/code").alias("root"), F.lit("acme/corpus").alias("repository"), F.lit("rev").alias("revision"),
        F.sha2("content", 256).alias("content_sha256"), F.lit(7).alias("line_count"),
    )


def relation_edges(spark, folder):
    notes = _noted(spark, folder)
    symbols = codemap.facts_table(codemap.source_facts(code_files(spark, folder)), "symbols")
    edges, _ = relations.build_edges(notes, _code(spark, folder), symbols)
    return edges.select("source", "target", "kind", "status", "fragment", "fragment_status", F.col("line").cast("long").alias("line"), "field")


RELATION_EDGES = f"""WITH d AS (SELECT *, {_NOTE} AS uri, {_CODE} AS code, EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = documents.doc_id + 1) AS has_next FROM documents),
owners AS (SELECT source, lang, min(doc_id) AS doc_id FROM documents WHERE lang <> 'es' GROUP BY ALL),
asked AS (SELECT d.uri, d.doc_id, d.source, 'top' AS fragment, CAST(3 AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS field FROM d
  UNION ALL SELECT 'note://resources/project/doc-' || doc_id || '.md', doc_id, source, '', NULL, 'source.home' FROM owners),
hits AS (SELECT a.*, o.doc_id AS other, count(o.doc_id) OVER (PARTITION BY a.doc_id, a.field) AS n FROM asked a LEFT JOIN owners o ON o.source = a.source AND o.doc_id <> a.doc_id)
SELECT uri AS source, CASE WHEN has_next THEN 'note://resources/project/doc-' || (doc_id + 1) || '.md' ELSE '/corpus/project/doc-' || (doc_id + 1) || '.md' END AS target,
  'explicit_link' AS kind, CASE WHEN has_next THEN 'resolved' ELSE 'outside_snapshot' END AS status, 'L1-L2' AS fragment, 'unchecked' AS fragment_status, CAST(3 AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS field FROM d
UNION ALL SELECT uri, CASE WHEN other IS NULL THEN 'https://site.example/' || source ELSE 'note://resources/project/doc-' || other || '.md' END, 'explicit_link',
  CASE n WHEN 0 THEN 'external_unchecked' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END, fragment, CASE fragment WHEN '' THEN 'none' ELSE 'unchecked' END, line, field FROM hits
UNION ALL SELECT uri, 'code:corpus:' || code, 'explicit_code_link', 'resolved', 'L3-L4', 'verified', 3, NULL FROM d
UNION ALL SELECT uri, 'code:corpus:symbol:' || code || ':run_' || doc_id || ':3', 'symbol_candidate', 'candidate', '', 'none', 3, NULL FROM d
UNION ALL SELECT uri, 'https://es.example/' || doc_id, 'explicit_link', 'external_unchecked', '', 'none', NULL, 'source.url' FROM d WHERE lang = 'es'"""


def _edges(spark, folder, symbols):
    notes = markdown_notes(spark, folder).drop("source")
    return relations.build_edges(notes, _code(spark, folder), symbols)[0]


def backlinks(spark, folder):
    """Who links to the site of each source: at most 40 per site, with a truncated flag."""
    targets = documents(spark, folder).select(F.concat(F.lit("https://site.example/"), "source").alias("ref"))
    symbols = codemap.facts_table(codemap.source_facts(code_files(spark, folder)), "symbols")
    found = relations.backlinks(_edges(spark, folder, symbols), targets)
    return found.select("ref", "source", "truncated")


BACKLINKS = f"""WITH r AS (SELECT 'https://site.example/' || source AS ref, {_NOTE} AS source, count(*) OVER (PARTITION BY source) > 40 AS truncated,
  row_number() OVER (PARTITION BY documents.source ORDER BY {_NOTE}) AS pos FROM documents) SELECT ref, source, truncated FROM r WHERE pos <= 40"""


def affected_notes(spark, folder):
    """Files of de documents changed in helper only, those of fr in run; es files are gone."""
    code = code_files(spark, folder)
    state = F.when(F.col("lang") == "es", F.lit("removed")).when(F.col("lang").isin("de", "fr"), F.lit("changed"))
    changes = code.select("source_id", "path", state.alias("state")).where("state is not null")
    symbols = codemap.facts_table(codemap.source_facts(code), "symbols")
    changed = symbols.where("name <> 'helper'").join(code.where("lang = 'fr'").select("source_id", "path"), ["source_id", "path"], "left_semi")
    found = relations.affected_notes(_edges(spark, folder, symbols), changes, changed)
    return found.select("document", "source_path", "change", "relation")


AFFECTED_NOTES = f"""SELECT {_NOTE} AS document, {_CODE} AS source_path, CASE lang WHEN 'es' THEN 'removed' ELSE 'changed' END AS change, 'explicit_code_link' AS relation FROM documents WHERE lang IN ('es', 'de', 'fr')
UNION ALL SELECT {_NOTE}, {_CODE}, CASE lang WHEN 'es' THEN 'removed' ELSE 'changed' END, 'symbol_candidate' FROM documents WHERE lang IN ('es', 'fr')"""


def link_drift(spark, folder):
    """Relative links of notes to their neighbour and code, where de neighbours changed since
    the first observation and es notes were never observed."""
    notes = markdown_notes(spark, folder).withColumn("body", md.body_of(F.col("raw")))
    files = markdown_notes(spark, folder).select("path", F.sha2("raw", 256).alias("sha256"))
    links = health.local_links(notes.where("lang <> 'es'"))
    old = F.when(F.col("lang") == "de", F.lit("older")).otherwise(F.col("sha256"))
    first = files.join(documents(spark, folder).select(F.concat(F.lit("/corpus/project/doc-"), "doc_id", F.lit(".md")).alias("path"), "lang"), "path").select(F.col("path").alias("target"), old.alias("sha256"))
    baseline = links.join(first, "target").select("uri", "raw_sha256", "link", "sha256")
    return health.link_drift(notes, files, baseline).select("uri", "link", "outcome")


LINK_DRIFT = f"""SELECT 'note://resources/project/doc-' || d.doc_id || '.md' AS uri, 'doc-' || (d.doc_id + 1) || '.md#L1-L2' AS link,
  CASE WHEN n.doc_id IS NULL THEN 'unavailable' WHEN d.lang = 'es' THEN 'new' WHEN n.lang = 'de' THEN 'changed' ELSE 'same' END AS outcome
FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
UNION ALL SELECT {_NOTE}, unnest(['../../code/' || {_CODE} || '#L3-L4', 'a-link.md']), 'unavailable' FROM documents"""


def code_symbols(spark, folder):
    facts = codemap.source_facts(code_files(spark, folder))
    return codemap.facts_table(facts, "symbols").select("path", "symbol_id", "kind", "signature", "line_start", "line_end")


CODE_SYMBOLS = f"""SELECT {_CODE} AS path, 'symbol:' || {_CODE} || ':run_' || doc_id || ':3' AS symbol_id, 'function' AS kind, 'run_' || doc_id || '(x)' AS signature, 3 AS line_start, 4 AS line_end FROM documents
UNION ALL SELECT {_CODE}, 'symbol:' || {_CODE} || ':helper:6', 'function', 'helper(y)', 6, 7 FROM documents"""


def code_references(spark, folder):
    r = codemap.resolve_references(codemap.source_facts(code_files(spark, folder)))
    return r.select("path", "source", "name", "target", "kind", "resolution")


CODE_REFERENCES = f"""WITH d AS (SELECT *, {_CODE} AS code FROM documents), c AS (SELECT *, 'symbol:' || code || ':run_' || doc_id || ':3' AS run, 'symbol:' || code || ':helper:6' AS helper FROM d)
SELECT code AS path, run AS source, 'helper' AS name, helper AS target, 'static_call_reference' AS kind, 'static_reference' AS resolution FROM c
UNION ALL SELECT code, run, 'other', 'unresolved:' || run || ':4:other', 'call_expression', 'unresolved' FROM c
UNION ALL SELECT code, helper, 'len', 'unresolved:' || helper || ':7:len', 'call_expression', 'unresolved' FROM c"""


def code_imports(spark, folder):
    r = codemap.resolve_imports(codemap.source_facts(code_files(spark, folder)))
    return r.select("path", "target", "resolution")


CODE_IMPORTS = f"""SELECT {_CODE} AS path, CASE WHEN EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d.doc_id + 1 AND o.source = d.source)
  THEN 'file:lib/' || source || '/m' || (doc_id + 1) || '.py' ELSE 'import:lib.' || source || '.m' || (doc_id + 1) END AS target,
  CASE WHEN EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d.doc_id + 1 AND o.source = d.source) THEN 'static_reference' ELSE 'unresolved' END AS resolution FROM documents d"""


def changed_symbols(spark, folder):
    """Before and after: de files were rewritten, fr files only gained a line, es files are gone."""
    before = code_files(spark, folder)
    after = before.where("lang <> 'es'").withColumn(
        "content",
        F.when(F.col("lang") == "de", F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("len(y)"), F.lit("len(y) + 1")), "UTF-8"))
        .when(F.col("lang") == "fr", F.concat("content", F.encode(F.lit("# end\n"), "UTF-8")))
        .otherwise(F.col("content")),
    )
    old, new = codemap.source_facts(before), codemap.source_facts(after)
    states = codemap.compare_sources(old, new, complete=True)
    gone = codemap.changed_symbols(codemap.facts_table(old, "symbols"), codemap.facts_table(new, "symbols"), states)
    return gone.select("path", "qualified_name")


CHANGED_SYMBOLS = f"""SELECT {_CODE} AS path, unnest(CASE lang WHEN 'de' THEN ['helper'] ELSE ['helper', 'run_' || doc_id] END) AS qualified_name FROM documents WHERE lang IN ('de', 'es')"""


def code_neighbourhood(spark, folder):
    """Two steps around the entry of every hundredth module, over all files, and whether
    anything was left out."""
    facts = codemap.source_facts(code_files(spark, folder))
    symbols = codemap.facts_table(facts, "symbols")
    calls = materialize(codemap.resolve_references(facts).select("source", "target", "kind", "resolution"), "calls")
    none = F.lit(None).cast("string")
    nodes = symbols.select(F.col("symbol_id").alias("id"), "name", "qualified_name", "path", "kind").unionByName(
        calls.where("resolution = 'unresolved'").select(
            F.col("target").alias("id"), F.substring_index("target", ":", -1).alias("name"), none.alias("qualified_name"), none.alias("path"),
            F.lit("unresolved_symbol").alias("kind"),
        )
    )
    seeds = documents(spark, folder).where("doc_id % 100 = 0").select(F.concat(F.lit("run_"), "doc_id").alias("seed"))
    found = codemap.neighbourhood(nodes, calls, seeds, depth=2)
    told = found.seeds.select("seed", F.size("matches").cast("long").alias("matches"), F.size("nodes").cast("long").alias("nodes"), "truncated")
    return found.edges.join(told, "seed").select("seed", "source", "target", F.col("step").cast("long").alias("step"), "matches", "nodes", "truncated")


CODE_NEIGHBOURHOOD = f"""WITH d AS (SELECT *, {_CODE} AS code FROM documents WHERE doc_id % 100 = 0),
c AS (SELECT 'run_' || doc_id AS seed, 'symbol:' || code || ':run_' || doc_id || ':3' AS run, 'symbol:' || code || ':helper:6' AS helper FROM d),
e AS (SELECT seed, run AS source, helper AS target, CAST(1 AS BIGINT) AS step FROM c UNION ALL SELECT seed, run, 'unresolved:' || run || ':4:other', 1 FROM c
UNION ALL SELECT seed, helper, 'unresolved:' || helper || ':7:len', 2 FROM c)
SELECT *, CAST(1 AS BIGINT) AS matches, CAST(4 AS BIGINT) AS nodes, false AS truncated FROM e"""


QUERIES = {
    "page_blocks": (page_blocks, None),
    "note_blocks": (note_blocks, NOTE_BLOCKS),
    "note_conditions": (note_conditions, NOTE_CONDITIONS),
    "note_links": (note_links, NOTE_LINKS),
    "note_mentions": (note_mentions, NOTE_MENTIONS),
    "mined_aliases": (mined_aliases, MINED_ALIASES),
    "relation_edges": (relation_edges, RELATION_EDGES),
    "backlinks": (backlinks, BACKLINKS),
    "affected_notes": (affected_notes, AFFECTED_NOTES),
    "link_drift": (link_drift, LINK_DRIFT),
    "code_symbols": (code_symbols, CODE_SYMBOLS),
    "code_references": (code_references, CODE_REFERENCES),
    "code_imports": (code_imports, CODE_IMPORTS),
    "changed_symbols": (changed_symbols, CHANGED_SYMBOLS),
    "code_neighbourhood": (code_neighbourhood, CODE_NEIGHBOURHOOD),
}
