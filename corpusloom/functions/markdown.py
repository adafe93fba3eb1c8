"""Column expressions for Markdown notes: titles, identities, paths, directives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANKS, LINE_ENDS, fold, let, strip, unix_newlines

# Layer names, size limits and the public size limit of a corpus file.
LAYERS = ("shared", "project", "candidate")
URI_ROOT = "note://resources"
SHARED_FOLDER = "shared/bootstrap"
MAX_NOTE_BYTES = 4 * 1024 * 1024
MAX_SIDECAR_BYTES = 256 * 1024
MAX_CORPUS_FILE_BYTES = 1_048_576

# The first ATX heading of level one, with everything before it in group 1.
FIRST_HEADING = rf"(?s)\A(.*?)(?m:^)#[{BLANKS}]+([^\n]+?)[{BLANKS}]*(?m:$)"
JAVA_FIRST_HEADING = "(?d)" + FIRST_HEADING
HAS_HEADING = rf"(?d)(?m:^)#[{BLANKS}]+[^\n{BLANKS}]"


def first_line(value: Column) -> Column:
    return strip(F.regexp_extract(strip(value), rf"\A[^{LINE_ENDS}]*", 0))


def _has_heading(raw: Column) -> Column:
    return F.contains(raw, F.lit("#")) & raw.rlike(HAS_HEADING)


def title_of(value: Column) -> Column:
    """First level-one heading, else the first nonblank line, else ``untitled``."""

    def title(raw: Column) -> Column:
        # Bound once: nullif() would read the line twice.
        line = let(first_line(raw), lambda t: F.when(t != "", t).otherwise(F.lit("untitled")))
        return F.when(_has_heading(raw), strip(F.regexp_extract(raw, JAVA_FIRST_HEADING, 2))).otherwise(line)

    return let(unix_newlines(value), title)


def _without_heading(raw: Column, otherwise: Column) -> Column:
    return F.when(_has_heading(raw), strip(F.regexp_replace(raw, JAVA_FIRST_HEADING, "$1"))).otherwise(otherwise)


def body_of(value: Column) -> Column:
    """The text without its title heading; a note without one keeps every line."""
    return let(unix_newlines(value), lambda raw: _without_heading(raw, strip(raw)))


def release_body_of(value: Column) -> Column:
    """Body by the stricter release gate: without a heading the first line is not body."""
    rest = lambda raw: F.when(F.instr(raw, "\n") > 0, strip(F.regexp_replace(raw, r"\A[^\n]*\n", ""))).otherwise(F.lit(""))
    return let(unix_newlines(value), lambda raw: _without_heading(raw, rest(raw)))


def render(title: Column, body: Column) -> Column:
    head = let(strip(F.coalesce(title, F.lit(""))), lambda t: F.concat(F.lit("# "), F.when(t == "", F.lit("untitled")).otherwise(t), F.lit("\n")))
    rest = let(strip(F.coalesce(body, F.lit(""))), lambda t: F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("\n"), t, F.lit("\n"))))
    return F.concat(head, rest)


def written(title: Column, body: Column) -> Column:
    """Title and body as they are, also where one is empty; null where one is missing."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))


def slugify(value: Column, width: int = 80, default: str = "captured-entry") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(strip(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.substring(slug, 1, width)
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def title_digest(value: Column) -> Column:
    return F.left(F.sha2(strip(F.coalesce(value, F.lit(""))), 256), F.lit(12))


def note_slug(title: Column) -> Column:
    """Identity that depends on the title alone and survives readable collisions."""
    readable = slugify(title)
    return F.concat(F.when(readable == "captured-entry", F.lit("entry")).otherwise(readable), F.lit("-"), title_digest(title))


def content_digest(title: Column, body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(render(title, body), 256))


def public_filename(digest: Column, title: Column) -> Column:
    return F.concat(
        F.left(F.regexp_replace(digest, "^sha256:", ""), F.lit(12)), F.lit("-"), slugify(title, 60, "contribution"), F.lit(".md")
    )


def uri_for(layer: Column, relative: Column, root: str = URI_ROOT) -> Column:
    name = F.ltrim(F.translate(F.coalesce(relative, F.lit("")), "\\", "/"), F.lit("/"))
    name = F.when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit(".md")))
    folder = F.when(layer == "shared", F.lit(SHARED_FOLDER)).otherwise(layer)
    return F.concat_ws("/", F.lit(root), folder, name)


def layer_from_uri(uri: Column, root: str = URI_ROOT) -> Column:
    name = F.substring_index(F.substr(uri, F.lit(len(root) + 2)), "/", 1)
    return F.when(uri.startswith(root + "/") & name.isin(*LAYERS), name)


def is_safe_relative(path: Column) -> Column:
    """Relative, forward slashes only, no empty, ``.`` or ``..`` part."""
    return F.coalesce(
        (path != "")
        & ~path.rlike(r"^[/\\]")
        & ~path.rlike(r"[\\:\x00]")
        & ~F.exists(F.split(path, "/", -1), lambda part: part.isin("", ".", "..")),
        F.lit(False),
    )


# Device names Windows reserves.
RESERVED_NAMES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def is_portable_relative(path: Column) -> Column:
    """Safe on every platform: also no control or reserved characters and names."""
    return F.coalesce(
        (path != "")
        & ~path.startswith("/")
        & ~path.rlike(r"[\\:]")
        & ~F.exists(
            F.split(path, "/", -1),
            lambda part: part.isin("", ".", "..")
            | part.rlike(r"[. ]$")
            | part.rlike(r'[\x00-\x1f<>"|?*]')
            | F.regexp_extract(part, r"^[^.]*", 0).rlike(RESERVED_NAMES),
        ),
        F.lit(False),
    )


# An ISO timestamp that names its zone; nothing else is trusted.
ZONED = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$"


def strict_epoch(value: Column) -> Column:
    """Seconds since the epoch for a zoned ISO timestamp, otherwise NULL."""
    text = F.regexp_replace(F.regexp_replace(value, " ", "T"), ",", ".")
    return F.when(value.rlike(ZONED), F.unix_micros(F.try_to_timestamp(text)) / F.lit(1_000_000.0))


URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def normal_url(value: Column) -> Column:
    """http(s) addresses: lower-case scheme and host, no trailing ``/``, no fragment."""
    query = F.regexp_extract(value, URL_PARTS, 4)
    return F.when(
        F.lower(F.regexp_extract(value, URL_PARTS, 1)).isin("http", "https"),
        F.concat(
            F.lower(F.regexp_extract(value, URL_PARTS, 1)),
            F.lit("://"),
            F.lower(F.regexp_extract(value, URL_PARTS, 2)),
            F.rtrim(F.regexp_extract(value, URL_PARTS, 3), F.lit("/")),
            F.when(query == "?", F.lit("")).otherwise(query),
        ),
    ).otherwise(value)


# Fixed value: citation markup that some clients append to a final message.
CITATION = r"(?s)<oai-mem-citation>.*?</oai-mem-citation>"


def summary_text(value: Column) -> Column:
    """Final message without citation markup; NULL when too short to keep."""
    text = strip(F.regexp_replace(value, CITATION, ""))
    return F.when(F.length(text) >= 24, text)


def summary_title(text: Column) -> Column:
    heading = F.ltrim(first_line(text), F.lit("# "))
    return F.concat(
        F.substring(F.when(first_line(text) == "", F.lit("Session observation")).otherwise(heading), 1, 100),
        F.lit(" ["),
        F.left(F.sha2(text, 256), F.lit(8)),
        F.lit("]"),
    )


ALL_TOPICS = r"(?i)\ball-topics\b"
TOPIC = r"(?i)\btopic:([\w./-]+)"


def query_directives(text: Column, default: Column | None = None) -> Column:
    """struct<text, topics, mode>: directives removed from the text and applied."""
    cleared = text.rlike(ALL_TOPICS)
    rest = F.regexp_replace(text, ALL_TOPICS, "")
    named = F.regexp_extract_all(rest, F.lit(TOPIC), F.lit(1))
    none = F.array().cast("array<string>")
    base_topics = none if default is None else F.coalesce(default["topics"], none)
    base_mode = F.lit("prefer") if default is None else F.coalesce(default["mode"], F.lit("prefer"))
    return F.struct(
        strip(F.regexp_replace(rest, TOPIC, "")).alias("text"),
        F.when(F.size(named) > 0, named).when(cleared, none).otherwise(base_topics).alias("topics"),
        F.when((F.size(named) > 0) | cleared, F.lit("prefer")).otherwise(base_mode).alias("mode"),
    )


def clean_conditions(conditions: Column) -> Column:
    """Trimmed values; blank and ``unknown`` entries are dropped, not stored."""
    trimmed = F.transform_values(conditions, lambda _, v: strip(v))
    return F.coalesce(
        F.map_filter(trimmed, lambda _, v: v.isNotNull() & (v != "") & (F.lower(v) != "unknown")),
        F.create_map().cast("map<string,string>"),
    )


def clean_mapping(mapping: Column) -> Column:
    """Like conditions, with keys trimmed too; NULL when nothing is left."""
    entries = F.transform(F.map_entries(mapping), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value")))
    kept = F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull() & (e["value"] != "") & (F.lower(e["value"]) != "unknown"))
    # Keys that only differ in blanks: the last one stays, as in a plain overwrite.
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.when(F.size(kept) > 0, F.map_from_entries(last))


ALIAS_TYPE = "array<struct<text:string,relation:string,scope:array<string>>>"


def bind_enrichment(retrieval: Column, raw_hash: Column) -> Column:
    """Aliases and topics count only while they name the note's current hash.

    ``retrieval`` is struct<source_sha256, aliases, topics> with aliases already in
    the one struct shape; a scope array holding a NULL or blank entry is malformed
    and drops its alias.
    """
    bound = retrieval["source_sha256"] == raw_hash
    aliases = F.filter(
        F.transform(
            F.coalesce(retrieval["aliases"], F.array().cast(ALIAS_TYPE)),
            lambda a: F.struct(
                strip(a["text"]).alias("text"),
                F.when(F.coalesce(a["relation"], F.lit("")) == "", F.lit("related")).otherwise(a["relation"]).alias("relation"),
                F.transform(F.coalesce(a["scope"], F.array().cast("array<string>")), lambda s: strip(s)).alias("scope"),
            ),
        ),
        lambda a: a["text"].isNotNull() & (a["text"] != "") & ~F.exists(a["scope"], lambda s: s.isNull() | (s == "")),
    )
    topics = F.array_sort(
        F.array_distinct(
            F.filter(F.transform(F.coalesce(retrieval["topics"], F.array().cast("array<string>")), lambda t: strip(t)), lambda t: t.isNotNull() & (t != ""))
        )
    )
    return F.struct(
        F.when(bound, aliases).otherwise(F.array().cast(ALIAS_TYPE)).alias("aliases"),
        F.when(bound, topics).otherwise(F.array().cast("array<string>")).alias("topics"),
        F.when(retrieval.isNull() | F.coalesce(bound, F.lit(False)), F.lit(None))
        .when(F.coalesce(retrieval["source_sha256"], F.lit("")) == "", F.lit("source_hash_missing"))
        .otherwise(F.lit("source_changed"))
        .alias("ignored"),
    )


def scoped_aliases(aliases: Column, topics: Column) -> Column:
    """Alias texts that are unscoped or whose scope covers one of the topics."""
    own = F.transform(topics, fold)
    kept = F.filter(
        aliases,
        lambda a: (F.coalesce(F.size(a["scope"]), F.lit(0)) <= 0) | F.arrays_overlap(F.transform(a["scope"], fold), own),
    )
    return F.transform(kept, lambda a: a["text"])


# Headings that introduce a list of search phrases.
ALIAS_HEADINGS = ("retrieval queries", "检索问法", "检索问题")
BULLET = rf"^[{BLANKS}]*(?:[-*]|\d+[.)])[{BLANKS}]+(.+)"


def mined_aliases(text_lines: Column) -> Column:
    """Bullets under a search-phrase heading: distinct, at most 400 characters, first 12."""

    def keep(line: Column, i: Column) -> Column:
        return F.struct(
            i.alias("at"),
            line.startswith("#").alias("heading"),
            F.lower(strip(F.ltrim(line, F.lit("# ")))).isin(*ALIAS_HEADINGS).alias("opens"),
            F.btrim(strip(F.regexp_extract(line, BULLET, 1)), F.lit("`")).alias("value"),
        )

    marked = F.filter(F.transform(text_lines, keep), lambda m: m["heading"] | (m["value"] != ""))
    start = F.struct(F.lit(False).alias("active"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, m: Column) -> Column:
        # The array stays at twelve entries, so the fold is linear in the lines.
        add = (
            state["active"]
            & ~m["heading"]
            & (F.length(m["value"]) <= 400)
            & (F.size(state["found"]) < 12)
            & ~F.array_contains(state["found"], m["value"])
        )
        return F.struct(
            F.when(m["heading"], m["opens"]).otherwise(state["active"]).alias("active"),
            F.when(add, F.concat(state["found"], F.array(m["value"]))).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(marked, start, step, lambda state: state["found"])

