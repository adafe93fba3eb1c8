"""Line-level structure of notes: fences, sections, blocks, conditions, links.

Lines are marked with short facts next to the scan; only those facts, not the texts,
are grouped by note. A note is at most 4 MiB, so a note's lines are a bounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANKS, fold, let, lines, lstrip, strip

# The shapes of headings, table rules, fields and links in notes.
HEADING = rf"^(#{{1,6}})[{BLANKS}]+(.+?)[{BLANKS}]*#*[{BLANKS}]*$"
TABLE_RULE = rf"^[{BLANKS}|:-]+$"
FIELD = rf"(?U)^[{BLANKS}]*[-*]?[{BLANKS}]*([\w./ -]{{1,40}}):[{BLANKS}]*(.+)$"
CONDITION_HEADING = r"(?i)condition|prerequis|context|条件|环境|上下文"
NOT_RECORDED = ("", "unknown", "not recorded", "未记录", "未知")
FENCE = rf"^[{BLANKS}]{{0,3}}(`{{3,}}|~{{3,}})"
DEFINITION = rf"^[{BLANKS}]{{0,3}}\[([^\]]+)\]:[{BLANKS}]*(?:<([^>]+)>|([^{BLANKS}]+))"
INLINE_LINK = (
    rf"\[[^\]\n]*\]\([{BLANKS}]*(?:<([^>]+)>|((?:[^{BLANKS}()]++|\([^()]*\))*+))"
    rf"(?:[{BLANKS}]+[\"'][^\n]*?[\"'])?[{BLANKS}]*\)"
)
REFERENCE_LINK = r"\[([^\]\n]+)\](?:\[([^\]\n]*)\])?(?!\()"
AUTOLINK = r"<(https?://[^>]+)>"
CODE_SPAN = r"(?<!`)`([^`\n]+)`(?!`)"
PLAIN_LINK = rf"(?<!!)\[[^\]\n]*\]\(<?([^{BLANKS}<>]+)>?(?:[{BLANKS}]+\"[^\"]*\")?\)"


def line_table(notes: DataFrame) -> DataFrame:
    """(uri, line, text), lines counted from 1."""
    # Outer form, here and below: a plain explode adds a size() > 0 filter that would
    # evaluate the array twice.
    return (
        notes.select("uri", F.posexplode_outer(lines(F.col("raw"))).alias("at", "text"))
        .where("text is not null")
        .select("uri", (F.col("at") + 1).alias("line"), "text")
    )


def line_marks(notes: DataFrame) -> DataFrame:
    """Facts per line, without the line itself."""
    text, start = F.col("text"), lstrip(F.col("text"))
    value = strip(F.regexp_extract(text, FIELD, 2))
    is_field = text.rlike(FIELD) & ~F.lower(value).isin(*NOT_RECORDED[1:])
    fence = F.when(start.startswith("```"), 1).when(start.startswith("~~~"), 2).otherwise(0)
    return line_table(notes).select(
        "uri",
        "line",
        F.when(text.rlike(HEADING), F.length(F.regexp_extract(text, HEADING, 1))).otherwise(0).alias("level"),
        F.when(text.rlike(HEADING), F.regexp_extract(text, HEADING, 2)).alias("heading"),
        fence.alias("fence"),
        F.when(fence > 0, strip(F.substr(start, F.lit(4)))).alias("language"),
        (strip(text) == "").alias("blank"),
        F.contains(text, F.lit("|")).alias("pipe"),
        text.rlike(TABLE_RULE).alias("rule"),
        F.when(is_field, strip(F.regexp_extract(text, FIELD, 1))).alias("field"),
        F.when(is_field, value).alias("value"),
    )


def line_structure(notes: DataFrame) -> DataFrame:
    """Each line with its kind, section stack, block number and fence state.

    Fences toggle between three states: none, backticks, tildes. A backtick line swaps
    none and backticks, a tilde line swaps none and tildes. On states 0, 1, 2 these swaps
    are x -> 1 - x and x -> 2 - x modulo 3, so the state after any line is an alternating
    running sum: a window function instead of a sequential fold.
    """
    note = Window.partitionBy("uri").orderBy("line")
    until = note.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sign = F.when(F.col("fences") % 2 == 0, 1).otherwise(-1)
    marked = (
        line_marks(notes)
        .withColumn("fences", F.sum((F.col("fence") > 0).cast("int")).over(until))
        .withColumn("after", F.pmod(sign * F.sum(sign * F.col("fence")).over(until), F.lit(3)))
        .withColumn("before", F.coalesce(F.lag("after").over(note), F.lit(0)))
        .withColumn("in_code", (F.col("before") > 0) | (F.col("after") > 0))
        .withColumn("opens", (F.col("before") == 0) & (F.col("after") > 0))
        .withColumn("closes", (F.col("before") > 0) & (F.col("after") == 0))
        .withColumn("is_heading", ~F.col("in_code") & (F.col("level") > 0))
        .withColumn("is_text", ~F.col("in_code") & (F.col("level") == 0) & ~F.col("blank"))
    )
    # The entry of level L is open exactly when the latest heading of level <= L has level L.
    stack = []
    for level in range(1, 7):
        latest = F.last(F.when(F.col("is_heading") & (F.col("level") <= level), F.struct("level", "heading")), ignorenulls=True)
        stack.append(F.when(latest.over(until)["level"] == level, latest.over(until)["heading"]))
    starts = F.col("is_text") & ~F.coalesce(F.lag("is_text").over(note), F.lit(False))
    shaped = (
        marked.withColumn("section", F.filter(F.array(*stack), lambda h: h.isNotNull()))
        .withColumn("code_no", F.sum(F.col("opens").cast("int")).over(until))
        .withColumn("starts", starts)
        .withColumn("run", F.sum(F.col("starts").cast("int")).over(until))
        .withColumn("rule_next", F.coalesce(F.lead("rule").over(note), F.lit(False)))
    )
    # A run of text lines is a paragraph, or a table up to its first line without a pipe.
    run = Window.partitionBy("uri", "run", "is_text").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = F.first(F.col("pipe") & F.col("rule_next")).over(run) & F.min("pipe").over(run)
    kind = (
        F.when(F.col("in_code"), F.lit("code"))
        .when(F.col("is_heading"), F.lit("heading"))
        .when(~F.col("is_text"), F.lit("blank"))
        .when(table, F.lit("table"))
        .otherwise(F.lit("paragraph"))
    )
    number = F.when(F.col("in_code"), F.col("code_no")).when(F.col("is_heading"), F.col("line")).otherwise(F.col("run"))
    return shaped.withColumn("kind", kind).withColumn("block", number).select(
        "uri", "line", "kind", "block", "section", "language", "opens", "closes", "field", "value"
    )


def blocks(notes: DataFrame) -> DataFrame:
    """(uri, kind, line_start, line_end, section, language, closed) in source lines."""
    return (
        line_structure(notes)
        .where("kind <> 'blank'")
        .groupBy("uri", "kind", "block")
        .agg(
            F.min("line").alias("line_start"),
            F.max("line").alias("line_end"),
            F.min_by("section", "line").alias("section"),
            F.when(F.col("kind") == "code", F.min_by("language", "line")).alias("language"),
            F.when(F.col("kind") == "code", F.bool_or("closes")).alias("closed"),
        )
        .drop("block")
    )


def conditions(notes: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """(uri, field, value, line, origin): fields under condition headings, plus sidecar ones."""
    written = (
        (structure or line_structure(notes))
        .where(
            (F.col("kind") == "paragraph")
            & F.col("field").isNotNull()
            & F.exists("section", lambda title: title.rlike(CONDITION_HEADING))
        )
        .select("uri", "field", "value", "line", F.lit("markdown").alias("origin"))
    )
    if "conditions" not in notes.columns:
        return written
    recorded = (
        notes.select("uri", F.explode("conditions").alias("field", "value"))
        .where(~F.lower(strip(F.col("value"))).isin(*NOT_RECORDED))
        .select("uri", "field", "value", F.lit(None).cast("int").alias("line"), F.lit("recorded_sidecar").alias("origin"))
    )
    return written.unionByName(recorded)


def _open_ranges(texts: Column) -> Column:
    """The ranges of lines outside fences, as array<struct<skip,size>>.

    A fold over the few lines that carry a fence marker. The state is the marker that holds
    the fence open ("" outside), the first line after the last fence, and the ranges so far.
    A marker is a run of one character, so a fence ends at a marker that begins with its own.
    """
    marks = F.filter(
        F.transform(texts, lambda t, i: F.struct(i.alias("line"), F.regexp_extract(t, FENCE, 1).alias("mark"))), lambda m: m["mark"] != ""
    )
    none = F.array().cast("array<struct<skip:int,size:int>>")
    begin = F.struct(F.lit("").alias("held"), F.lit(0).alias("free"), none.alias("ranges"))

    def upto(state: Column, line: Column) -> Column:
        return F.concat(state["ranges"], F.array(F.struct(state["free"].alias("skip"), (line - state["free"]).alias("size"))))

    def step(state: Column, m: Column) -> Column:
        opening = state["held"] == ""
        closing = ~opening & F.startswith(m["mark"], state["held"])
        return F.struct(
            F.when(opening, m["mark"]).when(closing, F.lit("")).otherwise(state["held"]).alias("held"),
            F.when(closing, m["line"] + 1).otherwise(state["free"]).alias("free"),
            F.when(opening, upto(state, m["line"])).otherwise(state["ranges"]).alias("ranges"),
        )

    # What an unclosed fence holds is fenced to the end of the note.
    last = lambda s: F.when(s["held"] == "", upto(s, F.size(texts))).otherwise(s["ranges"])
    return F.aggregate(marks, begin, step, last)


def unfenced_lines(notes: DataFrame) -> DataFrame:
    """(uri, line, text) outside fences."""

    def numbered(texts: Column) -> Column:
        whole = F.transform(texts, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
        piece = lambda w, r: F.slice(w, r["skip"] + 1, r["size"])
        parts = let(whole, lambda w: F.flatten(F.transform(_open_ranges(texts), lambda r: piece(w, r))))
        return F.when(F.exists(texts, lambda t: t.rlike(FENCE)), parts).otherwise(whole)

    # The outer form: a plain inline() would evaluate the array twice.
    return notes.select("uri", F.inline_outer(let(lines(F.col("raw")), numbered))).where("line is not null")


def links(notes: DataFrame, positions: bool = False) -> DataFrame:
    """(uri, line, target): inline, reference-style and automatic links outside fences.

    With ``positions`` also ``at``, the order of a link within its line.

    One pass finds links, references and definitions; a window per (note, label) then
    gives references their definition, so texts are read once and only findings move.
    """

    def item(kind: str, label: Column | None, target: Column | None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), (none if label is None else label).alias("label"), (none if target is None else target).alias("target")
        )

    def either(text: Column, pattern: str, first: int, second: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, first), F.lit("")), F.regexp_extract(text, pattern, second))

    def each(pattern: str, group: int, make) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), make)

    definition = F.array(item("definition", fold(F.regexp_extract("text", DEFINITION, 1)), either(F.col("text"), DEFINITION, 2, 3)))
    uses = F.concat(
        each(INLINE_LINK, 0, lambda m: item("link", None, either(m, INLINE_LINK, 1, 2))),
        each(REFERENCE_LINK, 0, lambda m: item("reference", fold(either(m, REFERENCE_LINK, 2, 1)), None)),
        each(AUTOLINK, 1, lambda m: item("link", None, m)),
    )
    entries = F.when(F.col("text").rlike(DEFINITION), definition).when(F.col("text").rlike(r"[\[<]"), uses)
    found = unfenced_lines(notes).select("uri", "line", F.posexplode_outer(entries).alias("at", "e")).select("uri", "line", "at", "e.*")
    found = found.where("kind is not null")
    is_definition = F.col("kind") == "definition"
    label = Window.partitionBy("uri", "label")
    defined = F.max_by(F.when(is_definition, F.col("target")), F.when(is_definition, F.col("line"))).over(label)
    return (
        found.withColumn("target", F.when(F.col("kind") == "reference", defined).otherwise(F.col("target")))
        .where(~is_definition & (F.col("target") != ""))
        .select("uri", "line", "target", *(["at"] if positions else []))
    )


def plain_links(body: Column) -> Column:
    """Distinct inline link targets of a body, sorted; images are not links."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(PLAIN_LINK), F.lit(1))))


def code_spans(notes: DataFrame) -> DataFrame:
    """(uri, line, mention) for every backtick span."""
    return (
        line_table(notes)
        .where(F.contains("text", F.lit("`")))
        .select("uri", "line", F.explode_outer(F.regexp_extract_all("text", F.lit(CODE_SPAN), F.lit(1))).alias("mention"))
        .where("mention is not null")
    )
