"""SQL fragments for the checks (DuckDB dialect)."""

from __future__ import annotations

from corpusloom.functions.markdown import FIRST_HEADING
from corpusloom.functions.text import BLANKS, FOLDS, LINE_ENDS, WORD

LF = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(BLANKS)})"


def unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def fold(x: str) -> str:
    out = f"lower({x})"
    for char, text in FOLDS.items():
        out = f"replace({out}, {lit(char)}, {lit(text)})"
    return out


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, {lit(WORD)})"


HAS_HEADING = lit(rf"(?m:^)#[{BLANKS}]+[^\n{BLANKS}]")


def first_line(x: str) -> str:
    return strip(f"regexp_extract({strip(x)}, {lit(rf'\A[^{LINE_ENDS}]*')})")


def title(x: str) -> str:
    u = unix(x)
    return (
        f"CASE WHEN regexp_matches({u}, {HAS_HEADING}) THEN {strip(f'regexp_extract({u}, {lit(FIRST_HEADING)}, 2)')} "
        f"ELSE coalesce(nullif({first_line(u)}, ''), 'untitled') END"
    )


def body(x: str) -> str:
    u = unix(x)
    return (
        f"CASE WHEN regexp_matches({u}, {HAS_HEADING}) THEN {strip(f'regexp_replace({u}, {lit(FIRST_HEADING)}, {lit(chr(92) + str(1))})')} "
        f"ELSE {strip(u)} END"
    )


LAYER = "CASE CAST(regexp_extract(source, '[0-9]+') AS INT) % 3 WHEN 0 THEN 'shared' WHEN 1 THEN 'project' ELSE 'candidate' END"

NOTES = f"""
docs AS (
  SELECT *, {LAYER} AS layer, source || '/doc-' || doc_id || '.md' AS relative_path FROM documents
), notes AS (
  SELECT doc_id, lang, source, layer, relative_path, n_chars, text AS raw,
         '/corpus/' || layer || '/' || relative_path AS path,
         'note://resources/' || CASE WHEN layer = 'shared' THEN 'shared/bootstrap' ELSE layer END || '/' || relative_path AS uri,
         {title('text')} AS title, {body('text')} AS body, sha256({unix('text')}) AS source_sha256
  FROM docs
)"""

QUERY_TERMS = f"""
words AS (
  SELECT item_id AS query_id, unnest(w) AS term
  FROM (SELECT item_id, {tokens('text')} AS w FROM benchmark)
), query_terms AS (
  SELECT DISTINCT query_id, term FROM words
)"""


def bm25(weights: dict[str, float] | None = None, aliases: str | None = None) -> str:
    """CTEs ending in scores(query_id, uri, score)."""
    w = weights or {"title": 1.0, "body": 1.0, "aliases": 0.5}
    parts = [f"SELECT uri, unnest({tokens('title')}) AS term, {w['title']} AS w FROM notes", f"SELECT uri, unnest({tokens('body')}) AS term, {w['body']} AS w FROM notes"]
    if aliases:
        parts.append(f"SELECT uri, unnest({tokens(aliases)}) AS term, {w['aliases']} AS w FROM notes")
    return f"""{NOTES}, {QUERY_TERMS},
postings AS (SELECT uri, term, CAST(sum(w) AS DOUBLE) AS tf FROM ({' UNION ALL '.join(parts)}) GROUP BY uri, term),
lengths AS (SELECT uri, sum(tf) AS doc_len FROM postings GROUP BY uri),
facts AS (SELECT (SELECT count(*) FROM notes) AS n, (SELECT sum(doc_len) FROM lengths) / (SELECT count(*) FROM notes) AS mean),
frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scores AS (
  SELECT q.query_id, p.uri, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean))) AS score
  FROM query_terms q JOIN postings p USING (term) JOIN frequencies f USING (term) JOIN lengths l ON l.uri = p.uri, facts
  GROUP BY q.query_id, p.uri
)"""


def ranked(source: str, k: int, name: str = "ranked") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uri) AS rank FROM {source}) WHERE rank <= {k}
)"""
