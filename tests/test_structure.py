import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import structure
from corpusloom.operators.excerpts import excerpts, verify_evidence


def notes(spark, *raws):
    return spark.createDataFrame([(f"n{i}", r) for i, r in enumerate(raws)], "uri string, raw string")


def test_fence_states_match_a_sequential_scan(spark):
    rng = random.Random(3)
    raws = ["\n".join(rng.choice(["```", "~~~", "text", "# h", "", "  ```py", "~~~~"]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    rows = structure.line_structure(notes(spark, *raws)).select("uri", "line", "kind").collect()
    got = {(r.uri, r.line): r.kind == "code" for r in rows}
    for i, raw in enumerate(raws):
        opened = None
        for n, line in enumerate(raw.splitlines(), 1):
            mark = line.lstrip()[:3] if line.lstrip().startswith(("```", "~~~")) else None
            inside = opened is not None or mark is not None
            if opened is None:
                opened = mark
            elif mark == opened:
                opened = None
            assert got[(f"n{i}", n)] == inside, (raw, n)


def test_only_lines_outside_fences_are_read_for_links(spark):
    rng = random.Random(5)
    marks = ["```", "````", "`````", "~~~", "~~~~", "  ```py", "    ```", "~~~ ```", "text", "", "`` x", "[a](b)"]
    raws = ["\n".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    raws += ["```\n~~~\n````\nout", "~~~~\n~~~\nin", "```\nin", "a\n```", "```\nx\n```\n```\ny", "```" + "\nx" * 300]
    got = {}
    for r in structure.unfenced_lines(notes(spark, *raws)).collect():
        got.setdefault(r.uri, []).append((r.line, r.text))

    def outside(raw):
        """A fence runs from its marker to the next line whose marker begins with it."""
        texts = raw.splitlines()
        mark = lambda t: (lambda s: s[: len(s) - len(s.lstrip(s[0]))] if len(t) - len(s) <= 3 and s[:3] in ("```", "~~~") else "")(t.lstrip(" ") or "x")
        at, kept = 0, []
        while at < len(texts):
            if held := mark(texts[at]):
                at = next((j for j in range(at + 1, len(texts)) if mark(texts[j]).startswith(held)), len(texts))
            else:
                kept.append((at + 1, texts[at]))
            at += 1
        return kept

    for i, raw in enumerate(raws):
        assert got.get(f"n{i}", []) == outside(raw), raw


def test_blocks_and_sections(spark):
    raw = "# A\np | q\n--|--\nr | s\ntail\n\n### C ###\n## B\nx\n~~~ js \n# no\n```\n"
    rows = structure.blocks(notes(spark, raw)).orderBy("line_start").collect()
    assert [(r.kind, r.line_start, r.line_end, r.section) for r in rows] == [
        ("heading", 1, 1, ["A"]), ("table", 2, 4, ["A"]), ("paragraph", 5, 5, ["A"]), ("heading", 7, 7, ["A", "C"]), ("heading", 8, 8, ["A", "B"]), ("paragraph", 9, 9, ["A", "B"]), ("code", 10, 12, ["A", "B"]),
    ]
    assert (rows[-1].language, rows[-1].closed) == ("js", False)


def test_links(spark):
    raw = "[a](x%20y.md#L1) [b](<p q.md>) [c](u(1).md \"t\")\n[Ref][r] [r] and <https://e.example/x>\n```\n[no](z)\n````\n[d](w)\n\n[R]: <https://d.example/a b>\n[code]: k.py\n"
    found = {(r.line, r.target) for r in structure.links(notes(spark, raw)).collect()}
    assert found == {(1, "x%20y.md#L1"), (1, "p q.md"), (1, "u(1).md"), (2, "https://d.example/a b"), (2, "https://e.example/x"), (6, "w")}


def test_conditions_keep_their_origin(spark):
    df = notes(spark, "# N\n## 条件\n- soc: x1\n- n: 未知\n\n## Other\nk: v\n").withColumn("conditions", F.create_map(F.lit("os"), F.lit("linux"), F.lit("z"), F.lit("unknown")))
    assert {(r.field, r.value, r.line, r.origin) for r in structure.conditions(df).collect()} == {("soc", "x1", 3, "markdown"), ("os", "linux", None, "recorded_sidecar")}


def quoted(spark, raw, query, budget=600):
    df = notes(spark, raw)
    hits = spark.createDataFrame([("q", 1, "n0")], "query_id string, rank int, uri string")
    wanted = spark.createDataFrame([("q", query)], "query_id string, t string").select("query_id", F.array_distinct(tokens(F.col("t"))).alias("wanted"))
    made = excerpts(hits, wanted, df, budget)
    assert verify_evidence(made, df).first().valid is True
    return made.first()


def test_excerpt_keeps_table_header_and_distant_condition(spark):
    raw = "# T\n## Conditions\nsoc: needle910\n\n## Data\n\n| k | v |\n|---|---|\n" + "".join(f"| row{i} | {i} |\n" for i in range(60)) + "| target | 7 |\n"
    row = quoted(spark, raw, "target")
    assert [s.kind for s in row.spans] == ["table_header", "table", "condition"] and "soc: needle910" in row.excerpt and len(row.excerpt) <= 600
    assert row.section == ["T", "Data"]


def test_excerpt_of_long_lines_and_clipped_code(spark):
    line = "pad " * 400 + "needle here " + "tail " * 400
    row = quoted(spark, f"# A\n{line}\n", "needle")
    assert "needle" in row.excerpt and row.truncated and row.column_start > 1 and len(row.excerpt) <= 600
    code = "# A\n```py\n" + "\n".join(f"v{i} = {i}" for i in range(50)) + "\nhit = 1\n" + "\n".join("z" for _ in range(9))
    row = quoted(spark, code, "hit")
    assert row.language == "py" and row.code_clipped is True and row.spans[0].kind == "code"


def test_tampered_evidence_is_refused(spark):
    raw = "# A\nalpha beta\n"
    df = notes(spark, raw)
    row = quoted(spark, raw, "beta")
    kept = row.asDict()
    fields = ("query_id", "uri", "excerpt", "content_sha256", "spans")
    span = "array<struct<line_start:int,line_end:int,column_start:int,excerpt_start:int,excerpt_end:int,kind:string>>"
    base = spark.createDataFrame([tuple(kept[f] for f in fields)], f"query_id string, uri string, excerpt string, content_sha256 string, spans {span}")
    assert verify_evidence(base.withColumn("excerpt", F.concat(F.lit("x"), F.expr("substr(excerpt, 2)"))), df).first().valid is False
    assert verify_evidence(base.withColumn("content_sha256", F.lit("0")), df).first().valid is False
    assert verify_evidence(base.withColumn("uri", F.lit("gone")), df).first().valid is None


@pytest.mark.parametrize("chars", [600, 4800])
def test_query_budget_is_shared_in_rank_order(spark, chars):
    df = notes(spark, *[f"# N{i}\n" + "word " * 200 for i in range(12)])
    hits = spark.createDataFrame([("q", i + 1, f"n{i}") for i in range(12)], "query_id string, rank int, uri string")
    wanted = spark.createDataFrame([("q", ["word"])], "query_id string, wanted array<string>")
    rows = excerpts(hits, wanted, df, chars).orderBy("rank").collect()
    assert sum(len(r.excerpt) for r in rows) <= chars and [r.rank for r in rows] == list(range(1, chars // 600 + 1))
