"""The secret scan against plain loops, and the models on strings they never saw."""

import base64
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import secret_scan as S

BASE = [
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
KEYS = "A-Za-z0-9+/_=-"


def plain_base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, good) in enumerate(BASE) for m in pattern.finditer(text or "") if good(m)]
    return sorted(found)


def classes(value):
    return sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]"))


def plain_model(texts):
    """Ratio per (before, after) and the threshold, from all labelled strings."""
    ordinary, unlike = set(), set()
    for text in texts:
        text = text or ""
        for run in re.findall(f"[{KEYS}]+", text):
            if len(run) >= 8 and re.fullmatch(r"[A-Za-z]+([_/-][A-Za-z]+)*[0-9]{0,4}", run):
                ordinary.add(run)
        unlike |= {m[1] for m in BASE[0][1].finditer(text) if len(m[1]) >= 16 and classes(m[1]) >= 2}
        unlike |= {m[0] for _, pattern, good in BASE[1:] for m in pattern.finditer(text) if good(m)}
    ordinary -= unlike

    def forms(word):
        if not re.fullmatch("[A-Za-z]+", word):
            return [word]
        made = [word.lower() + word[0].upper() + word[1:].lower(), word + str(zlib.crc32(word[::-1].encode()) % 10_000), *[word + j + word for j in "_-/."]]
        return [word, made[zlib.crc32(word.encode()) // 10 % 6]]

    held = lambda w: zlib.crc32(w.encode()) % 10 == 0
    tables = []
    for words, uniform in (({w for w in unlike if not held(w)}, 0.5), ([f for w in ordinary if not held(w) for f in forms(w)], 0.0)):
        pairs = [(b, a) for w in words for b, a in zip(["", *w], w)]
        count = lambda key: sum(1 for p in pairs if key(p))
        plain = {a: (count(lambda p, a=a: p[1] == a) + 1) / (len(pairs) + 68) for a in S.ALPHABET}
        seen = {b: count(lambda p, b=b: p[0] == b) for b in ["", *S.ALPHABET]}
        tables.append({(b, a): math.log(uniform / 68 + (1 - uniform) * (pairs.count((b, a)) + 50 * plain[a]) / (seen[b] + 50)) for b in ["", *S.ALPHABET] for a in S.ALPHABET})
    ratios = {k: round(tables[0][k] - tables[1][k], 6) for k in tables[0]}
    score = lambda w: sum(ratios[b, a] for b, a in zip(["", *w], w)) / len(w)
    scores = sorted((math.floor(score(f) / 0.01) for w in ordinary if held(w) for f in forms(w)), reverse=True)
    spare, threshold = 0.001 * len(scores), 0.5
    if len(scores) > spare:
        threshold = max(0.5, (scores[int(spare)] + 1) * 0.01)
    return score, round(threshold, 6)


def plain_spans(text, score, threshold):
    base = plain_base(text)
    runs = [m for m in re.finditer(f"[{KEYS}]{{20,}}", text or "") if classes(m[0]) >= 2 and score(m[0]) > threshold]
    return base, [(m.start(), 3, m.end(), "random") for m in runs if all(m.end() <= s or e <= m.start() for s, _, e, _ in base)]


def some_texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "Quarterly", "overview", "of", "measurements", "naïve", "snake_case_names", "path/to/folder", "release-notes2024", "é" * 3]
    digest = lambda: hashlib.sha256(str(rng.random()).encode())
    made = [
        lambda: f'token = "{digest().hexdigest()[:40]}"', lambda: "PASSWORD: hunter2", lambda: f"api_key='{base64.b64encode(digest().digest()).decode()}'",
        lambda: "AKIA" + "".join(rng.choices("ABCDEF0123456789", k=rng.choice([5, 12, 16]))), lambda: base64.b64encode(digest().digest())[:30].decode(),
        lambda: digest().hexdigest()[: rng.choice([31, 32, 64])], lambda: "token:token:abcdefghij", lambda: "secret==" + "x" * 9, lambda: "someVeryLongCamelCaseName2024",
    ]
    return [" ".join(rng.choice(made)() if rng.random() < 0.15 else rng.choice(words) for _ in range(rng.choice([0, 3, 30, 90]))) for _ in range(n)]


def listed(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))


def test_query_equals_plain_loops(spark, place):
    texts = [*some_texts(120, 1), None, "", " \n", "𝒳 é token = 'abcdefgh1234' 𝒳", "deadbeef" * 300, ("0" * 33 + " ") * 400, "x" * 40_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same"), (None, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.withColumns({c: F.lit("x") for c in ("secrets", "word", "random", "held", "value", "spans")}).write.parquet(f"{place}/documents.parquet")
    score, threshold = plain_model(texts)
    model = S.fit(docs)
    assert model.threshold == threshold
    expected = []
    for doc_id, text in rows:
        base, added = plain_spans(text, score, threshold)
        count = lambda kind: sum(b[3] == kind for b in base)  # noqa: E731, B023
        expected.append((doc_id, count("assign"), count("access"), count("hex"), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)))
    assert sum("random" in e[5] for e in expected) > 20
    got = [tuple(r) for r in S.op11_secret_models(spark, place).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_no_labels_no_reports_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x9K2mQ7vLpR4tYwZ8bNcD3fGhJ1s")], "doc_id long, text string")
    model = S.fit(docs.filter("false"))
    assert S.scan(docs, model).first().secrets.added == []
    assert S.scan(docs.filter("false"), model).count() == 0


@pytest.mark.parametrize("n", [1, 64, 65, 1000])
def test_running_results(spark, n):
    values = [(7 * i) % 13 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    row = df.select(S._running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), S._running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(0)).alias("m")).first()
    assert row.s == [sum(values[: i + 1]) for i in range(n)] and row.m == [max(values[: i + 1]) for i in range(n)]


def test_models_tell_unseen_strings_apart(spark):
    model = S.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(4)
    digits = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    unlike = [(i, "key " + digits(24)) for i in range(300)]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(50).collect()]
    words = sorted(set(re.findall("[a-z]{3,9}", " ".join(texts))))
    joints = [lambda a, b: a + b.title(), lambda a, b: a + "_" + b, lambda a, b: f"{a}/{b}", lambda a, b: f"{a}-{b}"]
    names = []
    for i in range(400):
        a, b, c = rng.choices(words, k=3)
        join = rng.choice(joints)
        names.append((1000 + i, f"call {join(join(a, b), c) + 'Name' + str(rng.randrange(1000)):_<20} now"))
    found = {r.doc_id for r in S.scan(spark.createDataFrame(unlike + names, "doc_id long, text string"), model).collect() if r.secrets.added}
    assert len([i for i in found if i < 1000]) >= 290
    assert len([i for i in found if i >= 1000]) <= 8
