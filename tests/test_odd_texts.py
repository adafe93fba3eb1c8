"""Queries over notes against their SQL on texts that the given tables do not hold."""

import random

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

WHOLE = [None, "", " ", "\r\n", "　", "#", "# ", "# Only", "#  x \n\n ", "!!!", "\U0001f642", "русский текст", "# \x85A\nrest", "# A\n# B", "password: [redacted:x", "﻿# A\nb"]
PIECES = [
    "token=abcdefgh12345678", "pwd: 10.20.30.41", "token=10.20.30.40", "api_key=192.0.2.77", "secret=203.0.113.5", "passwd=127.0.0.1", "token=localhost", "secret=example.internal", "SECRET=bbbbbbbb",
    "password=abcdefgh%x@mail5.example.com", "token=user@host12.example.io", "token=AAAAAAAAtoken=BBBBBBBB", "étoken=dddddddd", "ToKen=eeeeeeee", "PAſſWD: ffffffff", "xſecret=gggggggg", "apıkey=hhhhhhhh",
    "who@example.net", "WHO@EXAMPLE.NET", "ab@mail3.example.com", "ab@MAIL3.example.com", "cd@mail4.example.com", "éab@mail2.example.ioé", "a@b..cd", "a@b-.cd", "_a@b.cd",
    "10.1.2.3", "é10.1.2.4文", "١٠.1.2.3", "192.0.2.1/24", "198.51.100.7-9", "10.0.0.1-10.0.0.9", "1.2.3.4.5.6.7.8", "x_10.1.2.3", "0.0.0.0",
    "# Head", "İstanbul", "Straße", "文档", "[redacted:", "plain words", "\x0b",
]
GLUE = [" ", "\n", ", ", "", "=", ":", "/", "@", "\r\n", "-"]


def odd_rows(seed, n):
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(PIECES) + rng.choice(GLUE) for _ in range(rng.choice([1, 2, 3, 9]))) for _ in range(n)]
    texts = [*WHOLE, *PIECES, *mixed, *mixed[:20]]
    return [(i, t, rng.choice(["en", "de", "fr", "es", "it", None]), f"src{rng.randrange(20)}" if i % 40 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(odd_rows(1, 300), schema).repartition(3).write.parquet(f"{place}/documents.parquet")
    con = connect(FOLDER)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{place}/documents.parquet/*.parquet')")
    return place, con


@pytest.mark.parametrize("name", ["allowed_findings", "redaction_findings", "redaction_report", "corpus_contract", "public_copies", "public_queue", "streamed_catalog"])
def test_query_matches_its_sql_on_odd_texts(spark, odd, name):
    place, con = odd
    problem, n = compare(entry.queries()[name](spark, place), con, SQL[name])
    assert problem is None and n > 0, problem
