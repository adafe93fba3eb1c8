"""Text functions against plain Python, on chosen and random strings."""

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.functions import text as tx

ALPHABET = "ab1_./-# \n\r\t\x0b\x85  ßſKİıﬁ中文字é:|"

TOKENS = {
    "": [], "Plain Words": ["plain", "words"], "lib/core.py:12 v1.2+b": ["lib/core.py:12", "v1.2+b"], "-a- .b.": ["a", "b"], "Straße": ["strasse"],
    "中": ["中"], "中文": ["中文"], "x中文字y": ["x", "中文", "文字", "y"], "a_b__c": ["a_b__c"], "é": [],
}
NOTES = {
    "": ("untitled", ""), "\n  \n": ("untitled", ""), "first\nsecond": ("first", "first\nsecond"), "# Head \nrest": ("Head", "rest"),
    "intro\r\n#\tLate\r\nend": ("Late", "intro\n\nend"), "#none\nx": ("#none", "#none\nx"), "## Sub\nx": ("## Sub", "## Sub\nx"),
}


def test_tokens_and_notes_by_example(spark):
    c = F.col("t")
    found = {r.t: r.k for r in spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", tx.tokens(c).alias("k")).collect()}
    assert found == TOKENS
    parsed = spark.createDataFrame([(t,) for t in NOTES], "t string").select("t", md.title_of(c).alias("a"), md.body_of(c).alias("b")).collect()
    assert {r.t: (r.a, r.b) for r in parsed} == NOTES


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=150, max_size=150))
def test_random_texts(spark, texts):
    c = F.col("t")
    rows = (
        spark.createDataFrame([(t,) for t in texts], "t string")
        .select("t", tx.tokens(c).alias("k"), tx.token_count(c).alias("n"), tx.term_counts(tx.tokens(c)).alias("c"), tx.tokens(F.concat_ws(" ", c, c)).alias("twice"), md.title_of(c).alias("title"), md.body_of(c).alias("body"), tx.lines(c).alias("lines"))
        .collect()
    )
    for r in rows:
        # Counts agree with the list, a blank never joins tokens, tokens hold no blank.
        assert r.n == len(r.k) and {e.term: e.tf for e in r.c} == Counter(r.k), r.t
        assert r.twice == r.k + r.k and not any(x.isspace() for k in r.k for x in k), r.t
        assert r.title and r.title == r.title.strip() and r.body == r.body.strip(), repr(r.t)
        assert r.lines == r.t.replace("\r\n", "\n").replace("\r", "\n").splitlines(), repr(r.t)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_weighted_counts(spark):
    parts = [(tx.term_counts(tx.tokens(F.lit("a a b"))), 1.0), (tx.term_counts(tx.tokens(F.lit("a c"))), 0.5)]
    assert {e.term: e.tf for e in one(spark, tx.merge_term_counts(parts).alias("c")).c} == {"a": 2.5, "b": 1.0, "c": 0.5}


def test_identity_and_paths(spark):
    r = one(
        spark,
        md.note_slug(F.lit("Héllo, World!")).alias("a"),
        md.note_slug(F.lit("中文")).alias("b"),
        md.is_safe_relative(F.lit("a/../b")).alias("c"),
        md.is_safe_relative(F.lit("a/b.md")).alias("d"),
        md.is_portable_relative(F.lit("a/con.md")).alias("e"),
        md.uri_for(F.lit("shared"), F.lit("/x\\y")).alias("f"),
        md.layer_from_uri(F.lit("note://resources/project/x.md")).alias("g"),
        md.layer_from_uri(F.lit("note://resources/other/x.md")).alias("h"),
    )
    assert re.fullmatch(r"h-llo-world-[0-9a-f]{12}", r.a) and re.fullmatch(r"entry-[0-9a-f]{12}", r.b)
    assert (r.c, r.d, r.e) == (False, True, False)
    assert r.f == "note://resources/shared/bootstrap/x/y.md" and (r.g, r.h) == ("project", None)


def test_metadata_is_cleaned(spark):
    r = one(
        spark,
        md.clean_conditions(F.create_map(F.lit("a"), F.lit(" x "), F.lit("b"), F.lit("Unknown"), F.lit("c"), F.lit(" "))).alias("c"),
        md.clean_mapping(F.create_map(F.lit(" k "), F.lit("v"), F.lit(" "), F.lit("w"))).alias("m"),
        md.clean_mapping(F.create_map(F.lit("k"), F.lit("unknown"))).alias("none"),
    )
    assert r.c == {"a": "x"} and r.m == {"k": "v"} and r.none is None


def test_enrichment_is_bound_to_the_text_and_scoped(spark):
    aliases = F.from_json(F.lit('[{"text":" one ","relation":"","scope":[]},{"text":"two","relation":"r","scope":["Topic"]},{"text":"bad","scope":["x",""]},{"text":"far","scope":["else"]}]'), md.ALIAS_TYPE)
    given_ = lambda h: F.struct(F.lit(h).alias("source_sha256"), aliases.alias("aliases"), F.array(F.lit("topic "), F.lit("topic"), F.lit("")).alias("topics"))
    r = one(spark, md.bind_enrichment(given_("h"), F.lit("h")).alias("ok"), md.bind_enrichment(given_("old"), F.lit("h")).alias("stale"), md.bind_enrichment(given_(""), F.lit("h")).alias("bare"))
    assert [(a.text, a.relation) for a in r.ok.aliases] == [("one", "related"), ("two", "r"), ("far", "related")] and r.ok.topics == ["topic"] and r.ok.ignored is None
    assert (r.stale.ignored, r.stale.aliases) == ("source_changed", []) and r.bare.ignored == "source_hash_missing"
    kept = spark.range(1).select(md.bind_enrichment(given_("h"), F.lit("h")).alias("b")).select(md.scoped_aliases(F.col("b.aliases"), F.col("b.topics")).alias("s")).first()
    assert kept.s == ["one", "two"]


def test_html_to_text(spark):
    from corpusloom.functions.html import html_to_text

    html = "<h2>T &amp; x</h2><script>no<b></script><table><tr><td>a</td><th>b</th></tr></table><ul><li>i  j</li></ul><pre>k\n  l</pre><template><p>n</p></template>"
    df = spark.createDataFrame([(html,), ("<p>" + "x" * 50,)], "h string")
    rows = df.select(html_to_text(90)(F.col("h")).alias("t")).collect()
    text = rows[0].t.text
    assert "## T & x" in text and " | a | b" in text and "- i j" in text and "````\nk\n  l\n````" in text and "no" not in text and "n" not in text.replace("\n", "").split("l````")[1]
    assert spark.range(1).select(html_to_text(10)(F.lit("<p>" + "x" * 50)).alias("t")).first().t.partial is True


REFERENCES = {
    "&copy; 2024 &middot; caf&eacute; &amp done": "© 2024 · café & done", "&mdash;&hellip;&NotEqualTilde;&Tab;x": "—…≂̸ x", "&copyright &notit; &notin; &nosuch; &; R&D &AMP": "©right ¬it; ∉ &nosuch; &; R&D &",
    "a &nbsp;&#32;&#xA0; b c&nbspd": "a b c d", "&#233;&#xe9;&#XE9 &#128;&#150;&#0;&#xD800;&#x110000;&#99999999999999999999;&#1;&#xFFFE;.": "ééé €–\ufffd\ufffd\ufffd\ufffd.",
    "&am<b>p;</b> &lt;p&gt; &amp;lt; &lt<i>;</i>": "&amp; <p> &lt; <;", "<pre>&copy;&nbsp;<b>&lt</b>  &eacute</pre>": "\n\n````\n© <  é\n````\n",
}


def test_every_character_reference_is_resolved(spark):
    from html import unescape
    from html.entities import html5

    from corpusloom.functions.html import html_to_text

    found = {r.h: r.t.text for r in spark.createDataFrame([(h,) for h in REFERENCES], "h string").select("h", html_to_text()(F.col("h")).alias("t")).collect()}
    assert found == REFERENCES
    # Inside <pre> blanks stay, so every name and number can be held against the library.
    pieces = [f"&{n}" for n in html5] + [f"&{n.rstrip(';')}zz" for n in html5] + [f"&#{n};" for n in (*range(300), 0xFDD0, 0xFFFD, 0x1F600, 0x10FFFF)] + [f"&#x{n:X}" for n in range(300)]
    rows = spark.createDataFrame([(p,) for p in pieces], "p string").select("p", html_to_text()(F.concat(F.lit("<pre>"), "p", F.lit(" </pre>"))).alias("t")).collect()
    assert {r.p: r.t.text[7:-7] for r in rows} == {p: unescape(p) for p in pieces}
