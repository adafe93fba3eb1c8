"""Operators without SQL against brute force, round trips and planted cases."""

import base64
import collections
import hashlib
import math
import random
import re

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import block_anchors, byte_bpe, decontaminate, language_id, license_scan, pseudonyms, set_join, shard_tree, url_filter

FOLDER = "/root/testdata/sf0.001"
RUN = entry.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def name(number):
    return next(k for k in RUN if k.startswith(f"op{number}_"))


# Near-duplicates --------------------------------------------------------------------

def shingle_set(text):
    w = text.encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def family(size, length=120):
    """Texts that drift: each differs from the one before in two words."""
    words = [f"w{i}" for i in range(length)]
    out = []
    for k in range(size):
        words[(k * 37) % length] = f"changed{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("leaf", "members"), [(512, set_join.MEMBERS), (8, set_join.MEMBERS), (512, 900), (8, 400)])
def test_components_match_all_pairs(spark, texts, leaf, members):
    docs = dict(texts) | {10_000 + i: t for i, t in enumerate(family(60))} | {20_000 + i: "same text again" for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.id: (r.component_id, r.n_shingles, r.kept) for r in set_join.group_duplicates(df, leaf=leaf, depth=2, members_most=members).collect()}
    sets = {i: shingle_set(t) for i, t in docs.items()}
    assert found == {i: (c, len(sets[i]), c == i) for i, c in components_of(sets).items()}


def test_stage_links_from_80_percent(spark):
    import corpus_pipeline

    def changed(name, *places):
        return " ".join(f"{name}{'new' if i in places else ''}{i}" for i in range(104))

    pairs = {
        1: changed("a"), 2: changed("a", 30, 60),  # 90 of 110 shingles, 0.818
        3: changed("b"), 4: changed("b", 20, 50, 80),  # 85 of 115, 0.739
        5: " ".join(f"c{i}" for i in range(12)), 6: " ".join(f"c{i}" for i in range(14)),  # 8 of 10
    }
    df = spark.createDataFrame(list(pairs.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, FOLDER).collect()} == {1, 3, 4, 5}
    assert {r.id for r in set_join.group_duplicates(df).filter("kept").collect()} == set(pairs)
    # Fewer agreeing minhashes and more trees at a lower threshold; op2's stay.
    assert [(set_join.agreement(t), set_join.trees_for(t)) for t in (85, 80)] == [(28, 8), (24, 10)]


# Substrings -------------------------------------------------------------------------

@pytest.mark.parametrize("group_bytes", [20_000, 12_000_000])
def test_repeats_match_all_windows(spark, texts, group_bytes):
    docs = dict(texts)
    shared = " ".join(f"s{i}" for i in range(73))
    for i in range(30):
        docs[5_000 + i] = " ".join(f"d{i}x{j}" for j in range(i * 3)) + " " + shared + " end " + shared
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    first = {}
    for i in sorted(docs):
        w = docs[i].split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for r in block_anchors.remove_repeats(df, group_bytes=group_bytes).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.id])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.get(tuple(w[k : k + 50]), r.id) < r.id:
                gone[k : k + 50] = [True] * 50
        assert (r.n_words, r.kept) == (len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g))


# Decontamination --------------------------------------------------------------------

def test_leaks_survive_substitution(spark):
    item = [f"q{i}" for i in range(30)]
    damaged = [f"other{i}" if i % 6 == 5 else w for i, w in enumerate(item)]
    rows = [
        (1, "before " + " ".join(item).upper() + ", after"), (2, "x " * 50 + " ".join(damaged)), (3, " ".join(item[:9])),
        (4, " ".join(reversed(item))), (5, None), (6, "tiny item"), (7, " ".join(item[10:24])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "Tiny, item!"), (3, None)], "item_id long, text string")
    found = {(r.id, r.item_id) for r in decontaminate.find_leaks(docs, tests).collect()}
    assert found == {(1, 1), (2, 1), (7, 1), (6, 2)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, tests).collect()} == {3, 4, 5}


def test_blocks_of_a_large_benchmark_change_nothing(spark, monkeypatch):
    docs, tests = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    once = {tuple(r) for r in decontaminate.find_leaks(docs, tests).collect()}
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 1_500)
    assert once and once == {tuple(r) for r in decontaminate.find_leaks(docs, tests).collect()}


def test_whole_items_are_found(spark, texts):
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    expected = {(d, i) for d, t in texts.items() for i, b in items.items() if b in plain(t)}
    assert expected <= {(r.doc_id, r.item_id) for r in RUN[name(3)](spark, FOLDER).collect()}


# Licenses ---------------------------------------------------------------------------

def test_phrases_and_templates(spark, texts):
    docs = dict(texts) | {
        9_001: "CC BY, cc by-nc. General Public License; all rights reserved all rights reserved",
        9_002: "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        9_003: "\u212a cc\u00e9 by general public licenses",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(df, license_scan.template_grams(spark)).collect()}
    for i, text in docs.items():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(k, label) for label, p in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        spots = [k for k, _ in at]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(spots, default=None), max(spots, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert rows[9_002].labels == "mit" and 0.8 <= rows[9_002].score < 1.01


# Byte-level BPE ---------------------------------------------------------------------

def test_tokens_equal_the_library(spark, texts):
    path = public_tokenizers.path(byte_bpe.RANKS)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = dict(list(texts.items())[:60]) | {
        7_001: "it's \u00a0 \u3000x  \n\n y\u0301 \U0001f600\U0001f600 \u4f60\u597d\u4e16\u754c 12345 <|endoftext|> \ue000a\ue001 \x00\x01", 7_002: "a" * 400, 7_003: " \t ",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    vocabulary = byte_bpe.Vocabulary.load(path, public_tokenizers.PATTERN)
    for r in byte_bpe.digests(df, vocabulary).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_rank_map_answers_in_one_place():
    ranks = byte_bpe.Vocabulary.load(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN).ranks
    pairs = {(ranks[t[:k]], ranks[t[k:]]): rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    single = [ranks[bytes([b])] for b in range(256)]
    table, begin = byte_bpe._rank_map(pairs, single)
    table = table.tolist()
    some = random.Random(5)
    other = [(some.randrange(len(ranks)), some.randrange(len(ranks))) for _ in range(50_000)]
    for left, right in [*pairs, *other, (byte_bpe.NONE, 0), (0, byte_bpe.NONE), (len(ranks) - 1, byte_bpe.NONE)]:
        entry = table[table[left] + right]
        rank = (entry - left) // byte_bpe.RANK if entry % byte_bpe.PLACE == left else byte_bpe.NONE
        assert rank == pairs.get((left, right), byte_bpe.NONE)
    for a in (0, 32, 101, 255):
        for b in range(256):
            assert table[begin + 257 * a + b] == pairs.get((single[a], single[b]), byte_bpe.NONE) * byte_bpe.RANK + single[a]


# Pseudonyms -------------------------------------------------------------------------

def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def replaced(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymise(df).orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_and_link(spark):
    values = ["on 4111 1111 1111 1111.", "4111 1111 1111 1111", "reach +1 (212) 555-0182", "born 2001-03-04, 31.12.1980", "10.20.30.250", "jo.smith7@mail.example.org", "GB82WEST12345698765432"]
    new = replaced(spark, values)
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", t)))
    assert all(a != b for a, b in zip(values, new, strict=True))
    assert [shape(v) for i, v in enumerate(values) if i != 4] == [shape(v) for i, v in enumerate(new) if i != 4]
    assert luhn(new[1]) % 10 == 0 and new[0] == f"on {new[1]}."
    assert all(0 <= int(x) <= 255 for x in new[4].split("."))
    turned = new[6][4:] + new[6][:4]
    assert int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def test_look_alikes_stay(spark):
    values = ["4111111111111112", "999.10.10.10", "2021-02-30", "a@b", "year 2020 and 12-34", "GB00WEST12345698765432"]
    assert replaced(spark, values) == values


def test_feistel_is_a_permutation(spark):
    df = spark.range(10 * 26 * 7).select(F.array(F.floor(F.col("id") / 182) % 10, F.floor(F.col("id") / 7) % 26, F.col("id") % 7).cast("array<int>").alias("d"))
    df = df.select("d", pseudonyms.feistel(F.col("d"), F.array(F.lit(10), F.lit(26), F.lit(7)), "k").alias("e"))
    rows = df.collect()
    assert {tuple(r.d) for r in rows} == {tuple(r.e) for r in rows} and sum(r.d == r.e for r in rows) < 20


def test_planted_data_is_gone(spark, texts):
    found = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}")
    rows = {r.doc_id: r.text for r in RUN[name(7)](spark, FOLDER).collect()}
    planted = [(i, v) for i, t in texts.items() for v in found.findall(t)]
    assert planted and not [v for i, v in planted if v in rows[i]]
    assert all(rows[i] == t for i, t in texts.items() if not re.search(r"[0-9@=]", t))


# Languages --------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in RUN[name(4)](spark, folder).collect() if r.held_out]
    right = sum(truth[r.doc_id] == r.lang_pred for r in rows)
    assert right >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_nothing_learned_is_unknown(spark):
    docs = spark.createDataFrame([(0, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.fit(docs) is None
    assert language_id.identify(docs, None).first().lang_pred == "und"


# Addresses --------------------------------------------------------------------------

def test_address_parts_and_rules(spark):
    urls = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("x://org/fr/1", "org", "/fr/1", "org/fr/", "allow"),
        ("http://foo.net", "foo.net", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(len(urls))] == [u[1:] for u in urls]


def test_counts_and_scores_match_a_plain_model(spark):
    pages = [f"https://site{i % 7}.example.com/en/{i * 17 % 900}" for i in range(150)] + [f"http://casino-{i % 5}.example.com/win/{i}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    host, path = url_filter.address_parts(F.col("url"))
    parts = df.select(host.alias("host"), url_filter.symbols(host, path).alias("text"))
    ratio, limit = url_filter.fit(parts)
    import zlib

    plain = {"accept": collections.defaultdict(collections.Counter), "reject": collections.defaultdict(collections.Counter)}
    for r in parts.collect():
        if zlib.crc32(r.text.encode()) % url_filter.HELD_OUT:
            padded = url_filter.START * 4 + r.text
            for i in range(4, len(padded)):
                for k in range(5):
                    plain["reject" if "casino" in r.host else "accept"][padded[i - k : i]][padded[i]] += 1

    def probability(label, context, symbol):
        p = 1 / 96
        for k in range(len(context) + 1):
            seen = plain[label][context[len(context) - k :]]
            if seen:
                p = (seen[symbol] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    for text in ("site1.example.com/en/3", "casino-9.example.com/win/x", "zz"):
        padded = url_filter.START * 4 + text
        logs = [math.log(probability("accept", padded[i - 4 : i], padded[i]) / probability("reject", padded[i - 4 : i], padded[i])) for i in range(4, len(padded))]
        assert ratio.score(text) == pytest.approx(sum(logs) / len(logs))
    judged = url_filter.judge(df).collect()
    assert limit is not None and all((r.verdict == "block") == ("casino" in r.host) for r in judged)


@pytest.mark.parametrize("fast", [2_000, 300_000])
def test_all_contexts_count(spark, monkeypatch, fast):
    """More contexts than 50,000, and grams within and outside the broadcast."""
    import random
    import zlib

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=16))
    urls = [f"http://h.example.com/{word()}" for _ in range(6_000)] + [f"http://casino.example.com/{word()}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    follow = {x: collections.defaultdict(collections.Counter) for x in (False, True)}
    for url in urls:
        text = url[7:]
        if zlib.crc32(text.encode()) % url_filter.HELD_OUT:
            padded = url_filter.START * 4 + text
            for i in range(4, len(padded)):
                for k in range(5):
                    follow["casino" in text][padded[i - k : i]][padded[i]] += 1
    assert len(follow[False]) > 50_000

    def logs(spam, context, symbol):
        p = 1 / 96
        for k in range(5):
            if seen := follow[spam].get(context[4 - k :]):
                p = (seen[symbol] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return math.log(p)

    monkeypatch.setattr(url_filter, "FAST", fast)
    rows = url_filter.judge(df).collect()
    assert len(rows) == len(urls)
    for r in rows:
        padded = url_filter.START * 4 + r.url[7:]
        steps = [logs(False, padded[i - 4 : i], padded[i]) - logs(True, padded[i - 4 : i], padded[i]) for i in range(4, len(padded))]
        assert r.score == pytest.approx(sum(steps) / len(steps), abs=1e-9)


def test_threshold_over_all_kept_out_addresses(spark):
    import random

    def plain(rows):
        """The lowest cut with the fewest errors, by trying each."""
        values = sorted({v for v, _ in rows})
        cuts = [values[0] - 1.0] + [(x + y) / 2 for x, y in zip(values, [*values[1:], values[-1] + 2.0], strict=True)]
        n = {ok: sum(k == ok for _, k in rows) for ok in (True, False)}
        errors = lambda cut: sum(v < cut for v, ok in rows if ok) * n[False] + sum(v > cut for v, ok in rows if not ok) * n[True]
        return min(cuts, key=lambda cut: (errors(cut), cut))

    rng = random.Random(3)
    many = [(rng.choice([rng.gauss(m, 0.002), round(rng.gauss(m, 1), 1)]), ok) for ok, m in ((True, 0.5), (False, -0.1)) for _ in range(200)]
    for rows in (many, [(1.0, False), (0.0, True)], [(0.0, False), (3.0, True), (3.0, False)]):
        df = spark.createDataFrame([(v, "accept" if ok else "reject") for v, ok in rows], "score double, label string")
        assert url_filter.threshold(df) == pytest.approx(plain(rows))


def test_no_rejected_address_kept_out(spark):
    import zlib

    kept_out = lambda text: zlib.crc32(text.encode()) % url_filter.HELD_OUT == 0
    spam = [t for t in (f"casino-{i}.example.com/win/{i}" for i in range(60)) if not kept_out(t)][:8]
    urls = ["http://" + t for t in [*(f"site{i % 7}.example.com/en/{i * 17 % 900}" for i in range(150)), *spam]]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert all(r.verdict == "block" for r in rows if "casino" in r.host) and any(r.verdict == "allow" for r in rows)


# Sharding ---------------------------------------------------------------------------

def test_growth_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(20_000)
    for n in (16, 17, 23):
        both = shard_tree.assign(shard_tree.assign(df, F.col("id"), shard_tree.layout(n)), F.col("id"), shard_tree.layout(n + 1), "grown")
        counts = {(r.shard, r.grown): r["count"] for r in both.groupBy("shard", "grown").count().collect()}
        assert all(a == b or b == n for a, b in counts)
        moved = sum(c for (a, b), c in counts.items() if a != b)
        assert abs(moved - 20_000 / (n + 1)) < 250


def test_weight_changes_stay_inside_their_subtree(spark):
    old = shard_tree.layout(16)
    new = [shard_tree.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else x.weight) for x in old]
    both = shard_tree.assign(shard_tree.assign(spark.range(20_000), F.col("id"), old), F.col("id"), new, "after")
    for r in both.filter("shard != after").select("shard", "after").distinct().collect():
        a, b = old[r.shard], old[r.after]
        # Between regions only into the heavier region, between its racks only into the
        # heavier rack, inside that rack only into the heavier shard.
        assert b.region == 0 and (a.region != b.region or b.rack == 1) and (a.rack != b.rack or b.shard == 5)


def test_slots_are_gapless_with_repeated_rows(spark):
    df = spark.range(3_000).select((F.col("id") % 700).alias("doc_id"), (F.col("id") % 3).cast("int").alias("shard"))
    rows = shard_tree.number_rows(df).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 3_000 and all(sorted(v) == list(range(len(v))) for v in by.values())
