"""Each operator against a plain Python version, on whole small tables and on edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from crashlens.llm.chat import render_chats
from crashlens.llm.decontaminate import clean, contaminated
from crashlens.llm.line_dedup import dedup_lines
from crashlens.llm.minhash import near_duplicates
from crashlens.llm.mixing import mix
from crashlens.llm.quality import judge
from crashlens.llm.sharding import byte_shards
from crashlens.llm.substrings import remove_repeats
from crashlens.llm.tokens import Automaton, read_vocabulary, token_counts
from crashlens.llm.urls import filter_urls
from tests.llm import brute
from tests.llm.conftest import DOC_SCHEMA, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def pairs(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# -- line dedup ---------------------------------------------------------------------------

def _lines(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.text)) for r in dedup_lines(df).collect()}


def test_lines_whole_table(table, pairs):
    assert _lines(table) == brute.line_dedup(pairs)


def test_lines_planted(make_docs):
    line = "This line of License text has well over Forty characters"
    rows = [(i, f"{prose(i, 20)}\n  {line.upper() if i % 2 else line}\t\n{line}\nshort") for i in range(9)]
    rows += [(20, None), (21, ""), (22, f"{prose(50, 30)}\n" * 3), (23, "a\n\nb\n")]
    got = _lines(make_docs(rows))
    assert got == brute.line_dedup(rows)
    assert got[8][1] == 0 and got[7][1] == 2 and got[20][:2] == (1, 0)


def test_lines_edges(make_docs, edge_rows, empty):
    assert dedup_lines(empty).collect() == []
    rows = dedup_lines(make_docs(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    line = "a line of text that has more than forty characters in it"
    got = dedup_lines(make_docs([(i, line) for i in (1, 2, 3, 4, 4, 5, 5, None)])).collect()
    assert Counter((r.doc_id, r.n_dropped) for r in got) == Counter(
        [(1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (5, 0), (5, 0), (None, 1)])


# -- chats --------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def test_chats_keep_maximal(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    convs = {1: a[:2], 2: a, 3: a[:1], 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: a[1:]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    got = {r.conv_id: r for r in render_chats(spark.createDataFrame(rows + rows[:3], CHAT)).collect()}
    assert sorted(got) == [2, 5, 6]
    assert got[5].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert got[2].n_turns == 4


def test_chats_edges(spark):
    assert render_chats(spark.createDataFrame([], CHAT)).collect() == []
    rows = [(1, 0, None, None), (1, None, "user", "x"), (None, 0, "user", "y"), (None, 0, "user", "y"), (2, 5, "user", "y")]
    got = render_chats(spark.createDataFrame(rows, CHAT + "").selectExpr("*", "1 as place", "2 as a", "3 as conv")).collect()
    # the null conversation equals conversation 2, whose id comes first
    assert {r.conv_id: r.n_turns for r in got} == {1: 2, 2: 1}


def test_long_chat_in_parts_and_blocks(spark):
    rows = [(c, i, "user", f"t{i}") for c, n in ((1, 2500), (2, 2400)) for i in range(n)]
    got = sorted(render_chats(spark.createDataFrame(rows, CHAT)).collect(), key=lambda r: (r.conv_id, r.part))
    assert [(r.conv_id, r.part) for r in got] == [(1, p) for p in range(5)]
    assert "".join(r.rendered for r in got) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(2500))


# -- tokens -------------------------------------------------------------------------------

def test_automaton_is_greedy_longest_match():
    r = random.Random(3)
    for _ in range(300):
        pieces = {tuple(r.choice((97, 98, 256)) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 9))}
        a = Automaton(sorted(pieces))
        for _ in range(20):
            word = [r.choice((97, 98)) for _ in range(r.randint(1, 9))]
            assert a.count(bytes(word)) == brute.greedy_pieces(word, pieces, 256)


def test_token_counts(table, pairs):
    pieces = read_vocabulary()
    known = set(pieces)
    some = {i: t for i, t in pairs[:40]}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(table).select("row.doc_id", "k.*").collect()}
    for i, t in some.items():
        w = brute.words(brute.lower(t))
        assert got[i] == (len(w), sum(brute.greedy_pieces(x.encode(), known, 256) for x in w))


def test_token_edges(make_docs, edge_rows, empty):
    assert token_counts(empty).collect() == []
    got = token_counts(make_docs(edge_rows)).select("row.doc_id", "row.k1", "k.*").collect()
    assert len(got) == len(edge_rows) and [r.n_tokens for r in got[:3]] == [0, 0, 0] and got[0].k1 == "x"
    for r, (_, t) in zip(got, edge_rows, strict=True):
        assert r.n_words == len(brute.words(t))


# -- shards -------------------------------------------------------------------------------

def test_shards_are_balanced_and_contiguous(table, pairs):
    rows = byte_shards(table).orderBy("doc_id").collect()
    size = {i: len((t or "").encode()) + 1 for i, t in pairs}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in pairs}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (size[i], crc[i]) for i in size}
    shards = [r.shard for r in rows]
    assert shards == sorted(shards)
    load, target, most = Counter(), sum(size.values()) / 16, max(size.values())
    for r in rows:
        load[r.shard] += r.size
    assert all(abs(load[s] - target) <= most for s in range(16))
    for s in range(16):
        assert [r.slot for r in rows if r.shard == s] == list(range(shards.count(s)))


def test_shard_edges(make_docs, edge_rows, empty):
    assert byte_shards(empty).collect() == []
    rows = byte_shards(make_docs(edge_rows), n_shards=3, carry=("lang", "size")).collect()
    assert len(rows) == len(edge_rows) and {r.row.size for r in rows} == {"x"}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


# -- urls ---------------------------------------------------------------------------------

def test_url_rules(spark):
    urls = ["https://A.Example.NET/en/1?x#y", "http://example.net/fr/1", "http://xexample.com/de/1", "http://example.com/de/2",
            "http://b.example.com/de", "ftp://x.org/fr/?q", "http://org/fr/1", "http://x.net", "http://net/", None, "", "nothing",
            "a://b://c/d", "http://x.org/fr\n/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 as u", "2 as host")
    got = [r for r in filter_urls(df).select("row.page_id", "u.*").orderBy("page_id").collect()]
    assert [r.rule for r in got] == ["example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", "org/fr/", None, "net/",
                                     None, None, None, None, None]
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/1") and got[1].verdict == "block" and got[5].verdict == "allow"
    assert (got[9].host, got[9].path, got[9].score) == ("", "", 0.0) and (got[12].host, got[12].path) == ("b:", "//c/d")
    assert {r.verdict for r in got} <= {"allow", "block"}


def test_url_model_learns(spark):
    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.example.net/en/{word('abcde')}") for i in range(300)]
    rows += [(i, f"http://{word('vwxyz')}.net/{word('vwxyz')}") for i in range(300, 600)]
    rows += [(i, f"http://{word('abcde')}.com/{word('abcde')}") for i in range(600, 650)]
    rows += [(i, f"http://{word('vwxyz')}.com/{word('vwxyz')}") for i in range(650, 700)]
    got = {x.page_id: x.verdict for x in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).select("row.page_id", "u.verdict").collect()}
    right = sum(got[i] == "allow" for i in range(600, 650)) + sum(got[i] == "block" for i in range(650, 700))
    assert right >= 95


def test_url_model_counts_are_exact(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    urls = [f"http://{word()}{end}{word()}" for end in (".example.net/en/", ".net/", ".com/") for _ in range(1500)]
    got = {x.url: x.score for x in filter_urls(spark.createDataFrame([(u,) for u in urls + urls[:100]], "url string")).select("row.url", "u.score").collect()}
    verdicts = {x.url: x.verdict for x in filter_urls(spark.createDataFrame([(u,) for u in urls], "url string")).where("u.rule is not null").select("row.url", "u.verdict").collect()}
    rests = spark.createDataFrame([(u, u[7:]) for u in urls], "url string, text string").selectExpr("url", "pmod(xxhash64(text), 5) = 0 as held").collect()
    held = {x.url for x in rests if x.held}
    want = brute.url_scores([(u[7:], verdicts[u]) for u in urls + urls[:100] if u in verdicts and u not in held], [u[7:] for u in urls])
    assert len({g for u in urls for g in brute.url_grams(u[7:])}) > 1 << 16
    assert max(abs(got[u] - want[u[7:]]) for u in urls) < 2e-9


def test_url_empty(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


# -- quality ------------------------------------------------------------------------------

def test_quality_base_counts(table, pairs):
    rows = judge(table).select("row.doc_id", "q.*").collect()
    for r, text in ((r, dict(pairs)[r.doc_id]) for r in rows):
        base = brute.base_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)


def test_quality_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = judge(docs).select("row.doc_id", "q.*").join(labels, "doc_id").where("not base_failed").collect()
    good, junk = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert all(good) and sum(junk) < 0.5 * len(junk)


def test_quality_edges(make_docs, edge_rows, empty):
    assert judge(empty).collect() == []
    for lang in ("en", None, "xx"):
        rows = judge(make_docs(edge_rows, lang=lang)).select("row.doc_id", "row.q", "q.*").collect()
        assert {r[1] for r in rows} == {"x"}
        assert Counter((r[0], tuple(r)[2:7]) for r in rows) == Counter((i, brute.base_quality(t)) for i, t in edge_rows)  # rows have no order


def test_quality_of_languages_without_a_list(spark):
    """A minority script beside junk of another language: each language is held against its own documents."""
    r = random.Random(6)

    def text(letters, n=120):
        return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(n)) + "."

    rows = [(i, text("aeioulnrstcdpm"), "it", "s", 1) for i in range(80)]
    rows += [(100 + i, text("аеиоулнрстквдпм"), "ru", "s", 1) for i in range(20)]
    rows += [(200 + i, text("0123456789#$%&*|<>"), "it", "s", 1) for i in range(50)]
    rows += [(300 + i, text("аеиоулнрстквдпм"), None, "s", 1) for i in range(9)]
    kept = {x[0] for x in judge(spark.createDataFrame(rows, DOC_SCHEMA)).where("q.kept").select("row.doc_id").collect()}
    assert kept == {i for i, *_ in rows if not 200 <= i < 300}


def test_quality_without_any_near_document(spark):
    """Half the rows are of one kind, half of another: no document is near the medians, so all are rejected, not kept."""
    rows = [(i, " ".join(("1" if i % 2 else "#") * (3 + k) for k in range(60 + i)), "xx", "s", 1) for i in range(10)]
    got = judge(spark.createDataFrame(rows, DOC_SCHEMA)).select("q.*").collect()
    assert not any(x.base_failed for x in got) and not any(x.kept for x in got)
    assert all(0.28 < x.char_distance <= 1 for x in got)


# -- decontamination ----------------------------------------------------------------------

def test_leaks_whole_table(spark, table, pairs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    want = {(i, k) for i, t in pairs for k, x in plain.items() if x in " ".join(t.split())}
    got = {(r.doc_id, r.item_id) for r in contaminated(table, items).collect()}
    assert want <= got and {i for i, _ in got} == {i for i, _ in want}
    assert clean(table, items).count() == len(pairs) - len({i for i, _ in got})


QUESTION = "Alice has 12 apples and buys 7 more apples at 3 km from the old town market. How many apples does Alice carry home today?"


def test_leaks_templates(spark, make_docs, edge_rows, empty):
    items = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    anew = QUESTION.replace("Alice", "Robert").replace("12", "45").replace("7", "9").replace("km", "miles")
    mixed = QUESTION.replace("Alice", "Robert", 1)  # Alice meets two names
    rows = [(1, prose(1, 50) + " " + QUESTION + " " + prose(2, 50)), (2, prose(3, 30) + "\n" + anew), (3, mixed), (4, prose(4, 200)),
            (1, QUESTION), (None, QUESTION), *[(i, t) for i, t in edge_rows if i and i > 4]]
    got = contaminated(make_docs(rows), items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (1, 1), (2, 1), (None, 1)])
    assert contaminated(empty, items).collect() == [] and contaminated(make_docs(rows), items.limit(0)).collect() == []
    left = clean(make_docs(rows), items)
    assert left.count() == len(rows) - 4 and "t1" in left.columns


def test_leaks_at_every_offset(spark, make_docs):
    names = "Ann 5 Bob 6 Eve 7 Tim 8"  # windows over these have too few plain words
    items = [(n, " ".join("xyz"[n - 8] + 3 * chr(97 + k) for k in range(n))) for n in (8, 9, 10)]
    items.append((20, f"{names} how many red apples are left {names}"))
    rows = [(10 * n + at, prose(n, 20 + at) + " " + x + " " + prose(n + 1, 20)) for n, x in items for at in range(4)]
    got = contaminated(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter((10 * n + at, n) for n, _ in items for at in range(4))


def test_leaks_verbatim(spark, make_docs):
    short, sums, long = "What is the capital of Peru?", "12 + 7 = 19", prose(8, 59).translate(str.maketrans("0123456789", "abcdefghij"))
    many = "Ann 5 Bob 6 Eve 7 Tim 8 Kim 9 Lea 3 Max 4 Zoe 2"  # no window has four plain words
    part = " ".join(long.split()[30:55])
    items = spark.createDataFrame([(1, short), (2, sums), (3, long), (4, many), (5, "...")], "item_id long, text string")
    rows = [(1, f"Well: {short} Lima."), (2, "so - 12 + 7 = 19."), (3, "so 12 - 7 = 19"), (4, f"{prose(9, 33)} {part} {prose(10, 40)}"),
            (5, f"{prose(11, 9)} {many}, {prose(12, 9)}"), (6, many.replace("6", "1").replace("Lea", "Pia")),
            (7, "What is the capital of Chile?"), (8, f"{prose(13, 9)} {' '.join(long.split()[40:46])} {prose(14, 9)}")]
    got = contaminated(make_docs(rows), items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (2, 2), (4, 3), (5, 4)])
    assert {r.doc_id: r.cover < 0.5 for r in got} == {1: False, 2: False, 4: True, 5: False}


# -- near duplicates ----------------------------------------------------------------------

def _groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_near_duplicates_whole_table(table, pairs):
    assert _groups(table) == brute.near_groups(pairs)


def test_near_duplicates_planted(make_docs):
    r, rows = random.Random(7), []
    for g in range(12):  # families around the threshold, with chains
        words = prose(100 + g, 120).split()
        for k in range(12):
            copy = list(words)
            for _ in range(r.randrange(9)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(copy).upper() if k % 3 == 0 else " ".join(copy)))
            if k % 4 == 0:
                words = copy
    passage = prose(999, 80)
    rows += [(5000 + i, f"{prose(2000 + i, 150)} {passage}") for i in range(60)]
    rows += [(6000, "a b"), (6001, "A  b"), (6002, "a b c")]
    assert _groups(make_docs(rows)) == brute.near_groups(rows)


def test_near_duplicate_edges(make_docs, edge_rows, empty):
    assert near_duplicates(empty).collect() == []
    rows = near_duplicates(make_docs(edge_rows), keep_row=True).collect()
    assert len(rows) == len(edge_rows) and {r.row.m for r in rows} == {"x"}
    got = Counter((r.doc_id, r.component_id, r.kept) for r in rows)
    assert got[8, 8, True] == 2 and got[None, 8, False] == 1 and got[None, None, True] == 1
    assert got[7, 6, False] == 1 and got[1, 1, True] == 1 and got[3, 3, True] == 1
    assert sum(r.first for r in rows if r.component_id == 8) == 1


# -- substrings ---------------------------------------------------------------------------

def _cut(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect()}


def test_repeats_whole_table(table, pairs):
    assert _cut(table) == brute.repeats(pairs)


def test_repeats_planted(make_docs):
    a, b = prose(1, 55), prose(2, 20)
    rows = [(1, f"{prose(10, 30)} {a} {prose(11, 3)}"), (2, f"{a}\n{prose(12, 40)}\t{a}"), (3, f"{prose(13, 10)} {b}"),
            (4, f"{b} {prose(14, 10)} {b[:-3]}"), (5, "x " * 70), (6, "x " * 25), (7, a.upper()), (8, prose(15, 19)), (9, prose(15, 19)),
            (10, a), (11, None), (12, ""), (13, prose(16, 20)), (14, "  " + prose(16, 20) + " ")]
    got = _cut(make_docs(rows))
    assert got == brute.repeats(rows)
    assert got[10][1] == 55 and got[9][1] == 0 and got[14][1] == 20


def test_repeat_edges(make_docs, edge_rows, empty):
    assert remove_repeats(empty).collect() == []
    rows = remove_repeats(make_docs(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in rows)
    assert got[8, 300, 0] == 1 and got[8, 300, 300] == 1 and got[None, 300, 300] == 1 and got[7, 60000, 60000] == 1


# -- mixing -------------------------------------------------------------------------------

def _mixed(df):
    return df.select("row.doc_id", "row.source", "m.*")


def test_mix_reaches_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = _mixed(mix(docs)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert 0 <= r.copies <= 2
    want, taken = brute.targets(sizes), Counter()
    for r in rows:
        taken[r.source] += r.size * r.copies
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= max(30, 0.01 * want[s]) for s in sizes)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, _mixed(mix(docs.repartition(5))).collect()), key=str)


def test_mix_splits_equal_rows(spark):
    rows = [(i, "one two three", "en", "s" if i % 3 else None, 1) for i in range(900)] + [(i, prose(i, 20), "en", "t", 1) for i in range(900, 960)]
    got = _mixed(mix(spark.createDataFrame(rows, DOC_SCHEMA))).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[r.source] - r.target) <= 20 for r in got)


def test_mix_edges(make_docs, edge_rows, empty):
    assert mix(empty).collect() == []
    rows = mix(make_docs(edge_rows)).select("row.doc_id", "row.m", F_alias("m")).collect()
    assert len(rows) == len(edge_rows) and rows[0][1] == "x"
    assert mix(make_docs([(1, None), (2, "")])).select("m.copies").collect() == [(1,), (1,)]


def F_alias(name):
    from pyspark.sql import functions as F

    return F.col(name).alias("mixed")
