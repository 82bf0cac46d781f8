import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from shelfwise.llm import benchmark_automaton as ba
from shelfwise.llm.oracle import OP13_SQL

ITEMS = "item_id long, text string, score double"


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, max_words=10, coverage=1.0):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        w = min(max_words, math.ceil(coverage * len(own)))
        windows = {tuple(own[i : i + w]) for i in range(len(own) - w + 1)} if own else set()
        for i in range(len(words) - w + 1):
            if tuple(words[i : i + w]) in windows:
                hit |= set(range(i, i + w))
                found |= {item} - {None}
    return len(words), hit, found


def check(spark, docs_of, docs, items, **how):
    table = spark.createDataFrame([(i, t, 0.5) for i, t in items], ITEMS).select("item_id", "text")
    got = ba.contamination(docs_of(docs), table, **how).collect()
    want = sorted((str(d), len(t or ""), *brute(t, items, **how)) for d, t in docs)
    have = sorted((str(r.doc_id), len(r.text or ""), r.n_words, {w for s in r.hit_spans for w in range(s.start, s.stop)}, set(r.hit_items)) for r in got)
    assert [w[:3] for w in have] == [w[:3] for w in want]
    assert have == want
    for r in got:
        spans = [(s.start, s.stop) for s in r.hit_spans]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))  # maximal runs
        assert (r.score, r.mark) == ("own", 7)


def small_language(seed, n, letters="abc"):
    r = random.Random(seed)
    return " ".join(r.choice(letters) for _ in range(n))


def test_against_brute_force(spark, docs_of, odd_rows):
    passage = "The Quick, brown fox's 3 dogs über-jumped 你好 again & again till 10 o'clock"
    items = [(1, passage), (2, "short item here"), (3, None), (4, ""), (5, "!!! ..."), (1, passage), (None, "no id but words"), (7, small_language(3, 40)), (8, "one"), (-2, "again again")]
    docs = [*odd_rows, (20, f"before {passage.upper()} after"), (21, "x " + passage[:40]), (22, "say SHORT item, here! no id but words; again?again"), (23, "one one two one"), (24, small_language(3, 40)[6:50])]
    docs += [(30 + i, small_language(i, 60)) for i in range(20)]
    check(spark, docs_of, docs, items)
    check(spark, docs_of, docs, items, max_words=4, coverage=0.5)


def test_no_items_and_no_documents(spark, docs_of, odd_rows):
    check(spark, docs_of, odd_rows, [])
    check(spark, docs_of, [], [(1, "some words of an item")])
    check(spark, docs_of, odd_rows, [(1, None)])


def test_blocks_of_a_large_benchmark(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ba, "BLOCK_WORDS", 60)
    items = [(i, small_language(100 + i, 5 + 17 * i, "abcd")) for i in range(12)]
    assert ba.automata(spark.createDataFrame(items, "i long, t string")).count() > 8
    docs = [(i, small_language(500 + i, 80, "abcd")) for i in range(12)]
    docs += [(50 + i, "z " + t + " y") for i, t in items]
    check(spark, docs_of, docs, items, max_words=6)


def test_long_stretches_are_walked_in_lanes(monkeypatch):
    monkeypatch.setattr(ba, "LANE_WORDS", 16)
    items = [(k, small_language(k, 30, "ab")) for k in range(3)]
    machine = ba.Automaton.from_bytes(ba.Automaton.of([(k, 10, ba.hashed([t])[0]) for k, t in items]).to_bytes())
    texts = ["", small_language(9, 3000, "ab"), None, items[1][1], "c"]
    h, first = ba.hashed(texts)
    begin, end, owners = machine.hits(h, first)
    for t, text in enumerate(texts):
        n, hit, found = brute(text, items)
        assert n == first[t + 1] - first[t]
        assert {w - first[t] for a, b in zip(begin, end) for w in range(a, b) if first[t] <= a < first[t + 1]} == hit
        assert {int(machine.ids[i]) for x, i in owners.T if x == t} == found


def test_long_texts_are_cut_between_words():
    text = "é" * 50 + " " + "ab " * 700 + "x" * 900 + " y"
    whole, _ = ba.hashed([text])
    from shelfwise.llm.words import cut

    pieces = list(cut(text.encode(), ba.APART, 64))
    assert b"".join(p for _, p in pieces) == text.encode() and len(pieces) > 20
    parts = np.concatenate([ba.hashed([p.decode()])[0] for _, p in pieces])
    assert (parts == whole).all()


def test_spans_go(spark, docs_of):
    items = spark.createDataFrame([(1, "one two three four")], "i long, t string")
    rows = [(1, "Zero, ONE two; three four! Five"), (2, None), (3, "one two three four"), (4, "é one two three four é")]
    out = {r.doc_id: r.text for r in ba.without_contamination(docs_of(rows), items).collect()}
    assert out == {1: "Zero, ! Five", 2: None, 3: "", 4: "é  é"}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = ba.op13(spark, sf)
    names = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({OP13_SQL})").fetchall()
    got = [tuple(r) for r in out.select(*names).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[names.index("contaminated")] for r in got)
    clean = next(r for r in got if not r[names.index("contaminated")])
    assert clean[names.index("items_sha256")] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("seed", range(5))
def test_longest_matching_lengths(seed):
    items = [small_language(seed * 10 + k, 25, "ab") for k in range(3)]
    machine = ba.Automaton.of([(k, 1, ba.hashed([t])[0]) for k, t in enumerate(items)])
    text = small_language(seed + 77, 60, "abc")
    h, first = ba.hashed([text])
    token = machine.tokens(h)
    found = {}
    for place, _, matched in machine.walked(token, *machine.runs(h, first, token)):
        found |= dict(zip(place.tolist(), matched.tolist()))
    words = text.split()
    for i in range(len(words)):
        longest = max(n for n in range(i + 2) if n == 0 or any(" ".join(words[i + 1 - n : i + 1]) in t for t in items))
        assert found.get(i, 0) == longest
