import random
import re

import pytest

from pyspark.sql import functions as F

from shelfwise.llm import jaccard_join
from shelfwise.llm.common import components
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, numerator, denominator):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and denominator * both >= numerator * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(seed):
    """Families of texts with edits at rates around the threshold, chains of edits and unrelated texts."""
    r = random.Random(seed)
    rows, at = [], 0
    for family in range(12):
        base = words(100 * seed + family, r.choice([4, 12, 60, 200])).split()
        current = base
        for _ in range(r.randint(1, 12)):
            w = list(current if r.random() < 0.5 else base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(5)
            current = w
            rows.append((at, (" " if r.random() < 0.5 else "\n").join(w)))
            at += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,numerator", [(3, 90), (5, 80), (1, 50)])
def test_components_equal_brute_force(docs_of, odd_rows, k, numerator):
    rows = copies(k) + [(i if i is None else i + 1000, t) for i, t in odd_rows]
    got = {}
    for r in jaccard_join.link_components(docs_of(rows), k, numerator, 100).collect():
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert got.setdefault(r.doc_id, (r.n_shingles, r.component_id)) == (r.n_shingles, r.component_id)
    assert got == brute(rows, k, numerator, 100)
    assert jaccard_join.link_components(docs_of(rows), k, numerator, 100).count() == len(rows)


def test_hot_line_and_large_group(docs_of):
    line = words(9, 12)
    rows = [(i, line + " " + words(1000 + i, 40)) for i in range(60)]
    base = words(5, 150).split()
    for i in range(60, 140):
        w = list(base)
        w[i % 150] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard_join.link_components(docs_of(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 90, 100).items()}
    assert {got[i] for i in range(60, 140)} == {60}


def test_keep_one(docs_of, odd_rows):
    rows = copies(4) + [(i if i is None else i + 1000, t) for i, t in odd_rows]
    df = docs_of(rows)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    want = sorted(i for i, (_, c) in brute(rows, 5, 80, 100).items() if i == c)
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == want
    assert kept.filter("doc_id is null").count() == 1


def test_empty(docs_of):
    assert jaccard_join.link_components(docs_of([])).count() == 0
    assert jaccard_join.keep_one(docs_of([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(1000, 1000), (2000, 1999)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(401)} | {1999: 1999, 2000: 1999}
    assert components(edges.filter(F.lit(False))).count() == 0


def test_needed_map_has_every_id(spark):
    ids = spark.range(0, 5000, 3)
    bits = jaccard_join.needed_map(ids)
    values = [r.b for r in ids.select(F.pmod(F.xxhash64("id"), F.lit(jaccard_join.MAP_BITS)).alias("b")).collect()]
    test = jaccard_join._in_map(bits)
    assert test(values).all()
    assert test([v + 1 for v in values]).mean() < 0.01


def test_links_are_named_for_what_they_are(docs_of):
    assert jaccard_join.link_components(docs_of([])).columns == ["doc_id", "n_shingles", "component_id", "kept_links"]


def all_links(rows, k, numerator, denominator):
    """For each doc_id, the other documents that it links with, pair by pair."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    like = lambda a, b: a and b and denominator * len(a & b) >= numerator * len(a | b)
    return {i: sum(1 for j, b in sets.items() if i != j and like(a, b)) for i, a in sets.items()}


@pytest.mark.parametrize("k,numerator,tile", [(3, 90, 512), (3, 90, 3), (1, 50, 4), (5, 80, 1)])
def test_all_links_are_counted(docs_of, odd_rows, monkeypatch, k, numerator, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = copies(k) + [(i if i is None else i + 1000, t) for i, t in odd_rows]
    want = all_links(rows, k, numerator, 100)
    got = jaccard_join.link_components(docs_of(rows), k, numerator, 100).collect()
    assert {r.doc_id: r.kept_links for r in got if r.doc_id is not None} == want
    assert sum(want.values()) > 100 and [r.kept_links for r in got if r.doc_id is None] == [0]


def test_links_inside_a_large_component(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 5)
    base = words(15, 150).split()
    rows = [(i, " ".join(base[:i] + [f"own{i}"] + base[i + 1 :])) for i in range(100)]
    got = {r.doc_id: r.kept_links for r in jaccard_join.link_components(docs_of(rows)).collect()}
    assert got == {i: 99 for i in range(100)} == all_links(rows, 3, 90, 100)


def test_op7_joins_whole_components(docs_of, monkeypatch):
    from shelfwise.llm import common

    rows = copies(6)
    counted, link_counts = [], jaccard_join._link_counts
    monkeypatch.setattr(common, "table", lambda *_: docs_of(rows).select("doc_id", "text"))
    monkeypatch.setattr(jaccard_join, "_link_counts", lambda *a: counted.append(link_counts(*a)) or counted[-1])
    out = jaccard_join.op7(None, "")
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and len(counted) == 1
    one = {}  # each set's documents, and the links of one of them
    for i, t in rows:
        one.setdefault(frozenset(shingles(t, 3)), []).append(i)
    links = all_links(rows, 3, 90, 100)
    assert sorted(r.links for r in counted[0].collect()) == sorted(n for ids in one.values() if (n := links[ids[0]] - len(ids) + 1))
