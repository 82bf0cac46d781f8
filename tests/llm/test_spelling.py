import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from shelfwise.llm import spelling as sp
from shelfwise.llm.oracle import OP11_SQL


def brute_words(docs, damage=sp.DAMAGE):
    out = Counter()
    for key, text in docs:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for w in re.findall(r"[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, count = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, count[w], words.get(form[w])))
    return out


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def a_vocabulary(seed, n, letters="abcdeàé÷"):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(n)}
    for w in list(words):
        at = r.randrange(len(w))
        words |= {w[:at] + r.choice(letters) + w[at + 1 :], w[:at] + r.choice(letters) + w[at:]}
    return {w: r.choice([3, 3, 4, 5, 8, 20, 300]) for w in words}


def test_against_brute_force(spark):
    words = a_vocabulary(1, 150) | {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "aaaab": 6, "baaaa": 6}
    got = sp.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5))
    assert got.count() == len(words) and rows_of(got) == brute(words)
    assert ("aaaaa", "aaaaaa", "aaaaaaaaa") in {r[:3] for r in rows_of(got)}


def test_words_of_documents(docs_of, odd_rows):
    text = "Straße straße STRASSE! l'été-là coöperate×twice naïveté ÀÉÎÕÜ àéîõü ĀbcdeF ábcdef"
    docs = [*odd_rows, *[(i, f"{text} rec{i}eive receive recieve " + "tttttttt " * 3) for i in range(400)]]
    counted = sp.vocabulary(docs_of(docs).select("doc_id", "text"), damage=sp.DAMAGE)
    want = brute_words(docs)
    assert {r.word: r.n for r in counted.collect()} == want
    assert len(want) > len(brute_words(docs, None))  # some occurrences lost a letter
    assert rows_of(sp.variants(counted)) == brute(want)


def test_counts_are_handed_on_when_many(docs_of, monkeypatch):
    monkeypatch.setattr(sp, "HELD_WORDS", 7)
    docs = [(i, " ".join(a_vocabulary(i % 9, 20))) for i in range(40)]
    assert {r.word: r.n for r in sp.vocabulary(docs_of(docs).select("doc_id", "text"), damage=sp.DAMAGE).collect()} == brute_words(docs)


def test_empty_and_lone_words(spark, docs_of):
    assert rows_of(sp.variants(sp.vocabulary(docs_of([]).select("doc_id", "text")))) == set()
    one = spark.createDataFrame([("lonely", 3)], "word string, n long")
    assert rows_of(sp.variants(one)) == {("lonely", None, "lonely", 3, 0, None)}


def test_very_long_words(spark):
    long = "ab" * 100_000
    words = {long: 9, long[:-1]: 3, long + "a": 40, "c" + long[1:]: 4}
    got = {r[0][:1] + str(len(r[0])): (None if r[1] is None else len(r[1]), r[4]) for r in rows_of(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got == {"a200000": (200_001, 3), "a199999": (200_000, 1), "a200001": (None, 1), "c200000": (200_000, 1)}


def test_neighbours_are_all_one_edits_of_the_reduced_word():
    """Each pair of reduced words of one edit meets by key exactly once; other pairs don't."""
    letters = {c: 100 - i for i, c in enumerate("abcdefghij")}
    reducer = sp.Reducer(sp.alphabets(letters, 4, 12))
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.choice([5, 6, 6, 7]))) for _ in range(120)]
    keys = {}
    for w in words:
        codes = np.frombuffer(w.encode("latin-1"), np.uint8)[None, :]
        keys[w] = ([int(reducer.own(codes, n)[0]) for n in (len(w), len(w) + 1)], [int(k) for _, key in reducer.neighbours(codes) for k in key])
    for a in words:
        for b in words:
            if len(a) < len(b):
                continue
            symbol = reducer.alphabets.get(len(a), reducer.alphabets.get(0))
            x, y = [tuple(symbol[np.frombuffer(w.encode("latin-1"), np.uint8)]) for w in (a, b)]
            if len(a) == len(b):
                met = keys[a][1].count(keys[b][0][0]) + keys[b][1].count(keys[a][0][0])
                assert met == (sum(p != q for p, q in zip(x, y)) == 1)
            else:
                met = keys[a][1].count(keys[b][0][1])
                assert met == (len(a) == len(b) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x))))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({OP11_SQL})").fetchall()
    assert rows_of(sp.op11(spark, sf)) == set(want) and len(want) > 1000
