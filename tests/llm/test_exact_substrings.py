import hashlib
import random
from collections import Counter

import pytest

from shelfwise.llm import exact_substrings
from shelfwise.llm.collection_bwt import repeated_starts, transform
from shelfwise.llm.common import with_mark
from tests.llm.conftest import words


def brute(rows, span):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for (doc_id, _), r in zip(rows, raw):
        cut = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                cut[i : i + span] = b"\1" * span
        kept = bytes(b for b, c in zip(r, cut) if not c)
        runs = sum(1 for i, c in enumerate(cut) if c and (not i or not cut[i - 1]))
        out.append((doc_id is not None, doc_id or 0, len(r), sum(cut), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, span, gram):
    rows = exact_substrings.without_repeats(docs, span, gram).collect()
    for r in rows:
        assert sum(s.length for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows)


def rows_of(seed):
    r = random.Random(seed)
    shared = [words(seed * 10 + i, 40)[: r.randint(15, 200)] for i in range(6)]
    rows = []
    for i in range(80):
        parts = [words(1000 * seed + 7 * i + j, r.randint(0, 12)) for j in range(3)]
        parts.insert(1, r.choice(shared))
        if r.random() < 0.3:
            parts.insert(3, r.choice(shared)[r.randint(0, 30) :])
        rows.append((i, "".join(parts)))
    return rows + [(90, "ab" * 300), (91, "ab" * 40), (92, "c" * 19), (92, "c" * 20), (93, "ünïcödé " * 30), (94, "x ünïcödé " * 5)]


@pytest.mark.parametrize("span,gram", [(20, 8), (50, 16), (200, 64)])
def test_brute_force(docs_of, odd_rows, span, gram):
    rows = rows_of(span) + odd_rows
    assert found(docs_of(rows), span, gram) == brute(rows, span)


def test_large_groups_are_counted_apart(docs_of, monkeypatch):
    monkeypatch.setattr(exact_substrings, "LARGE_GROUP", 2)
    rows = rows_of(3)
    assert found(docs_of(rows), 20, 8) == brute(rows, 20)


def test_empty(docs_of):
    assert exact_substrings.without_repeats(docs_of([])).count() == 0


def test_transform_and_prefixes():
    r = random.Random(2)
    for alphabet in ("ab", "abc", "aab") * 20:
        strings = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))).encode() for _ in range(r.randint(1, 9))]
        bwt, lcp = transform(strings)
        suffixes = sorted(((s[i:], k, s[i - 1] + 1 if i else 0) for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: x[0])

        def common(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
        assert sorted(bwt.tolist()) == sorted(s[2] for s in suffixes)
        for span in (1, 2, 5):
            seen = Counter(s[i : i + span] for s in strings for i in range(len(s) - span + 1))
            for s, flags in zip(strings, repeated_starts(strings, span)):
                assert flags.tolist() == [len(s) - i >= span and seen[s[i : i + span]] > 1 for i in range(len(s))]


def test_marks(spark):
    df = spark.range(-3000, 3000)
    marked = {r.id for r in with_mark(df, df["id"], spark.range(-2999, 3000, 2)).filter("mark").collect()}
    assert marked == set(range(-2999, 3000, 2))


def test_bytes_are_stored_once(docs_of, monkeypatch):
    stored, keep = [], exact_substrings.written
    monkeypatch.setattr(exact_substrings, "written", lambda df, *by: stored.append(df.columns) or keep(df, *by))
    rows = rows_of(4)
    assert found(docs_of(rows), 60, 20) == brute(rows, 60)
    assert sum("bytes" in columns for columns in stored) == 1
