import re

import pytest

from shelfwise.llm import passages
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact_cover(rows, n=50):
    """Words of each document inside an n-word window that an earlier document has."""
    first, cover = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(low(text))
        for a in range(len(w) - n + 1):
            if first.setdefault(tuple(w[a : a + n]), i) < i:
                cover.setdefault(i, set()).update(range(a, a + n))
    return cover


def found_cover(df):
    cover = {}
    for r in df.collect():
        cover.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
        assert r.first_doc_id < r.doc_id
    return cover


def test_exact_passages_are_found_to_the_word(docs_of, odd_rows):
    p, q, short = words(50, 50), words(51, 90), words(52, 49)
    rows = [(10 + i, f"{words(200 + i, 30 + i)} {p} {words(300 + i, 20)}") for i in range(30)]
    rows += [(100 + i, f"{words(400 + i, 70)}\n{q.upper()}  {words(500 + i, 5)} {short}") for i in range(30)]
    rows += [(200 + i, words(600 + i, 120)) for i in range(20)] + odd_rows
    assert found_cover(passages.repeats(docs_of(rows))) == exact_cover(rows)


def test_near_duplicate_passage(docs_of):
    p = words(60, 120).split()
    edited = list(p)
    edited[40], edited[85] = "changed", "too"  # J of most 50-word stretches is above 0.8
    dropped = p[:60] + p[61:]
    rows = [(1, " ".join([words(61, 40), *p, words(62, 40)])), (2, " ".join([words(63, 10), *edited, words(64, 30)])), (3, " ".join([words(65, 25), *dropped, words(66, 8)])), (4, words(67, 200))]
    cover = found_cover(passages.repeats(docs_of(rows)))
    assert set(cover) == {2, 3}
    assert cover[2] <= set(range(10, 130)) and len(cover[2]) >= 110
    assert cover[3] <= set(range(25, 144)) and len(cover[3]) >= 110


def test_common_line_is_not_a_passage(docs_of):
    line = words(70, 12)
    rows = [(i, f"{words(700 + i, 60)} {line} {words(800 + i, 60)}") for i in range(80)]
    assert passages.repeats(docs_of(rows)).count() == 0


def test_parts_of_a_large_group(docs_of, monkeypatch):
    monkeypatch.setattr(passages, "PART", 4)
    p = words(80, 60)
    rows = [(i, f"{words(900 + i, 50)} {p} {words(1000 + i, 50)}") for i in range(40)]
    assert found_cover(passages.repeats(docs_of(rows))) == exact_cover(rows)


def near_cover(rows, n=50, k=5, least=0.8):
    """Words of each document inside an n-word window as like a window of an earlier document as ``least`` (sets of k-word shingles)."""
    span, place, cover = n - k + 1, {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(low(text))
        s = [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]
        others = {d: len(t) for x in s for d, t in place.get(x, {}).items()}
        for d in others:
            theirs = [{p for p in place.get(x, {}).get(d, ())} for x in s]
            for a in range(len(s) - span + 1):
                starts = {q - t for t in range(a, a + span) for q in theirs[t]}
                for b in {x + a + e for x in starts for e in range(-2, 3)}:
                    shared = [t for t in range(a, a + span) if any(b <= q < b + span for q in theirs[t])]
                    m = len({s[t] for t in shared})
                    if m >= least * (2 * span - m):
                        # trimmed to what is shared
                        cover.setdefault(i, set()).update(range(shared[0], shared[-1] + k))
        for a, x in enumerate(s):
            place.setdefault(x, {}).setdefault(i, []).append(a)
    return cover


def test_one_off_edits_of_a_common_passage(docs_of):
    p = words(90, 60).split()
    rows = [(i, f"{words(2000 + i, 20)} {' '.join(p)} {words(3000 + i, 20)}") for i in range(30)]
    edits = [p[:30] + [f"edit{i}"] + p[31:] for i in range(120)]
    rows += [(1000 + i, f"{words(4000 + i, 20)} {' '.join(e)} {words(5000 + i, 20)}") for i, e in enumerate(edits)]
    want = near_cover(rows[:1] + rows[30:32])
    assert set(want) == {1000, 1001}
    cover = found_cover(passages.repeats(docs_of(rows).coalesce(1)))
    found = [i for i in range(1000, 1120) if len(cover.get(i, ())) >= 58]
    assert len(found) >= 115
    assert all(cover[i] <= set(range(15, 85)) for i in found)


def chain_rows():
    """Copies of a passage with one edit, copies of these with one more; and longer passages around a short one."""
    rows = []
    for n in range(25):
        p = words(6000 + n, 60).split()
        one = p[:20] + [f"first{n}"] + p[21:]
        two = one[:42] + [f"second{n}"] + one[43:]
        rows += [(10 * n + i, f"{words(7000 + 10 * n + i, 15)} {' '.join(t)} {words(8000 + 10 * n + i, 15)}") for i, t in enumerate((p, one, two))]
    for n in range(25):
        p, before, after = words(6100 + n, 60), words(6200 + n, 40), words(6300 + n, 40)
        rows += [(1000 + 10 * n + i, f"{words(7500 + 10 * n + i, 15)} {t} {words(8500 + 10 * n + i, 15)}") for i, t in enumerate((p, f"{before} {p}", f"{before} {p} {after}", f"{p} {after}"))]
    return rows


@pytest.mark.parametrize("part", [4096, 2])
def test_chains_of_edits_and_mixed_lengths(docs_of, monkeypatch, part):
    monkeypatch.setattr(passages, "PART", part)
    rows = chain_rows()
    want, cover = near_cover(rows), found_cover(passages.repeats(docs_of(rows)))
    third = [i for i in want if i < 1000 and i % 10 == 2]
    assert len(third) == 25
    assert sum(len(cover.get(i, set()) & want[i]) >= 50 for i in third) >= 23
    assert all(cover.get(i, set()) >= c for i, c in exact_cover(rows).items())
    assert sum(len(cover.get(i, set()) & c) for i, c in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_without_repeats(docs_of, odd_rows):
    p = words(50, 60)
    rows = [(20, f"before {p} after"), (21, f"été\n{p}\n你好 end"), (22, p)] + odd_rows
    df = docs_of(rows)
    out = passages.without_repeats(df)
    assert out.schema == df.schema
    kept = {}
    for r in out.collect():
        kept.setdefault(r.doc_id, []).append(r)
    assert kept[20][0].text == rows[0][1]
    assert kept[21][0].text == "été\n\n你好 end" and kept[21][0].n_chars == len("été\n\n你好 end")
    assert 22 not in kept and 6 not in kept  # nothing left of them
    assert len(kept[5]) == 2 and kept[1][0].text is None and kept[2][0].text == "" and kept[None][0].text == "no id here"
    again = found_cover(passages.repeats(out))
    assert again == {}


def test_empty(docs_of):
    assert passages.repeats(docs_of([])).count() == 0
    assert passages.without_repeats(docs_of([])).count() == 0


def test_candidates_are_few_and_miss_no_agreement():
    import numpy as np

    span, r = 46, np.random.default_rng(5)
    passages_of = r.integers(100, 1 << 20, (12, 91))
    table = passages_of[r.integers(0, 12, 300)].astype(np.int32)
    for row in table:
        row[r.integers(0, 91, r.integers(0, 8))] = r.integers(100, 1 << 20)
        if r.random() < 0.3:
            at = int(r.integers(0, 40))
            row[at:-1] = row[at + 1 :].copy()
        row[38:52] = 7  # a run of one word around c, in all of them
    group = np.zeros(len(table), np.int64)
    near = passages._Candidates(table, span, 80, 100)
    rows = np.arange(len(table))
    near.index(group, rows)
    label, found = near.linked(group, rows), 0
    for i in rows:
        like = np.flatnonzero(passages._agree(table[[i] * len(table)], table, span, 80, 100).any(axis=1))
        near_i = near(group, rows[i : i + 1])
        assert set(like) <= set(near_i.tolist()) and (label[like] == label[i]).all()
        found += len(near_i)
    assert found < len(table) ** 2 / 4


def test_each_occurrence_meets_its_member_once(docs_of):
    p = words(95, 60)
    rows = [(i, f"{words(9000 + i, 20)} {p} {words(9500 + i, 20)}") for i in range(40)]
    out = passages.repeats(docs_of(rows))
    # one join for the members' facts, one for their occurrences
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert found_cover(out) == exact_cover(rows)


def joined(members, span, parts):
    """What ``_clustered`` makes of members in one task, as rows, and how many pairs it compared in full."""
    import pyarrow as pa

    class Members:
        def select(self, *_):
            return self

        repartition = sortWithinPartitions = select

        def mapInArrow(self, join, _):
            return join

    def counted(leader, other, *how):
        nonlocal pairs
        pairs += len(other)
        return agree(leader, other, *how)

    pairs, agree, col = 0, passages._agree, passages.F.col
    passages._agree, passages.F.col = counted, str
    try:
        names = ["key", "part", "hi", "lo", "doc_id", "c", "left", "around"]
        batch = pa.RecordBatch.from_pydict(dict(zip(names, zip(*members))))
        out = passages._clustered(Members(), span, 80, 100, parts=parts)(iter([batch.slice(0, 100), batch.slice(100)]))
        return sorted(pa.Table.from_batches(list(out)).to_pylist(), key=str), pairs
    finally:
        passages._agree, passages.F.col = agree, col


@pytest.mark.parametrize("parts", [False, True])
def test_leaders_side_by_side_give_what_leaders_in_turn_give(monkeypatch, parts):
    import numpy as np

    span, r = 46, np.random.default_rng(8)
    center, own = r.integers(1, 1 << 24, 91), r.integers(1, 1 << 24, (120, 91))
    rows = []
    for i in range(700):
        row = own[r.integers(0, 120)].copy()
        # all share the 31 places around c, which are no passage; some are edited copies of others
        row[30:61] = center[30:61]
        row[r.integers(0, 91, r.integers(0, 9))] = r.integers(1, 1 << 24, 1)
        a, b = (0, 91) if i % 3 else sorted(r.integers([0, 60], [31, 92]))
        rows.append((row, int(a), int(b)))
    raw = lambda x: np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    members = [(5 + (i >= 500) + (i >= 690), 0, i, i, i, 0, 45 - a, raw(row[a:b])) for i, (row, a, b) in enumerate(rows)]
    found, pairs = joined(members, span, parts)
    monkeypatch.setattr(passages, "LEADERS", 1)
    one_by_one, _ = joined(members, span, parts)
    assert found == one_by_one and len([x for x in found if x["by_doc"] is not None]) > 200
    monkeypatch.setattr(passages, "_Alike", lambda *_: lambda leader, row: np.ones(len(row), bool))
    monkeypatch.setattr(passages, "COMPARED", 1000)
    assert joined(members, span, parts)[0] == found
    # those that share only what is around c are not compared in full
    assert pairs < 700 * 20


def test_surroundings_are_scanned_once_for_all_groups(docs_of, monkeypatch):
    monkeypatch.setattr(passages, "PART", 4)
    scans, repeated = [], passages._repeated
    monkeypatch.setattr(passages, "_repeated", lambda *a: scans.append(a) or repeated(*a))
    p, q = words(96, 60), words(97, 60)
    rows = [(i, f"{words(9600 + i, 20)} {p} {words(9700 + i, 20)}") for i in range(12)]
    rows += [(100 + i, f"{words(9800 + i, 20)} {q}") for i in range(3)]
    assert found_cover(passages.repeats(docs_of(rows))) == exact_cover(rows)
    assert len(scans) == 2


def test_bounds_of_windows_are_the_nearest_smaller_places():
    import numpy as np

    r = np.random.default_rng(3)
    for span in (2, 5, 46):
        place = np.flatnonzero(r.random(300) < 0.4)
        value, least = r.permutation(len(place)), np.maximum(place - span + 1, (place >= 150) * 150)
        want = [max([p + 1 for p, v in zip(place[:j], value[:j]) if v < value[j] and p >= least[j]], default=least[j]) for j in range(len(place))]
        assert passages._Windows._smaller(place, value, least).tolist() == want


def long_line_rows(n):
    """Members that share a run of one word, short of a passage, beside text of their own; some are edited copies."""
    import numpy as np

    r, own, rows = np.random.default_rng(12), np.random.default_rng(13).integers(1, 1 << 24, (n, 91)), []
    for i in range(n):
        row = own[r.integers(0, n)].copy()
        begin, end = sorted(r.integers([2, 46], [46, 90]))
        row[max(begin, end - 44) : end] = 7
        row[r.integers(0, 91, r.integers(0, 4))] = r.integers(1, 1 << 24, 1)
        if i % 20 == 0:
            row[45:87], row[:45] = 7, own[i, :45]
        rows.append((5, 0, i, i, i, 0, 45, np.ascontiguousarray(row, np.uint32).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()))
    return rows


@pytest.mark.parametrize("parts", [False, True])
def test_rarest_shingles_give_what_all_candidates_give(monkeypatch, parts):
    tried, alike = [], passages._Alike.__call__
    monkeypatch.setattr(passages._Alike, "__call__", lambda self, by, row: tried.append(len(by)) or alike(self, by, row))
    rows = long_line_rows(600)
    found, _ = joined(rows, 46, parts)
    before = sum(tried)
    tried.clear()
    monkeypatch.setattr(passages, "MANY", 20)
    assert joined(rows, 46, parts)[0] == found and len([x for x in found if x["by_doc"] is not None]) > 100
    assert sum(tried) < 0.7 * before
    for name, value in (("INDEXED", 1), ("LEADERS", 3), ("COMMON", 2)):
        monkeypatch.setattr(passages, name, value)
        assert joined(rows, 46, parts)[0] == found
