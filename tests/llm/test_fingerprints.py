import hashlib

from shelfwise.llm import edit_fingerprints as E
from tests.llm.conftest import words


def plain(text):
    """The walk step by step."""
    moves, _ = E._moves()
    data, at, out = E._symbols(text).tolist(), 0, []
    c = E.size_class(len(text))
    wanted = set(E.sampled_steps(c).tolist())
    for j in range(E.STEPS << c):
        if j in wanted:
            out.append("0123456789abcdef"[data[at] & 15] if data[at] else "-")
        at += int(moves[j % E.PERIOD][data[at]])
    return f"{len(text):08x}" + "".join(out)


def test_walks_side_by_side_equal_single_walks():
    texts = [words(i, 1 + i % 60) for i in range(150)] + ["", "a", "ab", "é😀" * 700]
    assert E.fingerprints(texts) == [plain(t) for t in texts]


def test_likeness():
    base = words(1, 400)
    own = E.fingerprints([base])[0]
    assert E.likeness(own, own) == 1
    assert all(E.likeness(own, f) < 0.3 for f in E.fingerprints([words(i, 400) for i in range(2, 12)]))
    # walks meet again soon after most small edits
    near = []
    for i in range(40):
        text = words(100 + i, 400)
        at, size = 200 + 37 * i, 1 + i % 4
        near += [E.likeness(*E.fingerprints([text, text[:at] + text[at + size :]])), E.likeness(*E.fingerprints([text, text[:at] + "xyz"[:size] + text[at:]]))]
    assert sorted(near)[len(near) // 2] > 0.9 and sorted(near)[len(near) // 5] > 0.5
    empty, one = E.fingerprints(["", "a"])
    assert E.likeness(empty, empty) == 1 and E.likeness(empty, one) == 0
    # across a length class
    a, b = E.fingerprints([base[:2040], base[:2060]])
    assert E.size_class(2040) != E.size_class(2060) and E.likeness(a, b) > 0.9


def test_next_document_and_edited_text(docs_of, odd_rows):
    rows = [(i * 400, words(i, 3 + 11 * i)) for i in range(20)] + odd_rows
    got = {}
    for r in E.fingerprint(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: -(2**63) if r[0] is None else r[0])
    assert sum(map(len, got.values())) == len(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        r = got[i][0]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        if i != 5:  # two equal rows follow each other
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            own, other, late = E.fingerprints([text, edited, after])
            assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own, other)
            assert (r.near_edited, r.near_next) == (E.likeness(own, other), E.likeness(own, late))
    assert got[5][0].fingerprint == got[5][1].fingerprint == got[6][0].fingerprint


def test_one_row_and_none(docs_of):
    (r,) = E.fingerprint(docs_of([(3, words(3, 30))])).collect()
    assert r.near_next == 1
    assert E.fingerprint(docs_of([])).count() == 0


def test_near_duplicates(spark, docs_of):
    base = words(20, 300)
    rows = [(i, base[:500] + "q" * i + base[500:]) for i in range(6)] + [(100 + i, words(500 + i, 300)) for i in range(30)] + [(50, base)]
    found = E.fingerprint(docs_of(rows)).select("doc_id", "fingerprint")
    pairs = {(r.a, r.b) for r in E.near_duplicates(found, 0.6).collect()}
    assert {b for _, b in pairs} >= {1, 2, 3} and all(a < 100 and b < 100 for a, b in pairs)
    assert E.near_duplicates(found.filter("false")).count() == 0


def test_near_duplicates_against_brute_force(spark, docs_of):
    opening = words(30, 60)
    rows = [(0, f"{opening} {words(31, 300)}")]
    for n in range(8):
        base = words(40 + n, 300)
        rows += [(10 * n + i, f"{opening} {base[: 300 * i]}{'xy' * (i > 1)}{base[300 * i :]}") for i in range(1, 6)]
    found = E.fingerprint(docs_of(rows)).select("doc_id", "fingerprint").cache()
    prints = {r.doc_id: r.fingerprint for r in found.collect()}
    want = {(a, b) for a in prints for b in prints if a < b and E.likeness(prints[a], prints[b]) >= 0.8}
    got = {(r.a, r.b): r.likeness for r in E.near_duplicates(found).collect()}
    # the smallest document of a class of equal fingerprints stands for it
    first = {i: min(j for j in prints if prints[j] == prints[i]) for i in prints}
    met = {(a, b) for a, b in want if first[a] == first[b] or tuple(sorted((first[a], first[b]))) in got}
    assert len(want) > 20 and set(got) <= want and len(met) >= 0.95 * len(want)
    assert all((first[i], i) in got for i in prints if first[i] < i)
    # exact copies are named
    copies = spark.createDataFrame([(i, prints[11]) for i in (7, 5, 9, 5)], "doc_id long, fingerprint string")
    assert {(r.a, r.b, r.likeness) for r in E.near_duplicates(copies).collect()} == {(5, 7, 1.0), (5, 9, 1.0)}
