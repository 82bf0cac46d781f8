import math
from collections import Counter

import pytest

from shelfwise.llm import piece_sampling as P
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def lattices():
    return P.Lattices(P.piece_path())


def segmentations(lattices, text):
    """Probability of every way to cut ``text``, by recursion over the vocabulary."""
    model = lattices.model
    pieces = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not model.is_byte(i)}
    scores = {p: model.get_score(i) for p, i in pieces.items()}
    known = {p: s for p, s in scores.items() if s > P.UNUSED and s <= 0 and not (model.is_control(pieces[p]) or model.is_unknown(pieces[p]))}
    total = sum(1 / (1 - s) for s in known.values())
    rare = (1 / (2 - min(known.values())) / total) ** P.ALPHA

    def cut(word):
        if not word:
            yield (), 1.0
            return
        for j in range(1, len(word) + 1):
            p = word[:j]
            if p in known:
                w = ((1 / (1 - known[p]) / total) ** P.ALPHA, (pieces[p],))
            elif j == 1 and p in pieces:
                w = (rare, (pieces[p],))
            elif j == 1:
                raw = p.encode()
                w = (rare ** len(raw), tuple(lattices.byte[b] for b in raw))
            else:
                continue
            for rest, q in cut(word[j:]):
                yield w[1] + rest, w[0] * q

    all_cuts = [((), 1.0)]
    for word in lattices.words(text):
        own = list(cut(word))
        mass = sum(w for _, w in own)
        all_cuts = [(a + b, p * w / mass) for a, p in all_cuts for b, w in own]
    return dict(all_cuts)


def test_probabilities_and_inclusion(lattices):
    text, n, k = "the at 梦𠀀", 4000, 3
    want = segmentations(lattices, text)
    assert abs(sum(want.values()) - 1) < 1e-9
    first, any_of, scores = Counter(), Counter(), Counter()
    for at in range(0, n, 500):
        for own in P.sample_texts(lattices, [text] * 500, list(range(at, at + 500)), k):
            ids = [tuple(x[0].tolist()) for x in own]
            assert len(set(ids)) == len(ids) == k
            assert all(a[2] > b[2] for a, b in zip(own, own[1:]))
            first[ids[0]] += 1
            any_of.update(ids)
            for i, x in zip(ids, own):
                assert abs(math.exp(x[1]) - want[i]) < 1e-9
                scores[i] += math.exp(-x[3])
    for ids, p in want.items():
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        # inverse inclusion scores weigh every segmentation alike, and so sum to its share
        if p > 0.01:
            assert abs(scores[ids] / n - 1) < 0.2


def test_second_without_replacement(lattices):
    text, n = "that", 4000
    want = segmentations(lattices, text)
    pairs = Counter()
    for own in P.sample_texts(lattices, [text] * n, list(range(n)), 2):
        pairs[tuple(tuple(x[0].tolist()) for x in own)] += 1
    for (a, b), seen in pairs.most_common(6):
        p = want[a] * want[b] / (1 - want[a])
        assert abs(seen / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_sample_and_decode(docs_of, odd_rows):
    out = P.decode(P.sample(docs_of(odd_rows), 3)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert r.n_pieces == len(r.ids) and math.isfinite(r.log_inclusion) and r.log_inclusion <= 0
    assert [r.sample for r in by[1]] == [1] and by[1][0].n_pieces == 0
    texts = dict(odd_rows)
    for doc_id, rows in by.items():
        for r in rows:
            assert r.decoded == (texts[doc_id] or "")
    assert len({tuple(r.ids) for r in by[4]}) == 3
    # equal rows of one key get equal samples, another key others
    assert Counter(tuple(r.ids) for r in by[5]).most_common()[0][1] == 2
    again = {(r.doc_id, r.sample): tuple(r.ids) for r in P.sample(docs_of(odd_rows[::-1]).repartition(7), 3).collect()}
    assert all(again[r.doc_id, r.sample] == tuple(r.ids) for r in out)


def test_query_returns_the_segmentations(spark, tmp_path, docs_of, odd_rows):
    docs_of(odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    out, texts = P.op6(spark, str(tmp_path)).collect(), dict(odd_rows)
    model = P._model(P.piece_path())
    assert max(r.sample for r in out) == P.SAMPLES > 2
    assert all(r.round_trip and model.decode(list(r.ids)) == (texts[r.doc_id] or "") and r.n_pieces == len(r.ids) for r in out)


def test_fewer_segmentations_than_asked(lattices):
    ((own),) = (P.sample_texts(lattices, ["a"], [1], 5),)
    assert len(own[0]) == 2 == len(segmentations(lattices, "a"))
    assert P.sample_texts(lattices, [], [], 2) == []


def test_long_words(lattices):
    text = words(3, 1) * 400
    (own,) = P.sample_texts(lattices, [text], [9], 2)
    assert all(lattices.model.decode(x[0].tolist()) == text and math.isfinite(x[1]) for x in own)


def test_empty(docs_of):
    assert P.sample(docs_of([])).count() == 0


def test_open_values_of_early_choices_are_enough(lattices, monkeypatch):
    import numpy as np

    texts = [words(20 + i, 60 * i) for i in range(6)] + ["x" * 700, "a a " * 300, "été 你好 😀 É", "the", None] + [words(40, 6000)]
    keys, seen, values = list(range(len(texts))), [], P._open_values

    def counted(before, rest, gumbel, uniform):
        seen.append(np.size(uniform))
        return values(before, rest, gumbel, uniform)

    monkeypatch.setattr(P, "_open_values", counted)
    found = P.sample_texts(lattices, texts, keys, 4)
    # most choices of a long text come too late to be where another segmentation branches off
    assert sum(seen) < sum(len(x[0]) for own in found for x in own) / 2
    for early in (3, 10**6):
        monkeypatch.setattr(P, "EARLY", early)
        other = P.sample_texts(lattices, texts, keys, 4)
        assert [[(x[0].tolist(), *x[1:]) for x in own] for own in other] == [[(x[0].tolist(), *x[1:]) for x in own] for own in found]


def test_spelling_of_ids(lattices):
    import numpy as np

    texts = ["internationalization of été 你好 😀", "the end\n", ""]
    ids = [lattices.model.encode(t) for t in texts]
    norms = ["".join(lattices.words(t)).replace("▁", " ").encode() for t in texts]
    for cut in range(len(ids[0])):
        wrong = [*ids[0][:cut], ids[0][cut] % 30000 + 300, *ids[0][cut + 1 :]]
        rows = [ids[0], wrong, ids[1], ids[1][:-1], ids[0], ids[2], ids[2] + ids[1]]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        spelt = lattices.spells(np.array([i for x in rows for i in x], np.int32), bounds, [norms[0], norms[0], norms[1], norms[1], norms[0], norms[2], norms[2]])
        assert spelt.tolist() == [True, False, True, False, True, True, False]
