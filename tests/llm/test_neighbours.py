import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfwise.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, rank string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "own", 1) for i, v in rows], SCHEMA).repartition(4)


def exact(rows, k, step):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for i, v in zip(ids, x):
        if i % step == 0:
            score = (x * v).sum(axis=1)
            best = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24))
    if norms:
        x *= rng.uniform(0.2, 3, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0)), exact(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all(len(g) == 20 and [s for _, s in g] == sorted((s for _, s in g), reverse=True) for g in got.values())


def test_ties_and_repeated_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((5, 8)).tolist()
    rows = [(i, base[i % 5] if i % 3 else base[0]) for i in range(300)]
    rows += rows[:50]
    got = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == exact(rows, 20, 20)


def test_unusable_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0]), (4, None), (5, []), (6, [0.0, 0.0]), (40, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    got = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(20, 0.5), (3, 0.0)], 20: [(3, 1.0), (0, 0.5)]}
    assert neighbours.search(table(spark, rows).filter("vec_id = 4"), F.lit(True)).count() == 0
    assert neighbours.search(table(spark, []), F.lit(True)).count() == 0


def test_pigeonhole_probing_finds_all_codes_in_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (500, 4), np.uint8)
    codes[100:200] = codes[0] ^ (rng.random((100, 4)) < 0.3).astype(np.uint8)
    index = neighbours.Index(codes)
    for radius in range(0, 33, 3):
        for q in codes[:5]:
            assert index.within(q, radius).tolist() == np.flatnonzero(neighbours.distances(q, codes) <= radius).tolist()
