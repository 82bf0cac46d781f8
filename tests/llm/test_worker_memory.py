import os

import numpy as np

from shelfwise.llm import common, jaccard_join, packing, quality
from tests.llm.conftest import words


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def test_free_memory_goes_back():
    """What a task freed is not kept by the worker, though something small above it stays (F1)."""
    left = []

    def work(batches):
        held = [np.ones(12_000) for _ in range(1600)]  # 150 MB in pieces that malloc keeps
        left.append(held[-1])
        yield from batches

    before = resident()
    assert list(common.giving_back(work)(iter([1]))) == [1]
    assert resident() - before < 50


def test_tasks_give_back_at_their_end_only(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("end"))
    work = common.giving_back(lambda batches: (said.append(b) or 2 * b for b in batches))
    assert list(work(iter([1, 2]))) == [2, 4] and said == [1, 2, "end"]
    assert list(work(iter([]))) == [] and said[-2:] == ["end", "end"]
    stopped = work(iter([5, 6]))
    next(stopped)
    stopped.close()
    assert said[3:] == ["end", 5, "end"]


def test_steps_of_the_pipeline_give_back(spark, monkeypatch):
    wrapped = []
    for module in (jaccard_join, packing, quality):
        monkeypatch.setattr(module, "giving_back", lambda work, m=module: wrapped.append((m.__name__.rsplit(".")[-1], work.__name__)) or common.giving_back(work))
    docs = spark.createDataFrame([(1, words(1, 80)), (2, words(1, 80)), (3, words(3, 80))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    assert quality.without_rejected(docs, labels, 0.0).count() == 3
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs).collect()) == [1, 3]
    assert packing.pack(docs).count() >= 3
    steps = {"quality": ["chunks", "score"], "jaccard_join": ["count", "prefix", "cut"], "packing": ["cut"]}
    assert {(m, f) for m, names in steps.items() for f in names} <= set(wrapped)
