import inspect

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shelfwise.llm import quality
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def net(small):
    return quality.train(small[0], small[1])


def test_held_out_accuracy(spark, small, net):
    scored = quality.scored(small[0].select("doc_id", "text"), net)
    rows = scored.join(small[1], "doc_id").filter(quality.held_out()).collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right >= 0.93 * len(rows)


def test_only_the_text_counts_and_all_of_it(docs_of, odd_rows, net):
    rows = odd_rows + [(70, words(70, 400)), (71, words(70, 400)), (72, words(70, 400) + " %%% ### $$$ !!" * 300)]
    got = {}
    for r in quality.scored(docs_of(rows), net, "_score").collect():
        assert 0 <= r._score <= 1 and r.score == "own"
        got.setdefault(r.doc_id, set()).add(r._score)
    assert got[70] == got[71] and got[70] != got[72] and got[5] == got[6] and got[1] == got[2]
    assert all(len(x) == 1 for x in got.values())


def test_scores_do_not_depend_on_batches(net):
    texts = [words(i, 1 + 37 * i % 3000).encode() for i in range(60)]
    together = net.score(texts)
    assert max(abs(a - net.score([t])[0]) for a, t in zip(together, texts)) < 1e-5


def test_fit_without_or_with_one_class(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs.drop("score"), quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1), (4, 1), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    scores = {r.score for r in quality.scored(docs.drop("score"), quality.train(docs, one)).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1


def test_held_out_rows_never_train(spark, small):
    chunks = quality.sample_chunks(small[0], small[1]).select("doc_id").distinct()
    assert chunks.filter(quality.held_out()).count() == 0 and chunks.count() > 200


def test_stages(spark, docs_of, odd_rows):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]
    passage = words(90, 60)
    rows = odd_rows + [(30 + i, f"{words(300 + i, 40)} {passage} {words(400 + i, 40)}") for i in range(3)] + [(40 + i, words(500, 300) + f" end{i}") for i in range(3)]
    for docs in (docs_of(rows), docs_of([])):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
            docs = stage(spark, docs, SF).persist()
            assert docs.columns == columns
        if docs.count():
            kept = {r.doc_id: r.text for r in docs.collect()}
            assert 40 in kept and not {41, 42} & set(kept) and passage in kept[30]
            assert passage not in kept[31] and passage not in kept[32]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_pipeline_on_the_small_tables(spark, small):
    packed = entry.queries()["pipeline"](spark, SF).select("doc_id", "length", "doc_tokens").collect()
    kept = {r.doc_id for r in packed}
    assert 0.6 * small[0].count() < len(kept) < small[0].count()
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
