"""Evaluation without lists of ids: metrics, retrieved rows, lists in chunks, and relevance for tables of queries."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import evaluate, index
from lexiloom.plans.workbench import Collection

QUERIES = ["geese wolves", "engine ranks", "the of", "missing", "geese geese", "page", ""]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    words = "geese goose wolf wolves engine engines rank ranks ranked page pages the of running".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[5]), (3, texts[5]), (None, texts[6]), (99, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def key(x):
    return (x is not None, x or 0)


def test_metrics_rows_and_chunks_agree(docs, monkeypatch):
    c = Collection(docs)
    metrics = {r.query: r for r in c.compare_metrics(QUERIES).collect()}
    assert [r.query for r in c.compare_metrics(QUERIES).collect()] == QUERIES
    rows = c.retrieved(QUERIES).collect()
    held = {(q, m): sorted((r.doc_id for r in rows if (r.query, r.method) == (q, m)), key=key) for q in QUERIES for m in evaluate.METHODS}
    truth = evaluate.ground_truth(docs, QUERIES).collect()
    assert "Exchange" not in c.retrieved(QUERIES)._jdf.queryExecution().executedPlan().toString()
    for q in QUERIES:
        want = {m: len(held[q, m]) for m in evaluate.METHODS}
        assert (metrics[q].n_stem, metrics[q].n_lemma) == (want["stem"], want["lemma"]), q
        assert metrics[q].n_truth == sum(r.query == q for r in truth)
    assert metrics["geese wolves"].n_stem > 0 and metrics["missing"].n_stem == 0 and metrics["the of"].n_lemma == 0
    for chunk in (index.CHUNK, 4):
        monkeypatch.setattr(index, "CHUNK", chunk)
        told = c.compare(QUERIES).collect()
        assert max(len(r.stem_retrieved) for r in told) <= (chunk if chunk > 4 else 20)
        for q in QUERIES:
            mine = [r for r in told if r.query == q]
            assert sorted((d for r in mine for d in r.stem_retrieved), key=key) == [d for d in held[q, "stem"] if d is not None]
            assert {(r.stem_P, r.stem_R, r.lemma_F1) for r in mine} == {(metrics[q].stem_P, metrics[q].stem_R, metrics[q].lemma_F1)}
            assert [r.chunk for r in mine] == sorted({r.chunk for r in mine})


def test_many_queries_against_brute_force(spark, docs):
    rnd = random.Random(2)
    parts = "ge ees gee engin es rank anks page wo olves o run ning zz xq the 42".split()
    asked = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 4)))) for i in range(10_000)] + [(None, "ge"), (5, "ge"), (7, "!!!")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    texts = [(r.doc_id, (r.text or "").replace("-", " ").lower(), r.text) for r in docs.collect()]
    cache = {}

    def relevant(q):
        words = tuple(sorted({w for w in q.split() if w.isalnum()}))
        if words not in cache:
            cache[words] = [d for d, t, raw in texts if not words or (raw is not None and all(w in t for w in words))]
        return cache[words]

    want = sorted(((i, d) for i, q in asked for d in relevant(q)), key=lambda x: (key(x[0]), key(x[1])))
    for block in (evaluate.QUERY_BLOCK, 3000):
        got = evaluate.ground_truth_of(docs, queries, block).collect()
        assert sorted(((r.query_id, r.doc_id) for r in got), key=lambda x: (key(x[0]), key(x[1]))) == want


def test_nothing_asked_or_held(spark, docs):
    none = spark.createDataFrame([], "query_id string, query string")
    assert evaluate.ground_truth_of(docs, none).count() == 0
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert evaluate.ground_truth_of(empty, spark.createDataFrame([("a", "b")], "query_id string, query string")).count() == 0
    assert evaluate.retrieved(empty, queries=["a b"]).count() == 0
    assert [(r.n_truth, r.n_stem, r.stem_F1) for r in evaluate.compare_metrics(empty, queries=["a b"]).collect()] == [(0, 0, 0.0)]
    assert [list(r.stem_retrieved) for r in evaluate.compare_normalizers(empty, queries=["a b"]).collect()] == [[]]
