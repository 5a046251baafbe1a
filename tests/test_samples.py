"""Samples and valid terms pass over the documents once for each thing that they tell."""

import pytest

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators import index
from lexiloom.plans import catalogue
from lexiloom.plans.workbench import Collection

PLAIN = AnalyzerConfig(norm="none")


def test_valid_terms_read_the_documents_once(spark):
    plan = catalogue.QUERIES["valid_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_samples_are_the_first_keys_whatever_documents_bound_them(spark, monkeypatch, few):
    texts = ["zeta yard zinc zeta yard xylem wolf vine", None, "beta alpha beta alpha gamma delta epsilon", "", "alpha aardvark abacus able", "0 1 2 3 4"]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").coalesce(1)
    plain = Collection(docs, PLAIN)
    want = sorted(map(tuple, index.samples(index.biword_pairs(plain.arrays), plain.tokens, index.kgram_pairs(plain.terms)).collect()))
    monkeypatch.setattr(index, "SOME_DOCUMENTS", few)
    assert sorted(map(tuple, plain.samples().collect())) == want and len(want) == 23


def test_a_bound_leaves_out_keys_before_they_are_made_distinct(spark):
    pairs = spark.createDataFrame([(f"k{i:03d}", i) for i in range(500)], "biword string, doc_id long")
    assert index._first_keys(pairs, "biword", 3, pairs.where("doc_id % 50 = 0")).count() == 101
    assert index._first_keys(pairs, "biword", 3, pairs.where("doc_id = 7")).count() == 3
