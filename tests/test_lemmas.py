"""Lemmas as an expression, and as workers look them up."""

from pyspark.sql import functions as F

from lexiloom.functions import lemma
from lexiloom.functions.porter import stem

WORDS = ["geese", "mice", "boxes", "classes", "running", "été", "", "cities", "women", "xs", None, "statess"]


def test_lemmas_of_a_small_lexicon_are_in_the_plan(spark, monkeypatch):
    forms = lemma.lemma_forms(None, None)
    rows = spark.createDataFrame([(WORDS,), (None,), ([],)], "tokens array<string>")
    told = rows.select(lemma.lemma_tokens(F.col("tokens"), forms).alias("l"), lemma.lemma_tokens(F.col("tokens"), forms, stemmed=True).alias("s"))
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in told._jdf.queryExecution().executedPlan().toString()
    want = [None if w is None else forms.get(w, w) for w in WORDS]
    assert [tuple(r) for r in told.collect()] == [(want, [None if w is None else stem(w) for w in want]), (None, None), ([], [])]
    terms = spark.createDataFrame([(w,) for w in WORDS], "term string")
    one = [r.l for r in terms.select(lemma.lemma_terms(F.col("term"), forms).alias("l")).collect()]
    monkeypatch.setattr(lemma, "PLAN_FORMS", 0)
    assert one == want == [r.l for r in terms.select(lemma.lemma_terms(F.col("term"), forms).alias("l")).collect()]
