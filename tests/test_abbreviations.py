"""The abbreviation model against a plain version of the published score, and the tokeniser that uses it."""

import math
import random
import re
from collections import Counter

import pytest

from lexiloom.functions import text
from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators import abbreviations as model
from lexiloom.plans.workbench import Collection

PLAIN = AnalyzerConfig(norm="none")


def brute(texts):
    with_, without = Counter(), Counter()
    for t in texts:
        for run in re.findall(model.RUN, (t or "").replace("-", " ").lower()):
            if run.endswith(".") and not run.endswith("..") and run != ".":
                with_[run[:-1]] += 1
            else:
                without[run] += 1
    n, periods = sum(with_.values()) + sum(without.values()), sum(with_.values())
    p = min(periods / n, 1 - 1e-9)
    out = {}
    for w, k in with_.items():
        if any(c.isalpha() for c in w):
            m, inner = without[w], w.count(".")
            ratio = -2 * (k * math.log(p) + m * math.log(1 - p) - k * math.log(0.99) - m * math.log(0.01))
            letters = len(w) - inner
            score = ratio * math.exp(-letters) * (inner + 1) * letters ** -m
            if score >= model.THRESHOLD:
                out[w] = (k, m, score)
    return out


def prose():
    rnd = random.Random(2)
    words = "the river forest animal garden winter house company university market letter morning street".split()
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(4, 9)))
    out = []
    for _ in range(150):
        out.append(f"{sentence().capitalize()}. Dr. Stone of Acme Inc. met Mr. Hill, e.g. on 3. may {rnd.randrange(1900, 2000)}. {sentence()}... {sentence()} (cf. {sentence()}). He asked the dr.")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*prose(), None, "", "...", ".", "a. b. a. b.", "no period"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_model_against_the_published_score(docs):
    want = brute([r.text for r in docs.collect()])
    got = {r.word: (r.n_with, r.n_without, r.score) for r in model.abbreviations(docs).collect()}
    assert got.keys() == want.keys() and {"dr", "inc", "mr", "cf", "e.g"} <= got.keys() and not {"forest", "river", "street", "3"} & got.keys()
    for w, (k, m, score) in want.items():
        assert got[w][:2] == (k, m) and got[w][2] == pytest.approx(score)
    assert set(model.abbreviation_words(docs)) == {w for w in want if w.isalnum()}


def test_a_collection_that_has_learned_them(docs):
    c = Collection(docs, PLAIN)
    known = c.with_abbreviations()
    terms = lambda x: {r.term for r in x.vocabulary().collect()}
    assert {"dr", "inc", "mr", "cf"} <= terms(c) and not {"inc", "mr", "cf"} & terms(known)
    assert "dr" in terms(known)  # where it ends the text, the period is the sentence's
    assert "3" in terms(known) and "3" not in terms(c.with_abbreviations(ordinals=True))
    stage = known.stages(0).first()
    assert "inc" not in stage.stage3_tokens and "met" in stage.stage3_tokens
    assert known.summary(["river forest"]).first().vocab_size < c.summary(["river forest"]).first().vocab_size


def test_tokeniser_with_many_abbreviations_and_ordinals(spark):
    words = (*(f"x{i}y" for i in range(3000)), "dr", "inc", "vol")
    lines = ["See Dr. Who; Acme Inc., today. Vol. 3. of 42. The 5. may. 6.", "(Dr.) \"inc.\" a/dr. b", "dr.5 dr.,5 dr., 5", "x17y. z x17y", "inc.", "inc. "]
    got = lambda cfg: [r.t for r in spark.createDataFrame(list(enumerate(lines)), "i int, s string").select("i", text.plain_tokens(text.F.col("s"), cfg).alias("t")).orderBy("i").collect()]
    none = [["see", "dr", "acme", "inc", "today", "vol", "3", "42", "5", "may", "6"], ["dr", "inc", "b"], ["dr", "5"], ["x17y", "z", "x17y"], ["inc"], ["inc"]]
    assert got(AnalyzerConfig(norm="none")) == none
    some = [["see", "acme", "today", "3", "42", "5", "may", "6"], ["inc", "b"], ["5"], ["z", "x17y"], ["inc"], ["inc"]]
    assert got(AnalyzerConfig(norm="none", abbreviations=words)) == some
    some[0] = ["see", "acme", "today", "may", "6"]
    assert got(AnalyzerConfig(norm="none", abbreviations=words, ordinals=True)) == some


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert model.abbreviations(empty).count() == 0 and model.abbreviation_words(empty) == ()
    alone = spark.createDataFrame([(1, "a. b. c.")], "doc_id long, text string")  # every token has a period
    assert model.abbreviations(alone).count() == 0


def test_texts_are_cut_once_for_words_and_totals(spark):
    docs = spark.createDataFrame([(1, "Dr. Who met dr. No. Etc."), (2, None)], "doc_id long, text string")
    assert "regexp_extract_all" not in model.abbreviations(docs)._jdf.queryExecution().optimizedPlan().toString()
