"""The pipeline's stages and its run against brute force, on a small corpus with every odd case."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import common, hashing, near_dedup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = 'password = "hunter2-and-more"'


def corpus():
    """Good and bad texts, exact and near copies, benchmark passages, secrets, repeated rows, odd ids and texts."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(600)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, line(20)) for k in range(6)] + [(None, line(15)), (9, None), (10, "")]
    texts = [f"{line(60)}. {line(40)}." for _ in range(120)]
    texts += [" ".join(rnd.choice(["###", "$$", "x", "!!"]) + rnd.choice("qz") for _ in range(80)) for _ in range(120)]  # bad
    texts += [t + " more" for t in texts[:10]] + texts[10:20]
    texts += [f"{line(50)} {items[k][1]} {line(50)}" for k in range(6)] + [f"{line(30)} {SECRET} {line(30)}" for _ in range(5)]
    docs = [(i, t, "en", ("a", "a", "b", None)[i % 4], len(t)) for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (None, texts[5], "en", "a", 1), (None, line(40), None, "b", None), (900, None, "en", "a", 0), (901, "", "en", "b", 0), (902, "long words here " * 20_000, "en", "a", 320_000)]
    labels = [(i, int(not (120 <= i < 240)), 0) for i in range(240) if i % 3] + [(None, 1, 0), (1, None, 0)]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs, items, labels = corpus()
    for name, rows, kind in (("documents", docs, DOCS), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, kind).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def listed(df):
    return sorted(map(str, df.collect()))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_the_five(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "secret scans", "source mixing"]


def test_quality_stage(spark, docs, folder):
    kept = stage("quality classifier")(spark, docs, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = quality.score_quality(docs, model, out="s")
    assert listed(kept) == listed(scored.where(F.col("s") >= quality.THRESHOLD).drop("s")) and kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(120))) > 115 and len(ids & set(range(120, 240))) < 5


def test_near_duplicate_stage(spark, docs, folder):
    kept = stage("near-duplicates")(spark, docs, folder).collect()
    rows = docs.collect()
    bags = []
    for r in rows:
        hashes, offsets = hashing.word_hashes([(r.text or "").encode()])
        bags.append(near_dedup.multiset(hashes))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i] if r.text else ("empty", i), []).append(r)
    least = lambda g: min((r.doc_id is None, r.doc_id or 0) for r in g)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(least(g) for g in groups.values())
    assert all(any(k == r for r in rows) for k in kept)


def test_decontamination_stage(spark, docs, folder):
    kept = stage("benchmark decontamination")(spark, docs, folder)
    items = [(r.item_id, common.words((r.text or "").encode())) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[s : s + 13]) for _, w in items for s in range(max(1, len(w) - 12) if w else 0)}

    def clean(r):
        words = common.words((r.text or "").encode())
        hit = {i for s in range(len(words)) for n in {len(w) for w in windows} if tuple(words[s : s + n]) in windows for i in range(s, s + n)}
        return not (hit and 20 * len(hit) >= len(words))

    assert listed(kept) == sorted(str(r) for r in docs.collect() if clean(r))
    assert kept.columns == docs.columns and docs.count() - kept.count() == 6


def test_secret_stage(spark, docs, folder):
    redacted = stage("secret scans")(spark, docs, folder)
    before, after = docs.collect(), redacted.collect()
    assert redacted.schema == docs.schema and len(before) == len(after)
    changed = {(r.doc_id, r.text) for r in after} - {(r.doc_id, r.text) for r in before}
    assert len(changed) == 5 and all("hunter2" not in t and "[SECRET]" in t for _, t in changed)
    assert all(r.n_chars == len(r.text) for r in after if r.text and "[SECRET]" in r.text)


def test_mixing_stage(spark, docs, folder):
    mixed = stage("source mixing")(spark, docs, folder)
    rows = mixed.collect()
    assert mixed.columns[:5] == docs.columns and {r.source for r in rows} <= {"a", "b", None}
    originals = {(r.doc_id, r.text) for r in docs.collect()}
    assert rows and all((r.doc_id, r.text) in originals and 0 <= r["copy"] < r.n_copies for r in rows)


def test_run_is_its_stages_in_order(spark, docs, folder):
    found = corpus_pipeline.run(spark, folder)
    again = docs
    for _, f in corpus_pipeline.STAGES:
        again = f(spark, again, folder)
    assert listed(found) == listed(again) and found.count() > 50
    assert found.where("doc_id between 120 and 239").count() < 10
    assert found.where(F.col("text").contains("hunter2")).count() == 0


def test_stages_with_clashing_and_extra_columns(spark, docs, folder):
    taken = ("quality_score", "near_tag", "near_id", "near_null", "benchmark_marks", "text_digest", "text_hits", "secrets_found", "rate", "copy", "mix_name", "license_text", "node", "marks")
    wide = docs.select("*", *[F.lit(c).alias(c) for c in taken])
    for name, f in corpus_pipeline.STAGES:
        plain, found = f(spark, docs, folder), f(spark, wide, folder)
        assert found.columns[: len(wide.columns)] == wide.columns, name
        assert listed(found.select(*docs.columns)) == listed(plain.select(*docs.columns)), name
        assert all(r[c] == c for r in found.limit(3).collect() for c in taken), name


def test_stages_on_empty_tables(spark, docs, folder):
    none = docs.where("false")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, folder).count() == 0, name


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_rows_of_nulls(spark, folder):
    nulls = spark.createDataFrame([(None,) * 5] * 4 + [(None, "some words of a text", None, None, None)], DOCS)
    for name, f in corpus_pipeline.STAGES:
        f(spark, nulls, folder).collect()


def test_shared_tables_need_a_shared_folder(spark, monkeypatch):
    assert common.shared_folder(spark)

    class Elsewhere:
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: {}, "getCheckpointDir": lambda self: None})()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Elsewhere())
