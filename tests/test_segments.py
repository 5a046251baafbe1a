"""A growing collection against a fresh build after every change."""

import random

from pyspark.sql.types import LongType

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.plans.segments import GrowingCollection
from lexiloom.plans.workbench import Collection
from lexiloom.streaming import ingest

PLAIN = AnalyzerConfig(norm="none")
WORDS = "alpha beta gamma delta epsilon the of zeta".split()


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def same(grown, docs, spark):
    fresh = Collection(spark.createDataFrame(docs, "doc_id long, text string"), PLAIN)
    assert rows(grown.documents()) == rows(fresh.docs)
    for text, methods in (("alpha beta", ("positional",)), ("gamma delta epsilon", ("biword", "false_positives")), ("zeta", ("biword",))):
        for method in methods:
            assert rows(grown.phrase(text, method)) == rows(fresh.phrase(text, method)), (text, method)
    assert rows(grown.lookup("alpha, zeta, nothing")) == rows(fresh.lookup("alpha, zeta, nothing"))
    assert rows(grown.vocabulary()) == rows(fresh.vocabulary())
    assert rows(grown.wildcard("*e*a")) == rows(fresh.wildcard("*e*a"))


def test_changes_give_what_a_fresh_build_gives(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 9)))
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    grown, held = GrowingCollection(spark, str(tmp_path), PLAIN, LongType()), []
    assert grown.documents().count() == 0 and grown.generations() == []
    for step in range(4):
        new = [(rnd.choice([None, *range(8)]), text()) for _ in range(rnd.randrange(3, 7))]
        gone = [rnd.randrange(8) for _ in range(step)]
        held = [d for d in held if d[0] is None or d[0] not in {i for i, _ in new} | set(gone)] + new
        assert grown.change(frame(new), spark.createDataFrame([(i,) for i in gone], "doc_id long")) == step + 1
    same(grown, held, spark)
    assert grown.merge() == 5 and grown.generations() == [5]
    same(grown, held, spark)
    grown.vacuum()
    grown.change(deleted=spark.createDataFrame([(held[-1][0],), (77,), (None,)], "doc_id long"))
    same(grown, [d for d in held if d[0] is None or d[0] != held[-1][0]], spark)


def test_a_change_written_again_counts_once_and_an_uncommitted_one_not_at_all(spark, tmp_path):
    grown = GrowingCollection(spark, str(tmp_path), PLAIN, LongType())
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string")
    grown.change(docs, gen=1)
    grown.change(docs, gen=2)
    grown.change(docs, gen=2)
    assert rows(grown.documents()) == rows(docs)
    commit, grown._commit = grown._commit, lambda gen: None
    grown.change(spark.createDataFrame([(1, "gamma")], "doc_id long, text string"))  # fails before it is committed
    assert rows(grown.documents()) == rows(docs) and grown.wildcard("g*").count() == 0
    grown._commit = commit
    assert grown.change(spark.createDataFrame([(1, "gamma")], "doc_id long, text string")) == 3
    assert [r.term for r in grown.vocabulary().collect()] == ["beta", "gamma"]


def test_a_file_sent_again_replaces_its_document(spark, tmp_path):
    store = str(tmp_path / "store")

    def send(day, files):
        folder = tmp_path / "texts" / day
        folder.mkdir(parents=True)
        for name, text in files.items():
            (folder / name).write_text(text)
        stream = ingest.grow_stream(ingest.text_stream(spark, str(tmp_path / "texts" / "*")), GrowingCollection(spark, store, PLAIN), str(tmp_path / "checkpoint"))
        stream.awaitTermination()
        grown = GrowingCollection(spark, store, PLAIN)
        return [r.term for r in grown.vocabulary().collect()], sorted(r.doc_id for r in grown.documents().collect())

    assert send("1", {"a.txt": "alpha beta", "b.txt": "beta gamma"}) == (["alpha", "beta", "gamma"], ["a.txt", "b.txt"])
    assert send("2", {"a.txt": "delta"}) == (["beta", "delta", "gamma"], ["a.txt", "b.txt"])
