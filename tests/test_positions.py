"""The positional index: rows are grouped in place, only those that share an id are shuffled."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.functions.text import term_positions
from lexiloom.operators import index
from lexiloom.plans import catalogue
from lexiloom.plans.workbench import Collection

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def told(rows) -> list[tuple]:
    return sorted(tuple(map(str, r)) for r in rows)


def test_nothing_is_shuffled_for_ids_of_one_row(spark):
    docs = spark.createDataFrame([(0, "b a b"), (1, "a c"), (2, None), (None, "c c")], "doc_id long, text string")
    found = Collection(docs, AnalyzerConfig(stopwords=False, norm="none")).index("positional")
    assert "Exchange" not in plan(found)
    got = {(r.term, r.doc_id): r.positions for r in found.collect()}
    assert got == {("a", 0): [1], ("b", 0): [0, 2], ("a", 1): [0], ("c", 1): [1], ("c", None): [0, 1]}
    assert "hashpartitioning" not in plan(catalogue.QUERIES["positional_index"](spark, SF))


@pytest.mark.parametrize("most", [index.SENT_IDS, 1])
def test_rows_that_share_an_id_are_one_document(spark, tmp_path, monkeypatch, most):
    """Some ids of one row, some of several, none in several; sent to all tasks, and too many to be."""
    monkeypatch.setattr(index, "SENT_IDS", most)
    send = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(send)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rank = F.pmod("doc_id", F.lit(10))
    odd = docs.withColumn("doc_id", F.when(rank < 2, F.col("doc_id") - rank).when(rank > 2, F.col("doc_id")))
    odd.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    frame = catalogue.QUERIES["positional_index"](spark, str(tmp_path))
    if most == 1:
        spark.conf.set(send, "-1")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(catalogue.ORACLE_SQL["positional_index"])
    assert frame.columns == [c[0] for c in sql.description]
    try:
        assert told(frame.collect()) == told(sql.fetchall())
        assert ("SortMergeJoin" in plan(frame)) == (most == 1)
    finally:
        spark.conf.set(send, before)


def test_a_token_table_gives_the_same(spark):
    docs = spark.createDataFrame([(0, "b a b"), (0, "b"), (None, "c"), (None, "c d"), (3, "")], "doc_id long, text string")
    c = Collection(docs, AnalyzerConfig(stopwords=False, norm="none"))
    assert told(index.positional_index(c.tokens).collect()) == told(index.positional_index(c.arrays).collect()) == told(c.index("positional").collect())


def test_term_positions(spark):
    rng = random.Random(1)
    lists = [[], None, ["a"], *([rng.choice(["a", "b", "ab", "é", ""]) for _ in range(rng.randrange(30))] for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(lists)), "n int, tokens array<string>").select("n", F.inline(term_positions(F.col("tokens")))).collect()
    want = {(n, t): [i for i, x in enumerate(tokens) if x == t] for n, tokens in enumerate(lists) for t in tokens or ()}
    assert {(r.n, r.term): r.positions for r in rows} == want and len(rows) == len(want)
