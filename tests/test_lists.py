"""Registered queries whose SQL has one row for a key, with keys of more members than a chunk holds."""

import duckdb
import pytest

from lexiloom.operators import index
from lexiloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def told(rows) -> list[tuple]:
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", ["inverted_index", "biword_index", "kgram_index", "soundex_index", "dictionary_lookup", "compare_normalizers"])
def test_one_row_a_key_however_many_members(spark, con, monkeypatch, name):
    monkeypatch.setattr(index, "CHUNK", 3)
    frame = catalogue.QUERIES[name](spark, SF)
    sql = con.execute(catalogue.ORACLE_SQL[name])
    assert frame.columns == [c[0] for c in sql.description]
    assert told(frame.collect()) == told(sql.fetchall())


def test_repeated_and_missing_ids(spark, con):
    """A document without an id counts, and has no text; an id in several rows counts once."""
    pairs = spark.createDataFrame([("a", 2), ("a", None), ("a", 1), ("a", 2), ("b", None), ("a", None)], "term string, doc_id long")
    got = {r.term: tuple(r) for r in index.inverted_list(pairs).collect()}
    assert got == {"a": ("a", 0, 3, "1,2"), "b": ("b", 0, 1, "")}
