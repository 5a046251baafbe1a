"""Dictionary lookup with complete postings; ordering comes from sorting, not from a tree."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.functions.text import comma_list
from lexiloom.operators.analyze import analyzed
from lexiloom.operators.index import empty_list, inverted_index


def lookup_terms(frame: DataFrame, entries: str, cfg: AnalyzerConfig, **lexical: DataFrame) -> DataFrame:
    """(ord, query_term, term): each entry's first analyzed token, or the entry in lower case if it has none."""
    spark = frame.sparkSession
    raw = spark.createDataFrame([(entries,)], "e string").select(F.posexplode(comma_list(F.col("e"))).alias("doc_id", "text"))
    tokens = analyzed(raw, cfg, **lexical).withColumnRenamed("doc_id", "ord")
    return raw.withColumnRenamed("doc_id", "ord").join(tokens, "ord").select(
        "ord", F.col("text").alias("query_term"), F.coalesce(F.get("tokens", F.lit(0)), F.lower("text")).alias("term")
    )


def dictionary_lookup(tokens: DataFrame, entries: str, cfg: AnalyzerConfig = AnalyzerConfig(), lists: Callable[[DataFrame], DataFrame] = inverted_index, **lexical: DataFrame) -> DataFrame:
    """(query_term, in_corpus, chunk, docs) for each entry of a comma-separated list; docs in chunks as in the index, or, with lists=inverted_list, one text.

    The few terms are known when the plan is built, so the token table is filtered by them before it is
    shuffled, and the terms' documents are gathered for those terms alone.
    """
    terms = lookup_terms(tokens, entries, cfg, **lexical)
    wanted = [r.term for r in terms.select("term").distinct().collect()]
    found = tokens.where(F.col("term").isin(*wanted) if wanted else F.lit(False)).select("term", "doc_id")
    docs = lists(found)
    joined = terms.join(docs, "term", "left")
    empty = empty_list(docs, "docs")
    return joined.select("query_term", F.col("docs").isNotNull().alias("in_corpus"), F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("docs", empty).alias("docs"))


def lookup_latency(tokens: DataFrame, entries: str, cfg: AnalyzerConfig = AnalyzerConfig(), iterations: int = 5000, **lexical: DataFrame) -> DataFrame:
    """(query_term, in_corpus, search_us, retrieval_us) for each entry: mean microseconds of a look-up by itself.

    A look-up here is one of a batch: the entry is asked `iterations` times in one job, which is timed; search asks whether
    the term is there, retrieval for its documents.
    """
    spark = tokens.sparkSession
    rows = []
    for r in lookup_terms(tokens, entries, cfg, **lexical).orderBy("ord").collect():
        asked = spark.range(iterations).select(F.lit(r.term).alias("term"), "id")
        there = tokens.where(F.col("term") == r.term)
        found, spent = [], []
        for kept in (there.select("term").limit(1), inverted_index(there)):
            start = time.perf_counter()
            found.append(asked.join(F.broadcast(kept) if len(kept.columns) == 1 else kept, "term").agg(F.count("*")).first()[0])
            spent.append(round((time.perf_counter() - start) / iterations * 1e6, 4))
        rows.append((r.query_term, found[0] > 0, *spent))
    return spark.createDataFrame(rows, "query_term string, in_corpus boolean, search_us double, retrieval_us double")


def read_latency(
    frame: DataFrame, entries: str, search: Callable[[str], DataFrame], retrieve: Callable[[str], DataFrame], reads: int = 20,
    cfg: AnalyzerConfig = AnalyzerConfig(), **lexical: DataFrame,
) -> DataFrame:
    """(query_term, in_corpus, reads, and the 50th, 95th and 99th percentile of search and retrieval in microseconds) for each entry.

    Every read is a query of its own, planned and run; search tells whether there is a row, retrieval counts the documents. Both functions give a term's rows.
    """
    rows = []
    for r in lookup_terms(frame, entries, cfg, **lexical).orderBy("ord").collect():
        ask = (lambda: bool(search(r.term).limit(1).collect()), lambda: retrieve(r.term).select("doc_id").distinct().count())
        shares, there = [], False
        for k, f in enumerate(ask):
            spent = []
            for _ in range(reads):
                start = time.perf_counter()
                found = f()
                spent.append((time.perf_counter() - start) * 1e6)
            there = found if k == 0 else there
            shares += [round(sorted(spent)[min(reads - 1, int(reads * p))], 1) for p in (0.5, 0.95, 0.99)]
        rows.append((r.query_term, there, reads, *shares))
    columns = ", ".join(f"{kind}_p{p}_us double" for kind in ("search", "retrieval") for p in (50, 95, 99))
    return frame.sparkSession.createDataFrame(rows, f"query_term string, in_corpus boolean, reads int, {columns}")


def default_entries(terms: DataFrame) -> str:
    """The first three terms and one that is missing; all terms of a vocabulary of fewer."""
    first = [r.term for r in terms.select("term").distinct().orderBy("term").limit(3).collect()]
    return ", ".join([*first, "missingword"] if len(first) == 3 else first)
