"""Phrase queries: biwords, positions, and where they differ.

Over documents both are one pass without a shuffle. Over stored indexes, biwords are a relational
division and positions a single aggregation on (document, position less place in the phrase).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.functions.text import biwords
from lexiloom.operators.analyze import analyzed, leading


def pairs(terms: list[str]) -> list[str]:
    """A phrase's distinct neighbouring pairs."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(terms, terms[1:])))


def _literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_biwords(tokens: Column, terms: list[str]) -> Column:
    """Whether all neighbouring pairs of the phrase occur; one term: whether it does; no term: false."""
    if not terms:
        return F.lit(False)
    if len(terms) == 1:
        return F.array_contains(tokens, terms[0])
    # A document without the terms cannot have the pairs; the cheap test comes first.
    return F.forall(_literals(list(dict.fromkeys(terms))), lambda t: F.array_contains(tokens, t)) & (
        F.size(F.array_except(_literals(pairs(terms)), biwords(tokens))) == 0
    )


def phrase_start(tokens: Column, terms: list[str]) -> Column:
    """The first position at which the phrase stands, or null."""
    n = len(terms)
    if not n:
        return F.lit(None).cast("int")
    last = F.size(tokens) - n
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(tokens, i + 1, n) == _literals(terms))
    return F.when((last >= 0) & F.array_contains(tokens, terms[0]), F.get(starts, F.lit(0)))


def phrase_biword(arrays: DataFrame, terms: list[str]) -> DataFrame:
    """Documents (doc_id) that the biword index would return."""
    return arrays.where(has_biwords(F.col("tokens"), terms)).select("doc_id")


def phrase_positional(arrays: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, positions) of the phrase's first occurrence."""
    found = arrays.select("doc_id", phrase_start(F.col("tokens"), terms).alias("start")).where("start is not null")
    return found.select("doc_id", F.expr(f"sequence(start, start + {max(len(terms), 1) - 1})").alias("positions"))


def phrase_false_positives(arrays: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that biwords return and positions do not; only phrases of three terms or more have any."""
    if len(terms) < 3:
        return arrays.where(F.lit(False)).select("doc_id")
    return arrays.where(has_biwords(F.col("tokens"), terms) & phrase_start(F.col("tokens"), terms).isNull()).select("doc_id")


def phrase_report(arrays: DataFrame, terms: list[str]) -> DataFrame:
    """One row: the query's tokens, its pairs (the token itself if there is one), and the numbers of documents by either index and of false positives."""
    both = arrays.select(has_biwords(F.col("tokens"), terms).alias("b"), phrase_start(F.col("tokens"), terms).isNotNull().alias("p"))
    wrong = F.col("b") & ~F.col("p") & F.lit(len(terms) >= 3)
    counts = both.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("n_biword", F.col("b")), ("n_positional", F.col("p")), ("n_false_positives", wrong))])
    asked = pairs(terms) if len(terms) != 1 else terms
    return counts.select(*[_literals(x).cast("array<string>").alias(n) for n, x in (("tokens", terms), ("pairs", asked))], *counts.columns)


def default_phrase(docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), **lexical: DataFrame) -> str:
    """The first two tokens of the first document that has two; the empty string if none has."""
    first = leading(docs, lambda d: analyzed(d, cfg, **lexical).where(F.size("tokens") >= 2).select("doc_id", F.slice("tokens", 1, 2).alias("t")), 1)
    return " ".join(first[0].t) if first else ""


def default_phrase_of(arrays: DataFrame) -> str:
    """default_phrase of stored token arrays."""
    first = arrays.where(F.size("tokens") >= 2).orderBy("doc_id").select(F.slice("tokens", 1, 2).alias("t")).limit(1).collect()
    return " ".join(first[0].t) if first else ""


def biword_lookup(held: DataFrame, terms: list[str], *by: str) -> DataFrame:
    """phrase_biword over stored biwords (biword, doc_id), for two terms or more; for one over stored postings, renamed.

    by: what tells documents apart, if not their id alone; it is returned.
    """
    by = by or ("doc_id",)
    wanted = pairs(terms) if len(terms) != 1 else terms
    found = held.where(F.col("biword").isin(*wanted) if wanted else F.lit(False))
    return found.groupBy(*by).agg(F.count_distinct("biword").alias("n")).where(F.col("n") == len(wanted)).select(*by)


def positional_lookup(tokens: DataFrame, terms: list[str], *by: str) -> DataFrame:
    """phrase_positional over a stored token table (doc_id, pos, term): one shuffle for any number of terms.

    by: what tells documents apart, if not their id alone; it is returned.
    """
    by, n = by or ("doc_id",), len(terms)
    # A phrase without a term stands nowhere; its one place keeps the plan's types.
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(terms or [""])])
    hits = tokens.where(F.col("term").isin(*terms) if terms else F.lit(False)).select(
        *by, F.explode(F.filter(places, lambda p: p["t"] == F.col("term"))).alias("p"), "pos"
    )
    starts = hits.groupBy(*by, (F.col("pos") - F.col("p.k")).alias("start")).agg(F.count_distinct("p.k").alias("n")).where(F.col("n") == n)
    return starts.groupBy(*by).agg(F.min("start").alias("start")).select(*by, F.expr(f"sequence(start, start + {max(n, 1) - 1})").alias("positions"))
