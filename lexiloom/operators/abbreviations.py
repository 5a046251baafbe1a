"""Abbreviations of a collection, found without a list (Kiss and Strunk 2006, the type-based stage).

A word that is an abbreviation takes a period nearly always, is short, and often has periods inside. Its score is the log-likelihood
ratio of "a period follows with probability 0.99" to "as often as after any token", scaled by its length, its inner periods and its
occurrences without a period. One aggregation over the collection counts all words; a task sends a word once, however often it occurs.

What counts: tokens are runs between white space, quotes, brackets and the marks , ; : ? ! in lower case, after hyphens are spaced; a token with one period
at its end is a word with a period; tokens without a letter count in the totals alone; an ellipsis is no period. A null text has no tokens, repeated
documents count each, and an empty collection has no abbreviations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import hyphen_spaced
from lexiloom.sources.collection import scratch_path

#: A run between these is a token; Java and RE2 read the class alike.
RUN = r"[^\s,;:?!\"'()\[\]{}<>«»“”„‘’`@*]+"
#: The rate of periods after abbreviations, and the least score of one.
RATE, THRESHOLD = 0.99, 0.3
#: Abbreviations up to which a list is given to the analyzer, whose plans hold it.
MOST = 50_000


def period_counts(docs: DataFrame) -> DataFrame:
    """(word, n_with, n_without): how often each word stands with and without a period at its end."""
    runs = F.regexp_extract_all(F.lower(hyphen_spaced(F.coalesce(F.col("text"), F.lit("")))), F.lit(RUN), F.lit(0))
    run = F.col("run")
    ends = run.endswith(".") & ~run.endswith("..") & (run != ".")
    told = docs.select(F.explode(runs).alias("run")).select(F.when(ends, F.left(run, F.length(run) - 1)).otherwise(run).alias("word"), ends.cast("long").alias("with"))
    return told.groupBy("word").agg(F.sum("with").alias("n_with"), F.sum(1 - F.col("with")).alias("n_without"))


def score(word: Column, n_with: Column, n_without: Column, n_periods: Column, n_tokens: Column) -> Column:
    """The word's score, given all tokens and those with a period."""
    p = F.least(n_periods / n_tokens, F.lit(1 - 1e-9))
    ratio = 2 * (n_with * (math.log(RATE) - F.log(p)) + n_without * (math.log(1 - RATE) - F.log(1 - p)))
    inner = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = (F.length(word) - inner).cast("double")
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -n_without.cast("double"))


def abbreviations(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(word, n_with, n_without, score) of the collection's abbreviations, without their last period."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "periods")
    # Stored, as they are read twice: in one plan, texts would be read and cut for the words and again for the totals, a subquery of one row.
    period_counts(docs).write.mode("overwrite").parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.struct(F.sum("n_with").alias("periods"), F.sum(F.col("n_with") + F.col("n_without")).alias("tokens")).alias("t")).scalar()
    words = counts.where((F.col("n_with") > 0) & F.col("word").rlike(r"\p{L}")).withColumn("t", total)
    scored = words.withColumn("score", score(F.col("word"), F.col("n_with"), F.col("n_without"), F.col("t.periods"), F.col("t.tokens")))
    return scored.where(F.col("score") >= threshold).select("word", "n_with", "n_without", "score")


def abbreviation_words(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[str, ...]:
    """The abbreviations that matter to the analyzer: those of letters and digits alone, as all other tokens are dropped anyway."""
    found = abbreviations(docs, threshold).where(F.col("word").rlike(r"^[\p{L}\p{N}]+$")).select("word").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} abbreviations; raise the threshold")
    return tuple(sorted(r.word for r in found))
