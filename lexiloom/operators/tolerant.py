"""Tolerant retrieval over a vocabulary: wildcards, spelling, phonetics. These queries are not analyzed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import ALPHA, soundex_code, wildcard_grams, wildcard_like
from lexiloom.operators.index import kgram_pairs, soundex_pairs


def wildcard_candidates(terms: DataFrame, pattern: str) -> DataFrame:
    """Terms with all bigrams of the lower-cased pattern; all terms if it has none."""
    return gram_candidates(kgram_pairs(terms), terms, pattern)


def gram_candidates(pairs: DataFrame, terms: DataFrame, pattern: str) -> DataFrame:
    """wildcard_candidates over stored pairs (gram, term)."""
    grams = wildcard_grams(pattern)
    if not grams:
        return terms.select("term").distinct()
    hits = pairs.where(F.col("gram").isin(*grams))
    return hits.groupBy("term").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("term")


def wildcard(terms: DataFrame, pattern: str) -> DataFrame:
    """Matching terms, sorted; a pattern without * matches nothing.

    If the pattern is its own lower case, candidates cannot exclude a match, and LIKE alone is exact; Catalyst
    turns it into prefix and suffix tests that reach the scan. Otherwise candidates come first.
    """
    if "*" not in pattern:
        return terms.where(F.lit(False)).select("term")
    return matching(terms.select("term").distinct() if pattern == pattern.lower() else wildcard_candidates(terms, pattern), pattern)


def matching(candidates: DataFrame, pattern: str) -> DataFrame:
    """Candidates that match the pattern, sorted."""
    return candidates.where(F.col("term").like(wildcard_like(pattern))).orderBy("term")


def spell_suggest(terms: DataFrame, word: str, max_dist: int = 2) -> DataFrame:
    """(term, distance) of all terms within an edit distance of the lower-cased word, nearest first; lengths are compared before distances."""
    word = word.lower()
    near = terms.select("term").distinct().where(F.abs(F.length("term") - F.length(F.lit(word))) <= max_dist)
    scored = near.select("term", F.levenshtein("term", F.lit(word), max_dist).alias("distance"))
    return scored.where(F.col("distance").between(0, max_dist)).orderBy("distance", "term")


def _spell_keys(words: DataFrame, name: str, query: bool, max_dist: int) -> DataFrame:
    """(word, key): what words within max_dist of each other have in common.

    Cut a query into max_dist + 1 pieces: one of them stands unchanged in any word so near, moved by at most as many
    places as there are edits before it, and edits behind it make up for the rest of the difference in length. A
    query has a key for each piece; a term one for each piece of each length a query may have and each move. Their number
    depends on max_dist alone (39 for 2), however long the word.
    """
    parts, near = max_dist + 1, range(-max_dist, max_dist + 1)
    ways = [(0, k, 0) for k in range(parts)] if query else [(d, k, m) for d in near for k in range(parts) for m in near if abs(m) + abs(d - m) <= max_dist]
    way = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(w, ("longer", "k", "move"))]) for w in ways])).alias("way")
    rows = words.select(name, way).withColumn("m", F.length(name) - F.col("way.longer")).where("m >= 0")
    rows = rows.withColumn("start", F.floor(F.col("m") * F.col("way.k") / parts).cast("int")).withColumn("end", F.floor(F.col("m") * (F.col("way.k") + 1) / parts).cast("int"))
    rows = rows.withColumn("at", F.col("start") + F.col("way.move")).where((F.col("at") >= 0) & (F.col("at") + F.col("end") - F.col("start") <= F.length(name)))
    return rows.select(name, F.xxhash64("m", "way.k", F.substring(name, F.col("at") + 1, F.col("end") - F.col("start"))).alias("key"))


def spell_join(terms: DataFrame, queries: DataFrame, max_dist: int = 2) -> DataFrame:
    """(query, term, distance) for a table of queries; only words that share a key are compared."""
    asked = queries.select("query").distinct().where("query is not null")
    shortest, longest = asked.agg(F.min(F.length("query")), F.max(F.length("query"))).first()
    near = terms.select("term").distinct().where(F.length("term").between((shortest or 0) - max_dist, (longest or 0) + max_dist))
    pairs = _spell_keys(near, "term", False, max_dist).join(_spell_keys(asked, "query", True, max_dist), "key").select("query", "term").distinct()
    return pairs.select("query", "term", F.levenshtein("term", "query", max_dist).alias("distance")).where(F.col("distance").between(0, max_dist))


def decomposed(terms: DataFrame, pattern: str) -> DataFrame:
    """One row: the pattern, its bigrams, and the number of terms that have them all."""
    return decomposition(wildcard_candidates(terms, pattern), pattern)


def decomposition(candidates: DataFrame, pattern: str) -> DataFrame:
    """decomposed of candidates that are known."""
    count = candidates.agg(F.count("*").alias("n_candidates"))
    return count.select(F.lit(pattern).alias("pattern"), F.array(*[F.lit(g) for g in wildcard_grams(pattern)]).cast("array<string>").alias("grams"), "n_candidates")


def phonetic(terms: DataFrame, word: str) -> DataFrame:
    """(code, term) of all-letter terms that sound like the word."""
    return coded(soundex_pairs(terms), word)


def coded(pairs: DataFrame, word: str) -> DataFrame:
    """phonetic over stored pairs (code, term)."""
    code = soundex_code(F.lit(word))
    return pairs.where((F.col("code") == code) & (code != "")).select("code", "term").orderBy("term")


def default_queries(terms: DataFrame) -> dict[str, str]:
    """What a user is offered: a pattern, a misspelling and a name, made of the first all-letter terms."""
    alpha = terms.where(F.col("term").rlike(ALPHA))
    first = [r.term for r in alpha.orderBy("term").limit(1).collect()]
    long = [r.term for r in alpha.where(F.length("term") >= 3).orderBy("term").limit(1).collect()]
    return {
        "wildcard": f"{long[0][0]}*{long[0][-1]}" if long else "*",
        "spelling": first[0][:-1] if first and len(first[0]) > 2 else "word",
        "phonetic": first[0] if first else "college",
    }
