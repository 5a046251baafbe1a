"""Indexes as ordinary DataFrames.

The long forms (postings, biword_postings, kgram_pairs, soundex_pairs, the token table) are the indexes that queries
read. The forms with arrays are for results: a key's members come in chunks of about CHUNK, dealt by hash,
so no row grows with the collection; a key with at most CHUNK members has chunk 0 alone. The forms with text (listed)
have one row for each key, however many members it has.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom.functions.text import ALPHA, biwords, kgrams, soundex_code, term_positions


#: Members of a key in one row.
CHUNK = 1 << 16


def in_chunks(pairs: DataFrame, key: str, by: str, members: Column, names: tuple[str, str], most: int | None = None, distinct: bool = False) -> DataFrame:
    """(key, chunk, number of members, members) of pairs; only keys of more than CHUNK members are dealt.

    most: what no key has more members than, if that is known. Up to CHUNK, one exchange does. distinct: whether the pairs are distinct already.
    """
    n, name = names
    if most is not None and most <= CHUNK:
        grouped = pairs.groupBy(key).agg(F.array_sort(F.collect_set(members)).alias(name))
        return grouped.select(key, F.lit(0).alias("chunk"), F.size(name).cast("long").alias(n), name)
    pairs = pairs if distinct else pairs.distinct()
    heavy = pairs.groupBy(key).agg(F.count("*").alias("all")).where(F.col("all") > CHUNK)
    chunk = F.coalesce(F.pmod(F.xxhash64(by), F.ceil(F.col("all") / CHUNK)), F.lit(0)).cast("int")
    dealt = pairs.join(heavy, key, "left").withColumn("chunk", chunk)
    return dealt.groupBy(key, "chunk").agg(F.coalesce(F.max("all"), F.count("*")).alias(n), F.array_sort(F.collect_list(members)).alias(name))


def listed(pairs: DataFrame, key: str, members: str, names: tuple[str, str]) -> DataFrame:
    """(key, chunk 0, number of members, members as text) of pairs: all members of a key, each once, ascending, with commas between.

    One exchange. A key's rows are sorted, on disk where they are many; as members only CHUNK at a time are held, and of a whole key its text alone.
    Null counts as a member, and has no text.
    """
    n, name = names
    piece = F.floor((F.col("place") - 1) / CHUNK)
    ranked = pairs.withColumn("place", F.dense_rank().over(Window.partitionBy(key).orderBy(members)))
    text = F.array_join(F.transform(F.array_sort(F.collect_set(members)), lambda x: x.cast("string")), ",")
    pieces = ranked.groupBy(key, piece.alias("piece")).agg(F.max("place").cast("long").alias(n), text.alias("text"))
    whole = pieces.groupBy(key).agg(F.max(n).alias(n), F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("texts"))
    return whole.select(key, F.lit(0).alias("chunk"), n, F.array_join(F.transform("texts", lambda x: x["text"]), ",").alias(name))


def empty_list(lists: DataFrame, name: str) -> Column:
    """No members, as in_chunks or listed would give them."""
    kind = lists.schema[name].dataType
    return F.lit("") if kind == StringType() else F.array().cast(kind)


def _term_pairs(frame: DataFrame) -> DataFrame:
    """(term, doc_id) of a token table or of token arrays; of arrays, each once a row."""
    if "tokens" in frame.columns:
        frame = frame.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return frame.select("term", "doc_id")


def postings(frame: DataFrame) -> DataFrame:
    """(term, doc_id), distinct, of a token table or of token arrays."""
    return _term_pairs(frame).distinct()


def inverted_index(frame: DataFrame, most: int | None = None) -> DataFrame:
    """(term, chunk, df, docs): documents of each term, ascending in a chunk; df is the term's. most: the number of documents, if known."""
    return in_chunks(_term_pairs(frame), "term", "doc_id", F.col("doc_id"), ("df", "docs"), most)


def inverted_list(frame: DataFrame) -> DataFrame:
    """inverted_index with one row for each term, its documents as text."""
    return listed(_term_pairs(frame), "term", "doc_id", ("df", "docs"))


def biword_pairs(arrays: DataFrame, *by: str) -> DataFrame:
    """(biword, doc_id), each once a row; from token arrays, so pairs need no window. by: other columns to keep than doc_id."""
    by = by or ("doc_id",)
    return arrays.select(*by, F.explode(F.array_distinct(biwords(F.col("tokens")))).alias("biword")).select("biword", *by)


def biword_postings(arrays: DataFrame) -> DataFrame:
    """(biword, doc_id), distinct."""
    return biword_pairs(arrays).distinct()


def biword_index(arrays: DataFrame, most: int | None = None) -> DataFrame:
    """(biword, chunk, df, docs). most: the number of documents, if known."""
    return in_chunks(biword_pairs(arrays), "biword", "doc_id", F.col("doc_id"), ("df", "docs"), most)


def biword_list(arrays: DataFrame) -> DataFrame:
    """biword_index with one row for each biword, its documents as text."""
    return listed(biword_pairs(arrays), "biword", "doc_id", ("df", "docs"))


#: Ids of several rows that are sent to all tasks; of more, rows are shuffled to find theirs.
SENT_IDS = 200_000


def positional_index(frame: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, positions), positions ascending, of a token table or of token arrays.

    Of arrays, a row's positions are put together in the row. Only rows that share their id, or have none as others do, are shuffled, by term and document;
    which they are is looked up at once. ids: (doc_id) of the same rows, if that takes no tokens.
    """
    if "tokens" not in frame.columns:
        return frame.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    listed_in = lambda rows: rows.select("doc_id", F.inline(term_positions(F.col("tokens")))).select("term", "doc_id", "positions")
    shared = (frame if ids is None else ids).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("shared"))
    known = shared.limit(SENT_IDS + 1).count()
    if not known:
        return listed_in(frame)
    shared = F.broadcast(shared) if known <= SENT_IDS else shared
    of_shared = F.col("doc_id").eqNullSafe(F.col("shared"))
    # Dealt by both: else what a join by id has dealt would do, and an id of very many rows would be one task's.
    several = listed_in(frame.join(shared, of_shared, "left_semi")).repartition("term", "doc_id")
    several = several.groupBy("term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return listed_in(frame.join(shared, of_shared, "left_anti")).union(several)


def positional_map(tokens: DataFrame) -> DataFrame:
    """(term, chunk, df, map of document to positions). A map has no null key: documents without an id are left out."""
    pairs = in_chunks(positional_index(tokens.where("doc_id is not null")), "term", "doc_id", F.struct("doc_id", "positions"), ("df", "docs"))
    return pairs.withColumn("docs", F.map_from_entries("docs"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """Distinct terms."""
    return tokens.select("term").distinct()


def term_counts(arrays: DataFrame) -> DataFrame:
    """(term, n, n_rows): how often each term stands in a table of token arrays, and in how many rows. Tasks send a term once, and hold no more than their terms."""
    # A row's tokens, then its distinct tokens; unlike a sort of each row, no function is called for each comparison.
    both = F.array(F.struct(F.col("tokens"), F.lit(1).alias("n"), F.lit(0).alias("n_rows")), F.struct(F.array_distinct("tokens").alias("tokens"), F.lit(0).alias("n"), F.lit(1).alias("n_rows")))
    told = arrays.select(F.inline(both)).select(F.explode("tokens").alias("term"), "n", "n_rows")
    return told.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def kgram_pairs(terms: DataFrame, k: int = 2) -> DataFrame:
    """(gram, term), distinct."""
    return terms.select("term").distinct().select(F.explode(F.array_distinct(kgrams(F.col("term"), k))).alias("gram"), "term")


def kgram_index(terms: DataFrame, k: int = 2) -> DataFrame:
    """(gram, chunk, n, terms), terms ascending in a chunk."""
    return in_chunks(kgram_pairs(terms, k), "gram", "term", F.col("term"), ("n", "terms"), distinct=True)


def kgram_list(terms: DataFrame, k: int = 2) -> DataFrame:
    """kgram_index with one row for each k-gram, its terms as text."""
    return listed(kgram_pairs(terms, k), "gram", "term", ("n", "terms"))


def soundex_pairs(terms: DataFrame) -> DataFrame:
    """(code, term) of all-letter terms."""
    alpha = terms.select("term").distinct().where(F.col("term").rlike(ALPHA))
    return alpha.select(soundex_code(F.col("term")).alias("code"), "term").where("code <> ''")


def soundex_index(terms: DataFrame) -> DataFrame:
    """(code, chunk, n, terms), terms ascending in a chunk."""
    return in_chunks(soundex_pairs(terms), "code", "term", F.col("term"), ("n", "terms"), distinct=True)


def soundex_list(terms: DataFrame) -> DataFrame:
    """soundex_index with one row for each code, its terms as text."""
    return listed(soundex_pairs(terms), "code", "term", ("n", "terms"))


def index_sample(index: DataFrame, key: str, n: int) -> DataFrame:
    """The first n entries by key, as JSON text."""
    order = [key, *(c for c in ("chunk",) if c in index.columns)]
    return index.orderBy(*order).limit(n).select(F.col(key).alias("key"), F.to_json(F.struct(*index.columns)).alias("entry"))


#: Documents whose keys bound the first keys of all.
SOME_DOCUMENTS = 1000


def _first_keys(pairs: DataFrame, key: str, n: int, some: DataFrame | None = None) -> DataFrame:
    """The rows of the first n keys, and perhaps of some keys behind them, before any key's members are gathered.

    some: a few of the pairs; the nth of their keys is at or behind the nth of all, so that one pass leaves out what is behind it. Without so many, the keys are sought in a pass of their own.
    """
    first = lambda frame: [r[0] for r in frame.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n).collect()]
    known = [] if some is None else first(some)
    if len(known) == n:
        return pairs.where(F.col(key) <= known[-1])
    keys = first(pairs)
    return pairs.where(F.col(key).isin(*keys) if keys else F.lit(False))


def samples(biwords_held: DataFrame, tokens: DataFrame, grams: DataFrame, arrays: DataFrame | None = None) -> DataFrame:
    """(kind, key, entry): the first entries by key of the biword (8), positional (5) and k-gram (10) index, as JSON, of (biword, doc_id), a token table and (gram, term).

    arrays: the same documents' token arrays, of which a few bound the keys.
    """
    some: list[DataFrame | None] = [None, None, None]
    if arrays is not None:
        few = arrays.select("doc_id", "tokens").limit(SOME_DOCUMENTS)
        terms = few.select("doc_id", F.explode("tokens").alias("term"))
        some = [biword_pairs(few), terms.where("doc_id is not null"), kgram_pairs(terms)]
    kinds = (
        ("biword", in_chunks(_first_keys(biwords_held, "biword", 8, some[0]), "biword", "doc_id", F.col("doc_id"), ("df", "docs")), "biword", 8),
        ("positional", positional_map(_first_keys(tokens.where("doc_id is not null"), "term", 5, some[1])), "term", 5),
        ("kgram", in_chunks(_first_keys(grams, "gram", 10, some[2]), "gram", "term", F.col("term"), ("n", "terms"), distinct=True), "gram", 10),
    )
    parts = [index_sample(frame, key, n).select(F.lit(kind).alias("kind"), "key", "entry") for kind, frame, key, n in kinds]
    return functools.reduce(DataFrame.union, parts)
