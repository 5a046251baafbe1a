"""Stemming against lemmatisation: retrieval quality, vocabulary compression and lexical validity."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.functions.lemma import lemma_forms, lemma_map, lemma_terms, seed_exceptions, seed_lexicon
from lexiloom.functions.porter import stem_terms
from lexiloom.functions.text import ALPHA, hyphen_spaced, plain_tokens, without_stop_words, word_tokens
from lexiloom.operators.analyze import leading, normalised
from lexiloom.operators.index import empty_list, in_chunks, listed

# Queries that stand in where too few documents yield one.
FALLBACK_QUERIES = ("fox jumps", "Stanford university", "lung cancer")
METHODS = ("stem", "lemma")


def test_queries(docs: DataFrame) -> list[str]:
    """The first two all-letter words, without stop words, of the first three documents that have two."""
    words = F.filter(without_stop_words(word_tokens(F.lower(hyphen_spaced(F.col("text"))))), lambda w: w.rlike(ALPHA))
    rows = leading(docs, lambda d: d.select("doc_id", F.slice(words, 1, 2).alias("w")).where(F.size("w") >= 2), 3)
    found = [" ".join(r.w) for r in rows]
    return found + list(FALLBACK_QUERIES[len(found) :])


def query_words(docs: DataFrame, queries: list[str]) -> list[list[str]]:
    """Each query's words, tokenised as text is; stop words stay."""
    frame = docs.sparkSession.createDataFrame(list(enumerate(queries)), "i int, q string")
    return [list(r.w) for r in frame.select("i", word_tokens(F.lower("q")).alias("w")).orderBy("i").collect()]


def relevant(text: Column, words: list[str]) -> Column:
    """Whether every word is a substring of the lower-cased text with hyphens spaced."""
    low = F.lower(hyphen_spaced(text))
    out = F.lit(True)
    for w in words:
        out = out & F.coalesce(F.contains(low, F.lit(w)), F.lit(False))
    return out


def ground_truth(docs: DataFrame, queries: list[str]) -> DataFrame:
    """(query, doc_id) of all relevant documents, in one scan."""
    flags = F.array(*[F.struct(F.lit(q).alias("query"), relevant(F.col("text"), w).alias("hit")) for q, w in zip(queries, query_words(docs, queries))])
    return docs.select("doc_id", F.explode(F.filter(flags, lambda f: f["hit"])).alias("f")).select("f.query", "doc_id")


#: Queries whose words one automaton holds; more are asked block by block, in a scan each.
QUERY_BLOCK = 100_000


def ground_truth_of(docs: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id) of all relevant documents for a table (query_id, query) of any size: one pass over a text finds the words of all queries of a block.

    A query without words is relevant to every document, as for ground_truth. Queries of equal text are asked once each; documents are rows, whatever their ids.
    """
    asked = queries.select("query_id", F.array_distinct(word_tokens(F.lower("query"))).alias("words"))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block)))))
    kind, low = docs.schema["doc_id"].dataType.simpleString(), F.lower(hyphen_spaced(F.col("text"))).alias("text")
    of_query = queries.schema["query_id"].dataType.simpleString()
    rows, parts = docs.select("doc_id", low), []
    for n in sorted(r[0] for r in numbered.select("block").distinct().collect()):
        held = [(r.query_id, tuple(r.words)) for r in numbered.where(F.col("block") == n).select("query_id", "words").collect()]
        parts.append(rows.mapInArrow(_matcher(held), f"query_id {of_query}, doc_id {kind}"))
    return functools.reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], f"query_id {of_query}, doc_id {kind}")


def _matcher(queries: list[tuple]):
    """A function of batches (doc_id, text) to rows (query_id, doc_id) for these queries and their words."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of_word: dict[str, list[int]] = {}
        always = [i for i, (_, words) in enumerate(queries) if not words]
        for i, (_, words) in enumerate(queries):
            for w in words:
                of_word.setdefault(w, []).append(i)
        words = ahocorasick.Automaton()
        for w, wanted in of_word.items():
            words.add_word(w, (w, wanted))
        if of_word:
            words.make_automaton()
        for batch in batches:
            doc, query = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                held: dict[str, list[int]] = {w: wanted for _, (w, wanted) in words.iter(text)} if text and of_word else {}
                left: dict[int, int] = {}
                for wanted in held.values():
                    for i in wanted:
                        left[i] = left.get(i, len(queries[i][1])) - 1
                found = always + [i for i, n in left.items() if not n]
                query += found
                doc += [at] * len(found)
            ids = pa.array([q for q, _ in queries])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query, pa.int64())), batch.column("doc_id").take(pa.array(doc, pa.int64()))], names=["query_id", "doc_id"])

    return match


def _raw(cfg: AnalyzerConfig, norm: str = "none") -> AnalyzerConfig:
    """The evaluation's analyzer: always in lower case, with one norm."""
    return replace(cfg, lowercase=True, norm=norm)


def normal_forms(docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(term, stem, lemma) for the raw vocabulary; each distinct term is normalised once."""
    spark = docs.sparkSession
    vocabulary = docs.select(F.explode(plain_tokens(F.col("text"), _raw(cfg))).alias("term")).distinct()
    forms = lemma_forms(lexicon, exceptions)
    if forms is not None:
        return vocabulary.select("term", stem_terms(F.col("term")).alias("stem"), lemma_terms(F.col("term"), forms).alias("lemma"))
    lemmas = lemma_map(vocabulary, seed_lexicon(spark) if lexicon is None else lexicon, seed_exceptions(spark) if exceptions is None else exceptions)
    return lemmas.select("term", stem_terms(F.col("term")).alias("stem"), "lemma")


def _judged(docs: DataFrame, cfg: AnalyzerConfig, queries: list[str], lexical: dict) -> DataFrame:
    """(i, doc_id, truth, stem, lemma): for each query, the documents that are relevant or that a method retrieves; a row for each row of docs."""
    spark = docs.sparkSession
    words = query_words(docs, queries)
    asked = spark.createDataFrame(list(enumerate(words)), "i int, w array<string>")
    forms = {m: {r.i: list(dict.fromkeys(r.w)) for r in normalised(asked, "w", _raw(cfg, m), **lexical).collect()} for m in METHODS}
    rows = docs.select("doc_id", "text", F.explode(F.array(plain_tokens(F.col("text"), _raw(cfg)))).alias("tokens"))
    for m in METHODS:
        rows = normalised(rows.withColumn(m, F.col("tokens")), m, _raw(cfg, m), **lexical)

    def retrieves(method: str, i: int) -> Column:
        wanted = forms[method][i]
        return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col(method))) == 0 if wanted else F.lit(False)

    flags = [F.struct(F.lit(i).alias("i"), relevant(F.col("text"), w).alias("truth"), *[retrieves(m, i).alias(m) for m in METHODS]) for i, w in enumerate(words)]
    judged = rows.select("doc_id", F.explode(F.array(*flags)).alias("f")).select("doc_id", "f.*")
    return judged.where(F.col("truth") | functools.reduce(Column.__or__, [F.col(m) for m in METHODS])).select("i", "doc_id", "truth", *METHODS)


def _metrics(judged: DataFrame, queries: list[str]) -> DataFrame:
    """(i, query) with the numbers of relevant and of retrieved documents, and precision, recall and F1 of each method. Documents are counted, never listed."""
    spark = judged.sparkSession
    sums = judged.groupBy("i").agg(
        F.sum(F.col("truth").cast("long")).alias("n_truth"),
        *[F.sum(F.col(m).cast("long")).alias(f"n_{m}") for m in METHODS],
        *[F.sum((F.col(m) & F.col("truth")).cast("long")).alias(f"both_{m}") for m in METHODS],
    )
    # Queries keep their row when there are no documents.
    every = spark.createDataFrame(list(enumerate(queries)), "i int, query string").join(sums, "i", "left")
    out = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_truth", *(f"n_{m}" for m in METHODS))]
    for m in METHODS:
        ok = (F.coalesce(f"n_{m}", F.lit(0)) > 0) & (F.coalesce("n_truth", F.lit(0)) > 0)
        p, r = F.col(f"both_{m}") / F.col(f"n_{m}"), F.col(f"both_{m}") / F.col("n_truth")
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        out += [F.when(ok, F.round(x, 4)).otherwise(F.lit(0.0)).alias(f"{m}_{name}") for x, name in ((p, "P"), (r, "R"), (f1, "F1"))]
    return every.select("i", "query", *out)


def compare_metrics(
    docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), queries: list[str] | None = None, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """Per query: relevant documents, and for each method how many it retrieves, precision, recall and F1. One pass over the documents."""
    queries = test_queries(docs) if queries is None else queries
    return _metrics(_judged(docs, cfg, queries, {"lexicon": lexicon, "exceptions": exceptions}), queries).orderBy("i").drop("i")


def retrieved(
    docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), queries: list[str] | None = None, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """(query, method, doc_id): a row for each document that a method retrieves. Nothing is shuffled."""
    queries = test_queries(docs) if queries is None else queries
    judged = _judged(docs, cfg, queries, {"lexicon": lexicon, "exceptions": exceptions})
    kept = F.filter(F.array(*[F.when(F.col(m), F.lit(m)) for m in METHODS]), lambda m: m.isNotNull())
    names = F.array(*[F.lit(q) for q in queries]) if queries else F.array(F.lit(""))
    return judged.select(F.get(names, F.col("i")).alias("query"), F.explode(kept).alias("method"), "doc_id")


def compare_normalizers(
    docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), queries: list[str] | None = None, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None,
    whole: bool = False,
) -> DataFrame:
    """Per query and chunk: for each method, retrieved documents, precision, recall and F1; documents in chunks as in an index, so that no row grows with the collection.

    whole: each query has one row, its documents as text.
    """
    queries = test_queries(docs) if queries is None else queries
    # An exchange by all columns is the same for counts and lists, so that documents are analyzed once.
    judged = _judged(docs, cfg, queries, {"lexicon": lexicon, "exceptions": exceptions}).repartition("i", "doc_id", "truth", *METHODS)
    kinds = F.filter(F.array(*[F.when(F.col(m), F.struct(F.col("i"), F.lit(m).alias("m"))) for m in METHODS]), lambda x: x.isNotNull())
    pairs = judged.select("doc_id", F.explode(kinds).alias("key"))
    names = ("n", "docs")
    held = listed(pairs, "key", "doc_id", names) if whole else in_chunks(pairs, "key", "doc_id", F.col("doc_id"), names, distinct=True)
    by_query = held.groupBy(F.col("key.i").alias("i"), "chunk").agg(*[F.max(F.when(F.col("key.m") == m, F.col("docs"))).alias(f"{m}_retrieved") for m in METHODS])
    out = [c for m in METHODS for c in (F.coalesce(f"{m}_retrieved", empty_list(held, "docs")).alias(f"{m}_retrieved"), *[F.col(f"{m}_{k}") for k in ("P", "R", "F1")])]
    joined = _metrics(judged, queries).join(by_query, "i", "left")
    return joined.select("i", "query", F.coalesce("chunk", F.lit(0)).alias("chunk"), *out).orderBy("i", "chunk").drop("i")


def compare_summary(
    docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), queries: list[str] | None = None, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """Per method: averages, vocabulary size, compression and validity in percent, score, lead over the other; and, over both, who wins in each respect."""
    spark = docs.sparkSession
    words = seed_lexicon(spark) if lexicon is None else lexicon
    known = words.select(F.col("word").alias("form")).distinct().withColumn("known", F.lit(1))
    kinds = [F.struct(F.lit(m).alias("method"), F.col(c).alias("form")) for m, c in (*((m, m) for m in METHODS), ("raw", "term"))]
    long = normal_forms(docs, cfg, lexicon, exceptions).select(F.explode(F.array(*kinds)).alias("x")).select("x.*").distinct()
    sizes = long.join(known, "form", "left").groupBy("method").agg(F.count("*").alias("n"), F.count("known").alias("valid"))
    # Three rows: the two methods and the raw vocabulary.
    sizes = spark.createDataFrame([(m,) for m in (*METHODS, "raw")], "method string").join(sizes, "method", "left")
    both = sizes.agg(*[
        F.coalesce(F.max(F.when(F.col("method") == m, F.col(c))), F.lit(0)).alias(f"{c}_{m}") for m in (*METHODS, "raw") for c in ("n", "valid")
    ])
    quality = compare_metrics(docs, cfg, queries, lexicon, exceptions)
    means = quality.agg(*[F.round(F.avg(f"{m}_{k}"), 4).alias(f"{k}_{m}") for m in METHODS for k in ("P", "R", "F1")])
    one = both.join(means)  # both have one row
    for m in METHODS:
        n = F.col(f"n_{m}")
        one = one.withColumn(f"c_{m}", F.round((1 - n / F.greatest("n_raw", F.lit(1))) * 100, 2)).withColumn(f"v_{m}", F.round(F.col(f"valid_{m}") / F.greatest(n, F.lit(1)) * 100, 2))
        one = one.withColumn(f"s_{m}", F.round(0.5 * F.col(f"F1_{m}") + 0.25 * F.col(f"c_{m}") / 100 + 0.25 * F.col(f"v_{m}") / 100, 4))

    def higher(x: str) -> Column:
        return F.when(F.col(f"{x}_stem") > F.col(f"{x}_lemma"), "stem").when(F.col(f"{x}_lemma") > F.col(f"{x}_stem"), "lemma").otherwise("tie")

    rows = [
        F.struct(
            F.lit(m).alias("method"), *[F.col(f"{k}_{m}").alias(f"avg_{k}") for k in ("P", "R", "F1")], F.col(f"n_{m}").cast("long").alias("vocab_size"),
            F.col(f"c_{m}").alias("compression_rate"), F.col(f"v_{m}").alias("lexical_validity"), F.col(f"s_{m}").alias("score"),
            F.round(F.col(f"s_{m}") - F.col(f"s_{other}"), 4).alias("delta"), higher("s").alias("winner"),
            higher("c").alias("higher_compression"), higher("v").alias("higher_validity"),
        )
        for m, other in zip(METHODS, reversed(METHODS))
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").orderBy(F.desc("method"))


# Names of the methods in the summary's JSON.
LABELS = {"stem": "stemming", "lemma": "lemmatization"}


def summary_json(summary: DataFrame) -> DataFrame:
    """One row: both methods' averages, sizes and rates as nested JSON text, rates as percentages."""
    fields = [f"avg_{k}" for k in ("P", "R", "F1")] + ["vocab_size"]
    row = F.struct(*fields, *[percent(F.col(c)).alias(c) for c in ("compression_rate", "lexical_validity")])
    parts = summary.agg(*[F.max(F.when(F.col("method") == m, row)).alias(name) for m, name in LABELS.items()])
    return parts.select(F.to_json(F.struct(*LABELS.values())).alias("summary"))


def justification(summary: DataFrame) -> DataFrame:
    """One row: the winner, and for score, compression and validity both values and which is higher."""
    value = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    columns = [value(m, c).alias(f"{m}_{c}") for c in ("score", "compression_rate", "lexical_validity", "vocab_size") for m in METHODS]
    return summary.agg(F.max("winner").alias("winner"), F.max("higher_compression").alias("higher_compression"), F.max("higher_validity").alias("higher_validity"), *columns)


def percent(column: Column) -> Column:
    """A number as a percentage, for display."""
    return F.concat(column.cast("string"), F.lit("%"))
