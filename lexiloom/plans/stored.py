"""A collection whose indexes are stored, so that a query reads the few rows it asks for.

Every table is sorted by its key within files of key ranges. A query's terms are known when its plan is built, and
become filters that skip files and row groups. Rows of the collection are numbered when they are stored, so that documents
with one id, or none, stay apart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators import analyze, dictionary, index, permuterm, phrase, spelling, tolerant
from lexiloom.plans.workbench import Collection
from lexiloom.sources.collection import read_ranges, store_index, store_ranges, stored_bytes

#: Tables and their keys.
TABLES = {
    "arrays": ("row",), "tokens": ("term", "row", "pos"), "biwords": ("biword", "row"), "terms": ("term",), "grams": ("gram", "term"),
    "codes": ("code", "term"), "permuterm": ("rotation", "term"), "blocks": ("first",), "counts": ("term",),
}
#: Tables that are asked for single keys: their row groups have Bloom filters, for about so many keys, and the ranges of their files are stored.
POINTS = {"tokens": 1 << 17, "biwords": 1 << 20, "codes": 1 << 13, "counts": 1 << 20}
#: Rows of a phrase's rarest term up to which they are sent to all executors, to leave out rows of other terms before those are shuffled.
RARE_ROWS = 1 << 20
#: Bytes of a stored table whose rows' terms, pairs or places, with their keys, are one range at most: some 1.5 million rows, which a task sorts in some 250 MB.
RANGE_BYTES = {"arrays": 8 << 20, "counts": 32 << 20, "terms": 1 << 20}


#: What each table is made from.
MADE_FROM = {
    "tokens": "arrays", "biwords": "arrays", "counts": "arrays", "terms": "counts", "grams": "terms", "codes": "terms", "permuterm": "terms", "blocks": "terms",
}


def with_sources(*names: str) -> list[str]:
    """These tables and those they are made from, in the order in which they are built."""
    found = set(names)
    for name in names:
        while name := MADE_FROM.get(name, ""):
            found.add(name)
    return [n for n in ("arrays", *MADE_FROM) if n in found]


def build(collection: Collection, path: str, tables: Iterable[str] = tuple(TABLES), built: Iterable[str] = ()) -> StoredCollection:
    """Writes tables under a path, all of them unless some are named. Texts are analyzed once; what hangs on terms alone is made from the stored terms.

    A named table brings those that it is made from. built: tables that are there already, of the same collection.
    """
    spark, cfg = collection.docs.sparkSession, collection.cfg
    at = lambda name: spark.read.parquet(f"{path}/{name}")
    make = {
        # Numbers rise in the order in which rows are written.
        "arrays": lambda: collection.arrays.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tokens"),
        "tokens": lambda: at("arrays").select("row", "doc_id", F.posexplode("tokens").alias("pos", "term")),
        "biwords": lambda: index.biword_pairs(at("arrays"), "row", "doc_id"),
        "counts": lambda: index.term_counts(at("arrays")),
        "terms": lambda: at("counts").select("term"),
        "grams": lambda: index.kgram_pairs(at("terms")),
        "codes": lambda: index.soundex_pairs(at("terms")),
        "permuterm": lambda: permuterm.permuterm_pairs(at("terms")),
        "blocks": lambda: spelling.term_blocks(at("terms")),
    }
    have = set(built)
    for name in (n for n in with_sources(*tables) if n not in have):
        if name == "arrays":
            make[name]().write.mode("overwrite").parquet(f"{path}/{name}")
            continue
        source = MADE_FROM[name]
        parts = -(-stored_bytes(spark, f"{path}/{source}") // RANGE_BYTES[source])
        store_index(make[name](), f"{path}/{name}", *TABLES[name], bloom=POINTS.get(name, 0), parts=parts)
        if name in POINTS:
            store_ranges(spark, f"{path}/{name}", TABLES[name][0], f"{path}/ranges/{name}")
    return StoredCollection(spark, path, cfg, **collection.lexical)


class StoredCollection:
    """Queries on the tables under a path, with the configuration they were built with."""

    def __init__(self, spark: SparkSession, path: str, cfg: AnalyzerConfig = AnalyzerConfig(), lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> None:
        self.spark, self.path, self.cfg = spark, path, cfg
        self.lexical = {"lexicon": lexicon, "exceptions": exceptions}

    def __getattr__(self, name: str) -> DataFrame:
        """A table, opened when it is first asked for."""
        if name not in TABLES:
            raise AttributeError(name)
        setattr(self, name, self.spark.read.parquet(f"{self.path}/{name}"))
        return self.__dict__[name]

    def _phrase(self, text: str) -> list[str]:
        return analyze.query_tokens(self.tokens, text, self.cfg, **self.lexical)

    def at(self, name: str, *keys: str) -> DataFrame:
        """The rows of one of POINTS with these keys."""
        return read_ranges(self.spark, f"{self.path}/{name}", TABLES[name][0], f"{self.path}/ranges/{name}", list(dict.fromkeys(keys)))

    def _holders(self, terms: list[str]) -> DataFrame | None:
        """Numbers of the rows that hold the rarest of these terms, if they are few enough to be sent to all executors."""
        counts = {r.term: r.n_rows for r in self.at("counts", *terms).collect()}
        rarest = min(dict.fromkeys(terms), key=lambda t: counts.get(t, 0))
        if counts.get(rarest, 0) > RARE_ROWS:
            return None
        return self.at("tokens", rarest).select("row").distinct()

    def phrase(self, text: str | None = None, method: str = "positional") -> DataFrame:
        """method: positional, biword, or false_positives. Without a text, the first document's first two tokens are asked for.

        Of a phrase's terms the rarest is read first, and of the others only what stands in its rows is shuffled.
        """
        terms = self._phrase(phrase.default_phrase_of(self.arrays) if text is None else text)
        holders = self._holders(terms) if len(set(terms)) > 1 else None
        within = lambda rows: rows if holders is None else rows.join(F.broadcast(holders), "row", "left_semi")
        positional = phrase.positional_lookup(within(self.at("tokens", *terms)), terms, "row", "doc_id")
        if method == "positional":
            return positional.drop("row")
        single = len(terms) == 1
        pairs = self.at("tokens", *terms).select(F.col("term").alias("biword"), "row", "doc_id") if single else within(self.at("biwords", *phrase.pairs(terms)))
        found = phrase.biword_lookup(pairs, terms, "row", "doc_id")
        if method == "false_positives":
            found = found.join(positional, "row", "left_anti") if len(terms) >= 3 else found.where(F.lit(False))
        return found.drop("row")

    def samples(self) -> DataFrame:
        """As of the collection, from the stored tables."""
        return index.samples(self.biwords.select("biword", "doc_id"), self.tokens, self.grams, self.arrays)

    def defaults(self) -> dict[str, str]:
        """What a user is offered for each kind of query."""
        return {"phrase": phrase.default_phrase_of(self.arrays), "lookup": dictionary.default_entries(self.terms), **tolerant.default_queries(self.terms)}

    def lookup(self, entries: str | None = None, **options) -> DataFrame:
        return dictionary.dictionary_lookup(self.tokens, dictionary.default_entries(self.terms) if entries is None else entries, self.cfg, **options, **self.lexical)

    def lookup_latency(self, entries: str | None = None, iterations: int = 5000) -> DataFrame:
        return dictionary.lookup_latency(self.tokens, dictionary.default_entries(self.terms) if entries is None else entries, self.cfg, iterations, **self.lexical)

    def read_latency(self, entries: str | None = None, reads: int = 20) -> DataFrame:
        """How long separate look-ups take: (query_term, in_corpus, reads, and percentiles of search and retrieval in microseconds) for each entry."""
        entries = dictionary.default_entries(self.terms) if entries is None else entries
        return dictionary.read_latency(self.terms, entries, lambda t: self.at("counts", t), lambda t: self.at("tokens", t), reads, self.cfg, **self.lexical)

    def wildcard(self, pattern: str) -> DataFrame:
        """One range of rotations; a pattern that is not its own lower case has its candidates among the bigrams, as on an unstored collection."""
        if pattern == pattern.lower() or "*" not in pattern:
            return permuterm.permuterm_lookup(self.permuterm, pattern)
        return tolerant.matching(tolerant.gram_candidates(self.grams, self.terms, pattern), pattern)

    def wildcard_grams(self, pattern: str) -> DataFrame:
        return tolerant.decomposition(tolerant.gram_candidates(self.grams, self.terms, pattern), pattern)

    def spell(self, word: str, max_dist: int = 2) -> DataFrame:
        return spelling.spell_lookup(self.blocks, word, max_dist)

    def spell_blocks(self, word: str, max_dist: int = 2) -> DataFrame:
        """How many blocks and terms a spelling query reads, of all."""
        return spelling.spell_blocks(self.blocks, word, max_dist)

    def phonetic(self, word: str) -> DataFrame:
        """The word's code is known when the plan is built, so the filter reaches the scan."""
        return tolerant.coded(self.codes, word)
