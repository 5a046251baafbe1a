"""The facade: a collection with one analyzer configuration, and every query on it. Results are lazy DataFrames."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators import abbreviations, analyze, dictionary, evaluate, index, phrase, tolerant


class Collection:
    """Documents (doc_id, text) under a configuration."""

    def __init__(self, docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> None:
        self.docs, self.cfg = docs.select("doc_id", "text"), cfg
        self.lexical = {"lexicon": lexicon, "exceptions": exceptions}

    @cached_property
    def arrays(self) -> DataFrame:
        return analyze.analyzed(self.docs, self.cfg, **self.lexical)

    @cached_property
    def tokens(self) -> DataFrame:
        return analyze.token_table(self.docs, self.cfg, **self.lexical)

    @cached_property
    def terms(self) -> DataFrame:
        return index.vocabulary(self.tokens)

    def cache(self) -> Collection:
        """Keeps the analyzed documents, for many queries on one collection."""
        self.arrays = self.arrays.cache()
        self.tokens = self.arrays.selectExpr("doc_id", "posexplode(tokens) as (pos, term)")
        self.terms = index.vocabulary(self.tokens).cache()
        return self

    def uncache(self) -> None:
        self.arrays.unpersist()
        self.terms.unpersist()

    def _phrase(self, text: str) -> list[str]:
        return analyze.query_tokens(self.docs, text, self.cfg, **self.lexical)

    def abbreviations(self) -> DataFrame:
        """(word, n_with, n_without, score) of words that the collection uses as abbreviations."""
        return abbreviations.abbreviations(self.docs)

    def with_abbreviations(self, ordinals: bool = False) -> Collection:
        """The collection under a tokeniser that knows the abbreviations it uses."""
        words = tuple(sorted({*self.cfg.abbreviations, *abbreviations.abbreviation_words(self.docs)}))
        return Collection(self.docs, replace(self.cfg, abbreviations=words, ordinals=ordinals), **self.lexical)

    def stages(self, doc_id) -> DataFrame:
        return analyze.pipeline_stages(self.docs, doc_id, self.cfg, **self.lexical)

    def index(self, kind: str, **options) -> DataFrame:
        """inverted, biword, positional, kgram or soundex. For the first two the documents are counted, so that small collections need no chunks; for the third, rows of each id."""
        build = {"inverted": (index.inverted_index, "arrays"), "biword": (index.biword_index, "arrays"), "positional": (index.positional_index, "arrays"),
                 "kgram": (index.kgram_index, "terms"), "soundex": (index.soundex_index, "terms")}
        function, frame = build[kind]
        if kind in ("inverted", "biword"):
            options.setdefault("most", self.docs.count())
        if kind == "positional":
            options.setdefault("ids", self.docs.select("doc_id"))
        return function(getattr(self, frame), **options)

    def vocabulary(self) -> DataFrame:
        return self.terms.orderBy("term")

    def phrase(self, text: str | None = None, method: str = "positional") -> DataFrame:
        """method: positional, biword, or false_positives. Without a text, the first document's first two tokens are asked for."""
        text = phrase.default_phrase(self.docs, self.cfg, **self.lexical) if text is None else text
        ask = {"positional": phrase.phrase_positional, "biword": phrase.phrase_biword, "false_positives": phrase.phrase_false_positives}[method]
        return ask(self.arrays, self._phrase(text))

    def phrase_report(self, text: str) -> DataFrame:
        return phrase.phrase_report(self.arrays, self._phrase(text))

    def lookup(self, entries: str | None = None, **options) -> DataFrame:
        return dictionary.dictionary_lookup(self.tokens, dictionary.default_entries(self.terms) if entries is None else entries, self.cfg, **options, **self.lexical)

    def wildcard(self, pattern: str) -> DataFrame:
        return tolerant.wildcard(self.terms, pattern)

    def spell(self, word: str, max_dist: int = 2) -> DataFrame:
        return tolerant.spell_suggest(self.terms, word, max_dist)

    def phonetic(self, word: str) -> DataFrame:
        return tolerant.phonetic(self.terms, word)

    def compare(self, queries: list[str] | None = None, **options) -> DataFrame:
        return evaluate.compare_normalizers(self.docs, self.cfg, queries, **options, **self.lexical)

    def compare_metrics(self, queries: list[str] | None = None) -> DataFrame:
        return evaluate.compare_metrics(self.docs, self.cfg, queries, **self.lexical)

    def retrieved(self, queries: list[str] | None = None) -> DataFrame:
        """(query, method, doc_id) of all documents that stems or lemmas retrieve."""
        return evaluate.retrieved(self.docs, self.cfg, queries, **self.lexical)

    def ground_truth(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id) of the documents relevant to a table (query_id, query)."""
        return evaluate.ground_truth_of(self.docs, queries)

    def wildcard_grams(self, pattern: str) -> DataFrame:
        return tolerant.decomposed(self.terms, pattern)

    def defaults(self) -> dict[str, str]:
        """What a user is offered for each kind of query."""
        return {"phrase": phrase.default_phrase(self.docs, self.cfg, **self.lexical), "lookup": dictionary.default_entries(self.terms), **tolerant.default_queries(self.terms)}

    def samples(self) -> DataFrame:
        """The first entries of the biword (8), positional (5) and k-gram (10) index, as JSON."""
        return index.samples(index.biword_pairs(self.arrays), self.tokens, index.kgram_pairs(self.terms), self.arrays)

    def summary_json(self, queries: list[str] | None = None) -> DataFrame:
        return evaluate.summary_json(self.summary(queries))

    def justification(self, queries: list[str] | None = None) -> DataFrame:
        return evaluate.justification(self.summary(queries))

    def summary(self, queries: list[str] | None = None) -> DataFrame:
        return evaluate.compare_summary(self.docs, self.cfg, queries, **self.lexical)
