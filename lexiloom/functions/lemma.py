"""Noun lemmas by detachment rules over a lexicon, and the lexical validity test.

The lexicon (word, pos) and the exceptions (form, lemma) are inputs; a small seed is built in. The
rules are complete, the data is whatever the caller supplies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.batches import on_terms, on_tokens
from lexiloom.functions.porter import stem, stem_tokens

# Suffixes of plural nouns and what replaces them.
DETACHMENTS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
# A seed of irregular plurals, nouns and other words, in place of a full lexicon.
EXCEPTIONS = {
    "geese": "goose", "mice": "mouse", "feet": "foot", "teeth": "tooth", "children": "child", "wolves": "wolf", "leaves": "leaf",
    "knives": "knife", "lives": "life", "wives": "wife", "oxen": "ox", "indices": "index", "matrices": "matrix", "criteria": "criterion",
}
NOUNS = tuple(
    "information retrieval system document index query term tree search word data database algorithm text corpus goose mouse foot tooth "
    "child wolf leaf knife life wife ox man woman box church city story class bus dog cat house state art technology university student "
    "river field forest animal winter night morning garden phrase pattern name spelling error language result score".split()
)
OTHERS = (("running", "verb"), ("run", "verb"), ("find", "verb"), ("rely", "verb"), ("modern", "adj"), ("quick", "adj"), ("quickly", "adv"))


def seed_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, "noun") for w in NOUNS] + list(OTHERS), "word string, pos string")


def seed_exceptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXCEPTIONS.items()), "form string, lemma string")


def candidates(term: Column) -> Column:
    """The term and every detachment that fits it."""
    found = [F.array(term)]
    for suffix, new in DETACHMENTS:
        cut = F.concat(F.substring(term, F.lit(1), F.length(term) - len(suffix)), F.lit(new))
        found.append(F.when(term.endswith(suffix), F.array(cut)).otherwise(F.array().cast("array<string>")))
    return F.concat(*found)


def lemma_map(vocabulary: DataFrame, lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(term, lemma) for each distinct term: an exception's lemma, else the shortest candidate that is a noun, else the term."""
    terms = vocabulary.select("term").distinct()
    nouns = lexicon.where(F.col("pos") == "noun").select(F.col("word").alias("candidate")).distinct()
    known = (
        terms.select("term", F.explode(candidates(F.col("term"))).alias("candidate")).join(nouns, "candidate")
        .groupBy("term").agg(F.min(F.struct(F.length("candidate").alias("n"), F.col("candidate").alias("c"))).alias("best"))
        .select("term", F.col("best.c").alias("noun"))
    )
    irregular = exceptions.groupBy(F.col("form").alias("term")).agg(F.min("lemma").alias("irregular"))
    return terms.join(irregular, "term", "left").join(known, "term", "left").select("term", F.coalesce("irregular", "noun", "term").alias("lemma"))


#: Words of a lexicon and its exceptions up to which their forms (some ten for each) are sent to all executors.
LEXICON_WORDS = 200_000


def noun_forms(nouns, exceptions: dict[str, str]) -> dict[str, str]:
    """Every form that has another lemma than itself; as lemma_map finds them, but from the lexicon's side."""
    best: dict[str, tuple[int, str]] = {}
    for noun in nouns:
        for suffix, new in (*DETACHMENTS, ("", "")):
            if noun.endswith(new):
                form = noun[: len(noun) - len(new)] + suffix
                best[form] = min(best.get(form, (len(noun), noun)), (len(noun), noun))
    return {form: lemma for form, lemma in ({f: n for f, (_, n) in best.items()} | exceptions).items() if form != lemma}


#: Words of a lexicon up to which the words themselves, packed, are sent (some 25 bytes each); beyond, terms are joined.
PACKED_WORDS = 5_000_000


@dataclass(frozen=True)
class PackedWords:
    """A set of words as three arrays, in the order of their hashes: about 12 bytes a word and its letters."""

    hashes: np.ndarray
    offsets: np.ndarray
    letters: bytes

    @classmethod
    def of(cls, words: pa.Array) -> PackedWords:
        raws = words.cast(pa.binary()).to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in raws), np.uint64, len(raws))
        order = np.argsort(hashes, kind="stable")
        sizes = np.fromiter((len(raws[i]) for i in order), np.int64, len(raws))
        return cls(hashes[order], np.concatenate([[0], np.cumsum(sizes)]), b"".join([raws[i] for i in order]))

    def holds(self, words: list[bytes]) -> list[bool]:
        """Which words are in the set: hashes find them, letters decide."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        low, high = (np.searchsorted(self.hashes, hashes, side).tolist() for side in ("left", "right"))
        at = self.offsets
        return [any(self.letters[at[k] : at[k + 1]] == w for k in range(a, b)) for w, a, b in zip(words, low, high)]


@dataclass(frozen=True)
class PackedLemmas:
    """Lemmas by a packed lexicon, which executors hold once a process, and exceptions."""

    nouns: Broadcast
    irregular: dict[str, str]

    def many(self, words: list[str | None]) -> list[str | None]:
        """The exception's lemma, else the shortest candidate that is a noun, else the word."""
        tried = [(i, c) for i, w in enumerate(words) if w is not None for c in [w, *(w[: len(w) - len(s)] + new for s, new in DETACHMENTS if w.endswith(s))]]
        best: dict[int, str] = {}
        for (i, c), held in zip(tried, self.nouns.value.holds([c.encode() for _, c in tried])):
            if held and (i not in best or (len(c), c) < (len(best[i]), best[i])):
                best[i] = c
        return [None if w is None else self.irregular.get(w, best.get(i, w)) for i, w in enumerate(words)]


Forms = dict[str, str] | PackedLemmas


def lemma_forms(lexicon: DataFrame | None, exceptions: DataFrame | None) -> Forms | None:
    """What lemmas are looked up in: noun_forms of a lexicon and exceptions, or of the seed's; the packed words, if they are over LEXICON_WORDS; None if they are too many for that."""
    nouns, irregular = list(NOUNS), dict(EXCEPTIONS)
    if exceptions is not None:
        found = exceptions.where("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
        irregular = {r.form: r.lemma for r in found.limit(LEXICON_WORDS + 1).collect()}
    if lexicon is not None:
        found = lexicon.where((F.col("pos") == "noun") & F.col("word").isNotNull()).select("word").distinct()
        nouns = [r.word for r in found.limit(LEXICON_WORDS + 1).collect()]
        if len(irregular) <= LEXICON_WORDS < len(nouns) + len(irregular):
            whole = found.limit(PACKED_WORDS + 1).toArrow().column("word").combine_chunks()
            return None if len(whole) > PACKED_WORDS else PackedLemmas(lexicon.sparkSession.sparkContext.broadcast(PackedWords.of(whole)), irregular)
    return None if len(nouns) + len(irregular) > LEXICON_WORDS else noun_forms(nouns, irregular)


#: Forms up to which a plan holds them, so that lemmas are an expression; beyond, workers look them up.
PLAN_FORMS = 2_000


def _in_plan(forms: Forms) -> Callable[[Column], Column] | None:
    """A word's lemma as an expression; None of too many forms. Most words are no form, which a hash tells; only of a form the pairs are gone through."""
    if isinstance(forms, PackedLemmas) or len(forms) > PLAN_FORMS or any("\n" in x for pair in forms.items() for x in pair):
        return None
    if not forms:
        return lambda word: word
    listed = lambda words: F.split(F.lit("\n".join(words)), "\n")
    pairs = F.map_from_arrays(listed(forms.keys()), listed(forms.values()))
    return lambda word: F.when(word.isin(*forms), F.element_at(pairs, word)).otherwise(word)


def lemma_terms(terms: Column, forms: Forms) -> Column:
    """Lemmas of a string column."""
    if told := _in_plan(forms):
        return told(terms)
    return on_terms(terms, forms.many, many=True) if isinstance(forms, PackedLemmas) else on_terms(terms, lambda w: forms.get(w, w))


def lemma_tokens(tokens: Column, forms: Forms, stemmed: bool = False) -> Column:
    """Lemmas of an array column, or their stems, in place: no join, no shuffle."""
    if told := _in_plan(forms):
        lemmas = F.transform(tokens, told)
        return F.get(F.transform(F.array(lemmas), stem_tokens), F.lit(0)) if stemmed else lemmas
    if isinstance(forms, PackedLemmas):
        return on_tokens(tokens, (lambda ws: [None if w is None else stem(w) for w in forms.many(ws)]) if stemmed else forms.many, many=True)
    return on_tokens(tokens, (lambda w: stem(forms.get(w, w))) if stemmed else (lambda w: forms.get(w, w)))


def valid_terms(vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Terms that the lexicon has, as any part of speech."""
    return vocabulary.join(lexicon.select(F.col("word").alias("term")).distinct(), "term", "left_semi")
