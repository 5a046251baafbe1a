"""Text expressions: tokens, positions, biwords, k-grams, Soundex. All are built-in columns that Catalyst sees through.

STEPS define the tokeniser: a chain of regular expressions that Java and RE2 read alike, which is what the
DuckDB oracle runs. It follows the published word rules of treebank tokenisation as far as they matter
once tokens that are not wholly letters and digits have been dropped. A period that ends a word always
splits off, unless the configuration names the word as an abbreviation. The column form takes the same tokens out of a
text in one pass of one expression, TOKEN; rules for rare words apply only to texts that may hold one.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.config import SPLIT_WORDS, STOP_WORDS, AnalyzerConfig

#: (pattern, replacement) in order; a replacement's groups are written $1.
STEPS = (
    (r"\.\.\.", " "),
    (r"[;@#$%&?!\"()\[\]{}<>«»“”„‘’`]|--", " "),
    (r"([:,])([^0-9])", "$1 $2"),  # a comma or colon before a digit stays inside its token
    (r"([:,])$", " "),
    (r"([:,]) ", " "),
    (r"(?i)n't([^\p{L}\p{N}']|$)", " $1"),
    (r"(?i)'(s|m|d|ll|re|ve)([^\p{L}\p{N}]|$)", " $2"),
    (r"'(\s|$)", " $1"),
    (r"\.(\s|$)", " $1"),
    (r"\s+", "  "),  # so that neighbours can both be matched with a space on each side
    *((rf"(?i)(^| ){w[: len(a)]}{w[len(a) :]}( |$)", f"$1{a} {b}$2") for w, (a, b) in ((w, p.split()) for w, p in SPLIT_WORDS.items())),
)
ALNUM, ALPHA = r"^[\p{L}\p{N}]+$", r"^\p{L}+$"
#: The steps for contractions, which need an apostrophe.
CONTRACTIONS = STEPS[5:7]

# Where the chain leaves a space. Of a run of commas and colons it keeps the last with what follows, if that is a
# digit, or if their number is even and what follows is not a space.
_BLANK = r"[\s;@#$%&?!\"()\[\]{}<>«»“”„‘’`]"
_HARD = rf"{_BLANK}|--|\.\.\."
_COMMAS = rf"(?<![:,])(?:(?:[:,][:,])*+[:,](?![:,0-9])|(?:[:,][:,])++(?={_HARD}|\z)|[:,]+(?=[:,]))"
_BEFORE = rf"{_HARD}|{_COMMAS}|\z"
_GAP = rf"{_HARD}|{_COMMAS}|'(?={_BEFORE})|\.(?={_BEFORE}|'(?:{_BEFORE}))"
#: A token of letters and digits with the gap that ends it, a gap, or a run of other characters. Only the first has a group.
TOKEN = rf"([\p{{L}}\p{{N}}]++)(?:{_BLANK}++|{_GAP}|\z)|{_BLANK}++|{_GAP}|(?:(?!{_GAP})[\s\S])++"


def hyphen_spaced(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(" "))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _any(text: Column, words) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _kept_periods(ordinals: bool) -> str:
    """TOKEN, of which a group also takes the period behind a word that may be an abbreviation; or, of digits, an ordinal."""
    period = r"\.(?=[\s,;:)\]]+\S)"
    if ordinals:
        period = rf"(?:(?<!\p{{N}}){period}|(?<=\p{{N}})\.(?=\s+\p{{Ll}}))"
    return TOKEN.replace(r"([\p{L}\p{N}]++)", rf"([\p{{L}}\p{{N}}]++(?:{period})?)")


def _without_abbreviations(tokens: Column, words: tuple[str, ...], ordinals: bool) -> Column:
    """Tokens of _kept_periods, less those that keep their period; the others lose it."""

    def kept(w: Column) -> Column:
        known = F.lower(F.replace(w, F.lit("."), F.lit(""))).isin(*words) if words else F.lit(False)
        return ~w.endswith(".") | ~(known | w.rlike(r"^\p{N}+\.$") if ordinals else known)

    return F.transform(F.filter(tokens, kept), lambda w: F.replace(w, F.lit("."), F.lit("")))


def _split_words(tokens: Column) -> Column:
    def parts(w: Column) -> Column:
        out = F.array(w)
        for word, two in SPLIT_WORDS.items():
            out = F.when(F.lower(w) == word, F.array(*[F.lit(x) for x in two.split()])).otherwise(out)
        return out

    return F.flatten(F.transform(tokens, parts))


def word_tokens(text: Column, lowered: bool = False, abbreviations: tuple[str, ...] = (), ordinals: bool = False) -> Column:
    """All tokens that are wholly letters and digits. lowered: the text is in lower case already.

    abbreviations: words, in lower case, that keep a period behind them and are no tokens then, unless it ends the text; ordinals: so do
    numbers before a word in lower case.
    """

    def tokens(t: Column) -> Column:
        plain = t
        for pattern, replacement in CONTRACTIONS:
            plain = F.regexp_replace(plain, pattern, replacement)
        plain = F.when(t.contains("'"), plain).otherwise(t)
        if not abbreviations and not ordinals:
            return F.array_remove(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(1)), "")
        found = F.array_remove(F.regexp_extract_all(plain, F.lit(_kept_periods(ordinals)), F.lit(1)), "")
        return _without_abbreviations(found, abbreviations, ordinals)

    def whole(t: Column) -> Column:
        rare = _any(t, SPLIT_WORDS) if lowered else _once(F.lower(t), lambda x: _any(x, SPLIT_WORDS))
        return F.when(rare, _split_words(tokens(t))).otherwise(tokens(t))

    return _once(F.coalesce(text, F.lit("")), whole)


def without_stop_words(tokens: Column, lowered: bool = False) -> Column:
    """lowered: the tokens are in lower case already."""
    return F.filter(tokens, lambda w: ~(w if lowered else F.lower(w)).isin(*STOP_WORDS))


def plain_tokens(text: Column, cfg: AnalyzerConfig) -> Column:
    """Tokens after hyphens, case and stop words, before normalisation."""
    text = hyphen_spaced(text) if cfg.hyphens else text
    text = F.lower(text) if cfg.lowercase else text
    tokens = word_tokens(text, cfg.lowercase, cfg.abbreviations, cfg.ordinals)
    return without_stop_words(tokens, cfg.lowercase) if cfg.stopwords else tokens


def biwords(tokens: Column) -> Column:
    """Neighbouring pairs, joined by a space; none for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<string>"))


def term_positions(tokens: Column) -> Column:
    """Structs (term, positions), one for each distinct token, positions ascending from 0; by one sort of the tokens, otherwise in time proportional to their number."""

    def groups(placed: Column) -> Column:
        at = lambda i: F.get(placed, i)
        marks = F.transform(placed, lambda x, i: F.when((i == 0) | ~x["term"].eqNullSafe(at(i - 1)["term"]), i))

        def cut(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(placed))
            # Not by slice, which may copy the whole array for each term.
            places = lambda a, b: F.transform(F.sequence(a, b - 1), lambda j: at(j)["pos"])
            return F.transform(starts, lambda a, k: F.struct(at(a)["term"].alias("term"), places(a, end(k)).alias("positions")))

        return _once(F.filter(marks, lambda i: i.isNotNull()), cut)

    return _once(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))), groups)


def kgrams(term: Column, k: int = 2) -> Column:
    """All windows of k characters of the term between dollar signs."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    last = F.length(term) + 2 - k + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, k))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def soundex_code(token: Column) -> Column:
    """Four characters, or the empty string unless the token is all letters.

    Every letter without a digit separates equal digits, H and W too, unlike the built-in function,
    which sees through those; so they are made vowels after the first letter. A first letter that is
    not A to Z is kept, and codes the rest as after a vowel.
    """
    upper = F.upper(token)
    rest = F.translate(F.substring(upper, 2, 1 << 20), "HW", "AA")
    first = F.substring(upper, 1, 1)
    ascii_first = F.soundex(F.concat(first, rest))
    other_first = F.concat(first, F.substring(F.soundex(F.concat(F.lit("A"), rest)), 2, 3))
    return F.when(~F.coalesce(upper.rlike(ALPHA), F.lit(False)), F.lit("")).when(first.rlike("^[A-Z]"), ascii_first).otherwise(other_first)


def comma_list(text: Column) -> Column:
    """Trimmed non-empty entries of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def wildcard_grams(pattern: str) -> list[str]:
    """Bigrams that every match of a lower-cased pattern with * must have; computed when a plan is built."""
    parts = pattern.lower().split("*")
    grams: list[str] = []
    for i, part in enumerate(parts):
        if not part:
            continue
        padded = ("$" if i == 0 else "") + part + ("$" if i == len(parts) - 1 else "")
        grams += [padded[j : j + 2] for j in range(len(padded) - 1)]
    return list(dict.fromkeys(grams))


def wildcard_like(pattern: str) -> str:
    """The pattern for LIKE: * is any run, all else is literal."""
    return "".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in pattern)
