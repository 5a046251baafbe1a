"""The Porter stemmer (Porter 1980), with the common extensions as an option, and its column form."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular stems of the extended form.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# The suffix tables of steps 2, 3 and 4 of the published algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _pattern(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """The number of vowel-consonant turns."""
    return len(re.findall("v+c+", _pattern(stem)))


def _short(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _pattern(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replace(word: str, rules, least: int) -> str:
    """The longest suffix that fits decides; it is replaced if the stem's measure is over `least`."""
    fits = [(s, r) for s, r in rules if word.endswith(s)]
    if fits:
        suffix, new = max(fits, key=lambda x: len(x[0]))
        stem = word[: len(word) - len(suffix)]
        if _measure(stem) > least:
            return stem + new
    return word


def _plurals(w: str, extensions: bool) -> str:
    if extensions and w.endswith("ies") and len(w) == 4:
        return w[:-1]
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w if w.endswith("ss") or not w.endswith("s") else w[:-1]


def _past(w: str, extensions: bool) -> str:
    if extensions and w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if "v" not in _pattern(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _pattern(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and (_short(stem) or (extensions and _pattern(stem) == "vc")) else stem
    return w


def _final_y(w: str, extensions: bool) -> str:
    stem = w[:-1]
    if not w.endswith("y"):
        return w
    turned = len(stem) > 1 and _pattern(stem)[-1] == "c" if extensions else "v" in _pattern(stem)
    return stem + "i" if turned else w


def _second(w: str, extensions: bool) -> str:
    if not extensions:
        return _replace(w, STEP2, 0)
    if w.endswith("alli"):
        return _second(w[:-2], True) if _measure(w[:-4]) > 0 else w
    rules = [r for r in STEP2 if r[0] not in ("abli", "alli")] + [("bli", "ble"), ("fulli", "ful")]
    if w.endswith("logi"):  # the l belongs to the stem that is measured
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _replace(w, rules, 0)


def _fourth(w: str) -> str:
    fits = [s for s in STEP4 if w.endswith(s)]
    if fits:
        suffix = max(fits, key=len)
        stem = w[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
            return stem
    return w


def _last(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str, extensions: bool = True) -> str:
    """The stem of one word, lower-cased; words of one or two letters are left alone."""
    w = word.lower()
    if extensions and w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _final_y(_past(_plurals(w, extensions), extensions), extensions)
    w = _replace(_second(w, extensions), STEP3, 0)
    return _last(_fourth(w))


# ---- the same rules as an expression, which runs where the rows are
#
# Of a stem only its turns from vowels to consonants matter. y is a vowel after a consonant, so that runs are told apart from left to right without
# ever looking back: a run of vowels begins with one of aeiouy, a run of consonants with anything but aeiou, and neither gives a letter back.

_V, _C = "[aeiouy][aeiou]*+", "[^aeiou][^aeiouy]*+"
_LEAD = f"^(?:{_C})?+"
#: Patterns of a stem: a vowel; a measure over 0, over 1, of 1.
_VOWEL, _OVER0, _OVER1 = f"{_LEAD}[aeiouy]", f"{_LEAD}{_V}{_C}", f"{_LEAD}{_V}{_C}{_V}{_C}"
_IS1 = f"{_LEAD}{_V}{_C}(?:{_V})?+$"


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _ends_in_consonant(w: Column) -> Column:
    return w.rlike(f"{_LEAD}(?:{_V}{_C})*+$")


def _is_short(w: Column) -> Column:
    """Ends in a consonant, one vowel, and one consonant other than w, x and y: what stands before the last two letters ends in a consonant, and what stands before the last does not."""
    return (F.length(w) >= 3) & ~w.rlike("[wxyaeiou]$") & ~_ends_in_consonant(_cut(w, 1)) & _ends_in_consonant(_cut(w, 2))


def _rules(w: Column, rules, over: str, otherwise: Column) -> Column:
    """The longest suffix that fits decides."""
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut(w, len(suffix))
        value = F.when(stem.rlike(over), F.concat(stem, F.lit(new)) if new else stem).otherwise(w)
        out = F.when(w.endswith(suffix), value) if out is None else out.when(w.endswith(suffix), value)
    return out.otherwise(otherwise)


def _by_ending(w: Column, rules, over: str) -> Column:
    """_rules, with the rules asked only of words that end in one of their last letters, letter by letter."""
    out = None
    for letter in dict.fromkeys(s[-1] for s, _ in rules):
        value = _rules(w, [r for r in rules if r[0][-1] == letter], over, w)
        out = F.when(w.endswith(letter), value) if out is None else out.when(w.endswith(letter), value)
    return out.otherwise(w)


def _step_plurals(w: Column) -> Column:
    kept = F.when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("ies"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)))
    return F.when(w.endswith("s"), kept.when(w.endswith("ss"), w).otherwise(_cut(w, 1))).otherwise(w)


def _step_past(w: Column) -> Column:
    def rest(n: int) -> Column:
        stem = _cut(w, n)
        twice = stem.rlike(r"([^aeiou])\1$") & _ends_in_consonant(stem)
        ended = F.when(stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz"), F.concat(stem, F.lit("e")))
        ended = ended.when(twice, F.when(stem.rlike("[lsz]$"), stem).otherwise(_cut(stem, 1)))
        ended = ended.when(stem.rlike(_IS1) & (_is_short(stem) | ((F.length(stem) == 2) & stem.rlike("^[aeiou][^aeiou]$"))), F.concat(stem, F.lit("e")))
        return F.when(stem.rlike(_VOWEL), ended.otherwise(stem)).otherwise(w)

    ed = F.when(w.endswith("ied"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)))
    ed = ed.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(_OVER0), _cut(w, 1)).otherwise(w)).otherwise(rest(2))
    return F.when(w.endswith("ed"), ed).when(w.endswith("ing"), rest(3)).otherwise(w)


def _step_final_y(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("y") & (F.length(w) > 2) & _ends_in_consonant(stem), F.concat(stem, F.lit("i"))).otherwise(w)


def _step_alli(w: Column) -> Column:
    return F.when(w.endswith("alli") & _cut(w, 4).rlike(_OVER0), _cut(w, 2)).otherwise(w)


def _step_second(w: Column) -> Column:
    rules = [r for r in STEP2 if r[0] not in ("abli", "alli")] + [("bli", "ble"), ("fulli", "ful")]
    logi = F.when(_cut(w, 3).rlike(_OVER0), _cut(w, 1)).otherwise(w)
    return F.when(w.endswith("alli"), w).when(w.endswith("logi"), logi).otherwise(_by_ending(w, rules, _OVER0))


def _step_fourth(w: Column) -> Column:
    ion = _cut(w, 3)
    told = F.when(w.endswith("ion"), F.when(ion.rlike(_OVER1) & ion.rlike("[st]$"), ion).otherwise(w))
    return told.otherwise(_by_ending(w, [(s, "") for s in STEP4 if s != "ion"], _OVER1))


def _step_final_e(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("e") & (stem.rlike(_OVER1) | (stem.rlike(_IS1) & ~_is_short(stem))), stem).otherwise(w)


def _step_final_ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & _cut(w, 1).rlike(_OVER1), _cut(w, 1)).otherwise(w)


_COLUMN_STEPS = (
    _step_plurals, _step_past, _step_final_y, _step_alli, _step_second, lambda w: _by_ending(w, STEP3, _OVER0), _step_fourth, _step_final_e, _step_final_ll,
)


def stem_tokens(tokens: Column) -> Column:
    """Stems of an array column, with the extensions, by built-in expressions alone."""

    def stemmed(word: Column) -> Column:
        def chain(w: Column) -> Column:
            now = F.array(w)  # a step reads its word many times, so that each word has to be a value by then
            for step in _COLUMN_STEPS:
                now = F.transform(now, step)
            return F.get(now, F.lit(0))

        irregular = F.get(F.array(*[F.lit(v) for v in IRREGULAR.values()]), F.array_position(F.array(*[F.lit(k) for k in IRREGULAR]), word).cast("int") - 1)
        return F.when(word.isin(*IRREGULAR), irregular).when(F.length(word) <= 2, word).otherwise(chain(word))

    return F.transform(F.transform(tokens, lambda w: F.lower(w)), stemmed)


def stem_terms(terms: Column) -> Column:
    """Stems of a string column."""
    return F.get(stem_tokens(F.array(terms)), F.lit(0))
