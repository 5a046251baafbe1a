"""Licence scans: a trained paragraph classifier in DataFrame functions.

Paragraphs are blocks of lines between blank lines. Each is scored by sparse logistic regressions
over its word n-grams of one to three words: one output for each licence family and one for licences
at large. Only the n-grams of the templates are features, so a licence line keeps its score in
however long a paragraph of prose. Before, each paragraph's distinct words are added up by a bound: what
n-grams raise an output by is put down to one word of each (their longest that is no function word), as a share of what that
output lacks to its threshold. Below 1 in all, no output can reach its threshold whatever the order of
the words, so such a paragraph is not scored further; nothing that the classifier would find is lost.

A family is found in a paragraph if its probability reaches the calibrated threshold and the n-grams
cover enough of one of its templates; a paragraph may name several. If it names none, but the output
for licences at large reaches its own threshold, the paragraph is `unknown`. Both thresholds are
calibrated on families that a fit has not seen: families are left out by folds, and the paragraphs
of those left out are what `unknown` shall be.

n-grams are looked up by hash in a table of SLOTS slots and compared by all 64 bits, inside one
projection: no join, no shuffle, no Python on the data's path, and nothing a hot paragraph could skew.
The model is fitted on the driver, on texts of licences and sentences that share words with them. The corpus
is not learned from: any of its texts may be an unknown licence.

Edge cases: null and empty texts have no paragraphs; repeated rows, null ids and extra columns pass
through; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import free_name
from lexiloom.llm.license_texts import CLAIMS, FAMILIES, NOTICES, ORDINARY

#: Slots of the table of n-grams, so many that few meet; of those that do, the heavier stays.
SLOTS = 1 << 18
#: Slots of the words' bounds.
BOUND_SLOTS = 1 << 16
NGRAM = 3
#: The share of a template's n-grams that a paragraph must have.
COVER = 0.6
#: Folds of families left out for calibration.
FOLDS = 4
WORD = "[a-z0-9]+"
# Words that say nothing of a subject. n-grams of these alone are no features.
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be been but by can do for from has have he her his how i if in is it its may must no not of on or our own she should so such that the their them these they "
    "this those to under upon was we were what when which who will with without would you your".split()
)
SPDX = CLAIMS[0].split("{")[0]
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return re.findall(WORD, re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def ngrams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1)]


def gram_hash(gram: str) -> int:
    """The signed hash of an n-gram that the data's path computes."""
    return int.from_bytes(xxhash.xxh64(gram.encode(), seed=42).digest(), "big", signed=True)


def hashes(text: str) -> list[int]:
    return list(dict.fromkeys(gram_hash(g) for g in ngrams(tokens(text))))


def templates() -> dict[str, list[str]]:
    """All paragraphs of a family: full texts, the notices with its names and identifiers, and these by themselves, but for single words."""
    return {
        f: [*texts, *(n.format(name) for name in names for n in NOTICES), *(c.format(i) for i in ids for c in CLAIMS), *(x for x in (*names, *ids) if len(tokens(x)) > 1)]
        for f, (names, ids, texts) in FAMILIES.items()
    }


def is_claim(text: str) -> bool:
    """Whether a paragraph is little but a name or an identifier: one that is not known cannot be told to be a licence's."""
    return len(tokens(text)) <= 2 + len(tokens(SPDX)) and not text.startswith(SPDX) and not text.endswith(".")


def variants(text: str) -> list[str]:
    """A paragraph whole and, if long, its two ends and its middle, as broken notices leave them."""
    words = text.split()
    n = len(words)
    return [text] if n < 12 else [text, " ".join(words[: 2 * n // 3]), " ".join(words[n // 3 :]), " ".join(words[n // 6 : n - n // 6])]


class LicenseModel:
    """Families, hashes and weights of n-grams, biases, templates, and the calibrated thresholds of families and of licences at large."""

    def __init__(self, steps: int = 80, l1: float = 2e-4) -> None:
        self.families = list(FAMILIES)
        self.templates = {f: [hashes(t) for t in texts] for f, texts in templates().items()}
        rows, families, told = [], [], []
        for k, texts in enumerate(templates().values()):
            for t in texts:
                rows += [hashes(v) for v in variants(t)]
                families += [k] * len(variants(t))
                told += [not is_claim(t)] * len(variants(t))
        rows += [hashes(t) for t in ORDINARY]
        families += [-1] * len(ORDINARY)
        told += [True] * len(ORDINARY)
        names = {gram_hash(g): g for texts in templates().values() for t in texts for g in ngrams(tokens(t))}
        vocabulary = sorted(h for h, g in names.items() if not FUNCTION_WORDS.issuperset(g.split()))
        column = {h: i for i, h in enumerate(vocabulary)}
        X = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, r in enumerate(rows):
            X[i, [column[h] for h in r if h in column]] = 1
        family = np.array(families)
        Y = np.zeros((len(rows), len(self.families) + 1), np.float32)
        Y[family >= 0, family[family >= 0]] = 1
        Y[family >= 0, -1] = 1
        self.threshold, self.licence_threshold = self._calibrate(X, Y, family, np.array(told), steps, l1)
        W, self.bias = self._fit(X, Y, steps, l1)
        kept: dict[int, int] = {}
        for i in np.argsort(np.abs(W).max(1)):
            if W[i].any():
                kept[vocabulary[i] % SLOTS] = i  # of n-grams with one slot the heaviest comes last
        chosen = sorted(kept.values())
        self.grams, self.weights = [vocabulary[i] for i in chosen], W[chosen].astype(float)
        self.bounds = self._bounds([names[h] for h in self.grams])

    def _bounds(self, grams: list[str]) -> dict[str, float]:
        """By word, the most that its n-grams add to an output, as a share of what this lacks to its threshold."""
        least = np.append(np.full(len(self.families), self.threshold), self.licence_threshold)
        lack = np.log(least / (1 - least)) - self.bias
        if (lack <= 0).any():
            raise ValueError("a text without any n-gram would be a finding")
        added: dict[str, np.ndarray] = {}
        for gram, weight in zip(grams, self.weights):
            word = max(gram.split(), key=lambda w: (w not in FUNCTION_WORDS, len(w)))
            added[word] = added.get(word, 0) + np.maximum(weight, 0) / lack
        return {w: float(a.max()) for w, a in added.items()}

    def bound(self, text: str) -> float:
        """Below 1, no output for the text reaches its threshold."""
        return sum(self.bounds.get(w, 0.0) for w in set(tokens(text)))

    @staticmethod
    def _fit(X: np.ndarray, Y: np.ndarray, steps: int, l1: float) -> tuple[np.ndarray, np.ndarray]:
        """Logistic regressions, one for each column of Y, with an L1 penalty, by accelerated proximal gradient; both outcomes weigh equally."""
        ones = Y.sum(0)
        weight = np.where(Y > 0, 0.5 / np.maximum(1, ones), 0.5 / np.maximum(1, len(Y) - ones)).astype(np.float32)
        W, b = np.zeros((X.shape[1], Y.shape[1]), np.float32), np.zeros(Y.shape[1], np.float32)
        W0, b0 = W, b
        rate = np.float32(16.0 / np.sqrt(X.sum(1).max()))
        for t in range(steps):
            m = np.float32(t / (t + 3))
            V, c = W + m * (W - W0), b + m * (b - b0)
            g = (1 / (1 + np.exp(-np.clip(X @ V + c, -30, 30))) - Y) * weight
            W0, b0 = W, b
            W = V - rate * (X.T @ g)
            W = np.sign(W) * np.maximum(np.abs(W) - rate * np.float32(l1), 0)
            b = c - rate * g.sum(0)
        return W, b.astype(float)

    def _calibrate(self, X: np.ndarray, Y: np.ndarray, family: np.ndarray, told: np.ndarray, steps: int, l1: float) -> tuple[float, float]:
        """Thresholds from the paragraphs of families, and the ordinary sentences, that a fit has not seen.

        A family's: what 19 of 20 paragraphs of unseen families stay below. That of licences at large: where the
        share of unseen licences above and that of unseen ordinary sentences below add up to most.
        """
        ordinary = np.cumsum(family < 0) * (family < 0)
        best, large, is_licence = [], [], []
        for fold in range(FOLDS):
            out = ((family >= 0) & (family % FOLDS == fold)) | ((family < 0) & (ordinary % FOLDS == fold))
            seen = np.flatnonzero(~out)
            W, b = self._fit(X[seen], Y[seen], steps, l1)
            out &= told
            p = 1 / (1 + np.exp(-np.clip(X[out] @ W + b, -30, 30)))
            known = [k for k in range(len(self.families)) if k % FOLDS != fold]
            best += p[:, known].max(1).tolist()
            large += p[:, -1].tolist()
            is_licence += (family[out] >= 0).tolist()
        best, large, is_licence = np.array(best), np.array(large), np.array(is_licence)
        self.calibration = {"best": best, "large": large, "is_licence": is_licence}
        threshold = float(np.clip(np.quantile(best[is_licence], 0.95), 0.5, 0.9))
        grid = np.arange(0.05, 0.96, 0.01)
        gain = [(large[is_licence] >= t).mean() + (large[~is_licence] < t).mean() for t in grid]
        return threshold, float(grid[int(np.argmax(gain))])

    def probabilities(self, text: str) -> np.ndarray:
        """The outputs for one paragraph, in Python: what the data's path computes."""
        row = {h: i for i, h in enumerate(self.grams)}
        z = self.bias + sum((self.weights[row[h]] for h in hashes(text) if h in row), np.zeros(len(self.bias)))
        return 1 / (1 + np.exp(-z))

    def findings(self, text: str) -> list[tuple[str, float]]:
        """Families and probabilities found in one paragraph, or unknown, in Python."""
        p, have = self.probabilities(text), set(hashes(text))
        found = [
            (f, float(p[k])) for k, f in enumerate(self.families)
            if p[k] >= self.threshold and max(len(have & set(t)) / len(t) for t in self.templates[f]) >= COVER
        ]
        return found or ([(UNKNOWN, float(p[-1]))] if p[-1] >= self.licence_threshold else [])


@functools.lru_cache(maxsize=1)
def default_model() -> LicenseModel:
    return LicenseModel()


def _numbers(values, kind: str) -> Column:
    """A constant array that is folded when planned, however long."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, text: str = "text", out: str = "licenses") -> DataFrame:
    """Adds an array of structs: paragraph number, family (or `unknown`), probability, and cover of the family's best template."""
    model, out = model or default_model(), free_name(docs, out)
    outputs = len(model.bias)
    rows = np.full(SLOTS, -1)
    rows[np.array(model.grams) % SLOTS] = np.arange(len(model.grams))
    table, known = _numbers(rows.tolist(), "int"), _numbers(model.grams, "long")
    weights = _numbers([float(x) for x in model.weights.ravel()], "double")
    bounds = np.zeros(BOUND_SLOTS)
    for word, share in model.bounds.items():
        bounds[gram_hash(word) % BOUND_SLOTS] += share  # words that meet only raise the bound
    shares = _numbers([float(x) for x in bounds], "double")
    families = F.array(*[F.lit(f) for f in model.families])
    parts = F.array(*[F.array(*[_numbers(t, "long") for t in model.templates[f]]) for f in model.families])

    def pairs(a: Column, b: Column, skip: int) -> Column:
        """Each word of b, from the skipped on, after what ends before it."""
        n = F.size(b) - skip
        joined = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, skip + 1, F.greatest(n, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
        return F.when(n > 0, joined).otherwise(F.array().cast("array<string>"))

    def possible(x: Column) -> Column:
        """Whether a paragraph's words might make a finding."""
        words = F.array_distinct(F.regexp_extract_all(x["p"], F.lit(f"({WORD})"), F.lit(1)))
        total = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.get(shares, F.pmod(F.xxhash64(w), F.lit(BOUND_SLOTS)).cast("int")))
        return total >= 1 - 1e-9

    def described(x: Column) -> Column:
        """Paragraph number and hashes of distinct n-grams."""
        words = F.regexp_extract_all(x["p"], F.lit(f"({WORD})"), F.lit(1))
        two = pairs(words, words, 1)
        grams = F.concat(words, two, pairs(two, words, 2))
        return F.struct(x["paragraph"].alias("paragraph"), F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))).alias("g"))

    def place(h: Column) -> Column:
        return F.get(table, F.pmod(h, F.lit(SLOTS)).cast("int"))

    def weighed(x: Column) -> Column:
        """Paragraph number, hashes, and the outputs."""
        kept = F.filter(x["g"], lambda h: F.get(known, place(h)) == h)
        z = F.aggregate(kept, _numbers([float(v) for v in model.bias], "double"), lambda a, h: F.zip_with(a, F.slice(weights, place(h) * outputs + 1, outputs), lambda s, w: s + w))
        return F.struct(x["paragraph"].alias("paragraph"), x["g"].alias("g"), F.transform(z, lambda v: 1 / (1 + F.exp(-v))).alias("p"))

    def decided(x: Column) -> Column:
        """All findings of a paragraph."""
        likely = F.filter(F.sequence(F.lit(0), F.lit(outputs - 2)), lambda k: F.get(x["p"], k) >= model.threshold)
        cover = lambda k: F.array_max(F.transform(F.get(parts, k), lambda t: F.size(F.array_intersect(t, x["g"])) / F.size(t)))
        row = lambda f, p, c: F.struct(x["paragraph"].alias("paragraph"), f.alias("family"), p.alias("probability"), c.alias("cover"))
        named = F.filter(F.transform(likely, lambda k: row(F.get(families, k), F.get(x["p"], k), cover(k))), lambda r: r["cover"] >= COVER)
        large = F.get(x["p"], F.lit(outputs - 1))
        odd = F.filter(F.array(row(F.lit(UNKNOWN), large, F.lit(None).cast("double"))), lambda r: r["probability"] >= model.licence_threshold)
        return F.struct(named.alias("named"), odd.alias("odd"))

    # As the model reads: A-Z alone in lower case. Lines end in \n, \r\n or \r.
    plain = F.translate(F.coalesce(docs[text].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    paragraphs = F.transform(F.split(plain, r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*"), lambda p, i: F.struct(i.cast("long").alias("paragraph"), p.alias("p")))
    candidates = F.filter(paragraphs, possible)
    found = F.transform(F.transform(F.transform(candidates, described), weighed), decided)
    found = F.flatten(F.transform(found, lambda x: F.when(F.size(x["named"]) > 0, x["named"]).otherwise(x["odd"])))
    kind = "array<struct<paragraph:bigint,family:string,probability:double,cover:double>>"
    # The generator keeps Catalyst from computing its result again wherever it is used.
    return docs.select("*", F.explode(F.array(found.cast(kind))).alias(out))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: licences found, unknown paragraphs, the families in order, and all findings as text."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = scan_licenses(kept).select("doc_id", "licenses")
    named = F.filter("licenses", lambda x: x["family"] != UNKNOWN)
    return found.select(
        "doc_id",
        F.size(named).cast("long").alias("n_licenses"),
        (F.size("licenses") - F.size(named)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(named, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",").alias("findings"),
    )
