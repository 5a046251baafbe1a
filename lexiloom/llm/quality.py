"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into quantile bins. Boosting cycles over the features; each step
fits a shallow tree to the logistic gradients of one feature's bins and adds it to that feature's
look-up table. Then the pairs whose two-cut trees reduce the remaining loss most get tables of
their own, boosted alike. Scoring a batch is one binning and one addition per table, in numpy.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, those with the smallest
hashes); features and scores of all other rows need one pass without a shuffle.

Edge cases: null text counts as empty and is scored like it; null labels are no labels; repeated
labelled rows count once each; with no labelled rows every score is 0.5; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_mod, free_name, utf8, words

#: The largest number of labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "word_length", "long_words", "distinct_words", "top_word", "symbols", "runs", "bars", "marks", "commas",
    "capitals", "digits", "line_length", "repeated_lines", "repeated_trigrams", "line_ends", "non_ascii",
)


def features(raw: bytes) -> list[float]:
    """Numbers that describe a text; all are 0 for an empty one."""
    n = len(raw)
    tokens = words(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda chars: float(count[list(chars)].sum()) / n
    m = max(1, len(tokens))
    frequency: dict[bytes, int] = {}
    for w in tokens:
        frequency[w] = frequency.get(w, 0) + 1
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct_lines = set(lines)
    repeated = sum(map(len, lines)) - sum(map(len, distinct_lines))
    runs = sum(raw.count(x) for x in (b"###", b"$$$", b"%%%", b"&&&", b"***", b"!!", b"--", b"==", b"??"))
    grams = len(set(zip(tokens, tokens[1:], tokens[2:]))) if len(tokens) > 2 else 1
    return [
        float(np.log1p(n)), sum(map(len, tokens)) / m, sum(len(w) > 12 for w in tokens) / m, len(frequency) / m,
        max(frequency.values(), default=0) / m, share(b"#$%&*@^~_=+<>{}[]\\/"), runs / m, count[124] / m,
        (count[33] + count[63]) / m, count[44] / m, float(count[65:91].sum()) / letters, share(b"0123456789"),
        float(np.log1p(n / max(1, len(lines)))), repeated / n, 1 - grams / max(1, len(tokens) - 2),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), float(count[128:].sum()) / n,
    ]


@dataclass
class AdditiveModel:
    """Cuts and look-up tables; a score is the sigmoid of the sum of table entries."""

    bins: int = 48
    pair_bins: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    pairs_kept: int = 8
    leaves: int = 4
    rate: float = 0.08
    smoothing: float = 4.0
    base: float = 0.0
    cuts: list = field(default_factory=list)
    pair_cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A step function over bins with at most `leaves` steps, by greedy best splits."""
        G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        lam, parts = self.smoothing, [(0, len(g))]
        value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + lam)
        while len(parts) < self.leaves:
            best = (1e-9, None, None)
            for a, b in parts:
                if b - a > 1:
                    at = np.arange(a + 1, b)
                    gain = value(a, at) + value(at, b) - value(a, b)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (a, b), a + 1 + k)
            if best[1] is None:
                break
            parts.remove(best[1])
            parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + lam)
        return out

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best tree with one cut on each of two features: its gain and its table."""
        k, lam = self.pair_bins, self.smoothing
        G, H = (x.reshape(k, k).cumsum(0).cumsum(1) for x in (g, h))
        four = lambda C: np.array([C[:-1, :-1], C[:-1, -1:] - C[:-1, :-1], C[-1:, :-1] - C[:-1, :-1], C[-1, -1] - C[:-1, -1:] - C[-1:, :-1] + C[:-1, :-1]])
        P, Q = four(G), four(H)
        gain = (P**2 / (Q + lam)).sum(0)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        v = P[:, i, j] / (Q[:, i, j] + lam)
        out = np.empty((k, k))
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
        return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + lam)), out.ravel()

    def fit(self, X: np.ndarray, y: np.ndarray) -> AdditiveModel:
        quantiles = lambda x, n: np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))
        self.cuts = [quantiles(x, self.bins) for x in X.T]
        self.pair_cuts = [quantiles(x, self.pair_bins) for x in X.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        binned = [np.searchsorted(c, x, "right") for c, x in zip(self.cuts, X.T)]

        def gradients(score):
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for b, table in zip(binned, self.tables):
                g, h = gradients(score)
                step = self.rate * self._tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
                table += step
                score += step[b]
        k = self.pair_bins
        coarse = [np.searchsorted(c, x, "right") for c, x in zip(self.pair_cuts, X.T)]
        g, h = gradients(score)
        cell = lambda i, j: coarse[i] * k + coarse[j]
        ranked = sorted(
            ((self._quadrants(np.bincount(c, g, k * k), np.bincount(c, h, k * k))[0], i, j)
             for i in range(len(coarse)) for j in range(i) for c in [cell(i, j)]),
            reverse=True,
        )
        self.pairs = [(i, j, np.zeros(k * k)) for _, i, j in ranked[: self.pairs_kept]]
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                g, h = gradients(score)
                c = cell(i, j)
                step = self.rate * self._quadrants(np.bincount(c, g, k * k), np.bincount(c, h, k * k))[1]
                table += step
                score += step[c]
        return self

    def score(self, X: np.ndarray) -> np.ndarray:
        total = np.full(len(X), self.base)
        for c, table, x in zip(self.cuts, self.tables, X.T):
            total += table[np.searchsorted(c, x, "right")]
        for i, j, table in self.pairs:
            at = [np.searchsorted(self.pair_cuts[f], X[:, f], "right") for f in (i, j)]
            total += table[at[0] * self.pair_bins + at[1]]
        return 1 / (1 + np.exp(-total))


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(x.as_py() or b"") for x in texts]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, folds: int = 5) -> AdditiveModel:
    """Fits the model on labelled rows outside fold 0 of crc32(id) mod folds."""

    @F.arrow_udf("array<double>")
    def feature_column(texts: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(texts)), pa.list_(pa.float64()))

    known = labels.select(F.col(doc_id).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").distinct()
    sample = known.where(crc_mod(F.col("k"), folds) != 0).orderBy(F.xxhash64("k"), "k", "y").limit(sample_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("k"), utf8(docs[text]).alias("t"))
    told = texts.join(F.broadcast(sample), "k").select("y", feature_column("t").alias("x"), F.xxhash64("k", "t").alias("h"))
    # Ids may repeat among the documents, so that the bound is set again, on rows.
    rows = told.orderBy("h", "y").limit(sample_rows).collect()
    if not rows:
        empty = np.zeros((2, len(FEATURES)))
        return AdditiveModel().fit(empty, np.array([0.0, 1.0]))
    return AdditiveModel().fit(np.array([r.x for r in rows]), np.array([float(r.y > 0) for r in rows]))


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the model's score, 0 to 1, under a name that no column has."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_matrix(texts)), pa.float64())

    return docs.withColumn(free_name(docs, out), scored.asNondeterministic()(utf8(docs[text])))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether its fold was held out, its score and the verdict at 0.3."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scored = score_quality(kept, train(kept, labels)).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
