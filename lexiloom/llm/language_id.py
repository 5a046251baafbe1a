"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built of a bounded sample of its labelled text. A text is
parsed into phrases, each the longest match of what remains in the language's sample; the language
whose phrases cost least (phrase count times the log of the sample's size, per symbol) wins. Since a
parse only walks forward and restarts at a mismatch, the automata become one dense table (at most about 140 MB
in a process, whatever the input: of more than MOST_LANGUAGES labels those of the most documents are learned), and all
texts of a batch advance together, one symbol a step, in numpy. For that, texts are cut into pieces of
PIECE symbols, each parsed from the start first; then every piece is parsed again from where its
predecessor really ended, until both parses are in one state, in ROUNDS rounds for all pieces at once. Where a text repeats so regularly that parses never meet,
its pieces are parsed once more in order. So the result is that of the whole text, in time proportional to its length.

Symbols are the samples' most frequent lower-case letters and one for a run of anything that is no
letter. All other letters are written as hexadecimal digits, with 16 symbols of their own, so
that no two letters are ever confused, whatever the scripts.

Edge cases: a text that is null or has no letter gives `und` with score 0, as does any text if no
language was learned; ties go to the language first in order; null languages are not learned from;
repeated rows and extra columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_mod, free_name, utf8
from lexiloom.llm.hashing import mix

#: The sample: at most one document for each language and each of SLOTS hash slots; of their texts, cut whole into
#: pieces of at most SAMPLE_CHARS characters, those with the least hashes, so that they come from all parts.
SLOTS, SAMPLE_CHARS = 64, 640
#: Symbols of sample over all languages, which bounds the table to about 140 MB, but that each language has a piece.
TOTAL_CHARS = 400_000
#: The length of pieces where many languages share TOTAL_CHARS.
LEAST_CHARS = 64
#: Letters with a symbol of their own; of others, digits with 4 bits each, 4 digits up to U+FFFF and 6 beyond.
ALPHABET, DIGITS = 46, 16
PIECE, ROUNDS = 256, 3
#: Labels that are learned: those of the most labelled documents, as each needs a piece of sample.
MOST_LANGUAGES = TOTAL_CHARS // (LEAST_CHARS + 1)
#: Symbols parsed together.
BATCH = 4 << 20
UNKNOWN = "und"


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, state 0 the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


@dataclass
class CrossParser:
    """Languages, the symbol of each code point, and the joint table of all automata."""

    languages: list[str]
    symbols: np.ndarray
    width: int
    table: np.ndarray
    starts: np.ndarray
    costs: np.ndarray

    def read(self, text: str) -> np.ndarray:
        """A text's symbols; 0 stands for anything between letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.symbols[points]
        gap = found == 0
        gap[1:] &= gap[:-1].copy()
        gap[:1] = False
        found, points = found[~gap], points[~gap]
        if not (found < 0).any():
            return found
        sizes = np.where(found < 0, np.where(points > 0xFFFF, 6, 4), 1)
        left = np.cumsum(sizes).repeat(sizes) - np.arange(sizes.sum()) - 1  # digits that follow
        digits = self.width - DIGITS + (points.repeat(sizes) >> (4 * left).astype(np.uint32) & np.uint32(15)).astype(np.int32)
        found = found.repeat(sizes)
        return np.where(found < 0, digits, found)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text for each language."""
        pieces = [max(1, -(-len(t) // PIECE)) for t in texts]
        total = sum(pieces)
        grid = np.zeros((total, PIECE), np.int32)
        sizes, first = np.zeros(total, np.int64), np.zeros(total, bool)
        at = 0
        for t, n in zip(texts, pieces):
            grid[at : at + n].reshape(-1)[: len(t)] = t
            sizes[at : at + n] = np.clip(len(t) - PIECE * np.arange(n), 0, PIECE)
            first[at] = True
            at += n
        order = np.argsort(-sizes, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        alive = np.searchsorted(-sizes[order], -np.arange(PIECE), "left")
        counts = np.zeros((len(self.languages), total), np.int32)
        for k, start in enumerate(self.starts):
            state, count = np.full(total, start, np.int32), np.zeros(total, np.int32)
            for c in range(PIECE):
                n = alive[c]
                if not n:
                    break
                step = self.table[state[:n] + columns[c, :n]]
                count[:n] += step & 1
                state[:n] = step >> 1
            counts[k, order] = count
            ends = np.empty(total, np.int32)
            ends[order] = state
            self._join(grid, sizes, first, start, ends, counts[k])
        return np.add.reduceat(counts, np.concatenate([[0], np.cumsum(pieces)[:-1]]), axis=1).T + 1

    def _join(self, grid: np.ndarray, sizes: np.ndarray, first: np.ndarray, start: int, ends: np.ndarray, counts: np.ndarray) -> None:
        """Corrects the counts and end states of pieces that were parsed from the start to those of a parse from their predecessors' ends."""
        entry = np.full(len(ends), start, np.int32)
        for _ in range(ROUNDS):
            true = np.concatenate([[start], ends[:-1]]).astype(np.int32)
            true[first] = start
            piece = np.flatnonzero(true != entry)
            if not len(piece):
                return
            old, new = entry[piece], true[piece]
            entry[piece] = new
            for c in range(PIECE):
                # The shorter pieces end here: their last state is the new parse's.
                over = sizes[piece] == c
                ends[piece[over]] = new[over]
                piece, old, new = piece[~over], old[~over], new[~over]
                if not len(piece):
                    break
                symbol = grid[piece, c]
                a, b = self.table[old + symbol], self.table[new + symbol]
                counts[piece] += (b & 1) - (a & 1)
                old, new = a >> 1, b >> 1
                apart = old != new
                piece, old, new = piece[apart], old[apart], new[apart]
            ends[piece] = new
        self._walk(grid, sizes, first, start, entry, ends, counts)

    def _walk(self, grid: np.ndarray, sizes: np.ndarray, first: np.ndarray, start: int, entry: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        """What the rounds have not settled: piece by piece in order, each parsed once, from where its predecessor ends."""
        true = np.concatenate([[start], ends[:-1]]).astype(np.int32)
        true[first] = start
        table, last = memoryview(self.table), len(ends) - 1
        for at in np.flatnonzero(true != entry).tolist():
            while entry[at] != (state := start if first[at] else int(ends[at - 1])):
                entry[at], n = state, 0
                for symbol in grid[at, : sizes[at]].tolist():
                    step = table[state + symbol]
                    n += step & 1
                    state = step >> 1
                counts[at] = n
                if ends[at] == state or at == last:
                    ends[at] = state
                    break
                ends[at] = state
                at += 1

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        todo, waiting = [], 0

        def flush() -> None:
            if todo:
                cost = self.phrases([t for _, t in todo]) * self.costs
                best = cost.argmin(1)
                odds = np.exp(np.minimum(0, (cost.min(1)[:, None] - cost) / 16)).sum(1)
                for (i, _), b, o in zip(todo, best, odds):
                    out[i] = (self.languages[b], float(1 / o))
                todo.clear()

        for i, text in enumerate(texts):
            if not text or not self.languages:
                continue
            read = self.read(text)
            if not read.any():
                continue
            todo.append((i, read))
            waiting += len(read) + PIECE
            if waiting > BATCH:
                flush()
                waiting = 0
        flush()
        return out


def build(samples: dict[str, list[str]]) -> CrossParser:
    """The parser for samples of text by language: pieces in order, of which the first is used, and more while they fit the language's share."""
    languages = sorted(samples)
    letters: dict[str, int] = {}
    for parts in samples.values():
        for c in "".join(parts).lower():
            if c.isalpha():
                letters[c] = letters.get(c, 0) + 1
    alphabet = sorted(letters, key=lambda c: (-letters[c], c))[:ALPHABET]
    width = len(alphabet) + 1 + DIGITS
    symbols = np.fromiter((-1 if chr(i).isalpha() else 0 for i in range(0x110000)), np.int32, 0x110000)
    for i, c in enumerate(alphabet):
        symbols[ord(c)] = i + 1
    parser = CrossParser(languages, symbols, width, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    tables, starts, costs, base = [], [], [], 0
    for name in languages:
        sample: list[int] = []
        for i, part in enumerate(samples[name]):
            part = [0, *parser.read(part).tolist()]
            if i and len(sample) + len(part) > TOTAL_CHARS // len(languages):
                break
            sample += part
        nexts = suffix_automaton(sample)
        first = nexts[0]
        # A mismatch ends the phrase; the next begins with the same symbol, or after it if the sample lacks it.
        restart = np.array([(base + first.get(c, 0) * width) << 1 | 1 for c in range(width)], np.int32)
        table = np.tile(restart, (len(nexts), 1))
        for s, row in enumerate(nexts):
            for c, to in row.items():
                table[s, c] = (base + to * width) << 1
        tables.append(table.ravel())
        starts.append(base)
        costs.append(np.log2(len(sample) + 2))
        base += table.size
    parser.table = np.concatenate(tables) if tables else parser.table
    parser.starts, parser.costs = np.array(starts, np.int32), np.array(costs)
    return parser


@dataclass(frozen=True)
class LanguageModel:
    """Languages and their pieces of sample. Only these are sent to executors; each Python process builds the parser of them once."""

    samples: tuple[tuple[str, tuple[str, ...]], ...]

    def parser(self) -> CrossParser:
        return _built(self.samples)


@functools.lru_cache(maxsize=1)
def _built(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> CrossParser:
    return build({name: list(parts) for name, parts in samples})


def piece_size(languages: int) -> tuple[int, int]:
    """The length of a piece of sample and the number of pieces of each language."""
    share = TOTAL_CHARS // max(1, languages)
    size = max(LEAST_CHARS, min(SAMPLE_CHARS, share // 16))
    return size, max(1, share // size)


def _pieces(size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(l, h, t) to (l, rank, t): of each text the pieces that rank first by hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for name, h, raw in zip(*(c.to_pylist() for c in batch.columns)):
                t = raw.decode("utf-8", "replace")
                ranks = mix(np.arange(-(-len(t) // size), dtype=np.uint64) + mix(np.array([h], np.int64).view(np.uint64))).view(np.int64)
                out += [(name, int(ranks[i]), t[i * size : (i + 1) * size]) for i in np.argsort(ranks, kind="stable")[:most].tolist()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["l", "rank", "t"])

    return cut


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2) -> LanguageModel:
    """Learns from a bounded sample of labelled rows outside the held-out fold of crc32(id)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(lang).cast("string").alias("l"), docs[text].alias("t"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (crc_mod(F.col("k"), folds) != held_out)).withColumn("h", F.xxhash64("k"))
    if rows.select("l").distinct().count() > MOST_LANGUAGES:
        most = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES).select("l")
        rows = rows.join(F.broadcast(most), "l", "left_semi")
    chosen = rows.groupBy("l", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min("h").alias("h")).select("l", "h")
    # At most SLOTS rows for each language, so the broadcast is bounded by the number of languages.
    found = rows.join(F.broadcast(chosen), ["l", "h"]).select("l", "h", utf8(F.col("t")).alias("t")).dropDuplicates(["l", "h"])
    size, most = piece_size(chosen.select("l").distinct().count())
    ranked = found.mapInArrow(_pieces(size, most), "l string, rank long, t string")
    # At most SLOTS * most pieces for each language.
    best = ranked.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("rank", "t"))).where(F.col("n") <= most).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(best, key=lambda r: (r.l, r.n)):
        samples.setdefault(r.l, []).append(r.t)
    return LanguageModel(tuple((name, tuple(parts)) for name, parts in sorted(samples.items())))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """Adds a struct of the predicted language and a score, 0 to 1, under a name that no column has."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def identified(texts: pa.Array) -> pa.Array:
        found = shared.value.parser().predict([None if not x.is_valid else x.as_py().decode("utf-8", "replace") for x in texts])
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return docs.withColumn(free_name(docs, out), identified.asNondeterministic()(utf8(docs[text])))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: whether its fold was held out, the predicted language and its score."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = identify(kept, train(docs)).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "language")
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
