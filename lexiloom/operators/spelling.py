"""Spelling on a stored vocabulary: a Levenshtein automaton, built when the plan is, over blocks of sorted terms.

Terms are stored in blocks of at most BLOCK neighbours in sorted order that share their first PREFIX characters, front-coded: what all terms of a block begin with is kept once, with the rests. A query's
automaton reads that beginning first; where it is dead by then, no term of the block can be near enough, and the block's terms are neither
unpacked nor compared. Otherwise each rest is read from the state that the beginning has led to, and the state at its end is the distance.
Blocks of terms that are all too short or too long are skipped by the scan. The automaton is two arrays in the plan: transitions by state and character class, and distances.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms in a block, and characters that they share at least, if they have so many.
BLOCK, PREFIX = 128, 4


@dataclass(frozen=True)
class Automaton:
    """All words within a distance of one word. Class 0 is any character that the word does not have; state 0 is the first; -1 is dead."""

    word: str
    most: int
    letters: str
    next: tuple[int, ...]
    distance: tuple[int, ...]


def automaton(word: str, most: int = 2) -> Automaton:
    """The deterministic automaton of a word: its states are rows of the edit-distance table, cut off above the most."""
    letters = "".join(dict.fromkeys(word))
    start = tuple(min(i, most + 1) for i in range(len(word) + 1))
    states, order, table = {start: 0}, [start], []
    for row in order:  # grows as states are found
        for c in ("", *letters):
            new = [min(row[0] + 1, most + 1)]
            for i, x in enumerate(word):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1, most + 1))
            if min(new) > most:
                table.append(-1)
                continue
            key = tuple(new)
            if key not in states:
                states[key] = len(states)
                order.append(key)
            table.append(states[key])
    return Automaton(word, most, letters, tuple(table), tuple(r[-1] if r[-1] <= most else -1 for r in order))


def read(a: Automaton, state: Column, text: Column) -> Column:
    """The state after the characters of a text."""
    table, width = F.lit(list(a.next)), len(a.letters) + 1
    step = lambda s, c: F.when(s < 0, s).otherwise(F.get(table, s * width + F.instr(F.lit(a.letters), c)))
    return F.when(text == "", state).otherwise(F.aggregate(F.split(text, ""), state, step))


def distance(a: Automaton, state: Column) -> Column:
    """The distance of a text that ends in a state; -1 if it is over the most."""
    return F.when(state < 0, -1).otherwise(F.get(F.lit(list(a.distance)), state))


def term_blocks(terms: DataFrame, size: int = BLOCK) -> DataFrame:
    """(first, prefix, least, most, n, rests): blocks of neighbours in sorted order; least and most are lengths in characters."""
    ordered = terms.select("term").where("term is not null").distinct().repartitionByRange("term").sortWithinPartitions("term")
    # Rows of a sorted partition are numbered in their order.
    dealt = ordered.withColumn("block", F.struct(F.left("term", F.lit(PREFIX)), F.floor(F.monotonically_increasing_id() / size)))
    blocks = dealt.groupBy("block").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.min(F.length("term")).alias("least"), F.max(F.length("term")).alias("most"))
    first, last = F.element_at("terms", 1), F.element_at("terms", -1)
    shared = F.filter(F.sequence(F.lit(0), F.least(F.length(first), F.length(last))), lambda i: F.left(first, i) == F.left(last, i))
    told = blocks.withColumn("shared", F.array_max(shared))
    rests = F.transform("terms", lambda t: F.substring(t, F.col("shared") + 1, F.length(t)))
    return told.select(first.alias("first"), F.left(first, F.col("shared")).alias("prefix"), "least", "most", F.size("terms").alias("n"), rests.alias("rests"))


def _live(blocks: DataFrame, a: Automaton) -> DataFrame:
    fits = blocks.where((F.col("most") >= len(a.word) - a.most) & (F.col("least") <= len(a.word) + a.most))
    return fits.withColumn("state", read(a, F.lit(0), F.col("prefix"))).where("state >= 0")


def spell_lookup(blocks: DataFrame, word: str, max_dist: int = 2) -> DataFrame:
    """(term, distance) of all terms within an edit distance of the lower-cased word, nearest first."""
    a = automaton(word.lower(), max_dist)
    rests = _live(blocks, a).select("prefix", "state", F.explode("rests").alias("rest"))
    ended = rests.select(F.concat("prefix", "rest").alias("term"), distance(a, read(a, F.col("state"), F.col("rest"))).alias("distance"))
    return ended.where("distance >= 0").orderBy("distance", "term")


def spell_blocks(blocks: DataFrame, word: str, max_dist: int = 2) -> DataFrame:
    """One row: the blocks and terms there are, and those that a query for the word unpacks."""
    read_ = _live(blocks, automaton(word.lower(), max_dist)).agg(F.count("*").alias("blocks_read"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms_read"))
    whole = blocks.agg(F.struct(F.count("*").alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).alias("w")).scalar()
    return read_.withColumn("w", whole).select(F.col("w.b").alias("blocks"), "blocks_read", F.col("w.n").alias("terms"), "terms_read")
