"""Permuterm index: every rotation of every term, sorted, so that a wildcard pattern is one range of it.

A term is closed by a dollar sign, which no term holds, and rotated. A pattern a*b is then all rotations that begin with b$a; of a pattern with more
stars, the outer parts or the longest inner one, whichever is longer, give the range, and the whole pattern is tested on its terms. The
index holds a row for each character of a term and one more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import wildcard_like


def permuterm_pairs(terms: DataFrame) -> DataFrame:
    """(rotation, term) of distinct terms."""
    closed = F.concat("term", F.lit("$"))
    turned = lambda i: F.concat(F.substring(closed, i + 1, F.length("term") + 1), F.left(closed, i))
    distinct = terms.select("term").where("term is not null").distinct()
    return distinct.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("term")), turned)).alias("rotation"), "term")


def rotation_prefix(pattern: str) -> tuple[str, bool]:
    """What the rotations of a pattern's matches begin with, and whether a term has one such rotation at most; computed when a plan is built."""
    first, *inner, last = pattern.split("*")
    longest = max(inner, key=len, default="")
    return (longest, False) if len(longest) > len(first) + len(last) else (f"{last}${first}", True)


def permuterm_lookup(pairs: DataFrame, pattern: str) -> DataFrame:
    """Terms that match a pattern, sorted, from one range of the stored pairs; none if it has no star."""
    if "*" not in pattern:
        return pairs.where(F.lit(False)).select("term")
    prefix, single = rotation_prefix(pattern)
    rotation = F.col("rotation")
    found = pairs.where((rotation >= prefix) & rotation.startswith(prefix)).where(F.col("term").like(wildcard_like(pattern))).select("term")
    return (found if single else found.distinct()).orderBy("term")
