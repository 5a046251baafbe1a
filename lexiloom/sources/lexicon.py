"""Lexicons from files in the format of the WordNet database (wndb(5WN)): index.POS and noun.exc."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of speech by the letter in an index file's lines.
PARTS = {"n": "noun", "v": "verb", "a": "adj", "r": "adv"}


def read_lexicon(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(word, pos) of all index files of a folder, and (form, lemma) of its noun exceptions.

    Lines that begin with a space are the files' preamble. A form with several lemmas keeps each, and the least counts.
    """
    lines = spark.read.text(f"{folder}/index.*", pathGlobFilter="index.[nva]*").where(~F.col("value").startswith(" "))
    parts = F.split("value", " ")
    part = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    words = lines.select(F.replace(F.get(parts, F.lit(0)), F.lit("_"), F.lit(" ")).alias("word"), F.element_at(part, F.get(parts, F.lit(1))).alias("pos"))
    forms = spark.read.text(f"{folder}/noun.exc").select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") > 1)
    exceptions = forms.select(F.get("w", F.lit(0)).alias("form"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("lemma"))
    return words.where("word <> '' and pos is not null").distinct(), exceptions.distinct()
