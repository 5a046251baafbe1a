"""The analyzer: documents to token arrays and to the long token table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.functions.lemma import lemma_forms, lemma_map, lemma_tokens, seed_exceptions, seed_lexicon
from lexiloom.functions.porter import stem_tokens
from lexiloom.functions.text import hyphen_spaced, plain_tokens, without_stop_words, word_tokens


def _in_place(cfg: AnalyzerConfig, lexicon: DataFrame | None, exceptions: DataFrame | None) -> Callable[[Column], Column] | None:
    """The norm as a function of a column of tokens; None if the lexicon has more than PACKED_WORDS words."""
    if cfg.norm == "none":
        return lambda tokens: tokens
    if cfg.norm == "stem":
        return stem_tokens
    forms = lemma_forms(lexicon, exceptions)
    return None if forms is None else lambda tokens: lemma_tokens(tokens, forms, stemmed=cfg.norm == "both")


def _joined(rows: DataFrame, column: str, cfg: AnalyzerConfig, lexicon: DataFrame | None, exceptions: DataFrame | None) -> DataFrame:
    """Lemmas of a column of tokens by a join of its terms; each row is numbered where it is read, and its tokens come together by that number."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != column]
    long = rows.withColumn("row", F.monotonically_increasing_id()).select("row", F.struct(*others).alias("others"), F.posexplode_outer(column).alias("pos", "term"))
    lexicon, exceptions = seed_lexicon(spark) if lexicon is None else lexicon, seed_exceptions(spark) if exceptions is None else exceptions
    lemmas = lemma_map(long.where("term is not null"), lexicon, exceptions)
    some = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "lemma")))
    told = long.join(lemmas, "term", "left").groupBy("row").agg(F.first("others").alias("others"), F.transform(F.array_sort(some), lambda x: x["lemma"]).alias(column))
    return told.select("others.*", (stem_tokens(F.col(column)) if cfg.norm == "both" else F.col(column)).alias(column))


def normalised(rows: DataFrame, column: str, cfg: AnalyzerConfig, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """A column of tokens after the norm alone, one row for each row."""
    norm = _in_place(cfg, lexicon, exceptions)
    if norm is None:
        return _joined(rows, column, cfg, lexicon, exceptions)
    # The generator keeps Catalyst from inlining stems wherever the tokens are used, in lambdas once for each element.
    return rows if cfg.norm == "none" else rows.withColumn(column, F.explode(F.array(norm(F.col(column)))))


def analyzed(docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(doc_id, tokens), one row for each row of docs, whatever the ids. Nothing is shuffled unless the lexicon is too large to be sent."""
    # The generator keeps Catalyst from inlining the tokeniser wherever tokens are used, in lambdas once for each element.
    base = docs.select("doc_id", F.explode(F.array(plain_tokens(F.col("text"), cfg))).alias("tokens"))
    return normalised(base, "tokens", cfg, lexicon, exceptions)


#: Documents that are looked at before the whole collection, when a few of its first are asked for.
LEADING = 64


def leading(docs: DataFrame, rows: Callable[[DataFrame], DataFrame], n: int) -> list:
    """The first n, by doc_id, of the rows that a function makes of documents; most often those of the first documents."""
    found = rows(docs.orderBy("doc_id").limit(LEADING)).orderBy("doc_id").limit(n).collect()
    return found if len(found) == n else rows(docs).orderBy("doc_id").limit(n).collect()


def token_table(docs: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), **lexical: DataFrame) -> DataFrame:
    """(doc_id, pos, term); pos counts what is left after every step, from 0."""
    return analyzed(docs, cfg, **lexical).select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def pipeline_stages(docs: DataFrame, doc_id, cfg: AnalyzerConfig = AnalyzerConfig(), **lexical: DataFrame) -> DataFrame:
    """One document's text after every step, as one row; bypassed steps repeat what they were given."""
    text = F.col("text")
    one = docs.where(F.col("doc_id").eqNullSafe(F.lit(doc_id))).select("doc_id", text.alias("stage0_raw"), (hyphen_spaced(text) if cfg.hyphens else text).alias("stage1_hyphen"))
    one = one.withColumn("stage2_lower", F.lower("stage1_hyphen") if cfg.lowercase else F.col("stage1_hyphen"))
    one = one.select("*", F.explode(F.array(word_tokens(F.col("stage2_lower"), cfg.lowercase, cfg.abbreviations, cfg.ordinals))).alias("stage3_tokens"))
    one = one.withColumn("stage4_stop", without_stop_words(F.col("stage3_tokens")) if cfg.stopwords else F.col("stage3_tokens"))
    return normalised(one.withColumn("stage5_norm", F.col("stage4_stop")), "stage5_norm", cfg, **lexical)


def stage_labels(cfg: AnalyzerConfig = AnalyzerConfig()) -> dict[str, str]:
    """Whether each optional step is active."""
    state = lambda on: "Active" if on else "Bypassed"
    return {"stage1_hyphen": state(cfg.hyphens), "stage2_lower": state(cfg.lowercase), "stage4_stop": state(cfg.stopwords), "stage5_norm": state(cfg.norm != "none")}


def query_tokens(docs: DataFrame, text: str, cfg: AnalyzerConfig, **lexical: DataFrame) -> list[str]:
    """A query string analyzed by the same expressions and lexicon, when a plan is built."""
    one = docs.sparkSession.createDataFrame([(0, text)], "doc_id int, text string")
    return list(analyzed(one, cfg, **lexical).first().tokens)
