"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last adds those of the mixture. Each stage's result is written as Parquet
and read again, so a lost executor never costs more than one stage.

Edge cases, stage by stage. Null and empty texts: the classifier scores them as it scores any text, from their features; they are no near-duplicates of
anything, so that all stay; they hold no benchmark words and no secrets; in the mixture they have no bytes, but are drawn like others of their source. Null ids: never labelled; each such row
is known by its text. Null sources are a source of their own. Repeated rows: one of a group of copies stays, that with the least id, and rows with equal ids and texts are
one document. Ties at the classifier's threshold are kept, those at the contamination rule's one word in twenty are removed. Extra columns pass through all stages, whatever their names.
Empty tables: no documents give no documents; without labels the classifier scores all alike, by its prior of one half, and keeps them; without benchmark items nothing is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from lexiloom.llm.common import delete_shared, fresh, table, write_shared


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this input's labelled rows, does not reject."""
    (score,) = fresh(docs, "quality_score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicate(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is in a benchmark window."""
    (marks,) = fresh(docs, "benchmark_marks")
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"), out=marks)
    return marked.where(~decontaminate.contaminated(marks)).drop(marks)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text."""
    (found,) = fresh(docs, "secrets_found")
    scanned = secret_scan.find_secrets(docs, out=found)
    clean = F.col(found)["redacted"].cast("string")
    columns = {"text": F.coalesce(clean, F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(clean.isNotNull(), F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return scanned.withColumns(columns).drop(found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares, by replication, in shuffled order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicates", near_deduplicate),
    ("benchmark decontamination", remove_contaminated),
    ("secret scans", redact_secrets),
    ("source mixing", mix),
]

#: No SQL expresses the classifier or the signatures; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once the next is written; the last stays until the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs, path = write_shared(stage(spark, docs, sf_dir), f"stage{i + 1}")
        if before:
            delete_shared(spark, before)
        before = path
    return docs
