"""Documents that keep arriving: a token table, or a growing collection, that follows a directory of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators.analyze import token_table
from lexiloom.plans.segments import GrowingCollection


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, text) of the files of a directory as they appear."""
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.txt").load(path, wholetext=True)
    return stream.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), F.col("value").alias("text"))


def index_stream(docs: DataFrame, path: str, checkpoint: str, cfg: AnalyzerConfig = AnalyzerConfig(), once: bool = True, **lexical: DataFrame) -> StreamingQuery:
    """Writes every batch's tokens to its own folder of a token table; a batch that runs again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        token_table(batch, cfg, **lexical).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def grow_stream(docs: DataFrame, grown: GrowingCollection, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Makes every batch a generation of a growing collection: a file that is sent again, in a later batch, replaces its document.

    Batches are numbered from 0; one that runs again replaces its generation. Merges are left to others, between runs of the stream, and need `once`.
    """
    before = max([0, *grown.generations()])
    first: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        first[:] = first or [number]
        grown.change(batch, gen=before + 1 + number - first[0])

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
