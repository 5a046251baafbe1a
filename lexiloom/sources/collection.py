"""Reading and storing collections of documents (doc_id, text)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_text(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """One document for each .txt file, named by its file; of files with one name the last path wins.

    strict: bytes that are not UTF-8 raise; otherwise they are replaced.
    """
    if strict:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(paths)
        rows = files.select(F.col("path").alias("path"), F.decode("content", "UTF-8").alias("text"))
    else:
        files = spark.read.text(paths, wholetext=True, pathGlobFilter="*.txt")
        rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    named = rows.withColumn("doc_id", F.element_at(F.split("path", "/"), -1))
    return last_of_each(named, "path").select("doc_id", "text")


def last_of_each(rows: DataFrame, order: str) -> DataFrame:
    """The last row for each doc_id; rows without an order come first. Tasks send one row for each id, however often it occurs."""
    others = [c for c in rows.columns if c != "doc_id"]
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"))
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*others), place).alias("last"))
    return last.select("doc_id", "last.*").select(*rows.columns)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of a few splits, of which fewer than there are cores hold rows, dealt to all cores; any other as it is.

    One row group cannot be split, so a small file would leave all work on its text to one task. Rows are
    counted by split from the files' footers, and only if there are few splits: a large table is never dealt anew.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > 4 * cores:
        return scan
    filled = scan.groupBy(F.spark_partition_id()).count().count()
    return scan.repartition(cores) if filled < cores else scan


def read_table(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents from Parquet; only the two columns are read."""
    return spread(spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))


def store(docs: DataFrame, path: str) -> None:
    """Replaces the stored collection."""
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path)


def register(docs: DataFrame, name: str = "collection") -> None:
    """Replaces the session's collection of that name."""
    docs.select("doc_id", "text").createOrReplaceTempView(name)


def select_document(docs: DataFrame, doc_id) -> DataFrame:
    """One document; the filter reaches the scan."""
    return docs.where(F.col("doc_id") == F.lit(doc_id)).select("doc_id", "text")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a stored table, by its list of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def store_index(index: DataFrame, path: str, *keys: str, bloom: int = 0, parts: int = 0) -> None:
    """Writes an index sorted by its keys within files of key ranges, so that scans skip files and row groups.

    Further keys than the first let the ranges cut through a frequent one. bloom: row groups also have Bloom filters of the first key, for about so many
    values, so that a scan for one value skips those that lack it even where it lies within their range. parts: the least number of ranges that a task can sort each of.
    """
    known = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(k) for k in keys]
    ranged = index.repartitionByRange(parts, *columns) if parts > known else index.repartitionByRange(*columns)
    writer = ranged.sortWithinPartitions(*keys).write.mode("overwrite")
    # Of a given size: an adaptive filter puts every row into candidates of all sizes.
    writer = writer.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").option(f"parquet.bloom.filter.expected.ndv#{keys[0]}", str(bloom)) if bloom else writer
    writer.parquet(path)


def store_ranges(spark: SparkSession, path: str, key: str, manifest: str) -> None:
    """Writes what range of a key each file of an index may hold: (file, first, last), a row for each file.

    A file is sorted, and the next one goes on where it ends: so each one's first row is enough, and `last` is where the next begins; of the last, the greatest
    key of all. The least and greatest key by file would take a sort of the whole index.
    """
    index = spark.read.parquet(path)
    rows = index.where(F.col("_metadata.row_index") == 0).select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("first"))
    # Files that begin with one frequent key come in the order of their names, as they were written.
    last = F.coalesce(F.lead("first").over(Window.orderBy("first", "file")), index.agg(F.max(key)).scalar())
    rows.withColumn("last", last).coalesce(1).write.mode("overwrite").parquet(manifest)


def read_ranges(spark: SparkSession, path: str, key: str, manifest: str, values: list[str]) -> DataFrame:
    """The rows of an index that have one of these keys, read from the files whose range may hold one; the other files are not even opened."""
    inside = F.lit(False)
    for v in values:
        inside = inside | F.lit(v).between(F.col("first"), F.col("last"))
    files = [r.file for r in spark.read.parquet(manifest).where(inside).select("file").collect()]
    frame = spark.read.parquet(path) if not files else spark.read.schema(spark.read.parquet(path).schema).parquet(*sorted(files))
    return frame.where(F.col(key).isin(*values) if files and values else F.lit(False))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), which goes with the driver; of a local master, under /tmp if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/lexiloom-scratch"
    path = f"{folder.rstrip('/')}/lexiloom-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)  # what is not there yet could not be marked
    files.deleteOnExit(where)
    return path
