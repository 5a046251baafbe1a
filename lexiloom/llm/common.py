"""What several operators share: table access, word rules and shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.collection import spread

#: Maps A-Z to a-z and every ASCII byte that is no digit or letter to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(raw: bytes) -> list[bytes]:
    """Lower-case words of UTF-8 text: runs of ASCII digits, letters and non-ASCII characters."""
    return raw.translate(WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to all cores if it is one of a few splits."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def utf8(column: Column) -> Column:
    """A text column as bytes, null as null."""
    return column.cast("string").cast("binary")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a value's decimal text, modulo n; 0's remainder class for null ids."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a default of one machine, for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/lexiloom-shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_shared(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Writes a table to the shared folder, cutting lineage; returns its reader and its path. What is not deleted before goes with the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
    files, where = _files(spark, path)
    df.write.option("compression", compression).parquet(path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def delete_shared(spark: SparkSession, *paths: str) -> None:
    """Removes intermediate tables once nothing reads them any more."""
    for path in paths:
        files, where = _files(spark, path)
        files.delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises a small table reliably, in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of the frame has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(raws: list[bytes], limit: int = 4 << 20):
    """Consecutive slices [a, b) of a list of texts, of about `limit` bytes each."""
    start = size = 0
    for i, raw in enumerate(raws):
        size += len(raw) + 8
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(raws):
        yield start, len(raws)


def free_name(df: DataFrame, name: str) -> str:
    """A result column's name, unless a column of the frame has it already, which is an error rather than a column lost."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already; give another name for the result")
    return name
