"""Keyed upsert into a table of sorted files, copy on write and without a join.

A table is a folder of Parquet files of at most M rows, sorted by an integer key within and across files. A key's home is
the last file that begins at or below it, else the first. An upsert unites the rows of the homes that take part with the changes,
each tagged by what it is, and one group-by of the key keeps the base row and the winning change; comparing the two tells
which homes change. Only those are written anew, cut into the fewest files of at most M rows, sizes at most one apart;
neighbours that have become small are joined. All other files stay as they are, untouched.

How it scales. A change that loses never leaves its task: the group-by aggregates before it shuffles, so a key with a third of
all changes sends one row a task. Ranks within a home do not pass through one task either: keys are cut into SLICES
by approximate quantiles, rows are ranked within slices, and the slices' counts are added up. What the driver sees are first keys, counts and sizes
of files and slices; their number is that of the files, not of rows. A file is written by one task, row after row. Tables between the steps are
written to the shared folder, so a lost executor costs a step at most; files are renamed into the table's folder only when all are written.

Edge cases: rows without a key are no part of a table, and changes without one change nothing; of rows with equal keys a new table keeps the
least by its other columns; of changes with equal keys and order the greatest by its other fields wins, and repeated changes count
once; a table without files has no homes, so that nothing is inserted; columns that changes have beyond those that are set are ignored; a table's column may have
any name. Nulls and NaN are equal to themselves when rows are compared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import delete_shared, fresh, shared_folder, write_shared

#: Ranges of keys within which rows are ranked, and the quantiles' error, as a share of the rows.
SLICES, ACCURACY = 512, 1 / 8192
START, REWRITTEN = "start", "rewritten"


@dataclass(frozen=True)
class SortedTable:
    """A folder, its key, the most rows of a file, and for every file its name, first key and number of rows, ascending."""

    spark: SparkSession
    folder: str
    key: str
    most: int
    files: tuple[tuple[str, int, int], ...]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)


def place(value: Column, bounds: list[int]) -> Column:
    """The index of the last of these ascending bounds that is at or below the value, else 0; by bisection."""
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    listed = F.lit(bounds)
    further = lambda at, step: F.when(F.coalesce(F.get(listed, at + step) <= value, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.lit(steps), F.lit(0), further)


def _listed(values: list, at: Column) -> Column:
    """The value at an index of a list that the driver holds."""
    return F.get(F.lit(values), at)


def _bounds(keys: DataFrame, key: str) -> list[int]:
    """Ascending keys that cut these rows into at most SLICES ranges of about equal size."""
    shares = [i / SLICES for i in range(SLICES)]
    found = keys.agg(F.percentile_approx(F.col(f"`{key}`"), shares, int(1 / ACCURACY))).first()[0]
    return sorted(set(found or [0]))


def _ranked(rows: DataFrame, key: str, slice_: str, offsets: list[int], out: str) -> DataFrame:
    """A column with each row's place by key, from 0, given how many rows stand before each slice."""
    within = F.row_number().over(Window.partitionBy(slice_).orderBy(F.col(f"`{key}`")))
    return rows.withColumn(out, _listed(offsets, F.col(slice_)) + within - 1)


def _paths(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _write_files(rows: DataFrame, number: str, n: int, key: str, folder: str, prefix: str) -> None:
    """One file of the folder for each of the numbers 0 to n - 1 of a column, sorted by the key, without that column."""
    spark, staging = rows.sparkSession, f"{folder}/_staging-{prefix}"
    sorted_rows = rows.repartitionById(max(1, n), F.col(number)).sortWithinPartitions(number, F.col(f"`{key}`"))
    sorted_rows.write.partitionBy(number).parquet(staging)
    path, files = _paths(spark, folder)
    for found in files.globStatus(path(f"{staging}/{number}=*/part-*")):
        k = int(found.getPath().getParent().getName().split("=")[1])
        if not files.rename(found.getPath(), path(f"{folder}/{prefix}-{k:06d}.parquet")):
            raise OSError(f"cannot rename {found.getPath()}")
    files.delete(path(staging), True)


def _manifest(spark: SparkSession, folder: str, key: str) -> tuple[tuple[str, int, int], ...]:
    """Name, first key and rows of every file: a row a file comes to the driver."""
    path, files = _paths(spark, folder)
    if not files.globStatus(path(f"{folder}/*.parquet")):
        return ()
    rows = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(F.col(f"`{key}`")).alias("first"), F.count("*").alias("n"))
    return tuple(sorted(((r["name"], r["first"], r["n"]) for r in rows.collect()), key=lambda f: f[1]))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which stays."""
    return f"{shared_folder(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"


def create(rows: DataFrame, key: str, most: int, folder: str) -> SortedTable:
    """Writes rows as files of `most` rows, the last with the rest, sorted by the key, into a new folder."""
    spark = rows.sparkSession
    path, files = _paths(spark, folder)
    files.mkdirs(path(folder))
    slice_, rank, number, value = fresh(rows, "key_slice", "key_rank", "file_number", "key_value")
    others = [c for c in rows.columns if c != key]
    keyed = rows.where(F.col(f"`{key}`").isNotNull())
    one = keyed.groupBy(F.col(f"`{key}`")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias(value)) if others else keyed.distinct()
    kept, path_ = write_shared(one, "upsert-rows")
    bounds = _bounds(kept, key)
    sliced = kept.withColumn(slice_, place(F.col(f"`{key}`"), bounds))
    counts = {r[0]: r[1] for r in sliced.groupBy(slice_).count().collect()}
    offsets, before = [], 0
    for i in range(len(bounds)):
        offsets.append(before)
        before += counts.get(i, 0)
    ranked = _ranked(sliced, key, slice_, offsets, rank).withColumn(number, F.floor(F.col(rank) / most).cast("int"))
    flat = ranked.select(*[F.col(f"`{c}`") if c == key else F.col(value)[c].alias(c) for c in rows.columns], number)
    if before:
        _write_files(flat, number, -(-before // most), key, folder, START)
    delete_shared(spark, path_)
    return SortedTable(spark, folder, key, most, _manifest(spark, folder, key))


def cut(sizes: list[tuple[int, bool]], most: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where the rows of changed homes go, given each home's rows and whether it changed; and the number of new files.

    For every home: the rows of its smaller parts, how many parts have one row more, the file of its first part, and that of its second, which the others follow.
    A first part joins the file to its left if that is new too and both fit; no other part can, as two parts of one home are over `most`.
    """
    plan, files, left = [], 0, None  # left: rows of the file to the left, None if it is not new
    for n, changed in sizes:
        if not changed:
            plan.append((0, 0, -1, -1))
            left = None
            continue
        if not n:
            plan.append((0, 0, -1, -1))  # the file is gone, and its neighbours are neighbours now
            continue
        parts = -(-n // most)
        small, larger = divmod(n, parts)
        first = small + (larger > 0)
        if left is not None and left + first <= most:
            at, left = files - 1, left + first
        else:
            at, left, files = files, first, files + 1
        plan.append((small, larger, at, files))
        if parts > 1:
            files, left = files + parts - 1, small
    return plan, files


def _merged(table: SortedTable, changes: DataFrame, order: list[str], sets: list[str], fields: list[str], applies, deletes) -> DataFrame:
    """(key, home, row, differs): the rows of homes that take part after the changes, and rows that go as null."""
    spark, key = table.spark, table.key
    firsts = [first for _, first, _ in table.files]
    homes = spark.createDataFrame(list(enumerate(firsts)), "home int, first long")
    live = {r.home for r in homes.where(applies(F.col("first"))).select("home").collect()}
    taking = [i in live for i in range(len(firsts))]
    base = spark.read.parquet(*[f"{table.folder}/{name}" for (name, _, _), t in zip(table.files, taking) if t]) if live else table.read().where(F.lit(False))
    columns = base.columns
    fits = changes.where(F.col(f"`{key}`").isNotNull()).where(_listed(taking, place(F.col(f"`{key}`"), firsts)))
    entry = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*order, *sets, *fields])])
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    tagged = base.select(F.col(f"`{key}`").alias("key"), row.alias("base")).unionByName(fits.select(F.col(f"`{key}`").alias("key"), entry.alias("change")), allowMissingColumns=True)
    # The order comes first in a change, so that the greatest is the last one; fields after it settle ties.
    whole = F.col("change")
    told = tagged.groupBy("key").agg(F.max("base").alias("base"), F.max_by(whole, whole).alias("change"))
    told = told.withColumn("home", place(F.col("key"), firsts))
    gone = deletes(F.col("change"), _listed(firsts, F.col("home")))
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    values = [F.col("key") if c == key else F.col("change")[c].cast(base.schema[c].dataType) if c in sets else F.col("base")[at[c]] for c in columns]
    changed = F.struct(*[v.alias(at[c]) for c, v in zip(columns, values)])
    same = F.lit(True)
    for c in sets:
        same = same & F.col("base")[at[c]].eqNullSafe(changed[at[c]])
    none, no_base = F.col("change").isNull(), F.col("base").isNull()
    return told.select(
        "key", "home", F.when(none, F.col("base")).when(~gone, changed).alias("row"), F.when(none, F.lit(False)).when(gone, ~no_base).otherwise(no_base | ~same).alias("differs")
    ).where("row is not null or differs")


def upsert(
    table: SortedTable, changes: DataFrame, order: list[str], sets: list[str], applies: Callable[[Column], Column] = lambda first: F.lit(True),
    deletes: Callable[[Column, Column], Column] = lambda change, first: F.lit(False), fields: list[str] | None = None,
) -> SortedTable:
    """The table after each key's last change by `order`: it deletes, or sets the columns `sets`, inserting keys that are not there.

    applies: whether changes to a home count, from its first key. deletes: whether a change (a struct of order, sets and fields) deletes, from it and its home's first key.
    """
    spark, key = table.spark, table.key
    if not table.files:
        return table
    firsts = [first for _, first, _ in table.files]
    merged, path_ = write_shared(_merged(table, changes, order, sets, fields or [], applies, deletes), "upsert-merged")
    bounds = sorted({*_bounds(merged.where("row is not null"), "key"), *firsts})
    sliced = merged.withColumn("slice", place(F.col("key"), bounds))
    sums = sliced.groupBy("slice", "home").agg(F.count("row").alias("n"), F.max("differs").alias("differs")).orderBy("slice").collect()
    rows, changed, offsets = [0] * len(firsts), [False] * len(firsts), [0] * len(bounds)
    for r in sums:
        offsets[r["slice"]] = rows[r["home"]]
        rows[r["home"]] += r["n"]
        changed[r["home"]] |= r["differs"]
    plan, n_files = cut(list(zip(rows, changed)), table.most)
    home = F.col("home")
    small, larger, first, second = (_listed(list(x), home) for x in zip(*plan))
    kept = sliced.where("row is not null").where(_listed(changed, home))
    ranked = _ranked(kept, "key", "slice", offsets, "rank")
    head = larger * (small + 1)
    part = F.when(F.col("rank") < head, F.floor(F.col("rank") / (small + 1))).otherwise(larger + F.floor((F.col("rank") - head) / F.greatest(small, F.lit(1))))
    numbered = ranked.withColumn("part", part.cast("int")).withColumn("number", F.when(F.col("part") == 0, first).otherwise(second + F.col("part") - 1).cast("int"))
    names = spark.read.parquet(f"{table.folder}/{table.files[0][0]}").columns
    (number,) = fresh(spark.createDataFrame([], ", ".join(f"`{c}` int" for c in names)), "file_number")
    flat = numbered.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)], F.col("number").alias(number))
    if n_files:
        _write_files(flat, number, n_files, key, table.folder, REWRITTEN)
    path, files = _paths(spark, table.folder)
    for (name, _, _), gone in zip(table.files, changed):
        if gone:
            files.delete(path(f"{table.folder}/{name}"), False)
    delete_shared(spark, path_)
    return SortedTable(spark, table.folder, key, table.most, _manifest(spark, table.folder, key))


# ---- the query's table and rules


def _crc(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


SETS = ["source", "segment", "city", "balance"]


def clients_table(clients: DataFrame) -> SortedTable:
    """Clients with crc32(client_id) % 7 > 3, in files of a thousandth of all clients."""
    most = 1 + clients.count() // 1000
    return create(clients.where(_crc(F.col("client_id")) % 7 > 3), "client_id", most, new_folder(clients.sparkSession, "clients"))


def upsert_clients(table: SortedTable, changes: DataFrame) -> SortedTable:
    """Changes by seq and change_id; of homes with crc32(first id) % 16 over 7 none count."""
    group = lambda first: _crc(first) % 16
    deletes = lambda change, first: F.coalesce(change["op"] == "D", F.lit(False)) | F.coalesce(_crc(change["change_id"]) % 8 < group(first), F.lit(False))
    return upsert(table, changes, ["seq", "change_id"], SETS, lambda first: group(first) <= 7, deletes, ["op"])


def file_digests(table: SortedTable) -> DataFrame:
    """One row for each file, made of its rows in the file's order, which pass through a task one after the other."""
    schema = "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string"
    if not table.files:
        rows = table.spark.createDataFrame([], schema)
        return rows.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit("").alias("columns"), "path", F.lit(False).alias("rewritten"))
    frame = table.read()
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")])
    rows = frame.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col("client_id").alias("id"),
        F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)).cast("long").alias("cents"), F.crc32(text.cast("binary")).alias("crc"),
    )
    by_file = rows.repartition(F.col("path")).sortWithinPartitions("path", "at")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path, first, n, cents, crc, sha):
            return pa.RecordBatch.from_pylist([{"path": path, "first_id": first, "n_rows": n, "cents": cents, "rows_crc": crc, "ids_sha256": sha.hexdigest()}], into)

        into = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("first_id", "n_rows", "cents", "rows_crc")], ("ids_sha256", pa.string())])
        now = None
        for batch in batches:
            runs = batch.column("path").dictionary_encode()
            codes, at = runs.indices.to_numpy(zero_copy_only=False), 0
            while at < len(codes):
                upto = at + int((codes[at:] == codes[at]).sum())  # rows of a file stand together
                path, part = runs.dictionary[int(codes[at])].as_py(), batch.slice(at, upto - at)
                ids = part.column("id").to_pylist()
                if now is None or now[0] != path:
                    if now is not None:
                        yield row(*now)
                    now = [path, ids[0], 0, 0, 0, hashlib.sha256()]
                now[5].update(("," if now[2] else "").encode() + ",".join(map(str, ids)).encode())
                now[2] += len(ids)
                now[3] += sum(part.column("cents").to_pylist())
                now[4] += sum(part.column("crc").to_pylist())
                at = upto
        if now is not None:
            yield row(*now)

    found = by_file.mapInArrow(digests, schema)
    columns = F.lit(",".join(frame.columns)).alias("columns")
    return found.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", columns, "path", F.col("path").contains(f"/{REWRITTEN}-").alias("rewritten"))


def digest(clients: DataFrame, changes: DataFrame) -> DataFrame:
    return file_digests(upsert_clients(clients_table(clients), changes))
