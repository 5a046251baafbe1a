"""A stored collection that grows: documents are added, replaced and deleted without rewriting what is there.

Every change is a generation of its own: a folder `gen=n` under each table, so that n is a partition column of the whole table. A generation
also says which documents of earlier ones it hides, those that it replaces or deletes. Queries read the generations that are committed, by term as a
stored collection does, and drop rows of hidden documents by one join of the few rows found with the hidden ids. A merge writes the documents that are
left as one generation, which costs what they hold, and nothing waits for it.

A generation counts once its row in `generations` is written, last of all; the same change written again, after a failure, replaces its folder. Documents are
told apart by id: one id, one document, of the last generation that has it. Documents of one change that share an id, or have none, are all kept; those without an id are
never replaced. An empty change is a generation without rows. One process changes a collection at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators import analyze, dictionary, index, permuterm, phrase, tolerant
from lexiloom.sources.collection import store_index


def _fields(doc_id: DataType) -> dict[str, list[StructField]]:
    """Columns of every table."""
    id_, term, row = StructField("doc_id", doc_id), StructField("term", StringType()), StructField("row", StringType())
    return {
        "documents": [row, id_, StructField("text", StringType())], "tokens": [term, row, id_, StructField("pos", IntegerType())],
        "biwords": [StructField("biword", StringType()), row, id_], "permuterm": [StructField("rotation", StringType()), term],
        "hidden": [id_], "generations": [StructField("merged", IntegerType())],
    }


class GrowingCollection:
    """Documents (doc_id, text) under a path, with the configuration and the kind of id that they were stored with."""

    def __init__(
        self, spark: SparkSession, path: str, cfg: AnalyzerConfig = AnalyzerConfig(), doc_id: DataType | None = None,
        lexicon: DataFrame | None = None, exceptions: DataFrame | None = None,
    ) -> None:
        self.spark, self.path, self.cfg = spark, path, cfg
        self.lexical = {"lexicon": lexicon, "exceptions": exceptions}
        self.fields = _fields(doc_id or StringType())

    # ---- generations

    def _whole(self, name: str) -> DataFrame:
        """A table with the generation of each row, of all generations, committed or not."""
        schema = StructType([*self.fields[name], StructField("gen", IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing is stored yet
            return self.spark.createDataFrame([], schema)

    def generations(self) -> list[int]:
        """Generations that are committed and not merged into a later one; a row a change comes to the driver."""
        rows = self._whole("generations").collect()
        merged = max((r.merged for r in rows if r.merged is not None), default=0)
        return sorted(r.gen for r in rows if r.gen > merged)

    def _table(self, name: str) -> DataFrame:
        """Rows of the generations that count; the others' folders are not read."""
        return self._whole(name).where(F.col("gen").isin(*(self.generations() or [0])))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, gen, ...) of documents that no later generation hides."""
        until = self._table("hidden").groupBy("doc_id").agg(F.max("gen").alias("until"))
        return rows.join(until, "doc_id", "left").where("until is null or gen >= until").drop("until")

    def _write(self, name: str, rows: DataFrame, gen: int, *keys: str) -> None:
        rows = rows.select(*[f.name for f in self.fields[name]])
        folder = f"{self.path}/{name}/gen={gen}"
        if keys:
            store_index(rows, folder, *keys)
        else:
            rows.write.mode("overwrite").parquet(folder)

    def _commit(self, gen: int, merged: int | None = None) -> None:
        self._write("generations", self.spark.createDataFrame([(merged,)], "merged int"), gen)

    # ---- changes

    def change(self, docs: DataFrame | None = None, deleted: DataFrame | None = None, gen: int | None = None) -> int:
        """Adds documents (doc_id, text), which replace those of the same ids, and deletes others (doc_id); returns the generation.

        gen: the generation to write, for a caller that may have to write it again; the next one if it is not given.
        """
        spark, known = self.spark, self.generations()
        gen = max([0, *[r.gen for r in self._whole("generations").collect()]]) + 1 if gen is None else gen
        none = spark.createDataFrame([], StructType(self.fields["documents"][1:]))
        docs = none if docs is None else docs.select("doc_id", "text")
        # Rows are named when they are stored, by their generation and number.
        self._write("documents", docs.withColumn("row", F.concat_ws("-", F.lit(str(gen)), F.monotonically_increasing_id().cast("string"))), gen)
        stored = self._whole("documents").where(F.col("gen") == gen)
        self._index(stored, gen)
        ids = stored.select("doc_id")
        ids = ids if deleted is None else ids.union(deleted.select("doc_id"))
        earlier = self._whole("documents").where(F.col("gen").isin(*[g for g in known if g < gen] or [0])).select("doc_id")
        self._write("hidden", ids.where("doc_id is not null").distinct().join(earlier, "doc_id", "left_semi"), gen)
        self._commit(gen)
        return gen

    def _index(self, stored: DataFrame, gen: int) -> None:
        arrays = analyze.analyzed(stored.select(F.struct("row", "doc_id").alias("doc_id"), "text"), self.cfg, **self.lexical).select("doc_id.*", "tokens")
        self._write("tokens", arrays.select("row", "doc_id", F.posexplode("tokens").alias("pos", "term")), gen, "term", "row", "pos")
        self._write("biwords", index.biword_pairs(arrays, "row", "doc_id"), gen, "biword", "row")
        terms = self._whole("tokens").where(F.col("gen") == gen).select("term")
        self._write("permuterm", permuterm.permuterm_pairs(terms), gen, "rotation", "term")

    def merge(self) -> int:
        """Writes what is left of all documents as one generation, in place of those before."""
        known = self.generations()
        gen = max([0, *known]) + 1
        self._write("documents", self.documents().withColumn("row", F.concat_ws("-", F.lit(str(gen)), F.monotonically_increasing_id().cast("string"))), gen)
        self._index(self._whole("documents").where(F.col("gen") == gen), gen)
        self._write("hidden", self.spark.createDataFrame([], StructType(self.fields["hidden"])), gen)
        self._commit(gen, max([0, *known]))
        return gen

    def vacuum(self) -> None:
        """Deletes the folders of merged generations, once no query reads them any more."""
        kept = set(self.generations())
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in self.fields:
            for folder in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/gen=*")) or []:
                number = int(folder.getPath().getName().split("=")[1])
                if number not in kept and number < max(kept, default=0):
                    files.delete(folder.getPath(), True)

    # ---- queries

    def documents(self) -> DataFrame:
        """(doc_id, text) of all documents that are left."""
        return self._live(self._table("documents")).select("doc_id", "text")

    def _phrase(self, text: str) -> list[str]:
        return analyze.query_tokens(self._whole("tokens"), text, self.cfg, **self.lexical)

    def phrase(self, text: str, method: str = "positional") -> DataFrame:
        """method: positional, biword, or false_positives."""
        terms = self._phrase(text)
        positional = self._live(phrase.positional_lookup(self._table("tokens"), terms, "row", "doc_id", "gen"))
        if method == "positional":
            return positional.select("doc_id", "positions")
        pairs = self._table("tokens").select(F.col("term").alias("biword"), "row", "doc_id", "gen") if len(terms) == 1 else self._table("biwords")
        found = self._live(phrase.biword_lookup(pairs, terms, "row", "doc_id", "gen"))
        if method == "false_positives":
            found = found.join(positional.select("row"), "row", "left_anti") if len(terms) >= 3 else found.where(F.lit(False))
        return found.select("doc_id")

    def lookup(self, entries: str) -> DataFrame:
        """As of a collection; hidden documents are dropped after the look-up's terms have been found."""
        terms = [r.term for r in dictionary.lookup_terms(self._whole("tokens"), entries, self.cfg, **self.lexical).select("term").distinct().collect()]
        found = self._live(self._table("tokens").where(F.col("term").isin(*terms) if terms else F.lit(False)))
        return dictionary.dictionary_lookup(found.select("term", "doc_id", "pos"), entries, self.cfg, **self.lexical)

    def vocabulary(self) -> DataFrame:
        """Terms of the documents that are left."""
        return self._live(self._table("tokens")).select("term").distinct().orderBy("term")

    def wildcard(self, pattern: str) -> DataFrame:
        """Terms that match: candidates from the rotations of all generations, of which those stay that a document still has."""
        found = permuterm.permuterm_lookup(self._table("permuterm").select("rotation", "term"), pattern).distinct()
        if pattern != pattern.lower():
            found = tolerant.wildcard_candidates(found, pattern)
        held = self._live(self._table("tokens").join(found, "term", "left_semi"))
        return held.select("term").distinct().orderBy("term")
