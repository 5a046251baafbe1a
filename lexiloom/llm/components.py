"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import delete_shared, write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "components") -> tuple[DataFrame, str]:
    """Roots of all nodes of links (u, v), as a shared table (u, root) without the roots themselves, and its path.

    Every round is a few joins and partial aggregates; their hot keys are plain join sides that adaptive
    execution splits. The table of a round is written to the shared folder, so lost executors cost one round at most.
    """
    spark = links.sparkSession
    edges, path = write_shared(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    state = None
    while True:
        # Stable: every node has one link, and to a node without a smaller one.
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (found[0], found[1]) == state or not found[0]:
            return edges.select("u", F.col("v").alias("root")), path
        state = (found[0], found[1])
        new, new_path = write_shared(_small_star(_large_star(edges)), name)
        delete_shared(spark, path)
        edges, path = new, new_path
