"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long) -> id, root: every linked id with the root of its component.

    A round sends every vertex to its smallest neighbour's smallest neighbour (or itself),
    and keeps the links between the images.  Vertex names should be hashes, so that chains
    shorten by a share in each round.  Nothing is collected; each round is written to the
    shared folder.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        hop = near.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        step = materialize(near.join(hop, F.col("to") == F.col("_id")).select("id", F.least("to", "_to").alias("to")))
        total = step.select("id", F.col("to").alias("root")) if total is None else materialize(_follow(total, "root", step))
        edges = materialize(_follow(_follow(edges, "a", step), "b", step).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0) if total is None else total


def _follow(df: DataFrame, column: str, step: DataFrame) -> DataFrame:
    to = step.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
    return df.join(to, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to").select(df.columns)
