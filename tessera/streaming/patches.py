"""Streams of cell patches: ingest into a store, and windowed summaries.

A patch is (ts, row, col, z).  The newest patch of a cell wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.model import Spec


def latest(patches: DataFrame) -> DataFrame:
    """row, col, z of each cell's newest patch, the greatest of equally new ones; for a batch or in update mode."""
    newest = patches.groupBy("row", "col").agg(F.max(F.struct("ts", "z")).alias("p"))
    return newest.select("row", "col", F.col("p.z").alias("z"))


def tile_activity(patches: DataFrame, spec: Spec, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Patches and their mean by tumbling window and tile; patches later than the watermark are dropped."""
    at = patches.withWatermark("ts", late).withColumn("tile_index", grid.tile_index(spec, F.col("row"), F.col("col")))
    g = at.groupBy(F.window("ts", window).alias("w"), "tile_index").agg(F.count("*").alias("patches"), F.avg("z").alias("mean"))
    return g.select(F.col("w.start").alias("start"), "tile_index", "patches", "mean")


def ingest(patches: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append each micro-batch's newest patches to a log of patches, partitioned by batch.

    A batch is written under its number and overwritten if it is tried again, so a
    restart neither loses nor doubles patches.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("row", "col").agg(F.max(F.struct("ts", "z")).alias("p")).select("row", "col", "p.ts", "p.z").write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = patches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def current(log: DataFrame) -> DataFrame:
    """The cells that a log of patches gives."""
    return latest(log)
