"""Hillshading and rendering steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.interpolate import unit_normal


def sun(azimuth: float, elevation: float) -> tuple[float, float, float]:
    """Unit vector to the sun; azimuth counter-clockwise from the x axis, in degrees."""
    a, e = math.radians(azimuth), math.radians(elevation)
    return math.cos(a) * math.cos(e), math.sin(a) * math.cos(e), math.sin(e)


def hillshade(zx: Column, zy: Column, azimuth: float = 145, elevation: float = 60, ambient: float = 0.2, steepen: float = 50, y_up: bool = True) -> Column:
    """ambient + (1 - ambient) * max(0, normal . sun); y_up=False where rows run down."""
    nx, ny, nz = unit_normal(zx * steepen, zy * (steepen if y_up else -steepen))
    sx, sy, sz = sun(azimuth, elevation)
    return F.lit(ambient) + F.greatest(F.lit(0.0), nx * sx + ny * sy + nz * sz) * (1 - ambient)


def column_scale(lat: Column, cell: float) -> Column:
    """Width of a cell at a latitude, in the units of its height."""
    return F.cos(F.radians(lat)) * cell


def water(z: Column, rgb: Column, blue: int) -> Column:
    return F.when(z <= 0, F.lit(blue)).otherwise(rgb)


def dilate(cells: DataFrame, blank: int, passes: int = 1, rgb: str = "rgb", checkpoint_every: int = 5) -> DataFrame:
    """Blank cells take the first colour among their eight neighbours, row by row, `passes` times.

    A pass sends each coloured cell to its neighbours and keeps the first for each blank
    one; only cells next to a colour get several rows, eight at most.  A pass uses its cells
    twice, so more than `checkpoint_every` passes need a checkpoint folder.
    """
    if passes > checkpoint_every and not cells.sparkSession.sparkContext.getCheckpointDir():
        raise ValueError("set a checkpoint folder for so many passes")
    around = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
    for i in range(passes):
        offer = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (r, c) in enumerate(around))))
        sent = cells.filter(F.col(rgb) != blank).select("row", "col", rgb, offer.alias("o"))
        sent = sent.select((F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col"), F.struct(F.col("o.k").alias("k"), F.col(rgb).alias("v")).alias("s"))
        first = sent.groupBy("row", "col").agg(F.min("s").alias("s"))
        cells = cells.join(first, ["row", "col"], "left").withColumn(rgb, F.when(F.col(rgb) == blank, F.coalesce("s.v", rgb)).otherwise(F.col(rgb))).drop("s")
        if (i + 1) % checkpoint_every == 0 and i + 1 < passes:
            cells = cells.checkpoint()
    return cells
