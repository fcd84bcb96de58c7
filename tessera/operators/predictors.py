"""Lossless predictors over tiles, as windows: residuals, and their inverse running sums.

Input: tile_index, r, c (place in the tile) and a 32-bit z, one row for each cell of a
dense tile.  A window's partition is a tile's row or column, so it is bounded by the tile.
Sums are of 64 bits and wrapped to 32 at the end, as residuals wrap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.arith import wrap32

_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def _together(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """f of tiles dealt out by tile_index: one shuffle, which serves windows over rows, columns and whole tiles."""

    @wraps(f)
    def run(tiles: DataFrame) -> DataFrame:
        return f(tiles.repartition("tile_index"))

    return run


def _row() -> WindowSpec:
    return Window.partitionBy("tile_index", "r").orderBy("c")


def _col() -> WindowSpec:
    return Window.partitionBy("tile_index", "c").orderBy("r")


def _long(name: str) -> Column:
    return F.col(name).cast("long")


@_together
def encode_differencing(tiles: DataFrame) -> DataFrame:
    """Less the left neighbour; in column 0 less the cell above; the first cell is the seed."""
    z = _long("z")
    prior = F.when(F.col("c") > 0, F.lag(z).over(_row())).otherwise(F.lag(z).over(_col()))
    return tiles.withColumn("residual", wrap32(z - F.coalesce(prior, F.lit(0))))


def _row_base(tiles: DataFrame) -> DataFrame:
    """tiles with `base`: the first value of each row, summed down column 0."""
    down = F.sum(_long("residual")).over(_col().rowsBetween(*_UP_TO))
    return tiles.withColumn("_down", down).withColumn("base", F.first("_down").over(_row())).drop("_down")


@_together
def decode_differencing(tiles: DataFrame) -> DataFrame:
    along = F.sum(F.when(F.col("c") > 0, _long("residual")).otherwise(0)).over(_row().rowsBetween(*_UP_TO))
    return _row_base(tiles).withColumn("z", wrap32(F.col("base") + along)).drop("base")


@_together
def encode_linear(tiles: DataFrame) -> DataFrame:
    """Less the line through the two left neighbours; columns 0 and 1 are differenced."""
    z = _long("z")
    left, left2, above = F.lag(z).over(_row()), F.lag(z, 2).over(_row()), F.lag(z).over(_col())
    prior = F.when(F.col("c") > 1, 2 * left - left2).when(F.col("c") == 1, left).otherwise(above)
    return tiles.withColumn("residual", wrap32(z - F.coalesce(prior, F.lit(0))))


@_together
def decode_linear(tiles: DataFrame) -> DataFrame:
    steps = F.sum(F.when(F.col("c") > 0, _long("residual")).otherwise(0)).over(_row().rowsBetween(*_UP_TO))
    stepped = _row_base(tiles).withColumn("_step", steps)
    return stepped.withColumn("z", wrap32(F.col("base") + F.sum("_step").over(_row().rowsBetween(*_UP_TO)))).drop("base", "_step")


@_together
def encode_triangle(tiles: DataFrame) -> DataFrame:
    """Less left + above - above left; the first row and column are differenced."""
    z = _long("z")
    rows = tiles.withColumn("_d", z - F.coalesce(F.lag(z).over(_row()), F.lit(0)))
    return rows.withColumn("residual", wrap32(F.col("_d") - F.coalesce(F.lag("_d").over(_col()), F.lit(0)))).drop("_d")


@_together
def decode_triangle(tiles: DataFrame) -> DataFrame:
    along = tiles.withColumn("_s", F.sum(_long("residual")).over(_row().rowsBetween(*_UP_TO)))
    return along.withColumn("z", wrap32(F.sum("_s").over(_col().rowsBetween(*_UP_TO)))).drop("_s")


@_together
def encode_with_nulls(tiles: DataFrame) -> DataFrame:
    """Differencing that starts anew, from the seed, after each null.

    The seed is the mean, rounded half up, of the values that start a run; a null has no residual.
    """
    z = _long("z")
    prior = F.when(F.col("c") > 0, F.lag(z).over(_row())).otherwise(F.lag(z).over(_col()))
    t = tiles.withColumn("_prior", prior)
    starts = F.avg(F.when(F.col("z").isNotNull() & F.col("_prior").isNull(), z)).over(Window.partitionBy("tile_index"))
    t = t.withColumn("seed", F.floor(starts + 0.5).cast("int"))
    return t.withColumn("residual", F.when(F.col("z").isNotNull(), wrap32(z - F.coalesce("_prior", F.col("seed").cast("long"))))).drop("_prior")


@_together
def decode_with_nulls(tiles: DataFrame) -> DataFrame:
    """From residual (null where z was) and seed."""
    res, seed = _long("residual"), _long("seed")
    none = F.col("residual").isNull().cast("int")
    t = tiles.withColumn("_cs", F.sum(none).over(_col().rowsBetween(*_UP_TO))).withColumn("_rs", F.sum(none).over(_row().rowsBetween(*_UP_TO)))
    down = seed + F.sum(res).over(Window.partitionBy("tile_index", "c", "_cs").orderBy("r").rowsBetween(*_UP_TO))
    t = t.withColumn("_down", down).withColumn("_first", F.first("_down").over(_row()))
    run = Window.partitionBy("tile_index", "r", "_rs").orderBy("c")
    along = F.coalesce(F.sum(F.when(F.col("c") > 0, res)).over(run.rowsBetween(*_UP_TO)), F.lit(0))
    start = F.when(F.col("_rs") == 0, F.col("_first")).otherwise(seed)
    return t.withColumn("z", F.when(F.col("residual").isNotNull(), wrap32(start + along))).drop("_cs", "_rs", "_down", "_first")


#: Codes of the predictors in packed tiles; only the last takes nulls.
TYPES = {"none": 0, "differencing": 1, "linear": 2, "triangle": 3, "with_nulls": 4}
ENCODERS = {"differencing": encode_differencing, "linear": encode_linear, "triangle": encode_triangle, "with_nulls": encode_with_nulls}
DECODERS = {"differencing": decode_differencing, "linear": decode_linear, "triangle": decode_triangle, "with_nulls": decode_with_nulls}


#: Offsets (row, column) of the twelve neighbours of the least-squares predictor, nearest first.
NEIGHBOURS = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (-1, 2), (0, -2), (-1, -2), (-2, -2), (-2, -1), (-2, 0), (-2, 1), (-2, 2))
#: Those of the smaller one: what lies above, to the left and between, within two rows and columns; none to the right.
NEIGHBOURS_8 = ((0, -1), (-1, -1), (-1, 0), (0, -2), (-1, -2), (-2, -2), (-2, -1), (-2, 0))


@_together
def neighbour_moments(tiles: DataFrame) -> DataFrame:
    """tile_index, i, j, moment: sums of products of neighbours i and j (0 is the cell itself) over interior cells.

    Thirteen values of a cell stand in one row, so a tile's 91 moments are one aggregation.
    """
    by_row = {}
    t = tiles
    for k, (dr, dc) in enumerate(((0, 0), *NEIGHBOURS)):
        by_row.setdefault(dr, []).append((k, dc))
    for dc in (-2, -1, 1, 2):
        t = t.withColumn(f"_c{dc}", F.lag("z", -dc).over(_row()) if dc < 0 else F.lead("z", dc).over(_row()))
    t = t.withColumn("_c0", F.col("z"))
    for dr, each in by_row.items():
        for k, dc in each:
            t = t.withColumn(f"u{k}", F.lag(f"_c{dc}", -dr).over(_col()) if dr else F.col(f"_c{dc}"))
    inside = F.lit(True)
    for k in range(13):
        inside &= F.col(f"u{k}").isNotNull()
    pairs = [(i, j) for i in range(13) for j in range(i, 13)]
    sums = t.filter(inside).groupBy("tile_index").agg(*(F.sum(F.col(f"u{i}").cast("long") * F.col(f"u{j}").cast("long")).alias(f"m{i}_{j}") for i, j in pairs))
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m{i}_{j}").alias("moment")) for i, j in pairs))
    return sums.select("tile_index", F.explode(each).alias("m")).select("tile_index", "m.*")
