"""Reading, writing and tiling cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.model import Spec


def block(cells: DataFrame, row: int, col: int, n_rows: int, n_cols: int) -> DataFrame:
    """The populated cells of a rectangle.  The bounds reach a Parquet scan as filters."""
    return cells.filter(F.col("row").between(row, row + n_rows - 1) & F.col("col").between(col, col + n_cols - 1))


def dense_block(spark: SparkSession, cells: DataFrame, row: int, col: int, n_rows: int, n_cols: int, fill: Mapping[str, Column | float]) -> DataFrame:
    """Every cell of a rectangle, missing values replaced by fill[element].

    The rectangle is generated, so only it is dense, however large the raster.
    """
    n = F.col("id")
    every = spark.range(n_rows * n_cols).select((F.floor(n / n_cols) + row).cast("int").alias("row"), (n % n_cols + col).cast("int").alias("col"))
    joined = every.join(block(cells, row, col, n_rows, n_cols), ["row", "col"], "left")
    return joined.select("row", "col", *(F.coalesce(e, F.lit(v) if not isinstance(v, Column) else v).alias(e) for e, v in fill.items()))


def densify(spark: SparkSession, cells: DataFrame, spec: Spec, tiles_only: bool = True) -> DataFrame:
    """Every cell of the populated tiles (or of all), padding beyond the grid included, values null where missing."""
    if tiles_only:
        tiles = cells.select(grid.tile_row(spec, F.col("row")).alias("tile_row"), grid.tile_col(spec, F.col("col")).alias("tile_col")).distinct()
    else:
        i = F.col("id")
        tiles = spark.range(spec.tiles_down * spec.tiles_across).select(*(c.alias(n) for c, n in zip(grid.tile_origin(spec, i), ("tile_row", "tile_col"), strict=True)))
    place = F.explode(F.sequence(F.lit(0), F.lit(spec.cells_per_tile - 1))).alias("index_in_tile")
    every = tiles.select("tile_row", "tile_col", place).select(
        (F.col("tile_row") * spec.tile_rows + F.floor(F.col("index_in_tile") / spec.tile_cols)).cast("int").alias("row"),
        (F.col("tile_col") * spec.tile_cols + F.col("index_in_tile") % spec.tile_cols).cast("int").alias("col"),
        (F.col("tile_row") * spec.tiles_across + F.col("tile_col")).cast("int").alias("tile_index"), "index_in_tile",
    )
    return every.join(cells, ["row", "col"], "left")


def at_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (row, col, ...) with the values of their cells, null where missing."""
    return points.join(cells, ["row", "col"], "left")


def upsert(cells: DataFrame, patch: DataFrame) -> DataFrame:
    """cells with the patch's values; an element that the patch lacks, or has null, stays.

    Of a cell's values in several rows of the patch the greatest counts.
    """
    names = [c for c in cells.columns if c not in ("row", "col")]
    p = patch.groupBy("row", "col").agg(*(F.max(c).alias(f"_{c}") for c in names if c in patch.columns))
    joined = cells.join(p, ["row", "col"], "full_outer")
    return joined.select("row", "col", *((F.coalesce(f"_{c}", c) if c in patch.columns else F.col(c)).alias(c) for c in names))


def erase(cells: DataFrame, where: DataFrame) -> DataFrame:
    """cells without those of `where` (row, col): writing the fill value."""
    return cells.join(where.select("row", "col"), ["row", "col"], "left_anti")


def one_per_tile(cells: DataFrame, spec: Spec, place: int = 0) -> DataFrame:
    return cells.filter((F.col("row") % spec.tile_rows == place) & (F.col("col") % spec.tile_cols == place))


#: Cells of dense tiles put together at once.
DENSE = 1 << 19


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, a tile's number down and across, in tables that no tile spans."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        down, across = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.flatnonzero((np.diff(down) != 0) | (np.diff(across) != 0)) + 1
        if held and key != (down[0], across[0]):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, b.slice(0, new[-1])])
            held = []
            b = b.slice(new[-1])
        held.append(b)
        key = down[-1], across[-1]
    if held:
        yield pa.Table.from_batches(held)


def _dense(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(down, across, values of n cells each, null where missing) of the tiles of sorted cells (down, across, place, z)."""
    for table in _whole(batches):
        down, across, place = (table.column(k).to_numpy() for k in range(3))
        z = table.column(3).combine_chunks()
        starts = np.flatnonzero(np.r_[True, (np.diff(down) != 0) | (np.diff(across) != 0)])
        ends = np.r_[starts[1:], len(down)]
        for first in range(0, len(starts), step := max(1, DENSE // n)):
            own, until = starts[first : first + step], ends[first : first + step]
            source = np.full(len(own) * n, -1, np.int64)
            source[np.repeat(np.arange(len(own)) * n, until - own) + place[own[0] : until[-1]]] = np.arange(own[0], until[-1])
            yield down[own], across[own], z.take(pa.array(source, mask=source < 0))


def by_tile(cells: DataFrame, spec: Spec, element: str, by_row: bool = False) -> DataFrame:
    """tile_row, tile_col, place, z: the cells of an element dealt out and sorted by tile.

    by_row: a task has all tiles of a tile row, or of grid.ACROSS cells of it, not just single tiles.
    """
    row, col = F.col("row"), F.col("col")
    place = (row % spec.tile_rows).cast("int") * spec.tile_cols + (col % spec.tile_cols).cast("int")
    at = cells.filter(F.col(element).isNotNull()).select(grid.tile_row(spec, row).alias("tile_row"), grid.tile_col(spec, col).alias("tile_col"), place.alias("place"), F.col(element).alias("z"))
    return at.repartition("tile_row", grid.span(spec, F.col("tile_col")) if by_row else "tile_col").sortWithinPartitions("tile_row", "tile_col")


def tile_batches(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From cells as of by_tile: tile_index, tile_row, tile_col, values, in batches of DENSE cells or a tile."""
    n, across, limit = spec.cells_per_tile, spec.tiles_across, (1 << 31) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, flat in _dense(batches, n):
            index = i.astype(np.int64) * across + j
            if index.max() > limit:
                raise OverflowError(f"tile {index.max()} is beyond 32 bits")
            offsets = pa.array(np.arange(len(i) + 1, dtype=np.int32) * n)
            yield pa.record_batch([pa.array(index.astype(np.int32)), pa.array(i), pa.array(j), pa.ListArray.from_arrays(offsets, flat)], names=["tile_index", "tile_row", "tile_col", "values"])

    return run


def tile_form(cells: DataFrame, spec: Spec, element: str) -> DataFrame:
    """tile_index, tile_row, tile_col, element, values: a row for each populated tile, row-major, null where missing.

    Of a cell's values in several rows any one is taken.
    """
    kind = cells.schema[element].dataType
    tiles = by_tile(cells, spec, element).mapInArrow(tile_batches(spec), f"tile_index int, tile_row int, tile_col int, values array<{kind.simpleString()}>")
    return tiles.select("tile_index", "tile_row", "tile_col", F.lit(element).alias("element"), "values")


def tile_totals(cells: DataFrame, spec: Spec, element: str) -> DataFrame:
    """n, total of each populated tile, put together densely as in tile_form; NaN counts as a value."""
    n = spec.cells_per_tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, _, flat in _dense(batches, n):
            here = pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(len(i), n)
            z = pc.fill_null(pc.cast(flat, pa.float64(), safe=False), 0.0).to_numpy().reshape(len(i), n)
            yield pa.record_batch([pa.array(here.sum(1, dtype=np.int64)), pa.array(z.sum(1))], names=["n", "total"])

    return by_tile(cells, spec, element).mapInArrow(run, "n long, total double")


def cell_form(tiles: DataFrame, spec: Spec, element: str) -> DataFrame:
    """The cells of tiles, padding and missing ones left out."""
    each = tiles.select("tile_row", "tile_col", F.posexplode("values").alias("i", element)).filter(F.col(element).isNotNull())
    cells = each.select(
        (F.col("tile_row") * spec.tile_rows + F.floor(F.col("i") / spec.tile_cols)).cast("int").alias("row"),
        (F.col("tile_col") * spec.tile_cols + F.col("i") % spec.tile_cols).cast("int").alias("col"), element,
    )
    return cells.filter((F.col("row") < spec.n_rows) & (F.col("col") < spec.n_cols))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in which two rasters differ, null being a value of its own."""
    names = [c for c in a.columns if c not in ("row", "col")]
    joined = a.withColumn("_a", F.lit(1)).join(b.select("row", "col", *(F.col(c).alias(f"_{c}") for c in names), F.lit(1).alias("_b")), ["row", "col"], "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.filter(~same).drop("_a", "_b")
