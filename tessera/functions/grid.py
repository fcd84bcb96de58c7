"""Addresses, value rules and coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arith import half_up, to180, to360
from tessera.model import Element, Spec

#: Radius of the sphere of equal area, in km, and of the mean sphere, in m.
AREA_RADIUS_KM, SURFACE_RADIUS_M = 6371.0072, 6371007.2


# -- addresses ----------------------------------------------------------------------


def tile_row(spec: Spec, row: Column) -> Column:
    return F.floor(row / spec.tile_rows).cast("int")


def tile_col(spec: Spec, col: Column) -> Column:
    return F.floor(col / spec.tile_cols).cast("int")


def tile_index(spec: Spec, row: Column, col: Column) -> Column:
    return (tile_row(spec, row) * spec.tiles_across + tile_col(spec, col)).cast("int")


#: Cells across a tile row, whole tiles, that are written to one file.
ACROSS = 1 << 22


def span(spec: Spec, tile_col: Column) -> Column:
    """The part of its tile row that a tile belongs to, of ACROSS cells."""
    return F.floor(tile_col / max(1, ACROSS // spec.cells_per_tile)).cast("int")


def with_address(df: DataFrame, spec: Spec) -> DataFrame:
    """df with the tile of each (row, col) and the place in it."""
    row, col = F.col("row"), F.col("col")
    inside = (row % spec.tile_rows).cast("int"), (col % spec.tile_cols).cast("int")
    return df.select(
        "*", tile_row(spec, row).alias("tile_row"), tile_col(spec, col).alias("tile_col"), tile_index(spec, row, col).alias("tile_index"),
        inside[0].alias("row_in_tile"), inside[1].alias("col_in_tile"), (inside[0] * spec.tile_cols + inside[1]).cast("int").alias("index_in_tile"),
    )


def tile_origin(spec: Spec, index: Column) -> tuple[Column, Column]:
    """(tile_row, tile_col) of a tile index."""
    down = F.floor(index / spec.tiles_across).cast("int")
    return down, (index - down * spec.tiles_across).cast("int")


def in_grid(spec: Spec, row: Column, col: Column) -> Column:
    return (row >= 0) & (row < spec.n_rows) & (col >= 0) & (col < spec.n_cols)


def checked(df: DataFrame, spec: Spec) -> DataFrame:
    """df, raising for rows outside the grid."""
    bad = F.raise_error(F.concat(F.lit("outside the grid: "), F.concat_ws(",", "row", "col")))
    return df.withColumn("row", F.when(in_grid(spec, F.col("row"), F.col("col")), F.col("row")).otherwise(bad.cast("int")))


# -- values -------------------------------------------------------------------------


def supported(e: Element, z: Column) -> Column:
    """Whether an element takes a value: in range or the fill, and finite if it is coded."""
    if e.kind == "icf":
        code = icf_encode(e, z)
        return F.isnan(z) | code.between(int(e.low), int(e.high))
    if e.kind == "float":
        return F.isnan(z) | z.between(float(e.low), float(e.high)) if not math.isinf(e.low) or not math.isinf(e.high) else F.lit(True)
    whole = ~F.isnan(z.cast("double")) & (F.abs(z.cast("double")) < float("inf"))
    return whole & (z.between(int(e.low), int(e.high)) | (z == int(e.fill)))


def validated(e: Element, z: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"{e.name} doesn't take "), z.cast("string")))
    return F.when(z.isNull() | supported(e, z), z).otherwise(bad.cast("double"))


def icf_encode(e: Element, z: Column) -> Column:
    """floor((z - offset) * scale + 0.5), the product in 32-bit floats."""
    f = z.cast("float")
    scaled = ((f - F.lit(e.offset).cast("float")).cast("float") * F.lit(e.scale).cast("float")).cast("float")
    return F.when(F.isnan(f), F.lit(int(e.fill))).otherwise(F.floor((scaled + F.lit(0.5).cast("float")).cast("float")).cast("int"))


def icf_decode(e: Element, code: Column) -> Column:
    value = ((code.cast("float") / F.lit(e.scale).cast("float")).cast("float") + F.lit(e.offset).cast("float")).cast("float")
    return F.when(code == int(e.fill), F.lit(None).cast("float")).otherwise(value)


def to_stored(e: Element, z: Column) -> Column:
    """A nullable value as stored: coded, with the fill for null."""
    fill = F.lit(float("nan") if e.kind == "float" else int(e.fill)).cast(e.stored)
    return F.coalesce(icf_encode(e, z) if e.kind == "icf" else z.cast(e.stored), fill)


def from_stored(e: Element, code: Column) -> Column:
    if e.kind == "icf":
        return icf_decode(e, code)
    missing = F.isnan(code) if e.kind == "float" else code == int(e.fill)
    return F.when(~missing, code)


def as_float(e: Element, z: Column) -> Column:
    """A value as a 32-bit float, NaN where it is missing."""
    return F.coalesce(z.cast("float"), F.lit(float("nan")).cast("float"))


# -- coordinates --------------------------------------------------------------------


def _affine(m: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return x * a + y * b + c, x * d + y * e + f


def model_to_grid(spec: Spec, x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col) as fractions."""
    col, row = _affine(spec.model_to_grid, x, y)
    return row, col


def grid_to_model(spec: Spec, row: Column, col: Column) -> tuple[Column, Column]:
    return _affine(spec.grid_to_model, col, row)


def geo_to_grid(spec: Spec, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(row, col); a longitude is tried as it is, then in half turns, then in whole ones."""
    low, high = spec.fringe[2:]
    row = (lat - spec.y0) / spec.cell_y
    delta = lon - spec.x0
    plain, half, whole = delta / spec.cell_x, to180(delta) / spec.cell_x, to360(delta) / spec.cell_x
    return row, F.when(plain.between(low, high), plain).when(half.between(low, high), half).otherwise(whole)


def grid_to_geo(spec: Spec, row: Column, col: Column) -> tuple[Column, Column]:
    """(lat, lon); longitudes run on beyond a half turn."""
    return row * ((spec.y1 - spec.y0) / max(1, spec.n_rows - 1)) + spec.y0, col * ((spec.x1 - spec.x0) / max(1, spec.n_cols - 1)) + spec.x0


def rounded(spec: Spec, row: Column, col: Column) -> tuple[Column, Column]:
    """Whole (row, col); positions a few units of last place beyond an edge count as on it."""
    low_r, high_r, low_c, high_c = spec.fringe

    def snap(x: Column, n: int, low: float, high: float) -> Column:
        whole = half_up(x)
        return F.when((whole == -1) & (x >= low), F.lit(0)).when((whole == n) & (x <= high), F.lit(n - 1)).otherwise(whole).cast("int")

    return snap(row, spec.n_rows, low_r, high_r), snap(col, spec.n_cols, low_c, high_c)


def cell_area_km2(spec: Spec, row: Column) -> Column:
    """Area of a cell: of its latitude band on the sphere, or the product of its sides."""
    if spec.crs != "geographic":
        return F.lit(abs(spec.cell_x * spec.cell_y))
    low = F.radians(F.lit(spec.y0) + (row - 0.5) * spec.cell_y)
    high = F.radians(F.lit(spec.y0) + (row + 0.5) * spec.cell_y)
    return F.abs(F.sin(high) - F.sin(low)) * F.lit(AREA_RADIUS_KM**2 * math.radians(abs(spec.cell_x)))


def albers(lat: Column, lon: Column, lat0: float, lon0: float, lat1: float, lat2: float, semi_major: float = 6378137.0, flattening: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """(x, y) of the ellipsoidal equal-area conic projection (Snyder, equations 14-1 to 14-21)."""
    e2 = 2 * flattening - flattening**2
    e = math.sqrt(e2)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    def q(s, log, lib_abs=abs):
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    q0, q1, q2 = (q(math.sin(p), math.log) for p in (p0, p1, p2))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1) if p1 != p2 else math.sin(p1)
    c = m(p1) ** 2 + n * q1
    rho0 = semi_major * math.sqrt(c - n * q0) / n
    rho = F.sqrt(F.lit(c) - q(F.sin(F.radians(lat)), F.log) * n) * (semi_major / n)
    theta = F.radians(lon - lon0) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)
