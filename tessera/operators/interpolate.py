"""Cubic B-spline and bilinear interpolation as joins.

The raster is regrouped into row strips of `STRIP` columns that overlap by three, so a
4 x 4 neighbourhood is four strips, one in each row: points are replicated four times and
joined on (row, strip), a hash join on both sides, with the sixteen samples looked up in
the strips.  A strip holds at most STRIP + 3 samples.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.model import Spec

STRIP = 64


class Interpolator(Protocol):
    """What adds values z to query points (point_id, grid_row, grid_col) on a raster."""

    def __call__(self, points: DataFrame, cells: DataFrame, spec: Spec) -> DataFrame: ...


def sample(points: DataFrame, cells: DataFrame, spec: Spec, interpolator: Interpolator | None = None) -> DataFrame:
    """points (point_id, x, y; geographic: longitude, latitude) with z by any interpolator, a spline by default."""
    return (interpolator or spline)(at_model(points, spec), cells, spec)


# Six times the coefficients of the four weights of a uniform cubic B-spline, by power of u.
BASIS = ((1, -3, 3, -1), (4, 0, -6, 3), (1, 3, 3, -3), (0, 0, 0, 1))


def weights(u: Column, order: int = 0, h: Column | None = None) -> list[Column]:
    """The weights, or their derivatives for samples h apart; also used, unchanged, beyond [0, 1] at clamped edges."""
    out = []
    for c in BASIS:
        for _ in range(order):
            c = [k * x for k, x in enumerate(c)][1:]
        total = F.lit(float(c[-1]))
        for x in reversed(c[:-1]):
            total = total * u + float(x)
        total = total / 6.0
        for _ in range(order):
            total = total / h
        out.append(total)
    return out


def neighbourhood(points: DataFrame, spec: Spec, size: int = 4) -> DataFrame:
    """points (grid_row, grid_col) with row0, col0, u, v and whether they are within the fringe."""
    if size == 4 and (spec.n_rows < 4 or spec.n_cols < 4):
        raise ValueError("a spline needs four rows and columns")
    low_r, high_r, low_c, high_c = spec.fringe
    back = 1 if size == 4 else 0
    r, c = F.col("grid_row"), F.col("grid_col")
    inside = r.between(low_r, high_r) & ((F.lit(True) if spec.wraps else c.between(low_c, high_c)))
    row = F.least(F.greatest(r, F.lit(0.0)), F.lit(float(spec.n_rows - 1)))
    col = c if spec.wraps else F.least(F.greatest(c, F.lit(0.0)), F.lit(float(spec.n_cols - 1)))

    def start(x: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor(x) - back, F.lit(0)), F.lit(n - size)).cast("int")

    row0 = start(row, spec.n_rows)
    col0 = F.pmod(F.floor(col) - back, F.lit(spec.n_cols)).cast("int") if spec.wraps else start(col, spec.n_cols)
    u = col - F.floor(col) if spec.wraps else col - F.col("col0") - back
    return points.withColumns({"inside": inside & ~F.isnan(r) & ~F.isnan(c), "row0": row0, "col0": col0}).withColumns({"u": u, "v": row - F.col("row0") - back})


def strips(cells: DataFrame, spec: Spec, element: str, size: int = 4, wanted: DataFrame | None = None) -> DataFrame:
    """row, strip, zs: column -> sample, with the next strip's first columns (the first ones' at a seam).

    wanted: the only (row, strip) that are needed; other cells go no further than a semi-join.
    """
    c = F.col("col")
    own = F.struct(F.floor(c / STRIP).cast("int").alias("strip"), c.alias("at"))
    before = F.struct((F.floor(c / STRIP) - 1).cast("int").alias("strip"), c.alias("at"))
    last = (spec.n_cols - 1) // STRIP
    seam = [F.struct(F.lit(s).alias("strip"), (c + spec.n_cols).cast("int").alias("at")) for s in sorted({last, max(0, (spec.n_cols - size + 1) // STRIP)})]
    places = F.when((c % STRIP < size - 1) & (c >= STRIP), F.array(own, before)).otherwise(F.array(own))
    if spec.wraps:
        places = F.concat(places, F.when(c < size - 1, F.array(*seam)).otherwise(F.array().cast("array<struct<strip:int,at:int>>")))
    z = cells.filter(F.col(element).isNotNull()).select("row", F.explode(places).alias("p"), F.col(element).cast("double").alias("z")).select("row", "p.strip", "p.at", "z")
    if wanted is not None:
        z = z.join(wanted, ["row", "strip"], "left_semi")
    return z.groupBy("row", "strip").agg(F.map_from_entries(F.collect_list(F.struct("at", "z"))).alias("zs"))


def _samples(points: DataFrame, cells: DataFrame, spec: Spec, element: str, size: int) -> DataFrame:
    """points with s: an array of `size` rows of `size` samples, null if any is missing."""
    near = points.filter("inside").select("point_id", "col0", F.floor(F.col("col0") / STRIP).cast("int").alias("strip"), F.posexplode(F.sequence(F.col("row0"), F.col("row0") + size - 1)).alias("j", "row"))
    joined = near.join(strips(cells, spec, element, size, near.select("row", "strip").distinct()), ["row", "strip"])
    four = F.array(*(F.try_element_at("zs", F.col("col0") + i) for i in range(size)))
    rows = joined.select("point_id", "j", four.alias("z")).filter(F.forall("z", lambda e: e.isNotNull() & ~F.isnan(e)))
    s = rows.groupBy("point_id").agg(F.collect_list(F.struct("j", "z")).alias("s")).filter(F.size("s") == size)
    return points.join(s.select("point_id", F.transform(F.array_sort("s"), lambda r: r["z"]).alias("s")), "point_id", "left")


def _weighted(down: list[Column], across: list[Column]) -> Column:
    total = None
    for j, a in enumerate(down):
        for i, b in enumerate(across):
            term = F.get(F.get("s", j), i) * (a * b)
            total = term if total is None else total + term
    return total


def spline(points: DataFrame, cells: DataFrame, spec: Spec, element: str = "z", hx: Column | float = 1.0, hy: Column | float = 1.0, order: int = 0) -> DataFrame:
    """points (point_id, grid_row, grid_col) with z; from order 1 zx, zy; from 2 zxx, zxy, zyy.

    A point beyond the fringe, or with a missing sample among its sixteen, gets nulls.
    hx, hy: spacing of columns and rows; zero is an error.
    """
    if any(not isinstance(h, Column) and h == 0 for h in (hx, hy)):
        raise ValueError("a spacing of zero")
    hx, hy = (F.lit(float(h)) if not isinstance(h, Column) else h for h in (hx, hy))
    s = _samples(neighbourhood(points, spec), cells, spec, element, 4)
    u, v = F.col("u"), F.col("v")
    out = {"z": _weighted(weights(v), weights(u))}
    if order >= 1:
        out |= {"zx": _weighted(weights(v), weights(u, 1, hx)), "zy": _weighted(weights(v, 1, hy), weights(u))}
    if order >= 2:
        out |= {"zxx": _weighted(weights(v), weights(u, 2, hx)), "zxy": _weighted(weights(v, 1, hy), weights(u, 1, hx)), "zyy": _weighted(weights(v, 2, hy), weights(u))}
    return s.withColumns(out).drop("s", "u", "v", "row0", "col0", "inside")


def bilinear(points: DataFrame, cells: DataFrame, spec: Spec, element: str = "z") -> DataFrame:
    s = _samples(neighbourhood(points, spec, 2), cells, spec, element, 2)
    u, v = F.col("u"), F.col("v")
    return s.withColumn("z", _weighted([1 - v, v], [1 - u, u])).drop("s", "u", "v", "row0", "col0", "inside")


def at_model(points: DataFrame, spec: Spec) -> DataFrame:
    """points (x, y; geographic: longitude, latitude) with grid_row, grid_col."""
    x, y = F.col("x"), F.col("y")
    row, col = grid.geo_to_grid(spec, y, x) if spec.crs == "geographic" else grid.model_to_grid(spec, x, y)
    return points.withColumns({"grid_row": row, "grid_col": col})


def spacing(spec: Spec, lat: Column) -> tuple[Column, Column]:
    """Metres between columns and rows; a column's is one metre at least towards the poles."""
    if spec.crs != "geographic":
        return F.lit(float(abs(spec.cell_x))), F.lit(float(abs(spec.cell_y)))
    from math import radians

    du, dv = grid.SURFACE_RADIUS_M * radians(abs(spec.cell_x)), grid.SURFACE_RADIUS_M * radians(abs(spec.cell_y))
    return F.greatest(F.lit(1.0), F.cos(F.radians(lat)) * du), F.lit(dv)


def unit_normal(zx: Column, zy: Column) -> tuple[Column, Column, Column]:
    """(-zx, -zy, 1) over its length."""
    s = F.sqrt(zx * zx + zy * zy + 1)
    return -zx / s, -zy / s, 1 / s


def normals(points: DataFrame, cells: DataFrame, spec: Spec, element: str = "z") -> DataFrame:
    """points (point_id, x, y) with the surface's unit normal nx, ny, nz."""
    hx, hy = spacing(spec, F.col("y"))
    s = spline(at_model(points, spec), cells, spec, element, hx, hy, 1)
    nx, ny, nz = unit_normal(F.col("zx"), F.col("zy"))
    return s.withColumns({"nx": nx, "ny": ny, "nz": nz})


def bilinear_rgb(points: DataFrame, cells: DataFrame, spec: Spec, rgb: str = "rgb") -> DataFrame:
    """points with packed rgb: each channel bilinear, rounded half up; what is within a billionth of a half is one."""
    s = _samples(neighbourhood(points, spec, 2), cells, spec, rgb, 2)
    u, v = F.col("u"), F.col("v")

    def channel(shift: int) -> Column:
        total = None
        for j, a in enumerate((1 - v, v)):
            for i, b in enumerate((1 - u, u)):
                c = F.shiftright(F.get(F.get("s", j), i).cast("int"), shift).bitwiseAND(255)
                total = c * a * b if total is None else total + c * a * b
        return F.floor(total + (0.5 + 1e-9))

    return s.withColumn(rgb, (channel(16) * 65536 + channel(8) * 256 + channel(0)).cast("int")).drop("s", "u", "v", "row0", "col0", "inside")


def off_grid(coordinates: DataFrame, spec: Spec, tolerance: float = 1e-6) -> DataFrame:
    """Rows (row, col, x, y) whose coordinates are not those that the specification gives their cell."""
    x, y = grid.grid_to_model(spec, F.col("row"), F.col("col"))
    return coordinates.filter((F.abs(F.col("x") - x) > tolerance) | (F.abs(F.col("y") - y) > tolerance))
