"""Further registered queries: storage, coordinates, palettes, coders and metadata, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.model import Element, Raster, Spec
from tessera.operators import bits, cells, codecs, interpolate, metadata, palette, stats, terrain
from tessera.plans.catalog import _C, _GEN_POINTS, _R, _TILED_SQL, _TILES, _argb_sql, _PALETTE, _ids, _spline_sql, _w, _w1, query
from tessera.plans.rasters import EMBED_INT_SQL, EVENTS_SQL, GEN_SQL, ITEMS_SQL, embed_int, events, generated, items, micro, micro_sql, points, spec_of, table
from tessera.sources import formats, store

# -- stores -------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str, registry: codecs.Registry | None = None, compressed: bool = False) -> str:
    """The path of a new store of the items raster."""
    i = items(spark, sf_dir)
    path = store.scratch(spark)
    store.create(path, Raster(replace(spec_of(i, 50, 20, (Element("z"),)), compressed=compressed), i), registry=registry)
    return path


@query(f"WITH {ITEMS_SQL} SELECT row, col, z FROM i")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_(spark, _stored(spark, sf_dir)).select("z")


@query(f"WITH {ITEMS_SQL} SELECT row, col, z FROM i WHERE row BETWEEN 60 AND 139")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_rows(spark, _stored(spark, sf_dir), 60, 139).select("row", "col", "z")


def _turned() -> codecs.Registry:
    """The same codecs in another order."""
    return codecs.Registry(**dict(reversed(codecs.default_registry(True).codecs.items())))


@query(f"WITH {ITEMS_SQL} SELECT row, col, z FROM i")
def store_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_(spark, _stored(spark, sf_dir, codecs.default_registry(True), True), _turned()).select("z")


@query(f"WITH {ITEMS_SQL} SELECT row, col, z FROM i WHERE row BETWEEN 60 AND 139")
def store_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_rows(spark, _stored(spark, sf_dir, None, True), 60, 139).select("row", "col", "z")


@query(f"WITH {ITEMS_SQL}, d AS (SELECT {_TILES} FROM i) SELECT {micro_sql('(1 + 4 * tr * tc) * 8.0 / (tr * tc)')} AS bit_rate FROM d")
def store_bit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any codec, so that the packings' size is known."""
    path = _stored(spark, sf_dir, codecs.Registry(), True)
    return store.bit_rate(spark.read.parquet(f"{path}/tiles"), store.read_spec(spark, path)).select(micro(F.col("bit_rate")).alias("bit_rate"))


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT {_TILES} FROM i)
SELECT DISTINCT CAST(row // tr * across + col // tc AS INTEGER) AS tile_index, CAST(row // tr AS INTEGER) AS folder FROM i, d""")
def store_tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = store.open_(spark, _stored(spark, sf_dir))
    found = store.files(raster.cells, raster.spec)
    return found.select("tile_index", F.regexp_extract("file", "tile_row=([0-9]+)/", 1).cast("int").alias("folder")).distinct()


@query("SELECT 36 AS uuid_length, true AS has_times, ['z'] AS elements, 0 AS codecs")
def store_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored(spark, sf_dir)
    who, spec = store.identity(spark, path), store.read_spec(spark, path)
    row = (len(str(uuid.UUID(who["uuid"]))), who["created"] <= who["modified"], [e.name for e in spec.elements], len(store.codecs_of(spark, path)))
    return spark.createDataFrame([row], "uuid_length int, has_times boolean, elements array<string>, codecs int")


_LINES_SQL = "SELECT CAST(l_partkey AS INTEGER) AS row, CAST(l_suppkey AS INTEGER) AS col, CAST(max(l_quantity) AS INTEGER) AS qty, CAST(max(l_extendedprice) AS FLOAT) AS price FROM lineitem GROUP BY 1, 2"


def _lines(spark: SparkSession, sf_dir: str) -> Raster:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("row"), F.col("l_suppkey").cast("int").alias("col"))
    both = g.agg(F.max("l_quantity").cast("int").alias("qty"), F.max("l_extendedprice").cast("float").alias("price"))
    return Raster(spec_of(both, 50, 20, (Element("qty"), Element("price", "float", label="Price", description="highest price", unit="$"))), both)


@query(f"WITH l AS ({_LINES_SQL}) SELECT row, col, floor(price::DOUBLE * 100 + 0.5)::BIGINT AS cents, qty FROM l")
def element_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = _lines(spark, sf_dir)
    one, every = raster.select(raster.spec.elements[1].name), raster.select()
    cents = F.floor(F.col("price").cast("double") * 100 + 0.5)
    return one.select("row", "col", cents.alias("cents")).join(every.select("row", "col", "qty"), ["row", "col"])


@query(f"WITH l AS ({_LINES_SQL}) SELECT row, col, qty, floor(price::DOUBLE * 100 + 0.5)::BIGINT AS cents FROM l")
def store_two_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers and floats packed by tile; a tile's elements meet again by cell."""
    raster = _lines(spark, sf_dir)
    path = store.scratch(spark)
    store.create(path, Raster(replace(raster.spec, compressed=True), raster.cells))
    return store.open_(spark, path).cells.select("row", "col", "qty", F.floor(F.col("price").cast("double") * 100 + 0.5).alias("cents"))


@query("SELECT 'price' AS name, 'float' AS kind, 'Price' AS label, 'highest price' AS description, '$' AS unit, true AS continuous UNION ALL SELECT 'qty', 'int', '', '', '', true")
def element_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e.name, *(e.field().metadata[k] for k in ("kind", "label", "description", "unit", "continuous"))) for e in _lines(spark, sf_dir).spec.elements]
    return spark.createDataFrame(rows, "name string, kind string, label string, description string, unit string, continuous boolean")


# -- addresses and coordinates ------------------------------------------------------------


@query("""SELECT c_custkey AS point_id, CAST(c_custkey % 15 - 4 AS INTEGER) AS row, CAST(c_custkey % 9 - 2 AS INTEGER) AS col,
  c_custkey % 15 - 4 BETWEEN 0 AND 6 AND c_custkey % 9 - 2 BETWEEN 0 AND 4 AS inside FROM customer""")
def bounds_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    at = _ids(spark, sf_dir).select("point_id", (k % 15 - 4).cast("int").alias("row"), (k % 9 - 2).cast("int").alias("col"))
    return at.select("*", grid.in_grid(Spec(7, 5), F.col("row"), F.col("col")).alias("inside"))


@query("SELECT CAST(t AS INTEGER) AS tile_index, CAST(t // 7 AS INTEGER) AS tile_row, CAST(t % 7 AS INTEGER) AS tile_col FROM range(0, 42) r(t)")
def tile_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec(55, 65, 10, 10)
    down, across = grid.tile_origin(spec, F.col("id"))
    return spark.range(spec.tiles_down * spec.tiles_across).select(F.col("id").cast("int").alias("tile_index"), down.alias("tile_row"), across.alias("tile_col"))


_SIZES = ((7, 13, 0, 0), (300, 50, 0, 0), (1000, 999, 30, 40), (120, 121, 120, 120), (1, 1, 0, 0))


@query(f"""WITH s(n_rows, n_cols, a, b) AS (VALUES {', '.join(map(str, _SIZES))}), t AS (SELECT *, CASE a WHEN 0 THEN least(120, n_rows) ELSE a END AS tr, CASE b WHEN 0 THEN least(120, n_cols) ELSE b END AS tc FROM s)
SELECT n_rows, n_cols, CAST(ceil(n_rows / tr::DOUBLE) AS INTEGER) AS tiles_down, CAST(ceil(n_cols / tc::DOUBLE) AS INTEGER) AS tiles_across, tr * tc AS cells_per_tile FROM t""")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s.n_rows, s.n_cols, s.tiles_down, s.tiles_across, s.cells_per_tile) for s in (Spec(*z) for z in _SIZES)]
    return spark.createDataFrame(rows, "n_rows int, n_cols int, tiles_down int, tiles_across int, cells_per_tile int")


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT c_custkey AS point_id, 100 + (c_custkey * 17 % 10) * 2 + 0.3 AS x, 50 + (c_custkey * 31 % 200) * 0.5 + 0.1 AS y FROM customer),
q AS (SELECT point_id, CAST(floor((y - 50) / 0.5 + 0.5) AS INTEGER) AS row, CAST(floor((x - 100) / 2 + 0.5) AS INTEGER) AS col FROM p)
SELECT point_id, row, col, z FROM q LEFT JOIN i USING (row, col)""")
def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model coordinates to the nearest cell, and its value."""
    i = items(spark, sf_dir)
    spec = spec_of(i).cartesian_cells(100, 50, 2, 0.5)
    k = F.col("point_id")
    row, col = grid.model_to_grid(spec, (k * 17 % 10) * 2 + 100.3, (k * 31 % 200) * 0.5 + 50.1)
    row, col = grid.rounded(spec, row, col)
    return cells.at_points(_ids(spark, sf_dir).select("point_id", row.alias("row"), col.alias("col")), i).select("point_id", "row", "col", "z")


_EDGES = (-0.5 - 5e-15, -0.5 - 1e-13, -0.5, 12.5, 12.5 + 5e-15, 12.5 + 1e-13, 6.5, 0.49)


@query(f"""WITH p AS (SELECT c_custkey AS point_id, ({list(_EDGES)!r}::DOUBLE[])[c_custkey % 8 + 1] AS x FROM customer), w AS (SELECT point_id, x, floor(x + 0.5) AS w FROM p)
SELECT point_id, CAST(CASE WHEN w = -1 AND x >= -0.5 - 7.2e-15 THEN 0 WHEN w = 13 AND x <= 12.5 + 7.2e-15 THEN 12 ELSE w END AS INTEGER) AS col FROM w""")
def fringe_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.get(F.array(*map(F.lit, _EDGES)), (F.col("point_id") % 8).cast("int"))
    return _ids(spark, sf_dir).select("point_id", grid.rounded(Spec(7, 13), F.lit(0.0), x)[1].alias("col"))


@query(f"""SELECT c_custkey AS point_id, {micro_sql('c_custkey % 1300 / CAST(100 AS DOUBLE) * (23 / CAST(12 AS DOUBLE)) - 3')} AS x, {micro_sql('c_custkey % 700 / CAST(100 AS DOUBLE) * (23 / CAST(6 AS DOUBLE)) - 3')} AS y FROM customer""")
def corners_to_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    x, y = grid.grid_to_model(Spec(7, 13).cartesian(-3, -3, 20, 20), k % 700 / 100.0, k % 1300 / 100.0)
    return _ids(spark, sf_dir).select("point_id", micro(x).alias("x"), micro(y).alias("y"))


@query(f"""SELECT c_custkey AS point_id, {micro_sql('(c_custkey % 100 - 10) / CAST(0.5 AS DOUBLE)')} AS col, {micro_sql('(c_custkey % 70 - 20) / CAST(4 AS DOUBLE)')} AS row FROM customer""")
def cells_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    row, col = grid.model_to_grid(Spec(7, 13).cartesian_cells(10, 20, 0.5, 4), (k % 100).cast("double"), (k % 70).cast("double"))
    return _ids(spark, sf_dir).select("point_id", micro(col).alias("col"), micro(row).alias("row"))


@query(f"""WITH p AS (SELECT c_custkey AS point_id, c_custkey % 40 AS row, c_custkey % 50 AS col FROM customer)
SELECT point_id, {micro_sql('2 * col + 0.5 * row + 10')} AS x, {micro_sql('-0.25 * col + 3 * row + 20')} AS y, {micro_sql('row')} AS row, {micro_sql('col')} AS col FROM p""")
def affine_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec(40, 50).affine(2, 0.5, 10, -0.25, 3, 20)
    k = F.col("point_id")
    x, y = grid.grid_to_model(spec, (k % 40).cast("double"), (k % 50).cast("double"))
    at = _ids(spark, sf_dir).select("point_id", x.alias("x"), y.alias("y"))
    row, col = grid.model_to_grid(spec, F.col("x"), F.col("y"))
    return at.select("point_id", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"), micro(row).alias("row"), micro(col).alias("col"))


@query(f"""WITH p AS (SELECT c_custkey AS point_id, c_custkey % 70 AS x, c_custkey % 90 AS y FROM customer)
SELECT point_id, {micro_sql('0.5 * x + 0.25 * y - 4')} AS col, {micro_sql('-0.125 * x + 2 * y + 1')} AS row FROM p""")
def affine_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    row, col = grid.model_to_grid(Spec(40, 50).affine(0.5, 0.25, -4, -0.125, 2, 1, from_grid=False), (k % 70).cast("double"), (k % 90).cast("double"))
    return _ids(spark, sf_dir).select("point_id", micro(col).alias("col"), micro(row).alias("row"))


@query(f"""WITH p AS (SELECT c_custkey AS point_id, c_custkey % 500 AS x, c_custkey % 300 AS y FROM customer)
SELECT point_id, {micro_sql('(x - (100 - 2 * 10)) / CAST(10 AS DOUBLE)')} AS col, {micro_sql('(y - (200 + 3 * 5)) / CAST(-5 AS DOUBLE)')} AS row FROM p""")
def tie_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    row, col = grid.model_to_grid(Spec(60, 50).from_tie_point((2, 3, 100, 200), (10, 5)), (k % 500).cast("double"), (k % 300).cast("double"))
    return _ids(spark, sf_dir).select("point_id", micro(col).alias("col"), micro(row).alias("row"))


#: n_rows, n_cols, first and last latitude and longitude of cell centres.
_CORNERS = ((7, 13, -3, 179, 3, -179), (5, 13, -60, 0, 60, 0), (6, 12, -75, -165, 75, 165), (9, 36, -80, 5, 80, -5), (2, 2, 10, 170, 11, -100))
_CORNERS_SQL = f"""s(n_rows, n_cols, lat0, lon0, lat1, lon1) AS (VALUES {', '.join(map(str, _CORNERS))}),
t AS (SELECT *, (lon1 - lon0) - 360 * trunc((lon1 - lon0) / 360.0) AS d FROM s), u AS (SELECT *, CASE WHEN d <= 0 THEN d + 360 ELSE d END AS delta FROM t),
v AS (SELECT *, delta / CAST(n_cols - 1 AS DOUBLE) AS cell_x, (lat1 - lat0) / CAST(n_rows - 1 AS DOUBLE) AS cell_y FROM u)"""


@query(f"WITH {_CORNERS_SQL} SELECT n_rows, n_cols, {micro_sql('cell_x')} AS cell_x, {micro_sql('cell_y')} AS cell_y FROM v")
def geographic_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, m, s.cell_x, s.cell_y) for n, m, *c in _CORNERS for s in (Spec(n, m).geographic(*c),)]
    return spark.createDataFrame(rows, "n_rows int, n_cols int, cell_x double, cell_y double").withColumns({c: micro(F.col(c)) for c in ("cell_x", "cell_y")})


@query(f"""WITH {_CORNERS_SQL} SELECT n_rows, n_cols, {micro_sql('lon0 - cell_x / 2')} AS west, {micro_sql('lon0 + delta + cell_x / 2')} AS east, {micro_sql('lat0 - cell_y / 2')} AS south, {micro_sql('lat1 + cell_y / 2')} AS north FROM v""")
def raster_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, m, *Spec(n, m).geographic(*c).bounds) for n, m, *c in _CORNERS]
    df = spark.createDataFrame(rows, "n_rows int, n_cols int, west double, south double, east double, north double")
    return df.withColumns({c: micro(F.col(c)) for c in ("west", "south", "east", "north")})


@query(f"""WITH {_CORNERS_SQL} SELECT n_rows, n_cols, abs(delta + cell_x - 360) < 1e-6 AS wraps, abs(delta - 360) < 1e-9 AS brackets FROM v""")
def longitude_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, m, s.wraps, s.brackets) for n, m, *c in _CORNERS for s in (Spec(n, m).geographic(*c),)]
    return spark.createDataFrame(rows, "n_rows int, n_cols int, wraps boolean, brackets boolean")


def _valid(make) -> bool:
    try:
        make()
    except ValueError:
        return False
    return True


@query("SELECT CAST(lat AS INTEGER) AS lat, abs(lat) <= 90 AS corners, abs(lat + 2) <= 90 AND abs(lat) <= 90 AS cells FROM range(-92, 93) r(lat)")
def latitude_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(lat, _valid(lambda lat=lat: Spec(3, 3).geographic(lat, 0, 0, 10)), _valid(lambda lat=lat: Spec(3, 3).geographic_cells(lat, 0, 1, 1))) for lat in range(-92, 93)]
    return spark.createDataFrame(rows, "lat int, corners boolean, cells boolean")


@query("SELECT CAST(r AS INTEGER) AS row, CAST(1500000 AS BIGINT) AS area FROM range(0, 12) t(r)")
def cartesian_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec(12, 5).cartesian_cells(0, 0, 3, -0.5)
    return spark.range(12).select(F.col("id").cast("int").alias("row"), micro(grid.cell_area_km2(spec, F.col("id"))).alias("area"))


@query("""SELECT * FROM (VALUES ('area', true), ('point', true), ('unspecified', true), ('elsewhere', false)) t(space, known)""")
def raster_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lambda s: Spec.from_json(Spec(2, 2, raster_space=s).to_json()).raster_space == s
    return spark.createDataFrame([(s, _valid(lambda s=s: Spec(2, 2, raster_space=s)) and kept(s)) for s in ("area", "point", "unspecified", "elsewhere")], "space string, known boolean")


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT c_custkey AS point_id, CAST(c_custkey * 31 % 200 AS INTEGER) AS row, CAST(c_custkey * 17 % 10 AS INTEGER) AS col FROM customer)
SELECT point_id, z IS NULL AS missing, coalesce(z, -1) AS z FROM p LEFT JOIN i USING (row, col)""")
def fill_as_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("point_id"), (k * 31 % 200).cast("int").alias("row"), (k * 17 % 10).cast("int").alias("col"))
    z = grid.as_float(Element("z"), F.col("z"))
    return cells.at_points(p, items(spark, sf_dir)).select("point_id", F.isnan(z).alias("missing"), F.when(F.isnan(z), -1).otherwise(z.cast("int")).cast("int").alias("z"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT row, col, CAST(floor(CAST(CAST(z AS FLOAT) * CAST(100 AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS code FROM v)
SELECT row, col, CASE WHEN row % 7 = 3 THEN -2147483648 ELSE code END AS code, row % 7 = 3 AS missing FROM c""")
def stored_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as stored, with the fill for null, and back."""
    e = Element("z", "icf", scale=100.0)
    z = F.when(F.col("row") % 7 != 3, F.col("z"))
    coded = events(spark, sf_dir).select("row", "col", grid.to_stored(e, z).alias("code"))
    return coded.select("row", "col", "code", grid.from_stored(e, F.col("code")).isNull().alias("missing"))


# -- interpolation and terrain ------------------------------------------------------------


def _model_points(spark: SparkSession, sf_dir: str, x0: float, y0: float, cell: float) -> DataFrame:
    return points(spark, sf_dir, 40, 50).select("point_id", (F.col("grid_col") * cell + x0).alias("x"), (F.col("grid_row") * cell + y0).alias("y"))


@query(_spline_sql(GEN_SQL, "g", "max(row) + 1", "max(col) + 1", _GEN_POINTS, {"z": (_w("v"), _w("u"))}, f"{micro_sql('z')} AS z"))
def model_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpolate.sample(_model_points(spark, sf_dir, -2.5, -2.0, 0.1), generated(spark), Spec(40, 50).cartesian_cells(-2.5, -2.0, 0.1, 0.1))
    return found.select("point_id", micro(F.col("z")).alias("z"))


@query(f"""WITH {GEN_SQL}, {_GEN_POINTS}, q AS (SELECT point_id, CAST(floor(grid_row + 0.5) AS INTEGER) AS row, CAST(floor(grid_col + 0.5) AS INTEGER) AS col FROM p)
SELECT point_id, {micro_sql('z')} AS z FROM q JOIN g USING (row, col)""")
def pluggable_interpolator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interpolator of the caller's own: the nearest cell's value."""

    def nearest(at: DataFrame, raster: DataFrame, spec: Spec) -> DataFrame:
        row, col = grid.rounded(spec, F.col("grid_row"), F.col("grid_col"))
        return cells.at_points(at.withColumns({"row": row, "col": col}), raster)

    g, spec = generated(spark), Spec(40, 50)
    found = interpolate.sample(points(spark, sf_dir, 40, 50).select("point_id", F.col("grid_col").alias("x"), F.col("grid_row").alias("y")), g, spec, nearest)
    return found.select("point_id", micro(F.col("z")).alias("z"))


_METRES = 6371007.2 * np.pi / 180
_NORMAL_H = f"(greatest(1.0, cos(radians(grid_row - 19.5)) * {_METRES!r}))"


@query(_spline_sql(GEN_SQL, "g", "max(row) + 1", "max(col) + 1", _GEN_POINTS, {"zx": (_w("v"), _w1("u", _NORMAL_H)), "zy": (_w1("v", f"({_METRES!r})"), _w("u"))}, ", ".join(f"{micro_sql(f'{a} / sqrt(zx * zx * 1e10 + zy * zy * 1e10 + 1)')} AS {n}" for a, n in (("-zx * 1e5", "nx"), ("-zy * 1e5", "ny"), ("1", "nz")))))
def geographic_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals at longitudes and latitudes, with metres between samples."""
    spec = Spec(40, 50).geographic_cells(-19.5, -24.5, 1, 1)
    found = interpolate.normals(_model_points(spark, sf_dir, -24.5, -19.5, 1.0), generated(spark).withColumn("z", F.col("z") * 1e5), spec)
    return found.select("point_id", *(micro(F.col(c)).alias(c) for c in ("nx", "ny", "nz")))


@query(f"SELECT CAST(lat AS INTEGER) AS lat, {micro_sql('cos(radians(lat)) * 2.0')} AS width FROM range(-90, 91) r(lat)")
def column_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-90, 91).select(F.col("id").cast("int").alias("lat"), micro(terrain.column_scale(F.col("id"), 2.0)).alias("width"))


@query(f"WITH {GEN_SQL} SELECT row, col, CAST(CASE WHEN z <= 0 THEN 255 ELSE row * 65536 + col * 256 END AS INTEGER) AS rgb FROM g")
def water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark).select("row", "col", terrain.water(F.col("z"), F.col("row") * 65536 + F.col("col") * 256, 255).cast("int").alias("rgb"))


@query(f"WITH {GEN_SQL} SELECT row, col, CAST((row * 5 % 256) * 65536 + (col * 5 % 256) * 256 + (row + col) % 256 AS INTEGER) AS rgb FROM g")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as PNG images, read back."""
    r, c = F.col("row"), F.col("col")
    images = formats.tiles_to_png(generated(spark).select("row", "col", ((r * 5 % 256) * 65536 + (c * 5 % 256) * 256 + (r + c) % 256).cast("int").alias("rgb")), 8, 10)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for down, across, png in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rgb = formats.png_grid(png)
                row, col = np.divmod(np.arange(rgb.size), rgb.shape[1])
                yield pa.record_batch([pa.array(x.astype(np.int32)) for x in (row + 8 * down, col + 10 * across, rgb.reshape(-1))], names=["row", "col", "rgb"])

    return images.select("tile_row", "tile_col", "png").mapInArrow(read, "row int, col int, rgb int")


# -- palettes -----------------------------------------------------------------------------

_HSV = palette.parse("# COLOR_MODEL = HSV\n-12 350 0.5 0.9 0 20 1 0.6\n0 200 0.8 1 18 100 0.2 0.5\n")


def _hsv_sql(n: int) -> str:
    k = f"(({n} + hue / 60) - 6 * floor(({n} + hue / 60) / 6))"
    return f"CAST(floor((v - v * s * greatest(0, least({k}, 4 - {k}, 1))) * 255 + 0.5) AS BIGINT)"


@query(f"""WITH {GEN_SQL}, t AS (SELECT row, col, z, CASE WHEN z >= 0 THEN z / 18 ELSE (z + 12) / 12 END AS t FROM g),
h AS (SELECT row, col, z, CASE WHEN z >= 0 THEN 200 - 100 * t ELSE 350 + 30 * t END AS h, CASE WHEN z >= 0 THEN 0.8 - 0.6 * t ELSE 0.5 + 0.5 * t END AS s, CASE WHEN z >= 0 THEN 1 - 0.5 * t ELSE 0.9 - 0.3 * t END AS v FROM t),
m AS (SELECT *, h - 360 * floor(h / 360) AS hue FROM h)
SELECT row, col, CAST(CASE WHEN z BETWEEN -12 AND 18 THEN -16777216 + {_hsv_sql(5)} * 65536 + {_hsv_sql(3)} * 256 + {_hsv_sql(1)} END AS INTEGER) AS argb FROM m""")
def palette_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hues run the shorter way: from 350 over 0 to 20 degrees."""
    return generated(spark).select("row", "col", palette.argb(_HSV, F.col("z")).alias("argb"))


_HINGED = palette.parse("# HINGE = 0\n# RANGE = -20/40\n-1 0 0 64 0 0 64 192\n0 32 96 32 1 255 255 255\n")


@query(f"""WITH {GEN_SQL}, t AS (SELECT row, col, z, CASE WHEN z < 0 THEN z / 20 ELSE z / 40 END AS t FROM g)
SELECT row, col, CAST(CASE WHEN t < -1 OR t > 1 THEN NULL WHEN t < 0 THEN -16777216 + floor(64 * (t + 1) + 0.5) * 256 + floor(64 + 128 * (t + 1) + 0.5)
  ELSE -16777216 + floor(32 + 223 * t + 0.5) * 65536 + floor(96 + 159 * t + 0.5) * 256 + floor(32 + 223 * t + 0.5) END AS INTEGER) AS argb FROM t""")
def palette_hinged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark).select("row", "col", palette.argb(_HINGED, F.col("z")).alias("argb"))


@query("""SELECT * FROM (VALUES ('categories', true, false, false, 3), ('gap', false, false, false, 2), ('hinged', false, true, true, 2), ('plain', false, true, false, 4), ('unit', false, true, true, 2)) t(name, categorical, covered, normalised, records)""")
def palette_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = {
        "categories": palette.parse("1 red ;one\n3 lime ;three\n7 blue ;seven"), "gap": palette.parse("0 red 1 lime\n2 red 3 lime"), "hinged": _HINGED, "plain": _PALETTE,
        "unit": palette.parse("0 0/0/0 0.5 10/20/30\n0.5 #ffffff 1 255-0-0"),
    }
    return spark.createDataFrame([(n, p.categorical, p.covered, p.normalised, len(p.records)) for n, p in ps.items()], "name string, categorical boolean, covered boolean, normalised boolean, records int")


@query(f"WITH {GEN_SQL}, c AS (SELECT row, col, (z * 10 + 100) / 10 - 10 AS z FROM g) SELECT row, col, CASE WHEN z BETWEEN -12 AND 18 THEN {_argb_sql('z')} END AS argb FROM c")
def palette_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same colours over another range."""
    wide = replace(_PALETTE, background=None, foreground=None, null_colour=None).ranged(-20, 280)
    return generated(spark).select("row", "col", palette.argb(wide, F.col("z") * 10 + 100).alias("argb"))


@query("SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 20 AND 30 THEN 'middle' WHEN p_size BETWEEN 40 AND 50 THEN 'large' END AS label FROM part")
def palette_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = palette.parse("1 red 10 red ;small\n20 lime 30 lime ;middle\n40 blue 50 blue ;large")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), palette.label_of(p, F.col("p_size")).alias("label"))


_SOME = "Navy,TEAL,no such,lime,Fu chsia,olive"


@query("""WITH n(name, r, g, b) AS (VALUES ('navy', 0, 0, 128), ('teal', 0, 128, 128), ('lime', 0, 255, 0), ('fuchsia', 255, 0, 255), ('olive', 128, 128, 0)),
c AS (SELECT c_custkey AS id, ['Navy', 'TEAL', 'no such', 'lime', 'Fu chsia', 'olive'][c_custkey % 6 + 1] AS colour FROM customer)
SELECT id, colour, r, g, b FROM c LEFT JOIN n ON name = lower(replace(colour, ' ', ''))""")
def colour_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n, *c) for n, c in palette.BASIC_NAMES.items()], "name string, r int, g int, b int")
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("id"), F.get(F.split(F.lit(_SOME), ","), (k % 6).cast("int")).alias("colour"))
    return palette.name_lookup(asked, names, "colour").select("id", "colour", "r", "g", "b")


@query("SELECT * FROM (VALUES ('gold', 255, 215, 0), ('lightsteelblue', 176, 196, 222)) t(name, r, g, b)")
def colour_name_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the caller brings, in the usual text form."""
    found = palette.colour_names("255 215 0\tgold\n! a comment\n 176 196 222   Light Steel Blue\n")
    return spark.createDataFrame([(n, *c) for n, c in found.items()], "name string, r int, g int, b int")


# -- statistics ---------------------------------------------------------------------------


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT {_TILES} FROM i), n AS (SELECT count(*) AS n, CAST(sum(z) AS DOUBLE) AS total, count(DISTINCT row) AS rows, count(DISTINCT col) AS cols,
  count(DISTINCT row // tr) AS bands, count(DISTINCT row // tr * across + col // tc) AS tiles FROM i, d)
SELECT unnest(['row_major', 'column_major', 'row_block', 'tile_block', 'tile_load']) AS shape, unnest([rows, cols, bands, tiles, tiles]) AS reads, n, total FROM n""")
def scan_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    m = i.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    rows, cols = min(m.r + 1, 50), min(m.c + 1, 20)
    spec = Spec(rows, cols, rows, cols)  # scans need a tile's size, not its number, which a specification keeps to 32 bits
    out = None
    for shape in stats.SHAPES:
        one = stats.scan_shape(i, spec, shape)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {EVENTS_SQL}, b AS (SELECT floor(z * 0.5) AS b FROM v WHERE z IS NOT NULL) SELECT CAST(count(*) AS BIGINT) AS n, {micro_sql('(sum(b) + 0.5 * count(*)) / count(*) / 0.5')} AS mean FROM b")
def histogram_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.histogram(events(spark, sf_dir), F.col("z"), 0.5)
    return stats.histogram_mean(counts, 0.5).select("n", micro(F.col("mean")).alias("mean"))


# -- coders and checksums -----------------------------------------------------------------

#: The raw packing of each tile as a list of bytes: the mark, then 32-bit integers, low byte first.
_BYTES_SQL = f"""{EMBED_INT_SQL}, {_TILED_SQL}, k AS (SELECT DISTINCT tile_index FROM t),
f AS (SELECT k.tile_index, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM k, range(0, {_R}) a(r), range(0, {_C}) b(c)),
u AS (SELECT f.tile_index, r * {_C} + c AS place, CASE WHEN coalesce(z, -2147483648) < 0 THEN coalesce(z, -2147483648) + 4294967296 ELSE z END AS v FROM f LEFT JOIN t USING (tile_index, r, c)),
y AS (SELECT tile_index, place * 4 + j + 1 AS place, CAST((v >> (8 * j)) & 255 AS BIGINT) AS byte FROM u, range(0, 4) s(j) UNION ALL SELECT tile_index, 0, 255 FROM k)"""


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    e = embed_int(spark, sf_dir)
    spec = spec_of(e, _R, _C)
    return codecs.shortest(codecs.encode_tiles(cells.tile_form(e, spec, "z"), (_R, _C), registry=codecs.Registry())), spec


@query(f"""WITH {_BYTES_SQL}, l AS (SELECT tile_index, list(byte ORDER BY place) AS l FROM y GROUP BY tile_index),
c AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END)) AS c)
SELECT tile_index, xor(list_reduce([4294967295::BIGINT] || l, lambda x, b: xor(c[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) AS checksum FROM l, c""")
def raw_tile_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.sealed(_raw(spark, sf_dir)[0]).select("tile_index", "checksum")


@query(f"""WITH {_BYTES_SQL}, p AS (SELECT tile_index, byte, lag(byte) OVER (PARTITION BY tile_index ORDER BY place) AS prior FROM y),
a AS (SELECT tile_index, byte, count(*) AS n FROM p GROUP BY ALL), e0 AS (SELECT tile_index, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM a GROUP BY 1),
b AS (SELECT tile_index, prior, byte, count(*) AS n FROM p WHERE prior IS NOT NULL GROUP BY ALL), e2 AS (SELECT tile_index, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM b GROUP BY 1),
d AS (SELECT tile_index, prior, sum(n) AS n FROM b GROUP BY ALL), e1 AS (SELECT tile_index, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM d GROUP BY 1)
SELECT 'raw' AS codec, count(*) AS tiles, {micro_sql('avg(e0.bits)')} AS order0, {micro_sql('avg(e2.bits - e1.bits)')} AS order1 FROM e0 JOIN e1 USING (tile_index) JOIN e2 USING (tile_index)""")
def raw_byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.byte_entropy(_raw(spark, sf_dir)[0]).select("codec", "tiles", micro(F.col("order0")).alias("order0"), micro(F.col("order1")).alias("order1"))


@query(f"""WITH {EMBED_INT_SQL}, {_TILED_SQL}, n AS (SELECT count(DISTINCT tile_index) AS n FROM t)
SELECT 'raw' AS codec, n AS tiles, CAST(n * {1 + 4 * _R * _C} AS BIGINT) AS bytes, {micro_sql(f'{8 * (1 + 4 * _R * _C) / (_R * _C)!r}')} AS bits_per_symbol, {micro_sql(f'{(1 + 4 * _R * _C) / (4 * _R * _C)!r}')} AS of_raw FROM n""")
def raw_codec_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, spec = _raw(spark, sf_dir)
    return codecs.report(packed, spec.cells_per_tile).select("codec", "tiles", "bytes", micro(F.col("bits_per_symbol")).alias("bits_per_symbol"), micro(F.col("of_raw")).alias("of_raw"))


def _lengths_sql() -> str:
    return "SELECT CAST(i AS INTEGER) AS symbol, CAST(CASE i WHEN 0 THEN 11 ELSE 12 - i END AS INTEGER) AS length FROM range(0, 12) r(i)"


@query(_lengths_sql())
def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts 1, 1, 2, 4, ... 1024 have codes of 11, 11, 10, ... 1 bits."""
    found = bits.code_lengths(np.array([1, *(1 << i for i in range(11))]))
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(found)], "symbol int, length int")


@query("SELECT 15 AS longest, 30 AS symbols, CAST(32768 AS BIGINT) AS kraft, true AS ordered")
def code_length_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that grow like Fibonacci's numbers would need 29 bits; the limited code is complete, and no rarer symbol has a shorter one."""
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])
    n = bits.code_lengths(np.array(counts)).astype(int)
    return spark.createDataFrame([(int(n.max()), len(n), int((2 ** (15 - n)).sum()), bool((np.diff(n) <= 0).all()))], "longest int, symbols int, kraft long, ordered boolean")


@query("SELECT c_custkey AS id, CAST(c_custkey * 7919 % 65536 & ((1 << CAST(1 + c_custkey % 16 AS INTEGER)) - 1) AS BIGINT) AS value FROM customer")
def bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 1 to 16 bits written one after another, and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                value, width = part.column(1).to_numpy(), part.column(2).to_numpy()
                reader = bits.BitReader(bits.pack_bits(value, width))
                yield pa.record_batch([part.column(0), pa.array([reader.read(int(w)) for w in width], pa.int64())], names=["id", "value"])

    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 65536).alias("value"), (1 + k % 16).alias("width")).mapInArrow(run, "id long, value long")


@query("""SELECT * FROM (VALUES ('after', 0, 'lsop12', 'int'), ('after', 1, 'lsop08', 'int'), ('after', 2, 'planes', 'float'), ('before', 0, 'huffman', 'int'), ('before', 1, 'deflate', 'int'), ('before', 2, 'planes', 'float'), ('before', 3, 'canonical', 'int')) t(state, index, name, takes)""")
def codec_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codecs registered, replaced, removed one by one and together, and asked for."""
    r = codecs.default_registry()
    rows = [("before", r.index(n), n, r.get(n).takes) for n in r.codecs]
    r.remove("huffman")
    r.add("deflate", codecs.Deflate(9))
    r.remove()
    codecs.add_least_squares(r)
    r.add("planes", codecs.FloatPlanes())
    rows += [("after", r.index(n), n, r.get(n).takes) for n in r.codecs]
    return spark.createDataFrame(rows, "state string, index int, name string, takes string")


# -- metadata -----------------------------------------------------------------------------


def _records(spark: SparkSession) -> DataFrame:
    rec = metadata.record
    rows = [rec("Author", "a", record_id=1), rec("Author", "b", record_id=2), rec("Copyright", "c", record_id=1), rec("Limits", [1, 2], "unsigned_short", record_id=4), rec("Scale", [0.5], "double", record_id=1)]
    return spark.createDataFrame(rows, metadata.SCHEMA)


@query("SELECT * FROM (VALUES ('all', 'Author', 1), ('all', 'Author', 2), ('all', 'Copyright', 1), ('all', 'Limits', 4), ('all', 'Scale', 1), ('name', 'Author', 1), ('name', 'Author', 2), ('key', 'Limits', 4)) t(asked, name, record_id)")
def metadata_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark)
    parts = {"all": metadata.read(r), "name": metadata.read(r, metadata.STANDARD_NAMES[0]), "key": metadata.read(r, "Limits", 4)}
    out = None
    for asked, part in parts.items():
        part = part.select(F.lit(asked).alias("asked"), "name", "record_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT * FROM (VALUES ('Author', 1), ('Copyright', 1), ('Limits', 4), ('Scale', 1)) t(name, record_id)")
def metadata_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.read(metadata.delete(_records(spark), "Author", 2)).select("name", "record_id")


def _got(f, row) -> str:
    try:
        return str(f(row))
    except TypeError:
        return "error"


@query("""SELECT * FROM (VALUES ('Author', 'error', 'error', 'a'), ('Copyright', 'error', 'error', 'c'), ('Limits', '[1, 2]', '[1.0, 2.0]', 'error'), ('Scale', 'error', '[0.5]', 'error')) t(name, ints, doubles, string)""")
def metadata_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record is as integers, doubles and a string; a handful of rows, as metadata is."""
    rows = [r for r in metadata.read(_records(spark)).collect() if (r["name"], r["record_id"]) != ("Author", 2)]
    return spark.createDataFrame([(r["name"], _got(metadata.as_integers, r), _got(metadata.as_doubles, r), _got(metadata.as_string, r)) for r in rows], "name string, ints string, doubles string, string string")


@query("""SELECT * FROM (VALUES ('byte', -128, true), ('byte', 128, false), ('short', 32767, true), ('short', -32769, false), ('unsigned_short', 65535, true), ('unsigned_short', -1, false), ('integer', -2147483648, true), ('integer', 2147483648, false), ('unsigned_integer', 4294967295, true), ('unsigned_integer', -1, false)) t(type, value, fits)""")
def metadata_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = [("byte", -128), ("byte", 128), ("short", 32767), ("short", -32769), ("unsigned_short", 65535), ("unsigned_short", -1), ("integer", -(1 << 31)), ("integer", 1 << 31), ("unsigned_integer", (1 << 32) - 1), ("unsigned_integer", -1)]
    return spark.createDataFrame([(t, v, _valid(lambda t=t, v=v: metadata.record("N", v, t))) for t, v in tried], "type string, value long, fits boolean")

