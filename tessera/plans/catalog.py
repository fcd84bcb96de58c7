"""The registered raster queries, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colour, grid
from tessera.functions.arith import to180, to360
from tessera.model import Element, Spec
from tessera.operators import bits, cells, codecs, interpolate, metadata, palette, predictors, stats, terrain
from tessera.plans.rasters import (
    EMBED_INT_SQL, EMBED_SQL, EVENTS_ICF, EVENTS_SQL, GEN_SQL, ICF, ITEMS_SQL,
    embed, embed_int, events, generated, items, micro, micro_sql, points, points_sql, spec_of, table,
)
from tessera.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def wrapped_sql(x: str) -> str:
    return f"CAST(((({x}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER)"


# -- addresses and reads ------------------------------------------------------------------

_TILES = "least(50, max(row) + 1) AS tr, least(20, max(col) + 1) AS tc, CAST(ceil((max(col) + 1) / CAST(least(20, max(col) + 1) AS DOUBLE)) AS INTEGER) AS across"


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT {_TILES} FROM i)
SELECT row, col, z, CAST(row // tr AS INTEGER) AS tile_row, CAST(col // tc AS INTEGER) AS tile_col, CAST(row // tr * across + col // tc AS INTEGER) AS tile_index,
  CAST(row % tr AS INTEGER) AS row_in_tile, CAST(col % tc AS INTEGER) AS col_in_tile, CAST(row % tr * tc + col % tc AS INTEGER) AS index_in_tile FROM i, d""")
def tile_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return grid.with_address(i, spec_of(i, 50, 20))


@query(f"""WITH {ITEMS_SQL} SELECT count(DISTINCT (row // 50, col // 20)) AS populated_tiles FROM i""")
def populated_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return stats.populated_tiles(i, spec_of(i, 50, 20))


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT {_TILES}, max(row) + 1 AS nr, max(col) + 1 AS nc FROM i),
t AS (SELECT CAST(row // tr * across + col // tc AS INTEGER) AS tile_index, count(z) AS valid, min(z) AS least, max(z) AS most,
  least(tr, min(nr) - min(row // tr) * tr) * least(tc, min(nc) - min(col // tc) * tc) AS inside FROM i, d GROUP BY tile_index, tr, tc)
SELECT tile_index, valid, least, most, valid < inside AS has_missing FROM t""")
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return stats.tile_report(i, spec_of(i, 50, 20))


@query(f"WITH {ITEMS_SQL} SELECT row, col, z FROM i WHERE row % 50 = 3 AND col % 20 = 3")
def one_sample_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return cells.one_per_tile(i, Spec(50, 20, 50, 20), 3)


@query(f"""WITH {ITEMS_SQL}, b AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM range(10, 40) a(r), range(2, 27) b(c))
SELECT b.row, b.col, coalesce(i.z, -2147483648) AS z FROM b LEFT JOIN i USING (row, col)""")
def block_read_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.dense_block(spark, items(spark, sf_dir), 10, 2, 30, 25, {"z": bits.INT_MIN})


@query(f"WITH {EMBED_SQL} SELECT row, col, z FROM e WHERE row BETWEEN 100 AND 119 AND col BETWEEN 8 AND 15")
def block_read_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.block(embed(spark, sf_dir), 100, 8, 20, 8)


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT c_custkey AS point_id, CAST(c_custkey * 31 % 200 AS INTEGER) AS row, CAST(c_custkey * 17 % 10 AS INTEGER) AS col FROM customer)
SELECT point_id, row, col, z FROM p LEFT JOIN i USING (row, col)""")
def point_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("point_id"), (k * 31 % 200).cast("int").alias("row"), (k * 17 % 10).cast("int").alias("col"))
    return cells.at_points(p, items(spark, sf_dir)).select("point_id", "row", "col", "z")


_PATCH_SQL = "q AS (SELECT CAST(p_partkey AS INTEGER) AS row, CAST(p_partkey % 12 AS INTEGER) AS col, CAST(p_size AS INTEGER) AS z FROM part)"


def _patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.cast("int").alias("row"), (k % 12).cast("int").alias("col"), F.col("p_size").cast("int").alias("z"))


@query(f"WITH {ITEMS_SQL}, {_PATCH_SQL} SELECT row, col, coalesce(q.z, i.z) AS z FROM i FULL JOIN q USING (row, col)")
def upsert_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.upsert(items(spark, sf_dir), _patch(spark, sf_dir))


@query(f"WITH {ITEMS_SQL}, {_PATCH_SQL} SELECT i.row, i.col, i.z FROM i LEFT JOIN q USING (row, col) WHERE q.z IS NULL")
def erase_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.erase(items(spark, sf_dir), _patch(spark, sf_dir))


@query(f"WITH {ITEMS_SQL}, {_PATCH_SQL} SELECT row, col, i.z AS z, q.z AS _z FROM i FULL JOIN q USING (row, col) WHERE i.z IS DISTINCT FROM q.z")
def verify_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.differences(items(spark, sf_dir), _patch(spark, sf_dir)).select("row", "col", "z", "_z")


# -- coded values -------------------------------------------------------------------------

_ICF_SQL = "CAST(floor(CAST(CAST(z AS FLOAT) * CAST(100 AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER)"


@query(f"WITH {EVENTS_SQL} SELECT row, col, {_ICF_SQL} AS code FROM v")
def icf_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("row", "col", grid.icf_encode(EVENTS_ICF, F.col("z")).alias("code"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT z, CAST({_ICF_SQL} AS FLOAT) / CAST(100 AS FLOAT) AS back FROM v)
SELECT count(*) AS n, {micro_sql("max(abs(CAST(back AS DOUBLE) - z)) / 100")} AS largest, count(*) FILTER (WHERE abs(CAST(back AS DOUBLE) - z) > 0.01) AS off FROM c""")
def icf_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    error = F.abs(grid.icf_decode(EVENTS_ICF, grid.icf_encode(EVENTS_ICF, z)).cast("double") - z)
    return events(spark, sf_dir).agg(F.count("*").alias("n"), micro(F.max(error) / 100).alias("largest"), F.sum((error > 0.01).cast("long")).alias("off"))


@query(f"WITH {ITEMS_SQL} SELECT row, col, z BETWEEN -32768 AND 32767 AND z BETWEEN 20 AND 90 OR z = -1 AS ok FROM i")
def value_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("row", "col", grid.supported(Element("z", "short", 20, 90, -1), F.col("z")).alias("ok"))


# -- aggregates ---------------------------------------------------------------------------


@query(f"WITH {ITEMS_SQL} SELECT count(*) AS n, {micro_sql('avg(z)')} AS mean FROM i")
def scan_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scan(items(spark, sf_dir)).select("n", micro(F.col("mean")).alias("mean"))


@query(f"""WITH {EMBED_INT_SQL} SELECT 'embed' AS raster, count(*) AS n, min(z) AS least, max(z) AS most, CAST(sum(z) AS BIGINT) AS total FROM ei
UNION ALL SELECT 'items', count(*), min(z), max(z), CAST(sum(z) AS BIGINT) FROM ({'WITH ' + ITEMS_SQL + ' SELECT * FROM i'})""")
def minmax_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stats.scan(r(spark, sf_dir)).select(F.lit(n).alias("raster"), "n", "least", "most", "total") for n, r in (("embed", embed_int), ("items", items))]
    return parts[0].unionByName(parts[1])


@query("SELECT CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(38, 6))) * 100 + 0.5) AS BIGINT) AS cents, count(l_extendedprice) AS n FROM lineitem")
def exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exact_sum(table(spark, sf_dir, "lineitem"), "l_extendedprice").select(F.floor(F.col("total") * 100 + 0.5).alias("cents"), "n")


_GEO = Spec(40, 50).geographic(-39, -98, 39, 98)


@query(f"""WITH {GEN_SQL}, a AS (SELECT z * 100 AS z, abs(sin(radians(-39 + (row + 0.5) * {78 / 39})) - sin(radians(-39 + (row - 0.5) * {78 / 39}))) * (6371.0072 * 6371.0072) * radians({196 / 49}) AS area FROM g)
SELECT count(*) AS cells, CAST(floor(sum(area) + 0.5) AS BIGINT) AS area, CAST(floor(sum(-area * z / 1000) + 0.5) AS BIGINT) AS volume, {micro_sql('sum(-z) / count(*)')} AS mean_depth FROM a WHERE z < 0""")
def zonal_area_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generated(spark).withColumn("z", F.col("z") * 100)
    return stats.below_zero(g, _GEO).select("cells", F.floor(F.col("area") + 0.5).alias("area"), F.floor(F.col("volume") + 0.5).alias("volume"), micro(F.col("mean_depth")).alias("mean_depth"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means of coded vectors: ingest, coding, addressing, missing data and rounding in one."""
    e = embed(spark, sf_dir).withColumn("z", grid.icf_encode(ICF, F.col("z")))
    return stats.downsample(e, spec_of(e), 4)


QUERIES["downsample_avg"] = flagship
ORACLE_SQL["downsample_avg"] = f"""WITH {EMBED_SQL}, c AS (SELECT row, col, CAST(floor(CAST(z * CAST(10000 AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS z FROM e),
d AS (SELECT (max(row) + 1) // 4 * 4 AS nr, (max(col) + 1) // 4 * 4 AS nc FROM c)
SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, CASE WHEN count(z) = 16 THEN CAST(floor(sum(z) / 16.0 + 0.5) AS INTEGER) END AS z FROM c, d WHERE row < nr AND col < nc GROUP BY 1, 2"""


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT (max(row) + 1) // 4 * 4 AS nr, (max(col) + 1) // 4 * 4 AS nc FROM i)
SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, CAST(floor(sum(z) / CAST(count(z) AS DOUBLE) + 0.5) AS INTEGER) AS z FROM i, d WHERE row < nr AND col < nc GROUP BY 1, 2""")
def downsample_valid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return stats.downsample(i, spec_of(i), 4, strict=False)


@query(f"""WITH {GEN_SQL} SELECT CAST(row // 5 AS INTEGER) AS row, CAST(col // 5 AS INTEGER) AS col, {micro_sql('CAST(CAST(avg(z) AS FLOAT) AS DOUBLE)')} AS z FROM g GROUP BY 1, 2""")
def downsample_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.downsample_float(generated(spark), Spec(40, 50), 5).withColumn("z", micro(F.col("z").cast("double")))


@query(f"""WITH {EVENTS_SQL} SELECT CAST(row // 10 AS INTEGER) AS row, CAST(col // 10 AS INTEGER) AS col, {micro_sql('avg(z)')} AS z, count(z) AS n FROM v GROUP BY 1, 2""")
def image_scale_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scaled_mean(events(spark, sf_dir), 10).withColumn("z", micro(F.col("z")))


_ENTROPY = f"{micro_sql('log2(sum(n)) - sum(n * log2(n)) / sum(n)')} AS bits, CAST(sum(n) AS BIGINT) AS symbols, count(*) AS distinct_symbols, count(*) FILTER (WHERE n = 1) AS once, max(n) AS most"


def _entropy(counts: DataFrame) -> DataFrame:
    return stats.entropy(counts).withColumn("bits", micro(F.col("bits")))


@query(f"WITH {ITEMS_SQL}, n AS (SELECT z, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY z) SELECT {_ENTROPY} FROM n")
def entropy_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropy(stats.symbol_counts(items(spark, sf_dir), F.col("z")))


@query(f"WITH {EMBED_SQL}, n AS (SELECT z, count(*) AS n FROM e GROUP BY z) SELECT {_ENTROPY} FROM n")
def entropy_float_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropy(stats.symbol_counts(stats.float_bits(embed(spark, sf_dir)), F.col("bits")))


@query(f"WITH {EVENTS_SQL}, n AS (SELECT CAST(floor(z * 0.5) AS BIGINT) AS b, count(*) AS n FROM v GROUP BY 1) SELECT {_ENTROPY} FROM n")
def entropy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropy(stats.histogram(events(spark, sf_dir), F.col("z"), 0.5))


@query(f"""WITH {EMBED_INT_SQL}, s AS (SELECT row, col, CAST(floor(z / 500.0) AS INTEGER) AS b FROM ei), p AS (SELECT lag(b) OVER (PARTITION BY row ORDER BY col) AS prior, b AS x FROM s),
j AS (SELECT prior, x, count(*) AS n FROM p WHERE prior IS NOT NULL GROUP BY 1, 2), m AS (SELECT sum(n) AS m, sum(n * log2(n)) AS s FROM j GROUP BY prior)
SELECT {micro_sql('(sum(m * log2(m)) - sum(s)) / sum(m)')} AS bits, CAST(sum(m) AS BIGINT) AS pairs FROM m""")
def entropy_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stats.in_row_pairs(embed_int(spark, sf_dir), F.floor(F.col("z") / 500.0).cast("int"))
    return stats.order1_entropy(pairs).withColumn("bits", micro(F.col("bits")))


@query(f"WITH {ITEMS_SQL} SELECT z AS symbol, count(*) AS n FROM i GROUP BY z")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.symbol_counts(items(spark, sf_dir), F.col("z"))


@query(f"""WITH {EMBED_INT_SQL}, c AS (SELECT row // 4 AS row, col // 4 AS col, z + 5000 AS z FROM ei WHERE row < (SELECT (max(row) + 1) // 4 * 4 FROM ei)), a AS (
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, (sum((z >> 16) & 255) + 8) // 16 AS r, (sum((z >> 8) & 255) + 8) // 16 AS g, (sum(z & 255) + 8) // 16 AS b FROM c GROUP BY 1, 2)
SELECT row, col, CAST(r * 65536 + g * 256 + b AS INTEGER) AS rgb FROM a""")
def rgb_box_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rgb_reduce(embed_int(spark, sf_dir).select("row", "col", (F.col("z") + 5000).alias("rgb")), 4)


# -- coordinates --------------------------------------------------------------------------


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"))


@query(f"""WITH p AS (SELECT c_custkey AS point_id, c_custkey % 240 / CAST(10 AS DOUBLE) - 3.5 AS x, c_custkey * 7 % 240 / CAST(10 AS DOUBLE) - 3.5 AS y FROM customer),
q AS (SELECT point_id, (x + 3) / (23 / CAST(12 AS DOUBLE)) AS col, (y + 3) / (23 / CAST(6 AS DOUBLE)) AS row FROM p)
SELECT point_id, {micro_sql('row')} AS row, {micro_sql('col')} AS col, row BETWEEN -0.5 AND 6.5 AND col BETWEEN -0.5 AND 12.5 AS inside FROM q""")
def model_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    row, col = grid.model_to_grid(Spec(7, 13).cartesian(-3, -3, 20, 20), k % 240 / 10.0 - 3.5, k * 7 % 240 / 10.0 - 3.5)
    return _ids(spark, sf_dir).select("point_id", micro(row).alias("row"), micro(col).alias("col"), (row.between(-0.5, 6.5) & col.between(-0.5, 12.5)).alias("inside"))


_T180 = "CASE WHEN m < -180 THEN m + 360 WHEN m >= 180 THEN m - 360 ELSE m END"
_T360 = "CASE WHEN m < 0 THEN m + 360 ELSE m END"


@query(f"""WITH p AS (SELECT c_custkey AS point_id, c_custkey * 13 % 180 - 89.5 AS lat, c_custkey * 29 % 1080 - 540.25 AS lon FROM customer),
d AS (SELECT *, CAST(lon + 165 AS DOUBLE) AS d, lon + 165 - 360 * trunc((lon + 165) / 360.0) AS m FROM p),
c AS (SELECT *, d / 30 AS a, ({_T180}) / 30.0 AS b, ({_T360}) / 30.0 AS c FROM d)
SELECT point_id, {micro_sql('(lat + 75) / 30.0')} AS row, {micro_sql('CASE WHEN a BETWEEN -0.5 AND 11.5 THEN a WHEN b BETWEEN -0.5 AND 11.5 THEN b ELSE c END')} AS col FROM c""")
def geo_to_grid_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    spec = Spec(6, 12).geographic_cells(-75, -165, 30, 30)
    row, col = grid.geo_to_grid(spec, k * 13 % 180 - 89.5, k * 29 % 1080 - 540.25)
    return _ids(spark, sf_dir).select("point_id", micro(row).alias("row"), micro(col).alias("col"))


@query(f"""SELECT c_custkey AS point_id, {micro_sql('c_custkey % 700 / CAST(100 AS DOUBLE) * (6 / CAST(6 AS DOUBLE)) - 3')} AS lat, {micro_sql('c_custkey % 1300 / CAST(100 AS DOUBLE) * (2 / CAST(12 AS DOUBLE)) + 179')} AS lon FROM customer""")
def grid_to_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    lat, lon = grid.grid_to_geo(Spec(7, 13).geographic(-3, 179, 3, -179), k % 700 / 100.0, k % 1300 / 100.0)
    return _ids(spark, sf_dir).select("point_id", micro(lat).alias("lat"), micro(lon).alias("lon"))


@query(f"""WITH a AS (SELECT c_custkey AS point_id, CAST(c_custkey * 37 % 2000 - 1000 + 0.25 AS DOUBLE) AS a FROM customer), m AS (SELECT point_id, a - 360 * trunc(a / 360) AS m FROM a)
SELECT point_id, {micro_sql(_T180)} AS half, {micro_sql(_T360)} AS whole FROM m""")
def angle_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("point_id") * 37 % 2000 - 1000 + 0.25).cast("double")
    return _ids(spark, sf_dir).select("point_id", micro(to180(a)).alias("half"), micro(to360(a)).alias("whole"))


@query(f"""SELECT CAST(r AS INTEGER) AS row, {micro_sql('abs(sin(radians(-89.5 + (r + 0.5) * 1)) - sin(radians(-89.5 + (r - 0.5) * 1))) * (6371.0072 * 6371.0072) * radians(1) / 1000')} AS area FROM range(0, 180) t(r)""")
def cell_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec(180, 360).geographic_cells(-89.5, -179.5, 1, 1)
    return spark.range(180).select(F.col("id").cast("int").alias("row"), micro(grid.cell_area_km2(spec, F.col("id")) / 1000).alias("area"))


@query(f"""WITH k AS (SELECT 1 / 298.257222101 AS f), e AS (SELECT 2 * f - f * f AS e2, sqrt(2 * f - f * f) AS e FROM k),
s AS (SELECT *, sin(radians(23)) AS s0, sin(radians(29.5)) AS s1, sin(radians(45.5)) AS s2 FROM e),
q AS (SELECT *, {', '.join(f"(1 - e2) * (s{i} / (1 - e2 * s{i} * s{i}) - ln((1 - e * s{i}) / (1 + e * s{i})) / (2 * e)) AS q{i}" for i in range(3))},
  cos(radians(29.5)) / sqrt(1 - e2 * s1 * s1) AS m1, cos(radians(45.5)) / sqrt(1 - e2 * s2 * s2) AS m2 FROM s),
n AS (SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n FROM q), c AS (SELECT *, m1 * m1 + n * q1 AS c FROM n),
p AS (SELECT c_custkey AS point_id, sin(radians(24 + c_custkey % 250 / CAST(10 AS DOUBLE))) AS s, radians(-125 + c_custkey * 3 % 590 / CAST(10 AS DOUBLE) + 96) AS l FROM customer),
r AS (SELECT point_id, n, c, l, q0, 6378137 * sqrt(c - n * (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / n AS rho FROM p, c)
SELECT point_id, CAST(floor(rho * sin(n * l) * 1000 + 0.5) AS BIGINT) AS x_mm, CAST(floor((6378137 * sqrt(c - n * q0) / n - rho * cos(n * l)) * 1000 + 0.5) AS BIGINT) AS y_mm FROM r""")
def albers_conic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id")
    x, y = grid.albers(24 + k % 250 / 10.0, -125 + k * 3 % 590 / 10.0, 23, -96, 29.5, 45.5)
    return _ids(spark, sf_dir).select("point_id", F.floor(x * 1000 + 0.5).alias("x_mm"), F.floor(y * 1000 + 0.5).alias("y_mm"))


# -- interpolation ------------------------------------------------------------------------


def _w(u: str) -> list[str]:
    return [f"(1-{u})*(1-{u})*(1-{u})/6", f"(3*{u}*{u}*({u}-2)+4)/6", f"(3*{u}*(1+{u}-{u}*{u})+1)/6", f"{u}*{u}*{u}/6"]


def _w1(u: str, h: float) -> list[str]:
    return [f"-((1-{u})*(1-{u}))/(2*{h})", f"(1.5*{u}-2)*{u}/{h}", f"(0.5-(1.5*{u}-1)*{u})/{h}", f"{u}*{u}/(2*{h})"]


def _w2(u: str, h: float) -> list[str]:
    return [f"(1-{u})/({h}*{h})", f"(3*{u}-2)/({h}*{h})", f"(1-3*{u})/({h}*{h})", f"{u}/({h}*{h})"]


def _pick(ws: list[str], k: str) -> str:
    return f"CASE {k} {' '.join(f'WHEN {i} THEN CAST({w} AS DOUBLE)' for i, w in enumerate(ws))} END"


def _spline_sql(base: str, t: str, rows: str, cols: str, pts: str, outs: dict[str, tuple[list[str], list[str]]], tail: str) -> str:
    sums = ", ".join(f"sum(s.z * ({_pick(d, 'j')}) * ({_pick(a, 'i')})) AS {n}" for n, (d, a) in outs.items())
    return f"""WITH {base}, {pts}, d AS (SELECT {rows} AS nr, {cols} AS nc FROM {t}),
h AS (SELECT *, CAST(least(greatest(floor(grid_row) - 1, 0), nr - 4) AS INTEGER) AS row0, CAST(least(greatest(floor(grid_col) - 1, 0), nc - 4) AS INTEGER) AS col0 FROM p, d),
w AS (SELECT *, grid_col - col0 - 1 AS u, grid_row - row0 - 1 AS v FROM h),
o AS (SELECT point_id, {sums}, count(s.z) AS n FROM w, range(0, 4) a(j), range(0, 4) b(i), {t} s WHERE s.row = row0 + j AND s.col = col0 + i GROUP BY point_id)
SELECT point_id, {tail} FROM o WHERE n = 16"""


_EMBED_POINTS = """p AS (SELECT c_custkey AS point_id, (c_custkey * 7919 % (nr * 100 - 100)) / CAST(100 AS DOUBLE) AS grid_row, (c_custkey * 104729 % (nc * 100 - 100)) / CAST(100 AS DOUBLE) AS grid_col
  FROM customer, (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM e))"""
_GEN_POINTS = points_sql(40, 50)


@query(_spline_sql(EMBED_SQL, "e", "max(row) + 1", "max(col) + 1", _EMBED_POINTS, {"z": (_w("v"), _w("u"))}, f"{micro_sql('z')} AS z"))
def bspline_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embed(spark, sf_dir)
    spec = spec_of(e)
    return interpolate.spline(points(spark, sf_dir, spec.n_rows, spec.n_cols), e, spec).select("point_id", micro(F.col("z")).alias("z"))


@query(_spline_sql(GEN_SQL, "g", "max(row) + 1", "max(col) + 1", _GEN_POINTS, {"zx": (_w("v"), _w1("u", 0.1)), "zy": (_w1("v", 0.1), _w("u"))}, f"{micro_sql('zx')} AS zx, {micro_sql('zy')} AS zy"))
def bspline_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = interpolate.spline(points(spark, sf_dir, 40, 50), generated(spark), Spec(40, 50), "z", 0.1, 0.1, 1)
    return s.select("point_id", micro(F.col("zx")).alias("zx"), micro(F.col("zy")).alias("zy"))


@query(_spline_sql(GEN_SQL, "g", "max(row) + 1", "max(col) + 1", _GEN_POINTS, {"a": (_w("v"), _w2("u", 0.1)), "b": (_w1("v", 0.1), _w1("u", 0.1)), "c": (_w2("v", 0.1), _w("u"))}, f"{micro_sql('a / 1000')} AS zxx, {micro_sql('b / 1000')} AS zxy, {micro_sql('c / 1000')} AS zyy"))
def bspline_hessian(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = interpolate.spline(points(spark, sf_dir, 40, 50), generated(spark), Spec(40, 50), "z", 0.1, 0.1, 2)
    return s.select("point_id", *(micro(F.col(c) / 1000).alias(c) for c in ("zxx", "zxy", "zyy")))


_SEAM = Spec(6, 12).geographic_cells(-75, -165, 30, 30)


@query(f"""WITH s AS (SELECT CAST(i // 12 AS INTEGER) AS row, CAST(i % 12 AS INTEGER) AS col, CAST([0,1,2,2,1,0,0,1,2,2,1,0][i % 12 + 1] AS DOUBLE) AS z FROM range(0, 72) t(i)),
p AS (SELECT c_custkey AS point_id, (c_custkey * 7 % 500) / CAST(100 AS DOUBLE) AS grid_row, (c_custkey * 11 % 1200) / CAST(100 AS DOUBLE) - 0.5 AS grid_col FROM customer),
h AS (SELECT *, CAST(least(greatest(floor(grid_row) - 1, 0), 2) AS INTEGER) AS row0 FROM p), w AS (SELECT *, grid_col - floor(grid_col) AS u, grid_row - row0 - 1 AS v FROM h),
o AS (SELECT point_id, sum(s.z * ({_pick(_w('v'), 'j')}) * ({_pick(_w('u'), 'i')})) AS z FROM w, range(0, 4) a(j), range(0, 4) b(i), s
  WHERE s.row = row0 + j AND s.col = (CAST(floor(grid_col) AS INTEGER) - 1 + i + 24) % 12 GROUP BY point_id)
SELECT point_id, CAST(floor(z * 1000000 + 0.51) AS BIGINT) AS z FROM o""")
def bspline_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    wave = F.array(*map(F.lit, (0, 1, 2, 2, 1, 0, 0, 1, 2, 2, 1, 0)))
    s = spark.range(72).select(F.floor(i / 12).cast("int").alias("row"), (i % 12).cast("int").alias("col"), F.get(wave, (i % 12).cast("int")).cast("double").alias("z"))
    k = F.col("point_id")
    p = _ids(spark, sf_dir).select("point_id", (k * 7 % 500 / 100.0).alias("grid_row"), (k * 11 % 1200 / 100.0 - 0.5).alias("grid_col"))
    return interpolate.spline(p, s, _SEAM).select("point_id", F.floor(F.col("z") * 1000000 + 0.51).alias("z"))  # thirty-sixths of a millionth: no ties


@query(f"""WITH {GEN_SQL}, {_GEN_POINTS}, h AS (SELECT *, CAST(least(floor(grid_row), 38) AS INTEGER) AS row0, CAST(least(floor(grid_col), 48) AS INTEGER) AS col0 FROM p),
o AS (SELECT point_id, sum(g.z * (CASE j WHEN 0 THEN 1 - (grid_row - row0) ELSE grid_row - row0 END) * (CASE i WHEN 0 THEN 1 - (grid_col - col0) ELSE grid_col - col0 END)) AS z
  FROM h, range(0, 2) a(j), range(0, 2) b(i), g WHERE g.row = row0 + j AND g.col = col0 + i GROUP BY point_id)
SELECT point_id, {micro_sql('z')} AS z FROM o""")
def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate.bilinear(points(spark, sf_dir, 40, 50), generated(spark), Spec(40, 50)).select("point_id", micro(F.col("z")).alias("z"))


@query(f"""WITH {_GEN_POINTS}
SELECT point_id, CAST(floor(grid_row * 4 + 0.5 + 1e-9) * 65536 + floor(grid_col * 4 + 0.5 + 1e-9) * 256 + floor((grid_row + grid_col) * 2 + 0.5 + 1e-9) AS INTEGER) AS rgb FROM p""")
def bilinear_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that are linear in the grid, so that the answer is known."""
    r, c = F.col("row"), F.col("col")
    g = generated(spark).select("row", "col", (r * 4 * 65536 + c * 4 * 256 + (r + c) * 2).cast("int").alias("rgb"))
    return interpolate.bilinear_rgb(points(spark, sf_dir, 40, 50), g, Spec(40, 50)).select("point_id", "rgb")


@query(f"""WITH {GEN_SQL} SELECT row, col, col / CAST(10 AS DOUBLE) - 2.5 AS x, row / CAST(10 AS DOUBLE) - 2 + CASE WHEN row = col THEN 0.25 ELSE 0 END AS y FROM g WHERE row = col""")
def coordinate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = F.col("row"), F.col("col")
    at = generated(spark).select("row", "col", (c / 10.0 - 2.5).alias("x"), (r / 10.0 - 2.0 + F.when(r == c, 0.25).otherwise(0.0)).alias("y"))
    return interpolate.off_grid(at, Spec(40, 50).cartesian_cells(-2.5, -2.0, 0.1, 0.1))


_GRADIENT = {"zx": (_w("v"), _w1("u", 0.1)), "zy": (_w1("v", 0.1), _w("u"))}


@query(_spline_sql(GEN_SQL, "g", "max(row) + 1", "max(col) + 1", _GEN_POINTS, _GRADIENT, ", ".join(f"{micro_sql(f'{a} / sqrt(zx * zx + zy * zy + 1)')} AS {n}" for a, n in (("-zx", "nx"), ("-zy", "ny"), ("1", "nz")))))
def unit_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = interpolate.spline(points(spark, sf_dir, 40, 50), generated(spark), Spec(40, 50), "z", 0.1, 0.1, 1)
    n = interpolate.unit_normal(F.col("zx"), F.col("zy"))
    return s.select("point_id", *(micro(c).alias(a) for c, a in zip(n, ("nx", "ny", "nz"), strict=True)))


_SUN = terrain.sun(145, 60)


@query(_spline_sql(GEN_SQL, "g", "max(row) + 1", "max(col) + 1", _GEN_POINTS, _GRADIENT, micro_sql(f"0.2 + greatest(0, (-zx * 5 * ({_SUN[0]!r}) - zy * 5 * ({_SUN[1]!r}) + ({_SUN[2]!r})) / sqrt(zx * 5 * zx * 5 + zy * 5 * zy * 5 + 1)) * 0.8") + " AS shade"))
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = interpolate.spline(points(spark, sf_dir, 40, 50), generated(spark), Spec(40, 50), "z", 0.1, 0.1, 1)
    return s.select("point_id", micro(terrain.hillshade(F.col("zx"), F.col("zy"), steepen=5)).alias("shade"))


# -- colour -------------------------------------------------------------------------------

_CPT = """# COLOR_MODEL = RGB
-12 0 0 64 -4 0 64 192
-4 0 64 192 0 192 192 192
0 32 96 32 6 160 160 64
6 160 160 64 18 255 255 255
B 1 2 3
F 250 251 252
N 128 128 128
"""
_PALETTE = palette.parse(_CPT)
_PLAIN = replace(_PALETTE, background=None, foreground=None, null_colour=None)


def _argb_sql(z: str, shade: str = "1") -> str:
    out = ""
    for r in reversed(_PALETTE.records):
        t = f"(({z}) - ({r.range0})) / ({r.range1 - r.range0})"
        c = [f"CAST(floor(({a} + {t} * ({b - a})) * {shade} + 0.5) AS BIGINT)" for a, b in zip(r.first, r.last, strict=True)]
        out += f" WHEN ({z}) >= {r.range0} THEN {c[0]} * 65536 + {c[1]} * 256 + {c[2]}"
    return f"CAST(-16777216 + CASE{out} END AS INTEGER)"


@query(f"WITH {GEN_SQL} SELECT row, col, CASE WHEN z < -12 THEN {-16777216 + 0x010203} WHEN z > 18 THEN {-16777216 + 0xFAFBFC} ELSE {_argb_sql('z')} END AS argb FROM g")
def palette_argb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark).select("row", "col", palette.argb(_PALETTE, F.col("z")).alias("argb"))


@query(f"WITH {GEN_SQL} SELECT row, col, CASE WHEN z BETWEEN -12 AND 18 THEN {_argb_sql('z', '(0.25 + row % 4 * 0.25)')} END AS argb FROM g")
def palette_shaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark).select("row", "col", palette.argb(_PLAIN, F.col("z"), 0.25 + F.col("row") % 4 * 0.25).alias("argb"))


@query(f"WITH {GEN_SQL}, c AS (SELECT row, col, least(greatest(z, -12), 18) AS z FROM g) SELECT row, col, {_argb_sql('z')} AS argb FROM c")
def palette_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark).select("row", "col", palette.argb(_PLAIN, F.col("z"), clamp=True).alias("argb"))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT row, col, (row * 7919 + col * 104729 + z) % 16777216 AS rgb FROM i), s AS (SELECT *, (rgb >> 16) & 255 AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b FROM c),
y AS (SELECT *, r - b AS co, g - (b + ((r - b) >> 1)) AS cg FROM s)
SELECT row, col, CAST(b + (co >> 1) + (cg >> 1) AS INTEGER) AS y, CAST(co AS INTEGER) AS co, CAST(cg AS INTEGER) AS cg, CAST(rgb AS INTEGER) AS back FROM y""")
def ycocg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In 64 bits: the products outgrow 32 from about 271,000 rows or 20,500 columns.
    rgb = ((F.col("row").cast("long") * 7919 + F.col("col").cast("long") * 104729 + F.col("z")) % 16777216).cast("int")
    y, co, cg = colour.to_ycocg(*colour.channels(rgb))
    r, g, b = colour.from_ycocg(F.col("y"), F.col("co"), F.col("cg"))
    return items(spark, sf_dir).select("row", "col", y.cast("int").alias("y"), co.cast("int").alias("co"), cg.cast("int").alias("cg")).withColumn("back", (r * 65536 + g * 256 + b).cast("int"))


_LIN = "CASE WHEN p / CAST(255 AS DOUBLE) <= 0.04045 THEN p / CAST(255 AS DOUBLE) / 12.92 ELSE pow((p / CAST(255 AS DOUBLE) + 0.055) / 1.055, 2.4) END"


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT row, col, CAST(z % 256 AS INTEGER) AS p FROM i) SELECT row, col, {micro_sql(_LIN)} AS linear, {micro_sql(_LIN)} AS from_table, p AS back, p AS back_from_table FROM c""")
def srgb_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("z") % 256).cast("int")
    linear = colour.srgb_to_linear(p)
    return items(spark, sf_dir).select(
        "row", "col", micro(linear).alias("linear"), micro(colour.srgb_to_linear_table(p)).alias("from_table"), colour.linear_to_srgb(linear).alias("back"), colour.linear_to_srgb_table(linear).alias("back_from_table")
    )


@query(f"""WITH {GEN_SQL}, c AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 5 < 2 THEN 16777215 ELSE row * 50 + col END AS rgb FROM g),
n AS (SELECT c.row, c.col, arg_min(o.rgb, (o.row - c.row) * 3 + o.col - c.col) AS first FROM c JOIN c o ON abs(o.row - c.row) <= 1 AND abs(o.col - c.col) <= 1 AND o.rgb <> 16777215 WHERE c.rgb = 16777215 GROUP BY 1, 2)
SELECT row, col, CAST(CASE WHEN c.rgb = 16777215 THEN coalesce(n.first, c.rgb) ELSE c.rgb END AS INTEGER) AS rgb FROM c LEFT JOIN n USING (row, col)""")
def shore_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = F.col("row"), F.col("col")
    rgb = F.when((r * 7 + c * 3) % 5 < 2, F.lit(16777215)).otherwise(r * 50 + c)
    return terrain.dilate(generated(spark).select("row", "col", rgb.cast("int").alias("rgb")), 16777215).select("row", "col", "rgb")


# -- predictors ---------------------------------------------------------------------------

_R, _C = 20, 16
_TILED_SQL = f"t AS (SELECT CAST(row // {_R} * 4 + col // {_C} AS INTEGER) AS tile_index, CAST(row % {_R} AS INTEGER) AS r, CAST(col % {_C} AS INTEGER) AS c, z FROM ei)"
_WIN = "WINDOW a AS (PARTITION BY tile_index, r ORDER BY c), b AS (PARTITION BY tile_index, c ORDER BY r)"


def _tiled(z: DataFrame) -> DataFrame:
    row, col = F.col("row"), F.col("col")
    return z.select((F.floor(row / _R) * 4 + F.floor(col / _C)).cast("int").alias("tile_index"), (row % _R).cast("int").alias("r"), (col % _C).cast("int").alias("c"), "z")


def _residual_query(name: str, prior: str) -> None:
    encode, decode = predictors.ENCODERS[name], predictors.DECODERS[name]

    def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return encode(_tiled(embed_int(spark, sf_dir))).select("tile_index", "r", "c", "residual")

    def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decode(encoded(spark, sf_dir)).select("tile_index", "r", "c", "z")

    QUERIES[f"pred_{name}"], QUERIES[f"decode_{name}"] = encoded, decoded
    ORACLE_SQL[f"pred_{name}"] = f"WITH {EMBED_INT_SQL}, {_TILED_SQL} SELECT tile_index, r, c, {wrapped_sql(f'z - coalesce({prior}, 0)')} AS residual FROM t {_WIN}"
    ORACLE_SQL[f"decode_{name}"] = f"WITH {EMBED_INT_SQL}, {_TILED_SQL} SELECT tile_index, r, c, z FROM t"


_residual_query("differencing", "CASE WHEN c > 0 THEN lag(z) OVER a ELSE lag(z) OVER b END")
_residual_query("linear", "CASE WHEN c > 1 THEN 2 * lag(z) OVER a - lag(z, 2) OVER a WHEN c = 1 THEN lag(z) OVER a ELSE lag(z) OVER b END")
ORACLE_SQL_TRIANGLE = f"""WITH {EMBED_INT_SQL}, {_TILED_SQL}, d AS (SELECT *, z - coalesce(lag(z) OVER (PARTITION BY tile_index, r ORDER BY c), 0) AS d FROM t)
SELECT tile_index, r, c, {wrapped_sql('d - coalesce(lag(d) OVER (PARTITION BY tile_index, c ORDER BY r), 0)')} AS residual FROM d"""
_residual_query("triangle", "0")
ORACLE_SQL["pred_triangle"] = ORACLE_SQL_TRIANGLE

_SPARSE_SQL = f"""{ITEMS_SQL}, n AS (SELECT DISTINCT row // {_R} AS tr, col // {_C} AS tc FROM i), w AS (SELECT max(col) // {_C} + 1 AS across FROM i),
f AS (SELECT CAST(tr * {_R} + r AS INTEGER) AS row, CAST(tc * {_C} + c AS INTEGER) AS col FROM n, range(0, {_R}) a(r), range(0, {_C}) b(c)),
t AS (SELECT CAST(row // {_R} * across + col // {_C} AS INTEGER) AS tile_index, CAST(row % {_R} AS INTEGER) AS r, CAST(col % {_C} AS INTEGER) AS c, i.z AS z FROM f CROSS JOIN w LEFT JOIN i USING (row, col)),
p AS (SELECT *, CASE WHEN c > 0 THEN lag(z) OVER (PARTITION BY tile_index, r ORDER BY c) ELSE lag(z) OVER (PARTITION BY tile_index, c ORDER BY r) END AS prior FROM t),
s AS (SELECT *, CAST(floor(avg(CASE WHEN z IS NOT NULL AND prior IS NULL THEN z END) OVER (PARTITION BY tile_index) + 0.5) AS INTEGER) AS seed FROM p)"""


def _sparse_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of _R x _C, as many as the cells need; a tile is one row."""
    i = items(spark, sf_dir)
    m = i.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return cells.tile_form(i, Spec((m.r // _R + 1) * _R, (m.c // _C + 1) * _C, _R, _C), "z")


def _by_cell(tiles: DataFrame, values: str, name: str, *others: str) -> DataFrame:
    each = tiles.select("tile_index", *others, F.posexplode(values).alias("i", name))
    return each.select("tile_index", F.floor(F.col("i") / _C).cast("int").alias("r"), (F.col("i") % _C).cast("int").alias("c"), *others, name)


@query(f"WITH {_SPARSE_SQL} SELECT tile_index, r, c, seed, CAST(z - coalesce(prior, seed) AS INTEGER) AS residual FROM s")
def pred_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_cell(codecs.tile_residuals(_sparse_tiles(spark, sf_dir), (_R, _C)), "residuals", "residual", "seed")


@query(f"WITH {_SPARSE_SQL} SELECT tile_index, r, c, z FROM t")
def decode_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_cell(codecs.tile_restored(codecs.tile_residuals(_sparse_tiles(spark, sf_dir), (_R, _C)), (_R, _C)), "values", "z")


@query(f"""WITH {EMBED_INT_SQL}, {_TILED_SQL}, r AS (SELECT z - coalesce(CASE WHEN c > 0 THEN lag(z) OVER a ELSE lag(z) OVER b END, 0) AS v FROM t {_WIN}),
l AS (SELECT CASE WHEN abs(v) < 127 THEN 1 WHEN abs(v) < 255 THEN 2 WHEN abs(v) < 16639 THEN 3 WHEN abs(v) < 2113791 THEN 4 WHEN abs(v) < 270549247 THEN 5 ELSE 6 END AS length FROM r)
SELECT CAST(length AS INTEGER) AS length, count(*) AS n FROM l GROUP BY 1""")
def m32_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.abs(F.col("residual").cast("long"))
    length = F.when(F.col("residual") == bits.INT_MIN, 1)
    for n, step in enumerate((127, 255, 16639, 2113791, 270549247), 1):
        length = length.when(a < step, n)
    return predictors.encode_differencing(_tiled(embed_int(spark, sf_dir))).groupBy(length.otherwise(6).cast("int").alias("length")).agg(F.count("*").alias("n"))


_NEAR = ", ".join(f"u{k} AS (SELECT tile_index, r - ({dr}) AS r, c - ({dc}) AS c, z FROM t)" for k, (dr, dc) in enumerate(((0, 0), *predictors.NEIGHBOURS)))
_PAIRS = [(i, j) for i in range(13) for j in range(i, 13)]


@query(f"""WITH {EMBED_INT_SQL}, {_TILED_SQL}, {_NEAR}, m AS (SELECT u0.tile_index, {', '.join(f'CAST(sum(u{i}.z * u{j}.z) AS BIGINT) AS m{i}_{j}' for i, j in _PAIRS)}
FROM u0 {' '.join(f'JOIN u{k} USING (tile_index, r, c)' for k in range(1, 13))} GROUP BY u0.tile_index)
{' UNION ALL '.join(f'SELECT tile_index, {i} AS i, {j} AS j, m{i}_{j} AS moment FROM m' for i, j in _PAIRS)}""")
def lsop_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.neighbour_moments(_tiled(embed_int(spark, sf_dir)))


@query(f"""WITH {EMBED_INT_SQL}, {_TILED_SQL}, r AS (SELECT CAST(z - coalesce(CASE WHEN c > 0 THEN lag(z) OVER a ELSE lag(z) OVER b END, 0) AS DOUBLE) AS v FROM t {_WIN})
SELECT count(*) AS n, {micro_sql('avg(v)')} AS mean_error, {micro_sql('sqrt(avg(v * v))')} AS rmse, {micro_sql('avg(abs(v))')} AS mean_abs, {micro_sql('avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) * 100')} AS percent_zero FROM r""")
def residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.residual_stats(predictors.encode_differencing(_tiled(embed_int(spark, sf_dir))))
    return s.select("n", *(micro(F.col(c)).alias(c) for c in ("mean_error", "rmse", "mean_abs", "percent_zero")))


# -- codecs -------------------------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    e = embed_int(spark, sf_dir)
    spec = spec_of(e, _R, _C)
    return codecs.encode_tiles(cells.tile_form(e, spec, "z"), (_R, _C), registry=codecs.default_registry(True)), spec


@query()
def codec_compete(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, spec = _packed(spark, sf_dir)
    return codecs.report(codecs.shortest(packed), spec.cells_per_tile)


@query(f"WITH {EMBED_INT_SQL} SELECT row, col, z FROM ei")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, spec = _packed(spark, sf_dir)
    tiles = codecs.decode_tiles(codecs.shortest(packed), (_R, _C), registry=codecs.default_registry(True))
    down, across = grid.tile_origin(spec, F.col("tile_index"))
    return cells.cell_form(tiles.withColumns({"tile_row": down, "tile_col": across}), spec, "z")


@query(f"WITH {EMBED_SQL} SELECT row, col, z FROM e")
def float_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embed(spark, sf_dir)
    spec = spec_of(e, _R, _C, (Element("z", "float"),))
    best = codecs.shortest(codecs.encode_tiles(cells.tile_form(e, spec, "z"), (_R, _C), "float"))
    tiles = codecs.decode_tiles(best, (_R, _C), "float")
    down, across = grid.tile_origin(spec, F.col("tile_index"))
    return cells.cell_form(tiles.withColumns({"tile_row": down, "tile_col": across}), spec, "z")


@query()
def tile_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = _packed(spark, sf_dir)
    return codecs.sealed(codecs.shortest(packed)).select("tile_index", "element", "codec", "checksum")


@query(f"WITH {EMBED_INT_SQL}, {_TILED_SQL} SELECT DISTINCT tile_index, 'z' AS element FROM t WHERE tile_index % 3 = 0")
def inspect_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third tile's packing gets another last byte after it was sealed; the inspection finds just these."""
    packed, _ = _packed(spark, sf_dir)
    kept = codecs.sealed(codecs.shortest(packed))
    size = F.length("packing")
    other = F.when(F.expr("substring(packing, -1, 1)") == F.unhex(F.lit("00")), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    broken = F.concat(F.expr("substring(packing, 1, length(packing) - 1)"), other)
    return codecs.damaged(kept.withColumn("packing", F.when((F.col("tile_index") % 3 == 0) & (size > 0), broken).otherwise(F.col("packing"))))


@query()
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = _packed(spark, sf_dir)
    return codecs.byte_entropy(packed.filter("codec <> 'raw'"))


@query()
def float_plane_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embed(spark, sf_dir)
    return codecs.plane_sizes(cells.tile_form(e, spec_of(e, _R, _C, (Element("z", "float"),)), "z"), (_R, _C))


# -- metadata and summaries ---------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('Author', 1, 'a'), ('Author', 5, 'c'), ('Author', 6, 'd'), ('Author', 7, 'e'), ('Copyright', 1, 'g')) t(name, record_id, string)""")
def metadata_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = metadata.record
    first = spark.createDataFrame([rec("Author", "a"), rec("Author", "b", record_id=5), rec("Copyright", "f", record_id=1)], metadata.SCHEMA).coalesce(1)
    first = metadata.write(metadata.empty(spark), first.filter("record_id is not null"))
    one = spark.createDataFrame([rec("Author", "a", record_id=1), rec("Author", "c", record_id=5), rec("Author", "d"), rec("Author", "e"), rec("Copyright", "g", record_id=1)], metadata.SCHEMA).coalesce(1)
    return metadata.read(metadata.write(first, one)).select("name", "record_id", "string")


@query(f"""WITH {ITEMS_SQL} SELECT 'z' AS element, 'int' AS kind, CAST(max(row) + 1 AS INTEGER) AS n_rows, CAST(max(col) + 1 AS INTEGER) AS n_cols, count(*) AS cells,
  count(DISTINCT (row // 50, col // 20)) AS populated_tiles, CAST(min(z) AS DOUBLE) AS least, CAST(max(z) AS DOUBLE) AS most FROM i""")
def raster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.model import Raster

    i = items(spark, sf_dir)
    return store.summary(Raster(spec_of(i, 50, 20), i))




from tessera.plans import more  # noqa: E402, F401  registers further queries
