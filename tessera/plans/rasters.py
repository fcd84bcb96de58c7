"""Rasters made of the test tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arith import half_up
from tessera.model import Element, Spec

ICF = Element("z", "icf", scale=10000.0)
EVENTS_ICF = Element("z", "icf", scale=100.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row: vector, col: component, z: float; dense."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "z"))


def embed_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(spark, sf_dir).withColumn("z", half_up(F.col("z").cast("double") * 10000, "int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row: part, col: supplier, z: quantity; sparse."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("row"), F.col("l_suppkey").cast("int").alias("col"))
    return g.agg(F.sum("l_quantity").cast("int").alias("z"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row: user, col: hour since the start of 2024, z: value; sparse."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("int").alias("row"), hour.alias("col"))
    return g.agg(F.round(F.sum("value"), 2).alias("z"))


def generated(spark: SparkSession, rows: int = 40, cols: int = 50) -> DataFrame:
    """A dense polynomial surface."""
    i = F.col("id")
    r, c = F.floor(i / cols).cast("int"), (i % cols).cast("int")
    x, y = c / 10.0 - 2.5, r / 10.0 - 2.0
    return spark.range(rows * cols).select(r.alias("row"), c.alias("col"), (x * x * x + x * x * y + y * y * x + y * y * y).alias("z"))


def spec_of(cells: DataFrame, tile_rows: int = 0, tile_cols: int = 0, elements: tuple = (Element("z"),)) -> Spec:
    m = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    rows, cols = m.r + 1, m.c + 1
    return Spec(rows, cols, min(rows, tile_rows or 120), min(cols, tile_cols or 120), elements)


def points(spark: SparkSession, sf_dir: str, rows: int, cols: int) -> DataFrame:
    """Query points within a grid, spread by modular arithmetic."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("point_id"), ((k * 7919 % ((rows - 1) * 100)) / 100.0).alias("grid_row"), ((k * 104729 % ((cols - 1) * 100)) / 100.0).alias("grid_col")
    )


def micro(x: Column) -> Column:
    """x in millionths, rounded half up: comparable whatever the order of a sum."""
    return F.floor(x * 1000000 + 0.5).cast("long")


def micro_sql(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5) AS BIGINT)"


EMBED_SQL = "e AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS col, embedding[i] AS z FROM embeddings, range(1, 65) t(i))"
EMBED_INT_SQL = EMBED_SQL + ", ei AS (SELECT row, col, CAST(floor(CAST(z AS DOUBLE) * 10000 + 0.5) AS INTEGER) AS z FROM e)"
ITEMS_SQL = "i AS (SELECT CAST(l_partkey AS INTEGER) AS row, CAST(l_suppkey AS INTEGER) AS col, CAST(sum(l_quantity) AS INTEGER) AS z FROM lineitem GROUP BY 1, 2)"
EVENTS_SQL = "v AS (SELECT CAST(user_id AS INTEGER) AS row, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS col, round(sum(value), 2) AS z FROM events GROUP BY 1, 2)"
GEN_SQL = """g0 AS (SELECT CAST(i // 50 AS INTEGER) AS row, CAST(i % 50 AS INTEGER) AS col FROM range(0, 2000) t(i)),
g1 AS (SELECT row, col, col / CAST(10 AS DOUBLE) - 2.5 AS x, row / CAST(10 AS DOUBLE) - 2.0 AS y FROM g0),
g AS (SELECT row, col, x * x * x + x * x * y + y * y * x + y * y * y AS z FROM g1)"""


def points_sql(rows: int, cols: int) -> str:
    return f"p AS (SELECT c_custkey AS point_id, (c_custkey * 7919 % {(rows - 1) * 100}) / CAST(100 AS DOUBLE) AS grid_row, (c_custkey * 104729 % {(cols - 1) * 100}) / CAST(100 AS DOUBLE) AS grid_col FROM customer)"
