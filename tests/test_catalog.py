"""Every raster query against its DuckDB twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES, flagship

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = rows_of(df.columns, df.collect())
    assert found
    if name in ORACLE_SQL:
        twin = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(twin.columns)
        assert found == rows_of(twin.columns, twin.fetchall())


def test_entry(spark):
    assert flagship(spark, SF).count() > 0


def test_null_predictors_beyond_64_tiles(spark, tmp_path):
    cells = [(0, 1024, 7), (1, 1030, 9), (20, 0, 100), (21, 3, 50), (2_000_040, 5, 3)]
    spark.createDataFrame(cells, "l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    across = 65
    index = {(r // 20 * across + c // 16, r % 20, c % 16): z for r, c, z in cells}
    pred = QUERIES["pred_nulls"](spark, str(tmp_path)).collect()
    assert len(pred) == len({(r.tile_index, r.r, r.c) for r in pred}) == 3 * 320
    assert {r.tile_index: r.seed for r in pred} == {64: 8, across: 75, 100_002 * across: 3}
    decoded = QUERIES["decode_nulls"](spark, str(tmp_path)).collect()
    assert {(r.tile_index, r.r, r.c): r.z for r in decoded if r.z is not None} == index


def test_ycocg_beyond_32_bits(spark, tmp_path):
    cells = [(1_199_999, 59_999, 7), (3, 59_999, 50), (1_199_999, 2, 1)]
    spark.createDataFrame(cells, "l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(r.row, r.col): (r.y, r.co, r.cg, r.back) for r in QUERIES["ycocg_roundtrip"](spark, str(tmp_path)).collect()}
    expected = {}
    for row, col, z in cells:
        rgb = (row * 7919 + col * 104729 + z) % 16777216
        r, g, b = rgb >> 16, rgb >> 8 & 255, rgb & 255
        t = b + (r - b >> 1)
        expected[row, col] = t + (g - t >> 1), r - b, g - t, rgb
    assert found == expected


def test_tiles_are_put_together_without_lists(spark):
    """Cells meet in tiles sorted, as plain columns: lists of structs cost the JVM more than all else did."""
    plan = QUERIES["pred_nulls"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_scan_shapes_beyond_32_bits_of_tiles(spark, tmp_path):
    """A scan numbers no tiles, so their numbers can't outgrow 32 bits."""
    cells = [(2_000_000_000, 1_999_999_999, 5), (2_000_000_001, 1_999_999_998, 6), (0, 0, 7)]
    spark.createDataFrame(cells, "l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["shape"]: (r.reads, r.n, r.total) for r in QUERIES["scan_shapes"](spark, str(tmp_path)).collect()}
    assert found == {"row_major": (3, 3, 18.0), "column_major": (3, 3, 18.0), "row_block": (2, 3, 18.0), "tile_block": (2, 3, 18.0), "tile_load": (2, 3, 18.0)}
