import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arith, colour, grid
from tessera.model import INT_MIN, Element, Raster, Spec, identifier, inverse
from tessera.operators import bits, cells, codecs, interpolate, metadata, palette, predictors, stats, terrain
from tessera.sources import formats, store
from tessera.streaming import patches


def test_identifiers_and_specs():
    assert identifier("Abc_1") and not identifier("1a") and not identifier("a-b") and not identifier("a" * 33) and not identifier("")
    with pytest.raises(ValueError):
        Spec(5, 5, 6, 5)
    with pytest.raises(ValueError):
        Spec(5, 5, elements=(Element("z"), Element("z")))
    assert (Spec(300, 50).tile_rows, Spec(300, 50).tile_cols) == (120, 50)
    e = Element("z", "int", fill=-9999)
    assert (e.low, e.high, Element("z").low) == (INT_MIN, 2**31 - 1, INT_MIN + 1)
    spec = Spec(7, 13, elements=(Element("z", "icf", scale=100.0), Element("f", "float"))).geographic(-3, 179, 3, -179)
    again = Spec.from_json(spec.to_json())
    assert (again.x1, again.tile_cols, again.element("z").scale) == (181, 13, 100.0)
    assert Spec(6, 12).geographic_cells(-75, -165, 30, 30).wraps and Spec(6, 13).geographic(-75, -180, 75, 180).brackets


def test_rotation_maps_both_ways():
    k = math.sqrt(0.5)
    spec = Spec(11, 11).affine(k, -k, 0, k, k, -10 * k)
    assert inverse(inverse(spec.to_grid)) == pytest.approx(spec.to_grid)
    x0, y0, x1, y1 = spec.bounds
    assert x1 - x0 == pytest.approx(11 * math.sqrt(2)) and y1 - y0 == pytest.approx(11 * math.sqrt(2))
    with pytest.raises(ValueError):
        Spec(3, 3).affine(1, 1, 0, 1, 1, 0)


def test_geographic_cells_at_the_edges(spark):
    h = 1 / 120
    spec = Spec(10800, 21600).geographic_cells(-90 + h, -180 + h, 2 * h, 2 * h)
    pts = [(h / 4, h / 4), (-h, -h), (-90.0, -180.0), (90.0, 180.0)]
    row, col = grid.geo_to_grid(spec, F.col("lat"), F.col("lon"))
    r, c = grid.rounded(spec, row, col)
    found = [tuple(x) for x in spark.createDataFrame(pts, "lat double, lon double").coalesce(1).select(r, c).collect()]
    assert found[:2] == [(5400, 10800), (5399, 10799)] and found[2] == (0, 0) and found[3][0] == 10799
    assert all(grid_ok for grid_ok in (0 <= a < 10800 and 0 <= b < 21600 for a, b in found))


def test_wrapping_and_rounding(spark):
    df = spark.createDataFrame([(2147483648, -2.5), (-2147483649, float("nan")), (5, 1e300)], "a long, x double").coalesce(1)
    rows = df.select(arith.wrap32(F.col("a")), arith.truncated(F.col("x")), arith.to180(F.lit(540.0)), arith.to360(F.lit(-1.0))).collect()
    assert [r[0] for r in rows] == [INT_MIN, 2**31 - 1, 5] and [r[1] for r in rows] == [-2, 0, 2**31 - 1] and tuple(rows[0])[2:] == (-180.0, 359.0)


def test_values_and_fill(spark):
    icf = Element("z", "icf", scale=10.0)
    df = spark.createDataFrame([(1.25,), (float("nan"),), (None,)], "z float").coalesce(1)
    stored = [r[0] for r in df.select(grid.to_stored(icf, F.col("z")).alias("c")).collect()]
    assert stored == [13, INT_MIN, INT_MIN]
    back = [r[0] for r in df.select(grid.icf_decode(icf, grid.to_stored(icf, F.col("z")))).collect()]
    assert back[0] == pytest.approx(1.3, abs=1e-6) and back[1:] == [None, None]
    short = Element("s", "short", 0, 10, -1)
    ok = spark.createDataFrame([(0,), (10,), (11,), (-1,)], "s int").coalesce(1).select(grid.supported(short, F.col("s"))).collect()
    assert [r[0] for r in ok] == [True, True, False, True]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(r, c, r * 20 + c - 50, float(r * 20 + c) / 10) for r in range(10) for c in range(10)]
    return spark.createDataFrame(rows, "row int, col int, z int, f float")


@pytest.mark.parametrize("compressed", [False, True])
def test_store_round_trip(spark, small, tmp_path, compressed):
    spec = Spec(10, 20, 10, 10, (Element("z", fill=-9999), Element("f", "float")), compressed=compressed)
    records = spark.createDataFrame([metadata.record("Author", "me", record_id=1)], metadata.SCHEMA)
    store.create(str(tmp_path / "r"), Raster(spec, small), records)
    raster = store.open_(spark, str(tmp_path / "r"))
    assert raster.spec.to_json() == spec.to_json()
    assert cells.differences(small, raster.cells.select("row", "col", "z", "f")).count() == 0
    assert store.rows(raster, 3, 4).count() == 20
    s = {r.element: r for r in store.summary(raster).collect()}
    assert s["z"].populated_tiles == 1 and s["z"].cells == 100 and s["f"].most == pytest.approx(18.9)
    filled = cells.dense_block(spark, raster.cells, 9, 8, 1, 4, {"z": -9999}).orderBy("col").collect()
    assert [r.z for r in filled] == [138, 139, -9999, -9999]
    assert metadata.read(store.read_metadata(spark, str(tmp_path / "r"))).first().string == "me"
    if compressed:
        assert store.inspect(spark, str(tmp_path / "r")).count() == 0
        packed = spark.read.parquet(str(tmp_path / "r/tiles"))
        broken = packed.withColumn("packing", F.concat("packing", F.lit("x").cast("binary")))
        assert codecs.damaged(broken).count() == packed.count()
        assert store.bit_rate(packed, spec).first().bit_rate > 0


def test_writes_outside_are_errors(spark, tmp_path):
    bad = spark.createDataFrame([(10, 0, 1)], "row int, col int, z int")
    with pytest.raises(Exception, match="outside the grid"):
        store.create(str(tmp_path / "a"), Raster(Spec(10, 20, elements=(Element("z"),)), bad))
    bad = spark.createDataFrame([(1, 0, 99)], "row int, col int, z int")
    with pytest.raises(Exception, match="doesn't take"):
        store.create(str(tmp_path / "b"), Raster(Spec(10, 20, elements=(Element("z", high=50),)), bad))


def test_pushdown_reaches_the_scan(spark, small, tmp_path):
    store.create(str(tmp_path / "r"), Raster(Spec(10, 10, 5, 5, (Element("z"), Element("f", "float"))), small))
    plan = store.rows(store.open_(spark, str(tmp_path / "r")), 0, 2).select("z")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tile_row" in plan and "PushedFilters: [IsNotNull(row), GreaterThanOrEqual(row,0)" in plan
    assert "ReadSchema: struct<row:int,z:int>" in plan


def test_erase_and_tiles(spark, small):
    spec = Spec(10, 20, 10, 10, (Element("z"),))
    assert stats.populated_tiles(small, spec).first()[0] == 1
    assert cells.erase(small, small.filter("row = 0")).count() == 90
    patch = spark.createDataFrame([(0, 15, 1066)], "row int, col int, z int")
    more = cells.upsert(small, patch)
    assert stats.populated_tiles(more, spec).first()[0] == 2 and more.count() == 101
    tiles = cells.tile_form(more, spec, "z")
    assert cells.differences(more.select("row", "col", "z"), cells.cell_form(tiles, spec, "z")).count() == 0
    assert cells.densify(spark, more, spec).count() == 200


LENGTHS = {0: 1, 126: 1, 127: 2, -128: 2, 254: 2, 255: 3, 16638: 3, 16639: 4, 2113790: 4, 2113791: 5, 270549246: 5, 270549247: 6, 2**31 - 1: 6, INT_MIN + 1: 6, INT_MIN: 1}


def test_m32():
    v = np.array(list(LENGTHS))
    assert bits.m32_lengths(v).tolist() == list(LENGTHS.values()) and len(bits.m32_encode(v)) == sum(LENGTHS.values())
    v = np.arange(-32780, 32780)
    assert (bits.m32_decode(bits.m32_encode(v), len(v)) == v).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(INT_MIN, 2**31 - 1), min_size=1, max_size=60), st.integers(0, 40))
def test_coders_round_trip(values, shift):
    v = np.array(values) >> shift
    assert (bits.m32_decode(bits.m32_encode(v), len(v)) == v).all()
    assert (bits.huffman_decode(bits.huffman_encode(v)) == v).all()


def test_bit_store():
    rng = np.random.default_rng(1)
    widths = rng.integers(1, 33, 3000)
    values = rng.integers(0, 2**32, 3000) & ((1 << widths) - 1)
    r = bits.BitReader(bits.pack_bits(values, widths))
    assert [r.read(int(w)) for w in widths] == values.tolist()


def test_code_lengths_are_limited():
    counts = np.array([2**i for i in range(24)])
    n = bits.code_lengths(counts)
    assert n.max() <= 15 and sum(2.0 ** -n[n > 0]) == 1


@pytest.mark.parametrize("shape", [(10, 10), (6, 9), (30, 60), (1, 7), (7, 1)])
def test_codecs_round_trip(shape):
    rng = np.random.default_rng(2)
    ramp = np.add.outer(np.arange(shape[0]), np.arange(shape[1]) % 2 * 5)
    tiles = [ramp, rng.integers(INT_MIN, 2**31, shape), np.full(shape, -3), np.where(np.eye(*shape) > 0, INT_MIN, ramp), np.full(shape, INT_MIN)]
    for z in tiles:
        z = z.astype(np.int32)
        for codec in codecs.default_registry(True).codecs.values():
            if codec.takes == "int" and (data := codec.encode(z)) is not None:
                assert (codec.decode(data, shape) == z).all()
    f = rng.normal(size=shape).astype(np.float32)
    f.flat[0] = np.nan
    assert (codecs.FloatPlanes().decode(codecs.FloatPlanes().encode(f), shape).view(np.int32) == f.view(np.int32)).all()


def test_huffman_takes_the_shortest_predictor():
    rng = np.random.default_rng(4)
    noise = rng.integers(-60, 60, (20, 16))
    for z, best in ((noise, "differencing"), (noise.cumsum(1).cumsum(1), "linear"), (noise.cumsum(0).cumsum(1), "triangle")):
        z = z.astype(np.int32)
        data = codecs.Huffman().encode(z)
        assert data[0] == predictors.TYPES[best] and (codecs.Huffman().decode(data, z.shape) == z).all()


def test_competition_keeps_incompressible_tiles_raw(spark):
    rng = np.random.default_rng(0)
    smooth, noise = (np.arange(900) // 7).tolist(), rng.integers(INT_MIN + 1, 2**31, 900).tolist()
    tiles = spark.createDataFrame([(0, "z", smooth), (1, "z", noise)], "tile_index int, element string, values array<int>")
    best = codecs.shortest(codecs.encode_tiles(tiles, (30, 30)))
    assert {r.tile_index: r.codec for r in best.collect()}[1] == "raw"
    assert {r.tile_index: r["values"] for r in codecs.decode_tiles(best, (30, 30)).collect()} == {0: smooth, 1: noise}
    assert codecs.report(best, 900).count() == 2


def test_registry():
    r = codecs.default_registry()
    with pytest.raises(ValueError):
        r.add("not ok", codecs.Deflate())
    with pytest.raises(TypeError):
        r.add("x", object())
    r.add("deflate", codecs.Deflate(9))
    assert r.index("deflate") == 1 and r.get("deflate").level == 9
    r.remove("huffman")
    assert r.index("deflate") == 0
    r.remove()
    assert not r.codecs


@pytest.mark.parametrize("name", list(predictors.ENCODERS))
def test_predictors_agree_with_the_tile_coder(spark, name):
    rng = np.random.default_rng(3)
    z = np.add.outer(np.arange(8), np.arange(6) % 2 * 3) + rng.integers(-2, 3, (8, 6))
    z[0, 0], z[5, 5] = 2**31 - 1, -(2**31) + 5
    rows = [(0, r, c, None if name == "with_nulls" and (r == c or r == 3) else int(z[r, c])) for r in range(8) for c in range(6)]
    df = spark.createDataFrame(rows, "tile_index int, r int, c int, z int")
    coded = predictors.ENCODERS[name](df)
    back = predictors.DECODERS[name](coded.drop("z"))
    assert {(r.r, r.c): r.z for r in back.collect()} == {(r, c): v for _, r, c, v in rows}
    x = np.array([INT_MIN if v is None else v for *_, v in rows]).reshape(8, 6).astype(np.int32)
    seed, d = codecs.residuals(x, name)
    found = {(r.r, r.c): r.residual for r in coded.collect()}
    for (r, c), v in found.items():
        expected = None if x[r, c] == INT_MIN else int(d[r, c]) if name == "with_nulls" or (r, c) != (0, 0) else seed
        assert v == expected


def surface(spark, f, rows, cols, h):
    return spark.createDataFrame([(r, c, float(f(c * h, r * h))) for r in range(rows) for c in range(cols)], "row int, col int, z double")


def test_spline_of_a_cubic(spark):
    h = 0.1
    f = lambda x, y: x**3 + x * x * y + y * y * x + y**3
    pts = [(i * 41 + j, i / 4, j / 4) for i in range(41) for j in range(41)]
    s = interpolate.spline(spark.createDataFrame(pts, "point_id long, grid_row double, grid_col double"), surface(spark, f, 11, 11, h), Spec(11, 11), "z", h, h, 2)
    for r in s.collect():
        x, y = r.grid_col * h, r.grid_row * h
        assert r.z == pytest.approx(f(x, y), abs=3e-2)
        assert r.zx == pytest.approx(3 * x * x + 2 * x * y + y * y, abs=2e-2) and r.zy == pytest.approx(x * x + 2 * x * y + 3 * y * y, abs=2e-2)
        assert r.zxx == pytest.approx(6 * x + 2 * y, abs=1e-4) and r.zxy == pytest.approx(2 * x + 2 * y, abs=1e-4) and r.zyy == pytest.approx(2 * x + 6 * y, abs=1e-4)


def test_spline_across_the_seam_and_beyond(spark):
    wave = (0, 1, 2, 2, 1, 0, 0, 1, 2, 2, 1, 0)
    df = spark.createDataFrame([(r, c, float(wave[c])) for r in range(6) for c in range(12)], "row int, col int, z double")
    spec = Spec(6, 12).geographic_cells(-75, -165, 30, 30)
    pts = [(k, x, y) for k, (x, y) in enumerate((180 * s + d, lat) for d in (-20.0, -3.0, 0.0, 7.0) for lat in (0.0, 20.0) for s in (0, 1))]
    s = interpolate.spline(interpolate.at_model(spark.createDataFrame(pts, "point_id long, x double, y double"), spec), df, spec)
    z = [r.z for r in s.orderBy("point_id").collect()]
    assert z[::2] == pytest.approx(z[1::2], abs=1e-9)
    outside = spark.createDataFrame([(0, 6.0, 3.0), (1, float("nan"), 3.0)], "point_id long, grid_row double, grid_col double")
    assert [r.z for r in interpolate.spline(outside, df, spec).collect()] == [None, None]
    with pytest.raises(ValueError):
        interpolate.spline(outside, df, Spec(3, 12))


def test_missing_sample_gives_null(spark):
    df = surface(spark, lambda x, y: x, 10, 100, 1).filter("not (row = 5 and col = 65)")
    pts = spark.createDataFrame([(0, 5.0, 64.0), (1, 5.0, 60.5), (2, 5.0, 63.0)], "point_id long, grid_row double, grid_col double")
    z = {r.point_id: r.z for r in interpolate.spline(pts, df, Spec(10, 100)).collect()}
    assert z[0] is None and z[1] == pytest.approx(60.5) and z[2] is None
    b = {r.point_id: r.z for r in interpolate.bilinear(pts, df, Spec(10, 100)).collect()}
    assert b[1] == pytest.approx(60.5) and b[0] is None and b[2] == pytest.approx(63)


def test_normals_of_a_slope(spark):
    df = surface(spark, lambda x, y: 2 * x, 8, 8, 1.0)
    pts = spark.createDataFrame([(0, 3.5, 3.5)], "point_id long, x double, y double")
    r = interpolate.normals(pts, df, Spec(8, 8).cartesian_cells(0, 0, 1, 1)).first()
    assert (r.nx, r.ny, r.nz) == pytest.approx((-2 / math.sqrt(5), 0, 1 / math.sqrt(5)), abs=1e-9)
    shade = spark.range(1).select(terrain.hillshade(F.lit(0.0), F.lit(0.0))).first()[0]
    assert shade == pytest.approx(0.2 + 0.8 * math.sin(math.radians(60)))


CPT = """# COLOR_MODEL = RGB
# HINGE 0
-11000 10/20/30 -5000 20/40/60
-5000\t20 40 60\t0\t192 192 192 ; shelf
0 192 192 192 8000 255 255 255
B black
F white
N gray
"""


def test_palette(spark):
    p = palette.parse(CPT)
    assert (p.background, p.foreground, p.null_colour, p.hinge, p.covered, p.records[1].label) == ((0, 0, 0), (255, 255, 255), (128, 128, 128), 0.0, True, "shelf")
    df = spark.createDataFrame([(0.0,), (-20000.0,), (9000.0,), (None,), (8000.0,), (-8000.0,)], "z double").coalesce(1)
    found = [r[0] & 0xFFFFFFFF for r in df.select(palette.argb(p, F.col("z"))).collect()]
    assert found == [0xFFC0C0C0, 0xFF000000, 0xFFFFFFFF, 0xFF808080, 0xFFFFFFFF, 0xFF0F1E2D]
    assert df.select(palette.argb(p, F.col("z"), clamp=True)).first()[0] & 0xFFFFFFFF == 0xFFC0C0C0
    cats = palette.parse("1 red 2 red ;Shrubland\n3 green 4 green;Savanna\n5 10/20/30\n")
    assert [r.label for r in cats.records[:2]] == ["Shrubland", "Savanna"] and not cats.covered
    gap = spark.createDataFrame([(2.5,), (2.0,), (5.0,)], "z double").coalesce(1).select(palette.argb(cats, F.col("z")), palette.label_of(cats, F.col("z"))).collect()
    assert gap[0][0] is None and gap[1][1] == "Shrubland" and gap[2][0] & 0xFFFFFF == 0x0A141E
    assert p.ranged(0, 1).records[0].range0 == 0 and p.frame(spark).count() == 3
    assert palette.colour_names("255 250 250 Snow White\n") == {"snowwhite": (255, 250, 250)}


def test_hsv_and_hues(spark):
    import colorsys

    rows = [(float(h), s / 4, v / 4) for h in range(0, 360, 17) for s in range(5) for v in range(5)]
    df = spark.createDataFrame(rows, "h double, s double, v double").coalesce(1).select("h", "s", "v", *colour.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v")))
    for h, s, v, *rgb in df.collect():
        assert rgb == pytest.approx([255 * x for x in colorsys.hsv_to_rgb(h / 360, s, v)], abs=0.51)
    assert palette.hue_step(350, 10) == 20 and palette.hue_step(10, 350) == -20
    p = palette.parse("# COLOR_MODEL = HSV\n0 350 1 1 10 10 1 1\n")
    assert spark.range(1).select(palette.argb(p, F.lit(5.0))).first()[0] & 0xFFFFFF == 0xFF0000


def test_metadata(spark):
    none = metadata.empty(spark)
    new = spark.createDataFrame([metadata.record("A", "x"), metadata.record("A", "y"), metadata.record("B", [1, 2], "short", 4)], metadata.SCHEMA).coalesce(1)
    m = metadata.write(none, new)
    assert [(r.name, r.record_id) for r in metadata.read(m).collect()] == [("A", 1), ("A", 2), ("B", 4)]
    m = metadata.write(m, spark.createDataFrame([metadata.record("A", "z", record_id=2)], metadata.SCHEMA))
    assert [r.string for r in metadata.read(m, "A").collect()] == ["x", "z"] and metadata.delete(m, "A", 1).count() == 2
    b = metadata.read(m, "B", 4).first()
    assert metadata.as_integers(b) == [1, 2] and metadata.as_doubles(b) == [1.0, 2.0]
    for bad in (("9", "x"), ("A", 70000, "short"), ("A", "é", "ascii"), ("A", "x", "no")):
        with pytest.raises(ValueError):
            metadata.record(*bad)
    with pytest.raises(TypeError):
        metadata.as_string(b)


def test_formats(spark, tmp_path):
    z = np.arange(12, dtype=np.float32).reshape(3, 4) / 2
    strip = zlib.compress(z.astype("<f4").tobytes())
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 32), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, len(strip)), (339, 3, 3)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + bytes(4)
    (tmp_path / "a.tif").write_bytes(b"II*\0" + struct.pack("<I", 8 + len(strip)) + strip + ifd)
    found = {(r.row, r.col): r.z for r in formats.read_grid(spark, str(tmp_path / "a.tif"), "tiff").collect()}
    assert found == {(r, c): float(z[r, c]) for r in range(3) for c in range(4)}
    name = lambda s: struct.pack(">I", len(s)) + s + bytes(-len(s) % 4)
    head = b"CDF\1" + struct.pack(">III", 0, 10, 2) + name(b"lat") + struct.pack(">I", 3) + name(b"lon") + struct.pack(">I", 4) + struct.pack(">II", 0, 0)
    head += struct.pack(">II", 11, 1) + name(b"z") + struct.pack(">III", 2, 0, 1) + struct.pack(">II", 0, 0) + struct.pack(">II", 5, 48)
    (tmp_path / "a.nc").write_bytes(head + struct.pack(">I", len(head) + 4) + z.astype(">f4").tobytes())
    assert {(r.row, r.col): r.z for r in formats.read_grid(spark, str(tmp_path / "a.nc"), "netcdf").collect()} == found
    rgb = np.arange(30).reshape(5, 6) * 65793 % 16777216
    assert (formats.png_grid(formats.to_png(rgb)) == rgb).all()
    df = spark.createDataFrame([(int(r), int(c), int(rgb[r, c])) for r in range(5) for c in range(6)], "row int, col int, rgb int")
    png = formats.tiles_to_png(df, 5, 6).first().png
    assert (formats.png_grid(bytes(png)) == rgb).all()


def test_patch_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 0, 0, 1.0), ("2024-01-01 00:10:00", 0, 0, 2.0), ("2024-01-01 03:00:00", 5, 5, 3.0)]
    df = spark.createDataFrame(rows, "ts string, row int, col int, z double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    patches.ingest(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(120)
    now = patches.current(spark.read.parquet(str(tmp_path / "log")))
    assert sorted(tuple(r) for r in now.collect()) == [(0, 0, 2.0), (5, 5, 3.0)]
    q = patches.tile_activity(stream, Spec(10, 10, 5, 5)).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.tile_index, r.patches, r["mean"]) for r in spark.sql("select * from activity").collect()) == [(0, 2, 1.5), (3, 1, 3.0)]


def test_statistics(spark):
    df = spark.createDataFrame([(0, c, c % 4) for c in range(16)], "row int, col int, z int")
    assert stats.entropy(stats.symbol_counts(df, F.col("z"))).first().bits == pytest.approx(2)
    assert stats.order1_entropy(stats.in_row_pairs(df, F.col("z"))).first().bits == pytest.approx(0)
    floats = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)], "z float")
    assert stats.float_bits(floats).select("bits").distinct().count() == 3
    spec = stats.downsampled_spec(Spec(10, 9).cartesian_cells(0, 0, 1, 2), 3)
    assert (spec.n_rows, spec.n_cols, spec.x0, spec.y0, spec.cell_x) == (3, 3, 1, 2, 3)
    assert stats.exact_sum(spark.createDataFrame([(0.1,)] * 10, "z double")).first().total == 1.0


def test_store_opens_under_another_registry(spark, tmp_path):
    cells_ = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), (F.col("id") * 7 % 50).cast("int").alias("z"))
    spec = Spec(20, 20, 10, 10, (Element("z"),), compressed=True)
    path = str(tmp_path / "r")
    store.create(path, Raster(spec, cells_), registry=codecs.default_registry(True))
    assert store.codecs_of(spark, path)[:2] == ["huffman@1", "deflate@1"] and len(store.codecs_of(spark, path)) == 6
    other = codecs.Registry(**dict(reversed(codecs.default_registry(True).codecs.items())), raw2=codecs.Deflate(1))
    assert sorted(map(tuple, store.open_(spark, path, other).cells.collect())) == sorted(map(tuple, cells_.collect()))
    used = {store.codecs_of(spark, path)[r[0]].split("@")[0] for r in spark.read.parquet(f"{path}/tiles").select("codec_index").distinct().collect()}
    lacking = codecs.default_registry(True)
    for name in used:
        lacking.remove(name)
    with pytest.raises(Exception, match="no codec"):
        store.open_(spark, path, lacking).cells.collect()
    some = store.open_rows(spark, path, 12, 14)
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in cells_.collect() if 12 <= r.row <= 14)
    assert "tile_row" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]
    who = store.identity(spark, path)
    assert len(who["uuid"]) == 36 and who["created"] == who["modified"]


def test_smaller_least_squares_stencil():
    rng = np.random.default_rng(3)
    codec = codecs.LeastSquares(predictors.NEIGHBOURS_8, 4)
    assert codec.ahead == 0 and (-2, -2) in codec.neighbours and (-1, 1) not in codec.neighbours
    # A field in which each cell is a fixed mean of two of the eight neighbours: these coefficients come back.
    z = rng.integers(-1000, 1000, (30, 40)).astype(np.int64) * 1024
    for r in range(2, 30):
        for c in range(2, 40):
            z[r, c] = 3 * z[r - 2, c - 2] // 4 + z[r, c - 1] // 4 + rng.integers(-3, 4)
    k = codec.coefficients(z.astype(np.int32))
    expected = np.array([{(0, -1): 0.25, (-2, -2): 0.75}.get(n, 0.0) for n in predictors.NEIGHBOURS_8])
    assert np.abs(k - expected).max() < 1e-3
    r, c = codec._inside(z.shape)
    assert c.max() == 39 and (codec.decode(codec.encode(z.astype(np.int32)), z.shape) == z).all()


def test_checksums_side_by_side():
    rng = np.random.default_rng(1)
    data = [rng.bytes(int(n)) for n in rng.integers(0, 90, 50)] + [b"", b"123456789"]
    assert bits.crc32c_all(data) == [bits.crc32c_bytes(d) for d in data] and bits.crc32c_all(data)[-1] == 0xE3069283


def test_exact_sum_is_exact(spark):
    z = [1e30, 1.0, -1e30, 1e-30, 5e-324, 2.0**1000, -(2.0**1000), None, float("nan"), 0.1, 0.1, 0.1]
    one = lambda v: tuple(stats.exact_sum(spark.createDataFrame([(x,) for x in v], "z double")).first())
    assert one(z) == (math.fsum(x for x in z if x is not None and x == x), 10)
    assert one([float("inf"), 1.0]) == (float("inf"), 2) and one([None]) == (None, 0)


def test_patch_with_repeated_cells(spark):
    base, patch = spark.createDataFrame([(0, 0, 1)], "row int, col int, z int"), spark.createDataFrame([(0, 0, 5), (0, 0, 7), (0, 0, None), (1, 1, 2)], "row int, col int, z int")
    assert sorted(map(tuple, cells.upsert(base, patch).collect())) == [(0, 0, 7), (1, 1, 2)]


def test_sparse_tiles_are_linear(spark):
    import time

    big = spark.range(40_000).select(F.floor(F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), F.col("id").cast("int").alias("z")).filter("z % 3 <> 1")
    began = time.time()
    (tile,) = cells.tile_form(big, Spec(200, 200, 200, 200), "z").collect()
    assert tile["values"] == [i if i % 3 != 1 else None for i in range(40_000)] and time.time() - began < 30


def test_tiles_side_by_side():
    rng = np.random.default_rng(5)
    z = rng.integers(INT_MIN + 1, 2**31, (300, 7, 5)).astype(np.int32)
    z[rng.random(z.shape) < rng.random((300, 1, 1))] = INT_MIN
    seed, d = codecs.residuals_all(z, "with_nulls")
    assert (codecs.restored_all(seed, d, "with_nulls") == z).all()
    for one, s, e in zip(z, seed.tolist(), d, strict=True):
        prior = [[int(one[r, c - 1] if c else one[r - 1, 0] if r else INT_MIN) for c in range(5)] for r in range(7)]
        starts = [int(one[r, c]) for r in range(7) for c in range(5) if one[r, c] != INT_MIN and prior[r][c] == INT_MIN]
        assert s == (math.floor(sum(starts) / len(starts) + 0.5) if starts else 0)
        for (r, c), v in np.ndenumerate(one):
            assert e[r, c] == (INT_MIN if v == INT_MIN else (int(v) - (s if prior[r][c] == INT_MIN else prior[r][c]) + 2**31) % 2**32 - 2**31)
    whole = np.where(z == INT_MIN, 3, z)
    for p in ("differencing", "linear", "triangle"):
        seed, d = codecs.residuals_all(whole, p)
        assert (codecs.restored_all(seed, d, p) == whole).all() and (d[:, 0, 0] == 0).all()


def test_best_packing_is_the_shortest(spark):
    rng = np.random.default_rng(7)
    shape = (12, 9)
    ramp = np.add.outer(np.arange(12), np.arange(9) * 3)
    zs = [ramp, np.full(shape, 5), np.full(shape, INT_MIN), rng.integers(INT_MIN + 1, 2**31, shape), rng.integers(0, 2, shape), rng.integers(-300, 300, shape), rng.choice([0, 0, 0, 70_000], shape)]
    zs += [np.where(rng.random(shape) < k / 8, z, INT_MIN) for z in zs for k in range(1, 8)]
    zs = [z.astype(np.int32) for z in zs]
    for registry in (codecs.default_registry(True), codecs.Registry(canonical=codecs.CanonicalHuffman(), huffman=codecs.Huffman(), deflate=codecs.Deflate()), codecs.Registry()):
        for z in zs:
            for codec in registry.codecs.values():
                if codec.takes == "int" and hasattr(codec, "at_least"):
                    assert codec.at_least(z) <= len(codec.encode(z))
        tiles = spark.createDataFrame([(i, "z", z.reshape(-1).tolist()) for i, z in enumerate(zs)], "tile_index int, element string, values array<int>")
        best = {r.tile_index: (r.codec_index, r.codec, bytes(r.packing)) for r in codecs.shortest(codecs.encode_tiles(tiles, shape, registry=registry)).collect()}
        assert best == {i: codecs.best_packing(z, "int", registry) for i, z in enumerate(zs)}


@pytest.mark.parametrize("compressed", [False, True])
def test_a_tile_row_is_one_file(spark, tmp_path, compressed):
    cells_ = spark.range(4000).select(F.floor(F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), F.col("id").cast("int").alias("z"), F.col("id").cast("float").alias("f"))
    for names in (("z",), ("z", "f")):
        path = str(tmp_path / "-".join(names))
        spec = Spec(20, 200, 5, 4, tuple(Element(n, "float" if n == "f" else "int") for n in names), compressed=compressed)
        store.create(path, Raster(spec, cells_.select("row", "col", *names)))
        files = spark.read.parquet(f"{path}/{'tiles' if compressed else 'cells'}").inputFiles()
        assert len(files) == 4
        assert cells.differences(store.open_(spark, path).cells.select("row", "col", *names), cells_.select("row", "col", *names)).count() == 0
