"""External formats: classic NetCDF, uncompressed or deflated TIFF floats, and PNG images.

Files come through Spark's binaryFile source, a row each, and are decoded in Arrow
functions; a file is one task's work, so large rasters are best kept in many files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# External types of the classic format.
_NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_variables(data: bytes) -> dict[str, np.ndarray]:
    """The variables of a classic NetCDF file (versions 1 and 2), record variables included."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    wide, at = data[3] == 2, 4

    def number(fmt: str = ">I") -> int:
        nonlocal at
        v = struct.unpack_from(fmt, data, at)[0]
        at += struct.calcsize(fmt)
        return v

    def name() -> str:
        nonlocal at
        n = number()
        v = data[at : at + n].decode()
        at += -(-n // 4) * 4
        return v

    def attributes() -> None:
        nonlocal at
        number()
        for _ in range(number()):
            name()
            size = np.dtype(_NC_TYPES[number()]).itemsize
            at += -(-number() * size // 4) * 4

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    found = []
    for _ in range(number()):
        label = name()
        ids = [number() for _ in range(number())]
        attributes()
        kind, _, begin = number(), number(), number(">Q" if wide else ">I")
        found.append((label, ids, np.dtype(_NC_TYPES[kind]), begin))
    is_record = lambda ids: bool(ids) and dims[ids[0]][1] == 0
    size = lambda ids, t: int(np.prod([dims[i][1] for i in ids], dtype=np.int64)) * t.itemsize
    recorded = [(ids[1:], t) for _, ids, t, _ in found if is_record(ids)]
    step = sum(-(-size(i, t) // 4) * 4 for i, t in recorded) if len(recorded) > 1 else sum(size(i, t) for i, t in recorded)
    out = {}
    for label, ids, t, begin in found:
        shape = [dims[i][1] for i in ids]
        if is_record(ids):
            one = size(ids[1:], t)
            parts = [np.frombuffer(data, t, one // t.itemsize, begin + k * step) for k in range(records)]
            out[label] = np.concatenate(parts).reshape([records, *shape[1:]]) if parts else np.zeros([0, *shape[1:]], t)
        else:
            out[label] = np.frombuffer(data, t, size(ids, t) // t.itemsize, begin).reshape(shape)
    return out


def tiff_grid(data: bytes) -> np.ndarray:
    """The first image of a strip- or tile-organised TIFF with one sample per pixel, plain or deflated."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    sizes, tags = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d"}, {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in sizes:
            continue
        fmt = f"{order}{n}{sizes[kind]}"
        place = at + 10 + 12 * k
        if struct.calcsize(fmt) > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        tags[tag] = struct.unpack_from(fmt, data, place)
    width, height, bit, packing = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(259, (1,))[0]
    if packing not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1:
        raise ValueError("this kind of TIFF isn't read")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(339, (1,))[0]] }{bit // 8}")
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    starts, lengths = tags[324 if tiled else 273], tags[325 if tiled else 279]
    out = np.zeros((height, width), kind)
    across = -(-width // tw)
    for k, (s, n) in enumerate(zip(starts, lengths, strict=True)):
        raw = data[s : s + n] if packing == 1 else zlib.decompress(data[s : s + n])
        r, c = k // across * th, k % across * tw
        part = np.frombuffer(raw, kind, len(raw) // kind.itemsize).reshape(-1, tw)
        if tags.get(317, (1,))[0] == 2:
            part = part.cumsum(1, dtype=kind)
        out[r : r + th, c : c + tw] = part[: height - r, : width - c]
    return out


def png_grid(data: bytes) -> np.ndarray:
    """Packed RGB of an 8-bit, non-interlaced, grey or true-colour PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or not channels:
        raise ValueError("this kind of PNG isn't read")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        f, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if f == 1:
            line = line.reshape(-1, channels).cumsum(0).reshape(-1)
        elif f == 2:
            line = line + above
        elif f in (3, 4):
            for i in range(len(line)):
                a = line[i - channels] if i >= channels else 0
                b, c = above[i], above[i - channels] if i >= channels else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[i] = (line[i] + ((a + b) // 2 if f == 3 else near)) & 255
        above = line & 255
        out[y] = above
    p = out.reshape(height, width, channels).astype(np.int32)
    r, g, b = (p[..., 0],) * 3 if channels < 3 else (p[..., 0], p[..., 1], p[..., 2])
    return r << 16 | g << 8 | b


def to_png(rgb: np.ndarray) -> bytes:
    """A true-colour PNG of packed RGB."""
    h, w = rgb.shape
    p = np.stack([(rgb >> s) & 255 for s in (16, 8, 0)], 2).astype(np.uint8).reshape(h, -1)
    body = zlib.compress(np.c_[np.zeros((h, 1), np.uint8), p].tobytes(), 6)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


DECODERS = {"netcdf": None, "tiff": tiff_grid, "png": png_grid}


def read_grid(spark: SparkSession, path: str, format: str, variable: str = "z") -> DataFrame:
    """file, row, col, z (double) of each grid file under a path."""
    if format not in DECODERS:
        raise ValueError(f"no format {format!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.squeeze(netcdf_variables(data)[variable]) if format == "netcdf" else DECODERS[format](data)
                for r in range(0, z.shape[0], max(1, 100_000 // max(1, z.shape[1]))):
                    part = z[r : r + max(1, 100_000 // max(1, z.shape[1]))]
                    rows, cols = np.mgrid[r : r + part.shape[0], : part.shape[1]]
                    yield pa.record_batch([pa.array([file] * part.size), pa.array(rows.reshape(-1).astype(np.int32)), pa.array(cols.reshape(-1).astype(np.int32)), pa.array(part.astype(np.float64).reshape(-1))], names=["file", "row", "col", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row int, col int, z double")


def tiles_to_png(cells: DataFrame, tile_rows: int, tile_cols: int, rgb: str = "rgb") -> DataFrame:
    """tile_row, tile_col, png: an image of each tile, missing cells black; a group is one tile."""

    def render(key: tuple, t: pa.Table) -> pa.Table:
        image = np.zeros((tile_rows, tile_cols), np.int64)
        image[t["row"].to_numpy() % tile_rows, t["col"].to_numpy() % tile_cols] = t[rgb].to_numpy() & 0xFFFFFF
        return pa.table({"tile_row": pa.array([key[0].as_py()], pa.int32()), "tile_col": pa.array([key[1].as_py()], pa.int32()), "png": pa.array([to_png(image)], pa.binary())})

    keyed = cells.selectExpr("row", "col", f"`{rgb}`", f"cast(floor(row / {tile_rows}) as int) as tile_row", f"cast(floor(col / {tile_cols}) as int) as tile_col")
    return keyed.groupBy("tile_row", "tile_col").applyInArrow(render, "tile_row int, tile_col int, png binary")
