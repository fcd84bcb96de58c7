"""Tile codecs, their registry, and the competition between them.

A codec works on one tile in numpy inside an Arrow function; tiles are rows, so encoding
and decoding are parallel and need no shuffle.  Packings begin with the codec's index, the
predictor's code and the seed.  A tile holds each element in whichever codec is shortest,
or raw if none is shorter than that.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import Spec, identifier
from tessera.operators import bits
from tessera.operators.predictors import NEIGHBOURS, NEIGHBOURS_8, TYPES

INT_MIN = bits.INT_MIN
RAW = 255
#: Cells of tiles predicted or decoded at once.
AT_ONCE = 1 << 18


class Codec(Protocol):
    """encode returns bytes, or None if the codec doesn't take such a tile."""

    takes: str  # int or float
    # version: int, 1 if there is none; another version can't read what this one wrote
    # at_least(z, enough=0): int, optional: bytes that encode(z) has at least, if that is cheaper to
    #   find; with `enough` any such bound will do that reaches it
    # symbols(data, shape): optional: (predictor, seed, residuals) that decode() restores the tile from
    # shares: bool, optional: encode and at_least take a Predicted as well

    def encode(self, z: np.ndarray) -> bytes | None: ...

    def decode(self, data: bytes, shape: tuple[int, int]) -> np.ndarray: ...


def _wrapped(x: np.ndarray) -> np.ndarray:
    return ((x + (1 << 31)) % (1 << 32) - (1 << 31)).astype(np.int32)


# -- predictors on one tile ----------------------------------------------------------


def residuals(z: np.ndarray, predictor: str) -> tuple[int, np.ndarray]:
    """(seed, residuals row-major, the first cell's 0)."""
    seed, d = residuals_all(z[None], predictor)
    return int(seed[0]), d[0]


def residuals_all(z: np.ndarray, predictor: str) -> tuple[np.ndarray, np.ndarray]:
    """The seeds and residuals of several tiles (tile, row, column) side by side."""
    x = z.astype(np.int64)
    if predictor == "with_nulls":
        ok = z != INT_MIN
        prior = np.full(z.shape, INT_MIN, np.int64)
        prior[:, :, 1:] = x[:, :, :-1]
        prior[:, 1:, 0] = x[:, :-1, 0]
        starts = ok & (prior == INT_MIN)
        number = starts.sum((1, 2))
        seed = np.floor(np.where(starts, x, 0).sum((1, 2)) / np.maximum(number, 1) + 0.5).astype(np.int64)
        return seed, np.where(ok, _wrapped(x - np.where(prior == INT_MIN, seed[:, None, None], prior)), INT_MIN).astype(np.int32)
    if predictor == "triangle":
        d = np.diff(np.diff(x, axis=2, prepend=0), axis=1, prepend=0)
    else:
        d = np.diff(x, axis=2, prepend=0)
        d[:, :, 0] = np.diff(x[:, :, 0], axis=1, prepend=0)
        if predictor == "linear":
            d[:, :, 2:] = d[:, :, 2:] - np.diff(x, axis=2)[:, :, :-1]
    d[:, 0, 0] = 0
    return x[:, 0, 0], _wrapped(d)


def restored(seed: int, d: np.ndarray, predictor: str) -> np.ndarray:
    return restored_all(np.array([seed], np.int64), d[None], predictor)[0]


def restored_all(seed: np.ndarray, d: np.ndarray, predictor: str) -> np.ndarray:
    """Several tiles from their seeds and residuals (tile, row, column)."""
    x = d.astype(np.int64)
    if predictor == "with_nulls":
        ok = d != INT_MIN
        x[~ok] = 0
        x[:, :, 0] = np.where(ok[:, :, 0], _since(x[:, :, 0], ok[:, :, 0]), 0)  # the row starts at what column 0 gives
        return np.where(ok, _wrapped(seed[:, None, None] + _since(x, ok)), INT_MIN).astype(np.int32)
    x[:, 0, 0] = seed
    if predictor == "triangle":
        return _wrapped(x.cumsum(1).cumsum(2))
    base = x[:, :, 0].cumsum(1)
    x[:, :, 0] = 0
    along = x.cumsum(2)
    return _wrapped(base[:, :, None] + (along.cumsum(2) if predictor == "linear" else along))


def _since(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Running sums along the last axis of x (0 where missing) that begin anew after each missing value."""
    run = x.cumsum(-1)
    broken = np.maximum.accumulate(np.where(ok, -1, np.arange(x.shape[-1])), -1)
    return run - np.where(broken >= 0, np.take_along_axis(run, np.maximum(broken, 0), -1), 0)


def choices(z: np.ndarray) -> list[str]:
    if (z == INT_MIN).any():
        return ["with_nulls"]
    return ["differencing", *(["linear"] if z.shape[1] > 2 else []), *(["triangle"] if min(z.shape) > 1 else [])]


_NAMES = {v: k for k, v in TYPES.items()}


class Predicted:
    """A tile and, once asked for, (type, seed, symbols, their bytes) by each of its predictors, for codecs that share them."""

    def __init__(self, z: np.ndarray, by_nulls: tuple[int, np.ndarray] | None = None):
        """by_nulls: what residuals(z, "with_nulls") gives, for a tile with nulls."""
        self.z, self.by_nulls = z, by_nulls
        self._parts: list[tuple[int, int, np.ndarray, bytes]] | None = None

    @classmethod
    def of(cls, z: np.ndarray | Predicted) -> Predicted:
        return z if isinstance(z, cls) else cls(z)

    def parts(self) -> list[tuple[int, int, np.ndarray, bytes]]:
        if self._parts is None:
            self._parts = []
            for p in choices(self.z) if self.by_nulls is None else ["with_nulls"]:
                seed, d = self.by_nulls or residuals(self.z, p)
                v = d.reshape(-1)[0 if p == "with_nulls" else 1 :]
                self._parts.append((TYPES[p], seed, v, bits.m32_encode(v)))
        return self._parts


class Deflate:
    """The best predictor's residuals as variable-length integers, deflated."""

    takes = "int"
    shares = True  # takes a Predicted as well

    def __init__(self, level: int = 6):
        self.level = level

    def encode(self, z: np.ndarray | Predicted) -> bytes | None:
        best = None
        for p, seed, _, body in Predicted.of(z).parts():
            data = struct.pack("<BiI", p, seed, len(body)) + zlib.compress(body, self.level)
            best = data if best is None or len(data) < len(best) else best
        return best

    def symbols(self, data: bytes, shape: tuple[int, int]) -> tuple[str, int, np.ndarray]:
        p, seed, _ = struct.unpack_from("<BiI", data)
        return _NAMES[p], seed, bits.m32_decode(zlib.decompress(data[9:]), shape[0] * shape[1])

    def decode(self, data: bytes, shape: tuple[int, int]) -> np.ndarray:
        return _from_symbols(*self.symbols(data, shape), shape)


def _from_symbols(predictor: str, seed: int, v: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    v = v if predictor == "with_nulls" else np.r_[np.int32(0), v]
    return restored(seed, v.reshape(shape), predictor)


class CanonicalHuffman:
    """The best predictor's residuals in a canonical Huffman code; a uniform tile is its value."""

    takes = "int"
    shares = True  # takes a Predicted as well

    def encode(self, z: np.ndarray | Predicted) -> bytes | None:
        tile = Predicted.of(z)
        z = tile.z
        if (z == z.flat[0]).all():
            return struct.pack("<Bi", 0, int(z.flat[0]))
        best = None
        for p, seed, v, _ in tile.parts():
            data = struct.pack("<Bi", p, seed) + bits.huffman_encode(v)
            best = data if best is None or len(data) < len(best) else best
        return best

    def at_least(self, z: np.ndarray | Predicted, enough: int = 0) -> int:
        tile = Predicted.of(z)
        return 5 if (tile.z == tile.z.flat[0]).all() else 5 + min(bits.huffman_least(v, enough - 5) for _, _, v, _ in tile.parts())

    def decode(self, data: bytes, shape: tuple[int, int]) -> np.ndarray:
        p, seed = struct.unpack_from("<Bi", data)
        if not p:
            return np.full(shape, seed, np.int32)
        return _from_symbols(_NAMES[p], seed, bits.huffman_decode(data[5:]), shape)


class Huffman:
    """The best predictor's bytes in a plain Huffman code: the variable-length integers' bytes are the symbols."""

    takes = "int"
    shares = True  # takes a Predicted as well

    def encode(self, z: np.ndarray | Predicted) -> bytes | None:
        best = None
        for p, seed, _, body in Predicted.of(z).parts():
            data = struct.pack("<Bi", p, seed) + bits.huffman_encode(np.frombuffer(body, np.int8))
            best = data if best is None or len(data) < len(best) else best
        return best

    def at_least(self, z: np.ndarray | Predicted, enough: int = 0) -> int:
        return 5 + min(bits.huffman_least(np.frombuffer(body, np.int8), enough - 5) for _, _, _, body in Predicted.of(z).parts())

    def decode(self, data: bytes, shape: tuple[int, int]) -> np.ndarray:
        p, seed = struct.unpack_from("<Bi", data)
        body = bits.huffman_decode(data[5:]).astype(np.int8).tobytes()
        return _from_symbols(_NAMES[p], seed, bits.m32_decode(body, shape[0] * shape[1]), shape)


class FloatPlanes:
    """A float's sign, exponent and three mantissa bytes as planes, each differenced and deflated."""

    takes = "float"

    def __init__(self, level: int = 9):
        self.level = level

    @staticmethod
    def planes(z: np.ndarray) -> list[np.ndarray]:
        u = z.astype(np.float32).reshape(-1).view(np.uint32)
        sign = np.packbits((u >> 31).astype(np.uint8))
        return [sign, *(((u >> s) & m).astype(np.uint8) for s, m in ((23, 255), (16, 127), (8, 255), (0, 255)))]

    def encode(self, z: np.ndarray) -> bytes | None:
        parts = [zlib.compress(np.diff(p, prepend=np.uint8(0)).tobytes(), self.level) for p in self.planes(z)]
        return struct.pack("<5I", *map(len, parts)) + b"".join(parts)

    def decode(self, data: bytes, shape: tuple[int, int]) -> np.ndarray:
        sizes, at, planes, n = struct.unpack_from("<5I", data), 20, [], shape[0] * shape[1]
        for s in sizes:
            planes.append(np.frombuffer(zlib.decompress(data[at : at + s]), np.uint8).cumsum(dtype=np.uint8))
            at += s
        u = np.unpackbits(planes[0])[:n].astype(np.uint32) << 31
        for p, s in zip(planes[1:], (23, 16, 8, 0), strict=True):
            u |= p.astype(np.uint32) << s
        return u.view(np.float32).reshape(shape)


class LeastSquares:
    """Residuals of a linear predictor fitted to the tile, in float32; its borders are differenced twice.

    A cell depends on cells to its left and in the two rows above, two columns ahead at
    most, so cells with equal 3 * row + column are decoded at once.
    """

    takes = "int"

    def __init__(self, neighbours: tuple = NEIGHBOURS, least: int = 6):
        self.neighbours, self.least = neighbours, least
        self.ahead = max(0, *(c for _, c in neighbours))

    def _inside(self, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        r, c = np.mgrid[2 : shape[0], 2 : shape[1] - self.ahead]
        return r.reshape(-1), c.reshape(-1)

    def _predict(self, x: np.ndarray, k: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        p = np.zeros(len(r), np.float32)
        for w, (dr, dc) in zip(k, self.neighbours, strict=True):
            p = p + w * x[r + dr, c + dc].astype(np.float32)
        return np.clip(np.floor(p + np.float32(0.5)).astype(np.float64), INT_MIN, -INT_MIN - 1).astype(np.int64)

    def coefficients(self, z: np.ndarray) -> np.ndarray | None:
        """Least squares under the condition that the coefficients sum to one."""
        r, c = self._inside(z.shape)
        x = z.astype(np.float64)
        u = np.stack([x[r + dr, c + dc] for dr, dc in self.neighbours], 1)
        m = np.block([[u.T @ u, np.ones((u.shape[1], 1))], [np.ones((1, u.shape[1])), np.zeros((1, 1))]])
        try:
            k = np.linalg.lstsq(m, np.r_[u.T @ x[r, c], 1.0], rcond=None)[0][:-1]
        except np.linalg.LinAlgError:
            return None
        return k.astype(np.float32) if np.isfinite(k).all() else None

    def encode(self, z: np.ndarray) -> bytes | None:
        if min(z.shape) < self.least or (z == INT_MIN).any() or (k := self.coefficients(z)) is None:
            return None
        x = z.astype(np.int64)
        r, c = self._inside(z.shape)
        seed, d = residuals(z, "triangle")
        d[r, c] = _wrapped(x[r, c] - self._predict(x, k, r, c))
        v = d.reshape(-1)[1:]
        deflated, coded = zlib.compress(bits.m32_encode(v), 9), bits.huffman_encode(v)
        kind, body = (0, deflated) if len(deflated) <= len(coded) else (1, coded)
        return struct.pack("<BiI", kind, seed, zlib.crc32(x.astype("<i4").tobytes())) + k.astype("<f4").tobytes() + body

    def decode(self, data: bytes, shape: tuple[int, int]) -> np.ndarray:
        kind, seed, crc = struct.unpack_from("<BiI", data)
        n = len(self.neighbours)
        k = np.frombuffer(data, "<f4", n, 9)
        body = data[9 + 4 * n :]
        v = bits.m32_decode(zlib.decompress(body), shape[0] * shape[1] - 1) if kind == 0 else bits.huffman_decode(body)
        d = np.r_[np.int32(0), v].reshape(shape).astype(np.int64)
        x = np.zeros(shape, np.int64)
        x[0, 0] = seed
        rows, cols = np.mgrid[: shape[0], : shape[1]]
        wave = (rows * (self.ahead + 1) + cols).reshape(-1)
        order = np.argsort(wave, kind="stable")
        for cells in np.split(order, np.flatnonzero(np.diff(wave[order])) + 1):
            r, c = np.divmod(cells, shape[1])
            inside = (r >= 2) & (c >= 2) & (c < shape[1] - self.ahead)
            if inside.any():
                x[r[inside], c[inside]] = _wrapped(d[r[inside], c[inside]] + self._predict(x, k, r[inside], c[inside]))
            r, c = r[~inside], c[~inside]
            first = (r == 0) & (c == 0)
            r, c = r[~first], c[~first]
            left, up = np.where(c > 0, x[r, c - 1], 0), np.where(r > 0, x[r - 1, c], 0)
            corner = np.where((r > 0) & (c > 0), x[r - 1, c - 1], 0)
            x[r, c] = _wrapped(d[r, c] + left + up - corner)
        out = x.astype(np.int32)
        if zlib.crc32(out.astype("<i4").tobytes()) != crc:
            raise ValueError("the tile's checksum doesn't match")
        return out


class Registry:
    """Codecs by name, in the order in which they compete; the earlier wins a tie."""

    def __init__(self, **codecs: Codec):
        self.codecs: dict[str, Codec] = {}
        for name, codec in codecs.items():
            self.add(name, codec)

    def add(self, name: str, codec: Codec) -> None:
        if not identifier(name, 16):
            raise ValueError(f"not an identifier: {name!r}")
        if not all(callable(getattr(codec, m, None)) for m in ("encode", "decode")) or getattr(codec, "takes", "") not in ("int", "float"):
            raise TypeError("a codec has takes, encode and decode")
        if name not in self.codecs and len(self.codecs) >= RAW:
            raise ValueError("too many codecs")
        self.codecs[name] = codec

    def remove(self, name: str | None = None) -> None:
        """One codec, or all."""
        if name is None:
            self.codecs.clear()
        else:
            self.codecs.pop(name, None)

    def get(self, name: str) -> Codec:
        return self.codecs[name]

    def index(self, name: str) -> int:
        return list(self.codecs).index(name)

    def labels(self) -> tuple[str, ...]:
        """name@version of each codec, by index: what a store keeps, so that any registry with these codecs can read it."""
        return tuple(f"{n}@{getattr(c, 'version', 1)}" for n, c in self.codecs.items())

    def resolved(self, labels: Sequence[str] | None) -> list[Codec | str]:
        """The codec of each label, or the label if there is none such here; without labels all codecs in order."""
        if labels is None:
            return list(self.codecs.values())
        own = dict(zip(self.labels(), self.codecs.values(), strict=True))
        return [own.get(label, label) for label in labels]


def default_registry(least_squares: bool = False) -> Registry:
    r = Registry(huffman=Huffman(), deflate=Deflate(), planes=FloatPlanes(), canonical=CanonicalHuffman())
    if least_squares:
        add_least_squares(r)
    return r


def add_least_squares(registry: Registry) -> None:
    registry.add("lsop12", LeastSquares())
    registry.add("lsop08", LeastSquares(NEIGHBOURS_8, 4))


def _flat(values: pa.Array, kind: str) -> np.ndarray:
    """Cells of tiles, INT_MIN or NaN where null."""
    if kind == "float":
        return np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(np.float32), nan=np.nan)
    return values.fill_null(INT_MIN).to_numpy(zero_copy_only=False).astype(np.int32)


def _tile(values: pa.Scalar, kind: str, shape: tuple[int, int]) -> np.ndarray:
    return _flat(values.values, kind).reshape(shape)


def _raw(z: np.ndarray) -> bytes:
    return bytes([RAW]) + z.astype(z.dtype.newbyteorder("<"), copy=False).tobytes()


def best_packing(z: np.ndarray, kind: str, registry: Registry, by_nulls: tuple[int, np.ndarray] | None = None) -> tuple[int, str, bytes]:
    """(codec_index, codec, packing) of the shortest packing of a tile, ties to the earlier codec: what shortest() finds.

    Codecs that can't reach the shortest so far aren't run.
    """
    shared, best = Predicted(z, by_nulls), (z.nbytes + 1, RAW, "raw", None)
    own = [(i, name, codec) for i, (name, codec) in enumerate(registry.codecs.items()) if codec.takes == kind]
    for i, name, codec in sorted(own, key=lambda x: hasattr(x[2], "at_least")):
        tile = shared if getattr(codec, "shares", False) else z
        if hasattr(codec, "at_least") and (codec.at_least(tile, best[0]) + 1, i) > best[:2]:
            continue
        data = codec.encode(tile)
        if data is not None and len(data) + 1 < z.nbytes and (len(data) + 1, i) < best[:2]:
            best = len(data) + 1, i, name, data
    return (RAW, "raw", _raw(z)) if best[3] is None else (best[1], best[2], bytes([best[1]]) + best[3])


#: What packed_batches() gives of each tile.
PACKED = "tile_index int, element string, codec_index int, codec string, packing binary, size int, checksum long, tile_row int"


def packed_batches(tiles: Iterator[pa.RecordBatch], element: str, shape: tuple[int, int], kind: str, registry: Registry) -> Iterator[pa.RecordBatch]:
    """PACKED of batches (tile_index, tile_row, tile_col, values): each tile in its shortest packing, with its CRC-32C."""
    for b in tiles:
        zs = _flat(b.column(3).flatten(), kind).reshape(-1, *shape)
        sparse = (zs == INT_MIN).any((1, 2)) if kind == "int" and any(getattr(c, "shares", False) for c in registry.codecs.values()) else np.zeros(len(zs), bool)
        by_nulls = iter(zip(*residuals_all(zs[sparse], "with_nulls"), strict=True))
        found = [best_packing(z, kind, registry, (int((d := next(by_nulls))[0]), d[1]) if has else None) for z, has in zip(zs, sparse.tolist(), strict=True)]
        at, names, packings = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        yield pa.record_batch(
            [b.column(0), pa.array([element] * len(found), pa.string()), pa.array(at, pa.int32()), pa.array(names, pa.string()), pa.array(packings, pa.binary()), pa.array([len(p) for p in packings], pa.int32()), pa.array(bits.crc32c_all(packings), pa.int64()), b.column(1)],
            names=["tile_index", "element", "codec_index", "codec", "packing", "size", "checksum", "tile_row"],
        )


def encode_tiles(tiles: DataFrame, shape: tuple[int, int], kind: str = "int", registry: Registry | None = None) -> DataFrame:
    """tile_index, element, values -> for each codec that takes the tile: codec_index, codec, packing, size."""
    registry = registry or default_registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for index, element, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                z = _tile(values, kind, shape)
                for i, (name, codec) in enumerate(registry.codecs.items()):
                    data = codec.encode(z) if codec.takes == kind else None
                    if data is not None and len(data) + 1 < z.nbytes:
                        rows.append((index, element, i, name, bytes([i]) + data))
                rows.append((index, element, RAW, "raw", _raw(z)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary()), pa.array([len(p) for p in cols[4]], pa.int32())], names=["tile_index", "element", "codec_index", "codec", "packing", "size"])

    return tiles.select("tile_index", "element", "values").mapInArrow(run, "tile_index int, element string, codec_index int, codec string, packing binary, size int")


def shortest(packed: DataFrame) -> DataFrame:
    """Each tile's element in its shortest packing, ties to the earlier codec."""
    best = packed.groupBy("tile_index", "element").agg(F.min_by(F.struct("codec_index", "codec", "packing", "size"), F.struct("size", "codec_index")).alias("b"))
    return best.select("tile_index", "element", "b.*")


def sealed(packed: DataFrame) -> DataFrame:
    """packed with the CRC-32C of each packing, for those that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(bits.crc32c_all(b.column("packing").to_pylist()), pa.int64())], names=[*b.schema.names, "checksum"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields)
    return packed.mapInArrow(run, f"{kept}, checksum long")


def _arrays(flat: np.ndarray, n: int, missing: np.ndarray, kind: str) -> pa.ListArray:
    """Rows of n values each, null where missing, without a Python object for any."""
    values = pa.array(flat.astype(np.float32 if kind == "float" else np.int32, copy=False), mask=missing)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // n + 1, dtype=np.int32) * n), values)


def decoded(packings: list[bytes], shape: tuple[int, int], kind: str, known: list[Codec | str]) -> np.ndarray:
    """Tiles (tile, cell) of packings, those of a predictor restored side by side."""
    out = np.empty((len(packings), shape[0] * shape[1]), np.float32 if kind == "float" else np.int32)
    waiting: dict[str, list[tuple[int, int, np.ndarray]]] = {}
    for i, p in enumerate(packings):
        if p[0] == RAW:
            out[i] = np.frombuffer(p, "<f4" if kind == "float" else "<i4", offset=1)
        elif p[0] >= len(known) or isinstance(known[p[0]], str):
            raise ValueError(f"no codec {known[p[0]] if p[0] < len(known) else p[0]} is registered")
        elif hasattr(codec := known[p[0]], "symbols"):
            name, seed, v = codec.symbols(p[1:], shape)
            waiting.setdefault(name, []).append((i, seed, v))
        else:
            out[i] = codec.decode(p[1:], shape).reshape(-1)
    for name, each in waiting.items():
        at, seeds, v = zip(*each, strict=True)
        d = np.stack(v)
        d = d if name == "with_nulls" else np.c_[np.zeros(len(d), np.int32), d]
        out[list(at)] = restored_all(np.array(seeds, np.int64), d.reshape(-1, *shape), name).reshape(len(d), -1)
    return out


def decode_tiles(packed: DataFrame, shape: tuple[int, int], kind: str = "int", registry: Registry | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """tile_index, element, values; the codec is found by the packing's first byte, an index of labels (or of the registry)."""
    registry = registry or default_registry()
    n = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry.resolved(labels)
        for whole in batches:
            for first in range(0, whole.num_rows, step := max(1, AT_ONCE // n)):
                b = whole.slice(first, step)
                flat = decoded(b.column(2).to_pylist(), shape, kind, known).reshape(-1)
                yield pa.record_batch([b.column(0), b.column(1), _arrays(flat, n, np.isnan(flat) if kind == "float" else flat == INT_MIN, kind)], names=["tile_index", "element", "values"])

    return packed.select("tile_index", "element", "packing").mapInArrow(run, f"tile_index int, element string, values array<{'float' if kind == 'float' else 'int'}>")


def decode_cells(packed: DataFrame, spec: Spec, name: str, kind: str, registry: Registry | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """row, col, name: the cells of packed tiles of an element, padding and missing ones left out before they leave Python."""
    registry = registry or default_registry()
    shape = spec.tile_rows, spec.tile_cols
    n = spec.cells_per_tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry.resolved(labels)
        for whole in batches:
            for first in range(0, whole.num_rows, step := max(1, AT_ONCE // n)):
                b = whole.slice(first, step)
                flat = decoded(b.column(1).to_pylist(), shape, kind, known).reshape(-1)
                at = np.flatnonzero(~np.isnan(flat) if kind == "float" else flat != INT_MIN)
                tile, place = np.divmod(at, n)
                down, across = np.divmod(b.column(0).to_numpy().astype(np.int64)[tile], spec.tiles_across)
                row, col = down * spec.tile_rows + place // spec.tile_cols, across * spec.tile_cols + place % spec.tile_cols
                inside = (row < spec.n_rows) & (col < spec.n_cols)
                yield pa.record_batch([pa.array(row[inside].astype(np.int32)), pa.array(col[inside].astype(np.int32)), pa.array(flat[at[inside]])], names=["row", "col", name])

    return packed.select("tile_index", "packing").mapInArrow(run, f"row int, col int, `{name}` {'float' if kind == 'float' else 'int'}")


def _stacked(values: pa.ListArray, shape: tuple[int, int]) -> np.ndarray:
    """Integer tiles (tile, row, column), INT_MIN where null."""
    return values.flatten().fill_null(INT_MIN).to_numpy().astype(np.int32, copy=False).reshape(-1, *shape)


def tile_residuals(tiles: DataFrame, shape: tuple[int, int], predictor: str = "with_nulls") -> DataFrame:
    """tile_index, seed, residuals of integer tiles (tile_index, values), null where a value is; whole tiles, no shuffle."""
    n = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, step := max(1, AT_ONCE // n)):
                b = whole.slice(first, step)
                seed, d = residuals_all(_stacked(b.column(1), shape), predictor)
                missing = b.column(1).flatten().is_null().to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(0), pa.array(seed.astype(np.int32)), _arrays(d.reshape(-1), n, missing, "int")], names=["tile_index", "seed", "residuals"])

    return tiles.select("tile_index", "values").mapInArrow(run, "tile_index int, seed int, residuals array<int>")


def tile_restored(packed: DataFrame, shape: tuple[int, int], predictor: str = "with_nulls") -> DataFrame:
    """tile_index, values of tiles (tile_index, seed, residuals)."""
    n = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, step := max(1, AT_ONCE // n)):
                b = whole.slice(first, step)
                flat = restored_all(b.column(1).to_numpy().astype(np.int64), _stacked(b.column(2), shape), predictor).reshape(-1)
                yield pa.record_batch([b.column(0), _arrays(flat, n, flat == INT_MIN, "int")], names=["tile_index", "values"])

    return packed.select("tile_index", "seed", "residuals").mapInArrow(run, "tile_index int, values array<int>")


def report(packed: DataFrame, cells_per_tile: int) -> DataFrame:
    """For each codec: tiles, bytes, bits per symbol, mean size, and overhead against raw (four bytes a cell)."""
    return packed.groupBy("codec").agg(
        F.count("*").alias("tiles"), F.sum("size").alias("bytes"), (F.sum("size") * 8.0 / (F.count("*") * cells_per_tile)).alias("bits_per_symbol"),
        F.avg("size").alias("mean_size"), (F.sum("size") / (F.count("*") * cells_per_tile * 4.0)).alias("of_raw"),
    )


def damaged(packed: DataFrame) -> DataFrame:
    """tile_index, element of packings that don't match their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = bits.crc32c_all([p or b"" for p in b.column(2).to_pylist()])
            bad = [found != c for found, c in zip(sums, b.column(3).to_pylist(), strict=True)]
            yield b.filter(pa.array(bad, pa.bool_())).select([0, 1])

    return packed.select("tile_index", "element", "packing", "checksum").mapInArrow(run, "tile_index int, element string")


def byte_entropy(packed: DataFrame) -> DataFrame:
    """For each codec: mean over tiles of the bits per byte of its packings, of order 0 and given the byte before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits_of(counts: np.ndarray) -> float:
            c = counts[counts > 0].astype(np.float64)
            return float(np.log2(c.sum()) - (c * np.log2(c)).sum() / c.sum()) if len(c) else 0.0

        for b in batches:
            zero, one = [], []
            for data in b.column(1).to_pylist():
                x = np.frombuffer(data, np.uint8).astype(np.int64)
                zero.append(bits_of(np.bincount(x)))
                pairs = x[:-1] * 256 + x[1:]
                one.append(bits_of(np.unique(pairs, return_counts=True)[1]) - bits_of(np.bincount(x[:-1])) if len(x) > 1 else 0.0)
            yield pa.record_batch([b.column(0), pa.array(zero, pa.float64()), pa.array(one, pa.float64())], names=["codec", "order0", "order1"])

    each = packed.select("codec", "packing").mapInArrow(run, "codec string, order0 double, order1 double")
    return each.groupBy("codec").agg(F.count("*").alias("tiles"), F.avg("order0").alias("order0"), F.avg("order1").alias("order1"))


def plane_sizes(tiles: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """plane, bytes, bits (mean entropy) of the five planes of float tiles."""
    names = ("sign", "exponent", "mantissa_high", "mantissa_middle", "mantissa_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for values in b.column(0):
                for name, p in zip(names, FloatPlanes.planes(_tile(values, "float", shape)), strict=True):
                    c = np.bincount(p)
                    c = c[c > 0]
                    rows.append((name, len(zlib.compress(np.diff(p, prepend=np.uint8(0)).tobytes(), 9)), float(np.log2(c.sum()) - (c * np.log2(c)).sum() / c.sum())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["plane", "size", "entropy"])

    each = tiles.select("values").mapInArrow(run, "plane string, size long, entropy double")
    return each.groupBy("plane").agg(F.sum("size").alias("bytes"), F.avg("entropy").alias("bits"))
