"""The raster model: a frozen specification on the driver, cells in a DataFrame.

Cell form (one row per populated cell): row, col, and a nullable column per element.
An absent row and a null mean missing; fill values exist only in stored and written forms.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
SHORT_MIN, SHORT_MAX = -(1 << 15), (1 << 15) - 1
KINDS = {"int": T.IntegerType(), "icf": T.IntegerType(), "float": T.FloatType(), "short": T.ShortType()}
RASTER_SPACES = ("unspecified", "point", "area")


@dataclass(frozen=True)
class Element:
    """One value per cell.  kind: int, short, float, or icf (a float stored as scaled integer)."""

    name: str
    kind: str = "int"
    low: float | None = None
    high: float | None = None
    fill: float | None = None
    scale: float = 1.0
    offset: float = 0.0
    label: str = ""
    description: str = ""
    unit: str = ""
    continuous: bool = True

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"no element kind {self.kind!r}")
        if not identifier(self.name):
            raise ValueError(f"not an identifier: {self.name!r}")
        floor, top = {"int": (INT_MIN, INT_MAX), "short": (SHORT_MIN, SHORT_MAX), "icf": (INT_MIN, INT_MAX), "float": (-math.inf, math.inf)}[self.kind]
        given = self.fill is not None
        put = lambda n, v: object.__setattr__(self, n, v) if getattr(self, n) is None else None
        # A fill alone frees the whole range; without one the lowest code is kept for it.
        put("low", floor if given or self.kind == "float" else floor + 1)
        put("high", top - 1 if self.kind == "icf" else top)
        put("fill", math.nan if self.kind == "float" else floor)

    @property
    def stored(self) -> T.DataType:
        return KINDS[self.kind]

    @property
    def integral(self) -> bool:
        return self.kind != "float"

    def field(self) -> T.StructField:
        meta = {k: getattr(self, k) for k in ("label", "description", "unit", "continuous", "kind")}
        return T.StructField(self.name, T.FloatType() if self.kind == "icf" else self.stored, True, meta)


def identifier(text: str, longest: int = 32) -> bool:
    """A letter, then letters, digits and underscores."""
    plain = text.isascii() and text.replace("_", "a").isalnum()
    return 0 < len(text) <= longest and plain and text[0].isalpha()


@dataclass(frozen=True)
class Spec:
    """Dimensions, tiling, coordinates and elements of a raster."""

    n_rows: int
    n_cols: int
    tile_rows: int = 0
    tile_cols: int = 0
    elements: tuple[Element, ...] = ()
    crs: str = "none"  # none, cartesian, geographic
    x0: float = 0.0  # of the centre of cell (0, 0)
    y0: float = 0.0
    cell_x: float = 1.0
    cell_y: float = 1.0
    to_grid: tuple[float, ...] | None = None  # a user's affine map, model to (col, row): a, b, c, d, e, f
    compressed: bool = False
    checksums: bool = False
    label: str = ""
    raster_space: str = "unspecified"

    def __post_init__(self) -> None:
        if self.n_rows < 1 or self.n_cols < 1:
            raise ValueError("a raster has a row and a column at least")
        tr, tc = self.tile_rows or min(120, self.n_rows), self.tile_cols or min(120, self.n_cols)
        if tr > self.n_rows or tc > self.n_cols or tr < 1 or tc < 1:
            raise ValueError("a tile is within the grid")
        object.__setattr__(self, "tile_rows", tr)
        object.__setattr__(self, "tile_cols", tc)
        if self.tiles_down * self.tiles_across > INT_MAX:
            raise ValueError("too many tiles")
        if len({e.name for e in self.elements}) < len(self.elements):
            raise ValueError("two elements of one name")
        if self.raster_space not in RASTER_SPACES:
            raise ValueError(f"no raster space {self.raster_space!r}")

    @property
    def tiles_down(self) -> int:
        return -(-self.n_rows // self.tile_rows)

    @property
    def tiles_across(self) -> int:
        return -(-self.n_cols // self.tile_cols)

    @property
    def cells_per_tile(self) -> int:
        return self.tile_rows * self.tile_cols

    def element(self, name: str) -> Element:
        return next(e for e in self.elements if e.name == name)

    # -- coordinates -------------------------------------------------------------

    def cartesian(self, x0: float, y0: float, x1: float, y1: float) -> Spec:
        """From the centres of the first and last cells."""
        return replace(self, crs="cartesian", x0=x0, y0=y0, cell_x=(x1 - x0) / max(1, self.n_cols - 1), cell_y=(y1 - y0) / max(1, self.n_rows - 1))

    def cartesian_cells(self, x0: float, y0: float, cell_x: float, cell_y: float) -> Spec:
        return replace(self, crs="cartesian", x0=x0, y0=y0, cell_x=cell_x, cell_y=cell_y)

    def geographic(self, lat0: float, lon0: float, lat1: float, lon1: float) -> Spec:
        """Eastwards from lon0 to lon1; equal longitudes are a whole turn apart."""
        if max(abs(lat0), abs(lat1)) > 90:
            raise ValueError("a latitude is from -90 to 90")
        delta = math.fmod(lon1 - lon0, 360)
        delta = delta + 360 if delta <= 0 else delta
        return replace(self, crs="geographic", x0=lon0, y0=lat0, cell_x=delta / max(1, self.n_cols - 1), cell_y=(lat1 - lat0) / max(1, self.n_rows - 1))

    def geographic_cells(self, lat0: float, lon0: float, cell_lat: float, cell_lon: float) -> Spec:
        if max(abs(lat0), abs(lat0 + cell_lat * (self.n_rows - 1))) > 90 + 1e-9:
            raise ValueError("a latitude is from -90 to 90")
        return replace(self, crs="geographic", x0=lon0, y0=lat0, cell_x=cell_lon, cell_y=cell_lat)

    def affine(self, a: float, b: float, c: float, d: float, e: float, f: float, *, from_grid: bool = True) -> Spec:
        """x = a*col + b*row + c, y = d*col + e*row + f, or (from_grid=False) the other way."""
        m = (a, b, c, d, e, f)
        return replace(self, crs="cartesian", to_grid=inverse(m) if from_grid else (inverse(m) and m))

    def from_tie_point(self, tie: tuple[float, float, float, float], pixel: tuple[float, float]) -> Spec:
        """A tie point (column, row, x, y) and pixel sizes, rows running down."""
        col, row, x, y = tie
        return self.cartesian_cells(x - col * pixel[0], y + row * pixel[1], pixel[0], -pixel[1])

    @property
    def model_to_grid(self) -> tuple[float, ...]:
        if self.to_grid:
            return self.to_grid
        return (1 / self.cell_x, 0.0, -self.x0 / self.cell_x, 0.0, 1 / self.cell_y, -self.y0 / self.cell_y)

    @property
    def grid_to_model(self) -> tuple[float, ...]:
        return inverse(self.to_grid) if self.to_grid else (self.cell_x, 0.0, self.x0, 0.0, self.cell_y, self.y0)

    @property
    def x1(self) -> float:
        return self.x0 + self.cell_x * (self.n_cols - 1)

    @property
    def y1(self) -> float:
        return self.y0 + self.cell_y * (self.n_rows - 1)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """Least and greatest x and y of the corners, half a cell beyond the outer centres."""
        a, b, c, d, e, f = self.grid_to_model
        corners = [(a * q + b * p + c, d * q + e * p + f) for p in (-0.5, self.n_rows - 0.5) for q in (-0.5, self.n_cols - 0.5)]
        xs, ys = zip(*corners, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def wraps(self) -> bool:
        """The column after the last is the first."""
        return self.crs == "geographic" and abs(_to180(self.x1 + self.cell_x - self.x0)) < 1e-6

    @property
    def brackets(self) -> bool:
        """The last column repeats the first, a turn further."""
        return self.crs == "geographic" and abs(self.x1 - self.x0 - 360) < 1e-9

    @property
    def fringe(self) -> tuple[float, float, float, float]:
        """Least and greatest row, least and greatest column that round into the grid."""
        r, c = 4 * math.ulp(self.n_rows), 4 * math.ulp(self.n_cols)
        return -0.5 - r, self.n_rows - 0.5 + r, -0.5 - c, self.n_cols - 0.5 + c

    # -- persistence -------------------------------------------------------------

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Spec:
        d = json.loads(text)
        d["elements"] = tuple(Element(**e) for e in d["elements"])
        d["to_grid"] = tuple(d["to_grid"]) if d["to_grid"] else None
        return Spec(**d)


def inverse(m: tuple[float, ...]) -> tuple[float, ...]:
    a, b, c, d, e, f = m
    det = a * e - b * d
    if not det or not math.isfinite(det):
        raise ValueError("the map can't be inverted")
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def _to180(angle: float) -> float:
    a = math.fmod(angle, 360)
    return a + 360 if a < -180 else a - 360 if a >= 180 else a


@dataclass(frozen=True)
class Raster:
    spec: Spec
    cells: DataFrame

    def select(self, *names: str) -> DataFrame:
        """Elements by name, all without names."""
        return self.cells.select("row", "col", *(names or [e.name for e in self.spec.elements]))


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name
