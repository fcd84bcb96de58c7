"""Colour palettes: parsing, and value-to-colour lookup as expressions.

A palette is a short sorted list of records from range0 to range1.  It is a parameter of
a query, like a format string, and becomes a literal in the plan: a value finds its record
by comparing with the sorted starts, with no join and no shuffle.
"""

from __future__ import annotations

import colorsys
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colour

# The sixteen colour names of the first HTML standard.
BASIC_NAMES = {
    "aqua": (0, 255, 255), "black": (0, 0, 0), "blue": (0, 0, 255), "fuchsia": (255, 0, 255),
    "gray": (128, 128, 128), "green": (0, 128, 0), "lime": (0, 255, 0), "maroon": (128, 0, 0),
    "navy": (0, 0, 128), "olive": (128, 128, 0), "purple": (128, 0, 128), "red": (255, 0, 0),
    "silver": (192, 192, 192), "teal": (0, 128, 128), "white": (255, 255, 255), "yellow": (255, 255, 0),
}


@dataclass(frozen=True)
class Record:
    range0: float
    range1: float
    first: tuple[float, float, float]
    last: tuple[float, float, float]
    label: str = ""


@dataclass(frozen=True)
class Palette:
    records: tuple[Record, ...]
    model: str = "RGB"  # or HSV
    background: tuple | None = None
    foreground: tuple | None = None
    null_colour: tuple | None = None
    hinge: float | None = None
    range: tuple[float, float] | None = None
    names: dict = field(default_factory=dict, compare=False)

    @property
    def categorical(self) -> bool:
        """Every record has one colour and a label."""
        return all(r.first == r.last and r.label for r in self.records)

    @property
    def covered(self) -> bool:
        """No gaps between records."""
        return all(a.range1 == b.range0 for a, b in zip(self.records, self.records[1:], strict=False))

    @property
    def normalised(self) -> bool:
        ends = self.records[0].range0, self.records[-1].range1
        return self.covered and ends == ((-1.0, 1.0) if self.hinge is not None else (0.0, 1.0))

    def ranged(self, low: float, high: float) -> Palette:
        """The same colours over another range."""
        a, b = self.records[0].range0, self.records[-1].range1
        k = (high - low) / (b - a)
        return replace(self, records=tuple(replace(r, range0=low + (r.range0 - a) * k, range1=low + (r.range1 - a) * k) for r in self.records))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.range0, r.range1, *map(float, r.first), *map(float, r.last), r.label) for r in self.records]
        return spark.createDataFrame(rows, "range0 double, range1 double, a0 double, b0 double, c0 double, a1 double, b1 double, c1 double, label string")


def colour_names(lines: str) -> dict[str, tuple[int, int, int]]:
    """A table of names from text: three numbers and a name on each line."""
    found = {}
    for line in lines.splitlines():
        if m := re.match(r"\s*(\d+)\s+(\d+)\s+(\d+)\s+(\S.*?)\s*$", line):
            found[m[4].lower().replace(" ", "")] = tuple(int(m[i]) for i in (1, 2, 3))
    return found


def parse(text: str, names: dict | None = None) -> Palette:
    """A palette from the lines of a colour palette table.

    Value lines have 2 tokens (value colour), 4 (value colour value colour) or 8 (value and
    three numbers, twice), with `; label` after them; B, F and N lines give colours for
    below, above and missing.  In comments COLOR_MODEL, HINGE and RANGE = a/b count.
    """
    known = BASIC_NAMES | {k.lower(): v for k, v in (names or {}).items()}
    model, hinge, span, records, special = "RGB", None, None, [], {}

    def one(token: str) -> tuple[float, ...]:
        if token.lower() in known:
            return known[token.lower()]
        if m := re.fullmatch(r"#?([0-9a-fA-F]{6})", token):
            return tuple(int(m[1][i : i + 2], 16) for i in (0, 2, 4))
        parts = [float(p) for p in re.split(r"[/-]", token)]
        if len(parts) == 1:
            return (parts[0],) * 3
        if len(parts) != 3:
            raise ValueError(f"not a colour: {token!r}")
        return tuple(parts)

    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if line.startswith("#"):
            if m := re.search(r"COLOR_MODEL\s*=\s*\+?(\w+)", line):
                model = m[1].upper()
            elif m := re.search(r"HINGE\s*=?\s*(\S*)", line):
                hinge = float(m[1]) if m[1] else 0.0
            elif m := re.search(r"RANGE\s*=\s*([^/\s]+)/(\S+)", line):
                span = float(m[1]), float(m[2])
            continue
        body, _, label = line.partition(";")
        t = body.split()
        if t[0] in ("B", "F", "N"):
            special[t[0]] = one(t[1]) if len(t) == 2 else tuple(map(float, t[1:4]))
        elif len(t) == 2:
            records.append(Record(float(t[0]), float(t[0]), one(t[1]), one(t[1]), label.strip()))
        elif len(t) == 4:
            records.append(Record(float(t[0]), float(t[2]), one(t[1]), one(t[3]), label.strip()))
        elif len(t) == 8:
            records.append(Record(float(t[0]), float(t[4]), tuple(map(float, t[1:4])), tuple(map(float, t[5:8])), label.strip()))
        else:
            raise ValueError(f"not a palette line: {line!r}")
    records.sort(key=lambda r: (r.range0, r.range1))
    return Palette(tuple(records), model, special.get("B"), special.get("F"), special.get("N"), hinge, span)


def _packed(model: str, c: tuple) -> int:
    if model == "HSV":
        c = [255 * x for x in colorsys.hsv_to_rgb(c[0] / 360 % 1, c[1], c[2])]
    r, g, b = (int(x + 0.5) for x in c)
    return (0xFF000000 | r << 16 | g << 8 | b) - (1 << 32)


def hue_step(a: float, b: float) -> float:
    """Degrees from one hue to another the shorter way round."""
    d = (b - a) % 360
    return d - 360 if d > 180 else d


def argb(palette: Palette, z: Column, shade: Column | None = None, clamp: bool = False) -> Column:
    """Packed colour of z, null where nothing covers it; shade (0..1) scales its brightness.

    A record covers its start and, where no other starts there, its end.  A record of one
    value gives its colour.  clamp: values beyond the palette count as its ends.
    """
    rs = palette.records
    z = z.cast("double")
    if palette.hinge is not None and palette.normalised and palette.range:
        low, high = palette.range
        z = F.when(z < palette.hinge, (z - palette.hinge) / (palette.hinge - low)).otherwise((z - palette.hinge) / (high - palette.hinge))
    elif palette.normalised and palette.range:
        low, high = palette.range
        z = (z - low) / (high - low)
    if clamp:
        z = F.least(F.greatest(z, F.lit(rs[0].range0)), F.lit(rs[-1].range1))
    shade = F.lit(1.0) if shade is None else shade

    def colour_of(r: Record) -> Column:
        t = (z - r.range0) / (r.range1 - r.range0) if r.range1 > r.range0 else F.lit(0.0)
        mix = [F.lit(float(a)) + t * (b - a) for a, b in zip(r.first, r.last, strict=True)]
        if palette.model == "HSV":
            hue = F.lit(float(r.first[0])) + t * hue_step(r.first[0], r.last[0])
            return colour.packed(*colour.hsv_to_rgb(hue, mix[1], mix[2] * shade))
        return colour.packed(*(F.floor(c * shade + 0.5).cast("int") for c in mix))

    # The last record that starts at or below z, found by halving.
    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return F.when(z <= rs[low].range1, colour_of(rs[low]))
        mid = (low + high) // 2
        return F.when(z < rs[mid].range0, search(low, mid)).otherwise(search(mid, high))

    covered = F.when(z >= rs[0].range0, search(0, len(rs)))
    missing = None if palette.null_colour is None else _packed(palette.model, palette.null_colour)
    below = None if palette.background is None else _packed(palette.model, palette.background)
    above = None if palette.foreground is None else _packed(palette.model, palette.foreground)
    out = F.when(z.isNull() | F.isnan(z), F.lit(missing).cast("int"))
    return out.when(z < rs[0].range0, F.lit(below).cast("int")).when(z > rs[-1].range1, F.lit(above).cast("int")).otherwise(covered)


def label_of(palette: Palette, z: Column) -> Column:
    out = F.lit(None).cast("string")
    for r in palette.records:
        out = F.when(z.between(r.range0, r.range1), F.lit(r.label)).otherwise(out)
    return out


def name_lookup(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """df with r, g, b of the colour named in `column`, whatever its case; names: name, r, g, b."""
    key = F.lower(F.regexp_replace(F.col(column), " ", ""))
    n = names.select(F.lower(F.regexp_replace("name", " ", "")).alias("_key"), "r", "g", "b")
    return df.withColumn("_key", key).join(n, "_key", "left").drop("_key")
