"""Colour conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(rgb: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(rgb, s).bitwiseAND(255).cast("int") for s in (16, 8, 0))


def packed(r: Column, g: Column, b: Column) -> Column:
    """Opaque ARGB as a signed 32-bit integer."""
    return (F.lit(-16777216) + r * 65536 + g * 256 + b).cast("int")


def to_ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lossless luma and chroma by lifting."""
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return t + F.shiftright(cg, 1), co, cg


def from_ycocg(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - F.shiftright(cg, 1)
    b = t - F.shiftright(co, 1)
    return b + co, cg + t, b


def srgb_to_linear(p: Column) -> Column:
    """0..255 to 0..1, by the standard's two pieces."""
    s = p / 255
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    """0..1 to 0..255, rounded half up."""
    s = F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def srgb_table() -> list[float]:
    return [s / 12.92 if (s := p / 255) <= 0.04045 else ((s + 0.055) / 1.055) ** 2.4 for p in range(256)]


def srgb_to_linear_table(p: Column) -> Column:
    """As srgb_to_linear of whole numbers, by a literal table."""
    return F.get(F.array(*map(F.lit, srgb_table())), p.cast("int"))


def linear_to_srgb_table(x: Column, bins: int = 512) -> Column:
    """Linear interpolation between `bins` exact values; a level off at most."""
    exact = [255 * (i / bins * 12.92 if i / bins <= 0.0031308 else 1.055 * (i / bins) ** (1 / 2.4) - 0.055) for i in range(bins + 2)]
    at = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * bins
    i, table = F.floor(at).cast("int"), F.array(*map(F.lit, exact))
    low = F.get(table, i)
    # The curve is all but straight near 0, where its piece is linear, and steep after it.
    return F.when(x <= 8 / bins, linear_to_srgb(x)).otherwise(F.floor(low + (F.get(table, i + 1) - low) * (at - i) + 0.5).cast("int"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value 0..1; channels 0..255 rounded half up."""
    sector = F.pmod(h, F.lit(360.0)) / 60

    def channel(n: int) -> Column:
        k = F.pmod(sector + n, F.lit(6.0))
        return F.floor((v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255 + 0.5).cast("int")

    return channel(5), channel(3), channel(1)
