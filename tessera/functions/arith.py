"""Integer and rounding rules of the data model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(x: Column) -> Column:
    """x (BIGINT) as a two's-complement 32-bit integer; Spark's own int overflow raises."""
    return (F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)).cast("int")


def half_up(x: Column, to: str = "long") -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + F.lit(0.5)).cast(to)


def truncated(x: Column) -> Column:
    """To a 32-bit integer as by a saturating cast: NaN is 0."""
    bounded = F.greatest(F.least(x, F.lit(2147483647.0)), F.lit(-2147483648.0))
    return F.when(F.isnan(x), F.lit(0)).otherwise(bounded.cast("long").cast("int"))


def div(a: Column, b: int) -> Column:
    """Floor division of non-negative integers that stays integral."""
    return F.floor(a / F.lit(b)).cast("int")


def to180(angle: Column) -> Column:
    """Into [-180, 180)."""
    a = angle % F.lit(360.0)
    return F.when(a < -180, a + 360).when(a >= 180, a - 360).otherwise(a)


def to360(angle: Column) -> Column:
    """Into [0, 360)."""
    a = angle % F.lit(360.0)
    return F.when(a < 0, a + 360).otherwise(a)
