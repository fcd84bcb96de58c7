"""Aggregates of rasters: scans, entropies, downsampling, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.functions.arith import div, half_up
from tessera.model import Spec


def scan(cells: DataFrame, element: str = "z") -> DataFrame:
    """n, mean, least, most, total of the valid cells; the order of a scan doesn't matter."""
    z = F.col(element)
    valid = F.when(~F.isnan(z.cast("double")), z)
    return cells.agg(F.count(valid).alias("n"), F.avg(valid).alias("mean"), F.min(valid).alias("least"), F.max(valid).alias("most"), F.sum(valid).alias("total"))


def exact_sum(df: DataFrame, element: str = "z") -> DataFrame:
    """total, n: the sum of doubles as if with unlimited digits, rounded once, whatever the order; NaNs and nulls are left out.

    Terms are whole numbers times a power of two; those of one power are added up as integers, in
    two halves, task by task, then by power (2,100 at most, which one task puts together).
    """
    import numpy as np
    import pyarrow as pa

    def split(batches):
        for b in batches:
            z = b.column(0).drop_null().to_numpy()
            z = z[~np.isnan(z)]
            odd = z[np.isinf(z)]
            part, power = np.frexp(z[~np.isinf(z)])
            whole = (part * (1 << 53)).astype(np.int64)
            powers, at = np.unique(power, return_inverse=True)
            high, low = np.zeros(len(powers), np.int64), np.zeros(len(powers), np.int64)
            np.add.at(high, at, whole >> 27)
            np.add.at(low, at, whole & ((1 << 27) - 1))
            n = np.bincount(at, minlength=len(powers))
            yield pa.record_batch([pa.array([*powers.tolist(), None]), pa.array([*high.tolist(), 0]), pa.array([*low.tolist(), 0]), pa.array([*n.tolist(), len(odd)]), pa.array([0.0] * len(powers) + [float(odd.sum())])], schema=pa.schema([("power", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("odd", pa.float64())]))

    def put_together(batches):
        from fractions import Fraction

        total, n, odd = Fraction(0), 0, 0.0
        for b in batches:
            for r in b.to_pylist():
                n, odd = n + r["n"], odd + r["odd"]
                if r["power"] is not None:
                    total += Fraction(int(r["high"]) * (1 << 27) + int(r["low"])) * Fraction(2) ** (r["power"] - 53)
        try:
            value = float(total)
        except OverflowError:
            value = float("inf") if total > 0 else float("-inf")
        yield pa.record_batch([pa.array([odd if odd else value if n else None], pa.float64()), pa.array([n], pa.int64())], names=["total", "n"])

    parts = df.select(F.col(element).cast("double")).mapInArrow(split, "power long, high long, low long, n long, odd double")
    sums = parts.groupBy("power").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")), F.sum("n").alias("n"), F.sum("odd").alias("odd"))
    return sums.coalesce(1).mapInArrow(put_together, "total double, n long")


def tile_report(cells: DataFrame, spec: Spec, element: str = "z") -> DataFrame:
    """For each populated tile: valid cells, range, and whether any cell is missing."""
    at = cells.withColumn("tile_index", grid.tile_index(spec, F.col("row"), F.col("col")))
    down, across = grid.tile_origin(spec, F.col("tile_index"))
    inside = F.least(F.lit(spec.tile_rows), spec.n_rows - down * spec.tile_rows) * F.least(F.lit(spec.tile_cols), spec.n_cols - across * spec.tile_cols)
    g = at.filter(F.col(element).isNotNull()).groupBy("tile_index").agg(F.count(element).alias("valid"), F.min(element).alias("least"), F.max(element).alias("most"))
    return g.select("tile_index", "valid", "least", "most", (F.col("valid") < inside).alias("has_missing"))


def populated_tiles(cells: DataFrame, spec: Spec, element: str = "z") -> DataFrame:
    tile = grid.tile_index(spec, F.col("row"), F.col("col"))
    return cells.filter(F.col(element).isNotNull()).select(tile.alias("t")).distinct().agg(F.count("*").alias("populated_tiles"))


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """bits (Shannon), symbols, distinct, once, most of a table of symbol counts."""
    # -sum p log2 p = log2 N - sum c log2 c / N, so that one pass suffices.
    c = F.col(n)
    total = F.sum(c)
    return counts.agg(
        (F.log2(total.cast("double")) - F.sum(c * F.log2(c.cast("double"))) / total).alias("bits"), total.alias("symbols"), F.count("*").alias("distinct_symbols"),
        F.sum((c == 1).cast("long")).alias("once"), F.max(c).alias("most"),
    )


def symbol_counts(df: DataFrame, symbol: Column) -> DataFrame:
    return df.groupBy(symbol.alias("symbol")).agg(F.count("*").alias("n"))


def float_bits(df: DataFrame, element: str = "z") -> DataFrame:
    """df with `bits`: the 32-bit pattern of a float, told apart where SQL values are equal (zeros, NaNs)."""

    def view(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            z = b.column(0).to_numpy(zero_copy_only=False).astype(np.float32)
            yield pa.record_batch([b.column(0), pa.array(z.view(np.int32))], names=[element, "bits"])

    return df.select(F.col(element).cast("float").alias(element)).mapInArrow(view, f"`{element}` float, bits int")


def histogram_mean(counts: DataFrame, scale: float) -> DataFrame:
    """n, mean of what a histogram of floor(z * scale) counts, each value at the middle of its bin."""
    return counts.agg(F.sum("n").alias("n"), (F.sum((F.col("bin") + 0.5) * F.col("n")) / F.sum("n") / scale).alias("mean"))


SHAPES = ("row_major", "column_major", "row_block", "tile_block", "tile_load")


def scan_shape(cells: DataFrame, spec: Spec, shape: str, element: str = "z") -> DataFrame:
    """shape, reads, n, total: a full scan by rows, columns, rows of tiles, tiles' cells, or stored tiles; reads: how many pieces it takes."""
    from tessera.operators.cells import tile_totals

    z = F.col(element)
    if shape == "tile_load":
        each = tile_totals(cells, spec, element)
    else:
        row, col = F.col("row"), F.col("col")
        key = {"row_major": [row], "column_major": [col], "row_block": [grid.tile_row(spec, row)], "tile_block": [grid.tile_row(spec, row), grid.tile_col(spec, col)]}[shape]
        each = cells.filter(z.isNotNull()).groupBy(*key).agg(F.count(z).alias("n"), F.sum(z.cast("double")).alias("total"))
    return each.agg(F.count("*").alias("reads"), F.sum("n").cast("long").alias("n"), F.sum("total").alias("total")).select(F.lit(shape).alias("shape"), "reads", "n", "total")


def histogram(df: DataFrame, z: Column, scale: float) -> DataFrame:
    """Counts of floor(z * scale)."""
    return df.filter(z.isNotNull()).groupBy(F.floor(z.cast("double") * scale).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def order1_entropy(pairs: DataFrame) -> DataFrame:
    """H(x | prior) in bits of a table (prior, x) of pairs."""
    joint = pairs.groupBy("prior", "x").agg(F.count("*").alias("n"))
    c = F.col("n").cast("double")
    by = joint.groupBy("prior").agg(F.sum("n").alias("m"), F.sum(c * F.log2(c)).alias("s"))
    m = F.col("m").cast("double")
    return by.agg(((F.sum(m * F.log2(m)) - F.sum("s")) / F.sum(m)).alias("bits"), F.sum("m").alias("pairs"))


def in_row_pairs(cells: DataFrame, symbol: Column) -> DataFrame:
    """(prior, x) of neighbours in a row."""
    w = Window.partitionBy("row").orderBy("col")
    return cells.select(F.lag(symbol).over(w).alias("prior"), symbol.alias("x")).filter("prior is not null")


def downsample(cells: DataFrame, spec: Spec, factor: int, element: str = "z", strict: bool = True) -> DataFrame:
    """Block means of an integer-coded element, rounded half up; leftover rows and columns are dropped.

    strict: a block with any missing cell is missing; else the mean is of its valid cells.
    """
    rows, cols = spec.n_rows // factor, spec.n_cols // factor
    inside = cells.filter((F.col("row") < rows * factor) & (F.col("col") < cols * factor))
    g = inside.groupBy(div(F.col("row"), factor).alias("row"), div(F.col("col"), factor).alias("col"))
    mean = half_up(F.sum(F.col(element).cast("long")) / F.count(element), "int")
    return g.agg((F.when(F.count(element) == factor * factor, mean) if strict else mean).alias(element))


def downsample_float(cells: DataFrame, spec: Spec, factor: int, element: str = "z") -> DataFrame:
    """Block means of a float element; a block with any missing cell is missing."""
    rows, cols = spec.n_rows // factor, spec.n_cols // factor
    g = cells.filter((F.col("row") < rows * factor) & (F.col("col") < cols * factor)).groupBy(div(F.col("row"), factor).alias("row"), div(F.col("col"), factor).alias("col"))
    return g.agg(F.when(F.count(element) == factor * factor, F.avg(F.col(element).cast("double")).cast("float")).alias(element))


def downsampled_spec(spec: Spec, factor: int) -> Spec:
    """The smaller raster's specification; the outer corners stay where they are."""
    from dataclasses import replace

    rows, cols = spec.n_rows // factor, spec.n_cols // factor
    half = (factor - 1) / 2
    return replace(spec, n_rows=rows, n_cols=cols, tile_rows=min(spec.tile_rows, rows), tile_cols=min(spec.tile_cols, cols), x0=spec.x0 + half * spec.cell_x, y0=spec.y0 + half * spec.cell_y, cell_x=spec.cell_x * factor, cell_y=spec.cell_y * factor)


def below_zero(cells: DataFrame, spec: Spec, element: str = "z", missing: float = -32767) -> DataFrame:
    """cells, area (km2), volume (km3), mean_depth of the cells below zero; values up to `missing` are none."""
    z = F.col(element)
    sea = cells.filter((z < 0) & (z > missing))
    area = grid.cell_area_km2(spec, F.col("row"))
    return sea.agg(F.count("*").alias("cells"), F.sum(area).alias("area"), F.sum(-area * z / 1000).alias("volume"), (F.sum(-z) / F.count("*")).alias("mean_depth"))


def scaled_mean(cells: DataFrame, factor: int, element: str = "z") -> DataFrame:
    """Means by image pixel, of the valid cells."""
    return cells.groupBy(div(F.col("row"), factor).alias("row"), div(F.col("col"), factor).alias("col")).agg(F.avg(element).alias(element), F.count(element).alias("n"))


def rgb_reduce(cells: DataFrame, factor: int, rgb: str = "rgb") -> DataFrame:
    """Box means of packed colours, each channel rounded half up."""
    n = factor * factor

    def mean(shift: int) -> Column:
        total = F.sum(F.shiftright(F.col(rgb), shift).bitwiseAND(255).cast("long"))
        return F.floor((total + n // 2) / n).cast("int")

    g = cells.groupBy(div(F.col("row"), factor).alias("row"), div(F.col("col"), factor).alias("col"))
    return g.agg((mean(16) * 65536 + mean(8) * 256 + mean(0)).cast("int").alias(rgb), F.count("*").alias("n")).filter(F.col("n") == n).drop("n")


def residual_stats(df: DataFrame, e: str = "residual") -> DataFrame:
    """n, mean error, root mean square, mean absolute, and share of zeros (per cent)."""
    r = F.col(e).cast("double")
    return df.agg(F.count(e).alias("n"), F.avg(r).alias("mean_error"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mean_abs"), (F.avg((r == 0).cast("double")) * 100).alias("percent_zero"))
