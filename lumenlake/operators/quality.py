"""Checks of pixels and samples: dark frames, content boxes, volume, structural similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The constants of structural similarity for 8-bit pixels, the largest level in decibels, full scale of 16-bit samples.
C1, C2 = 6.5025, 58.5225
MAX_DB, FULL = 91, 32768


def dark_percent(pixels: Column, below: Column | float = 32) -> Column:
    """Whole percent, cut off, of the pixels (an array) darker than ``below``; null for an empty array."""
    return F.floor(F.size(F.filter(pixels, lambda p: p < F.lit(below))) * 100 / F.nullif(F.size(pixels), F.lit(0))).cast("int")


def content_box(pixels: Column, width: int, above: float = 16) -> Column:
    """``x1, y1, x2, y2`` of the pixels (row-major) brighter than ``above``; null if there are none."""
    bright = F.filter(F.transform(pixels, lambda p, i: F.when(p > above, i)), lambda i: i.isNotNull())
    columns, rows = F.transform(bright, lambda i: (i % width).cast("int")), F.transform(bright, lambda i: F.floor(i / width).cast("int"))
    box = F.struct(F.array_min(columns).alias("x1"), F.array_min(rows).alias("y1"), F.array_max(columns).alias("x2"), F.array_max(rows).alias("y2"))
    return F.when(F.size(bright) > 0, box)


def _decibels(power: Column) -> Column:
    return F.when(power > 0, F.lit(-10.0) * F.log10(power / F.lit(float(FULL) * FULL))).otherwise(F.lit(float(MAX_DB)))


def volume(samples: DataFrame, sample: str, *by: str) -> DataFrame:
    """``n_samples, mean_volume, max_volume`` (dB, 0 is full scale) of 16-bit samples per group; the mean power is rounded to a whole number first. Nulls are no samples."""
    s = F.col(sample).cast("long")
    power = F.floor((F.sum(s * s) + F.floor(F.count(s) / 2)) / F.count(s))
    out = samples.groupBy(*by).agg(F.count(s).alias("n_samples"), power.alias("power"), F.max(F.abs(s)).alias("peak"))
    out = out.where("n_samples > 0")
    return out.select(*by, "n_samples", (-_decibels(F.col("power"))).alias("mean_volume"), (-_decibels(F.col("peak") * F.col("peak"))).alias("max_volume"))


def loudness_histogram(samples: DataFrame, sample: str, *by: str) -> DataFrame:
    """``db, n``: samples per whole decibel below full scale; silence is at MAX_DB. One row per level, by partial aggregation."""
    s = F.col(sample).cast("long")
    return samples.where(s.isNotNull()).groupBy(*by, F.floor(_decibels(s * s)).cast("int").alias("db")).agg(F.count("*").alias("n"))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two frames of equal size with one window over the whole frame; 1 for equal frames. For sliding windows see ``sources.frames.ssim``."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    ma, mb = total(F.transform(a, lambda p: p.cast("double"))) / n, total(F.transform(b, lambda p: p.cast("double"))) / n
    va, vb, cov = total(product(a, a)) / n - ma * ma, total(product(b, b)) / n - mb * mb, total(product(a, b)) / n - ma * mb
    return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
