"""Perceptual hashes and name-based ids as expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 4122 name spaces.
NAMESPACE = {"dns": "6ba7b8109dad11d180b400c04fd430c8", "url": "6ba7b8119dad11d180b400c04fd430c8"}


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) as text, computed in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE[namespace])), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.substring(variant, nibble, F.lit(1)), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def _fold(bits: Column) -> Column:
    """BIGINT with bit i set where ``bits[i]``; bit 63 makes it negative, equality stays exact."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def dhash(grid: Column, size: int = 8) -> Column:
    """Difference hash of a row-major grid of ``size`` rows by ``size + 1`` columns: bit i is set where the right neighbour is larger; null for a missing or shorter grid."""
    at = lambda i: (i / size).cast("int") * (size + 1) + i % size + 1  # noqa: E731  1-based
    bits = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.element_at(grid, at(i) + 1) > F.element_at(grid, at(i)))
    return F.when(F.size(grid) >= size * (size + 1), _fold(bits))


def average_hash(grid: Column, cells: int = 64) -> Column:
    """Average hash of a row-major grid: bit i is set where the cell exceeds the mean."""
    mean = F.aggregate(F.slice(grid, 1, cells), F.lit(0.0), lambda a, x: a + x.cast("double")) / cells
    return F.when(F.size(grid) >= cells, _fold(F.transform(F.slice(grid, 1, cells), lambda x: x.cast("double") > mean)))


def block_mean_hash(grid: Column, rows: int, columns: int, block: int) -> Column:
    """Block-mean hash: bit per block of ``block`` x ``block`` cells, set where its mean is at least that of the grid."""
    per_row, n = columns // block, (rows // block) * (columns // block)
    mean = F.aggregate(F.slice(grid, 1, rows * columns), F.lit(0.0), lambda a, x: a + x.cast("double")) / (rows * columns)

    def block_mean(k: Column) -> Column:
        cell = lambda j: ((k / per_row).cast("int") * block + (j / block).cast("int")) * columns + (k % per_row) * block + j % block + 1
        return F.aggregate(F.sequence(F.lit(0), F.lit(block * block - 1)), F.lit(0.0), lambda a, j: a + F.element_at(grid, cell(j)).cast("double")) / (block * block)

    return F.when(F.size(grid) >= rows * columns, _fold(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: block_mean(k) >= mean)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@dataclass(frozen=True)
class Hasher:
    """A perceptual hash as two functions on columns: ``compute`` of a grid, ``compare`` of two hashes (their distance)."""

    compute: Callable[[Column], Column]
    compare: Callable[[Column, Column], Column] = hamming


#: The hashes of the library by name; others may be added.
HASHERS = {"average": Hasher(average_hash), "difference": Hasher(dhash), "block_mean": Hasher(lambda grid: block_mean_hash(grid, 8, 8, 2))}


def unsigned(h: Column) -> Column:
    """A hash as the unsigned number it stands for."""
    return F.when(h < 0, h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)")).cast("decimal(20,0)")
