"""Bloom filters that stay inside the JVM plan.

Spark builds and probes Bloom filters itself for its runtime joins; the two Catalyst expressions
are used here directly, so that building is a tree of partial aggregates and probing is one
code-generated call per row, with no Python and no driver round trip: the filter reaches the
executors as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, which with the best number of hashes leave 0.3 percent false positives.
BITS_PER_KEY = 12

#: Size limit of one segment (Spark's own for such filters), and segments that are sent together: 16 of 8 MiB, for 89 million keys.
SEGMENT_BITS, SEGMENTS = 8 * 1024 * 1024 * 8, 16


def _classic(spark, expression) -> Column:
    from pyspark.sql.classic.column import Column as ClassicColumn

    return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _expression(spark, column: Column):
    return spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(column._jc)


class Filter:
    """A Bloom filter of any number of keys, in segments by a hash of the key, each in the size that its keys need.

    Every segment is built by one task that sees only its keys, so the work of a task is bounded
    whatever their number, and partial filters are neither shuffled nor merged. At most SEGMENTS segments are one scalar subquery,
    which is what an executor holds at a time; more keys make further *rounds*, each with
    its own share of the keys (:meth:`rounds`).
    """

    def __init__(self, keys: DataFrame, key: Column, expected: int, segment_bits: int = SEGMENT_BITS, segments: int = SEGMENTS):
        self.spark = keys.sparkSession
        self.parts = max(1, -(-expected * BITS_PER_KEY // segment_bits))
        self.expected = max(1, -(-expected // self.parts))
        self.bits = max(1024, min(segment_bits, self.expected * BITS_PER_KEY))
        self.hashes = keys.where(key.isNotNull()).select(F.xxhash64(key).alias("h")).distinct()
        self.segments = segments

    def _part(self, h: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(h, 17), F.lit(self.parts)).cast("int")

    def rounds(self, key: Column) -> list[tuple[Column, Column]]:
        """For each round: whether a key belongs to it, and whether the filter may contain the key (false: certainly not)."""
        h = F.xxhash64(key)
        out = []
        for first in range(0, self.parts, self.segments):
            numbers = range(first, min(first + self.segments, self.parts))
            mine = self._part(h).between(numbers[0], numbers[-1]) if self.parts > self.segments else F.lit(True)
            filters = self._filters(numbers)
            probe = F.lit(None).cast("boolean")
            for i, n in enumerate(numbers):
                one = self._probe(filters, i, h)
                probe = one if len(numbers) == 1 else F.when(self._part(h) == n, one).otherwise(probe)
            out.append((mine, F.coalesce(probe, F.lit(False))))
        return out

    def _filters(self, numbers: range) -> DataFrame:
        """One row with a struct of the serialised filters of these segments; a segment without keys is null."""
        catalyst = self.spark._jvm.org.apache.spark.sql.catalyst.expressions
        build = catalyst.aggregate.BloomFilterAggregate(
            _expression(self.spark, F.col("h")), _expression(self.spark, F.lit(self.expected).cast("long")), _expression(self.spark, F.lit(self.bits).cast("long"))
        )
        mine = self.hashes.withColumn("part", self._part(F.col("h"))).where(F.col("part").between(numbers[0], numbers[-1]))
        built = mine.repartition(len(numbers), "part").groupBy("part").agg(_classic(self.spark, build.toAggregateExpression()).alias("f"))
        return built.agg(F.struct(*(F.max(F.when(F.col("part") == n, F.col("f"))).alias(f"f{n}") for n in numbers)).alias("filters"))

    def _probe(self, filters: DataFrame, i: int, h: Column) -> Column:
        catalyst = self.spark._jvm.org.apache.spark.sql.catalyst.expressions
        field = catalyst.GetStructField(_expression(self.spark, filters.scalar()), i, self.spark._jvm.scala.Option.empty())
        return _classic(self.spark, catalyst.BloomFilterMightContain(field, _expression(self.spark, h)))
