"""A few keys holding most records (problem 7): eager aggregation through joins.

Both inputs are aggregated by the join key before the join — a hot key shrinks to one partial state
per map task before anything is shuffled — and the compact states are joined. What a join of the
raw rows would have given is found algebraically: counts multiply, and a sum on one side is
multiplied by the count of the other. Roll-ups combine the joined states further.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type of counts and sums over a join, which may exceed 64 bits.
WIDE = "decimal(38,0)"


def states(df: DataFrame, key: Column | str, sums: dict[str, Column], prefix: str) -> DataFrame:
    """``key, <prefix>n`` and a sum and non-null count for each of ``sums``: the compact state of one input. Null keys join nothing and are dropped."""
    key = F.col(key) if isinstance(key, str) else key
    slim = df.select(key.alias("key"), *(c.alias(n) for n, c in sums.items())).where(F.col("key").isNotNull())
    return slim.groupBy("key").agg(F.count("*").alias(f"{prefix}n"), *(F.sum(n).alias(f"{prefix}{n}") for n in sums))


def eager_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join of two :func:`states` with prefixes ``l_`` and ``r_``, one row per key.

    Adds ``n_pairs``, the rows that the join of the raw inputs has for the key, and
    ``pair_<name>`` for every sum: its total over those rows. Null measures are ignored by sums, and a sum
    without any value is null, as in SQL. With ``how='left'`` keys without partner keep one row per left row. Empty inputs give no rows.
    """
    joined = left.join(right, "key", how)
    ln, rn = F.coalesce("l_n", F.lit(1)).cast(WIDE), F.coalesce("r_n", F.lit(1)).cast(WIDE)
    if how == "inner":
        ln, rn = F.col("l_n").cast(WIDE), F.col("r_n").cast(WIDE)
    pair = [(ln * rn).cast(WIDE).alias("n_pairs")]
    pair += [(F.col(c).cast(WIDE) * rn).cast(WIDE).alias(f"pair_{c[2:]}") for c in left.columns if c.startswith("l_") and c != "l_n"]
    pair += [(F.col(c).cast(WIDE) * ln).cast(WIDE).alias(f"pair_{c[2:]}") for c in right.columns if c.startswith("r_") and c != "r_n"]
    return joined.select("*", *pair)


def heavy_keys(joined: DataFrame, share: str, rows: DataFrame, side: str = "l_") -> DataFrame:
    """Rows of ``joined`` (an :func:`eager_join`) whose key holds at least ``share`` (a decimal, as text) of all rows of ``rows``, those without a key included.

    The key's rows are read off the joined states: the pairs of the key divided by the other side's count, so the
    join is part of the answer. ``side`` is the prefix of the input whose share is asked for.
    """
    other = F.coalesce(F.col("r_n" if side == "l_" else "l_n"), F.lit(1))
    total = rows.agg(F.count("*")).scalar()
    return joined.where((F.col("n_pairs") / other.cast(WIDE)).cast("decimal(20,0)") >= F.lit(Decimal(share)) * total)


def name_key(name: Column) -> Column:
    """One spelling of an account name: lower case, without blanks around it and the leading at-sign. Null and blank names are null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), "^@+", ""), F.lit(""))
