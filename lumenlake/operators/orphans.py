"""References to records that do not exist (problem 1).

A Bloom filter of the parents' keys, sized by their number and sent to every executor as a scalar
subquery, proves most missing parents without a shuffle. Only references that pass the filter
take part in the exact join with one compact state per parent. Both parts are then united,
and aggregated per table and month for the report. References are scanned once for each part: the proven ones
need no shuffle, which costs more than a second reading of three columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import Filter

_WRAPPING = "{}()[]<>\"'- \t\r\n\u00a0\u200b\ufeff"


def uuid_key(ref: Column) -> Column:
    """Binary key of a UUID in any customary notation (case, hyphens, braces, ``urn:uuid:``, blanks).

    Null for null, blank and empty-bodied references. Text that is no UUID keeps its own bytes,
    so it can equal only the same text.
    """
    usual = F.when(F.length(ref) == 36, F.unhex(F.replace(ref, F.lit("-"), F.lit(""))))
    body = F.translate(F.lower(ref), _WRAPPING, "")
    body = F.regexp_replace(body, "^(urn:)?(uuid:)", "")
    other = F.when(body == "", None).when(body.rlike("^[0-9a-f]{32}$"), F.unhex(body)).otherwise(F.encode(body, "UTF-8"))
    return F.when(F.octet_length(usual) == 16, usual).otherwise(other)  # most need no pattern


def references(df: DataFrame, table_name: str, row_id: str, ref: str, time: str) -> DataFrame:
    """``table_name, row_id, parent, time`` of the non-blank references of ``df``; other columns are dropped, so their names cannot clash."""
    return df.select(
        F.lit(table_name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), uuid_key(F.col(ref)).alias("parent"), F.col(time).alias("time")
    ).where(F.col("parent").isNotNull())


def orphans(refs: DataFrame, parents: DataFrame, expected_parents: int | None = None) -> DataFrame:
    """Orphan references, distinct, as ``table_name, row_id, time, reason``.

    ``refs`` comes from :func:`references`; ``parents`` has ``id, updated_at, created_at, is_removed``.
    Reasons: 'missing' (no parent row), 'removed' (the newest parent row by updated_at is removed
    and the reference is later), 'early' (the reference precedes the parent's creation).

    Nulls: blank references are none; without a time only 'missing' applies; a null is_removed
    is not removed. Ties on updated_at are settled by the larger flag and creation time. Repeated
    rows count once. An empty parent table makes every reference missing; an empty reference table
    gives no rows. ``expected_parents`` is counted (from the files' footers) if it is not given.
    """
    keyed = parents.select(uuid_key(F.col("id")).alias("parent"), "updated_at", "is_removed", "created_at").where(F.col("parent").isNotNull())
    bloom = Filter(keyed, F.col("parent"), parents.count() if expected_parents is None else expected_parents)
    parts = [(refs.where(mine), passed) for mine, passed in bloom.rounds(F.col("parent"))]
    definite = reduce(DataFrame.unionByName, [r.where(~passed) for r, passed in parts]).select("table_name", "row_id", "time", F.lit("missing").alias("reason"))
    maybe = reduce(DataFrame.unionByName, [r.where(passed) for r, passed in parts])
    newest = keyed.groupBy("parent").agg(F.max(F.struct("updated_at", "is_removed", "created_at")).alias("s"))
    joined = maybe.join(newest, "parent", "left")
    reason = (
        F.when(F.col("s").isNull(), "missing")
        .when(F.col("s.is_removed") & (F.col("time") > F.col("s.updated_at")), "removed")
        .when(F.col("s.created_at") > F.col("time"), "early")
    )
    verified = joined.select("table_name", "row_id", "time", reason.alias("reason")).where(F.col("reason").isNotNull())
    return definite.unionByName(verified).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference ('unknown' without a time) and reason."""
    month = F.coalesce(F.date_format("time", "yyyy-MM"), F.lit("unknown"))
    return found.groupBy("table_name", month.alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
