"""Relational bookkeeping of a catalog: keyset pages, progress, existence, status transitions, upserts, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pages


def next_batch(df: DataFrame, size: int, last_id=None, id_column: str = "id", created: str = "created_at", strict: bool = True) -> DataFrame:
    """Keyset page: the ``size`` rows after ``last_id`` in order of creation, then id.

    The border row is looked up by a scalar subquery. An unknown ``last_id`` gives no rows, or with
    ``strict=False`` starts from the beginning.
    """
    ordered = [F.col(created), F.col(id_column)]
    if last_id is not None:
        border = df.where(F.col(id_column) == last_id).agg(F.max(created).alias("t")).scalar()
        after = (F.col(created) > border) | ((F.col(created) == border) & (F.col(id_column) > last_id))
        df = df.where(after if strict else (after | border.isNull()))
    return df.orderBy(*ordered).limit(size)


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def recent(df: DataFrame, n: int, order_column: str, id_column: str, where: Column | None = None) -> DataFrame:
    """The ``n`` newest rows by a column given by name, which must exist; ties by id."""
    if order_column not in df.columns:
        raise ValueError(f"no column {order_column!r}")
    return (df if where is None else df.where(where)).orderBy(F.col(order_column).desc_nulls_last(), id_column).limit(n)


# Existence


def orphan_folders(folders: DataFrame, known: DataFrame, code: str = "code", platform: str | None = None) -> DataFrame:
    """Distinct folders without a known row; matched on the code alone, or on platform and code (``platform`` given)."""
    on = [code] if platform is None else [platform, code]
    return folders.distinct().join(known.select(*on).distinct(), on, "left_anti")


def existing(df: DataFrame, listing: DataFrame, *on: str) -> DataFrame:
    """Rows that the listing has: one semi join, which ends whether or not there is a hit."""
    return df.join(listing.select(*on), list(on), "left_semi")


def missing(df: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """Rows that none of the others has."""
    return reduce(lambda left, other: left.join(other.select(*on), on, "left_anti"), others, df)


def exists_map(codes: DataFrame, collection: DataFrame, on: str, out: str = "present") -> DataFrame:
    """Every distinct code once, with whether the collection has it."""
    have = collection.select(on).where(F.col(on).isNotNull()).distinct().withColumn(out, F.lit(True))
    return codes.select(on).distinct().join(have, on, "left").withColumn(out, F.coalesce(out, F.lit(False)))


# Status transitions


def set_flags(df: DataFrame, ids: DataFrame, values: dict[str, Column], on: str = "id") -> DataFrame:
    """``df`` with the given columns set in rows whose id is in ``ids``; other rows, and all rows if ``ids`` is empty, are unchanged."""
    hit = ids.select(F.col(on)).where(F.col(on).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    marked = df.join(hit, on, "left")
    return marked.select(*(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def bounded_reset(df: DataFrame, flag: str, n: int, id_column: str = "id") -> DataFrame:
    """``df`` with ``flag`` set to false in the first ``n`` rows (by id) that have it."""
    first = df.where(F.col(flag)).select(id_column).orderBy(id_column).limit(n)
    return set_flags(df, first, {flag: F.lit(False)}, id_column)


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Union of both with the last version of each key; of equal versions the row of ``new``. An empty ``new`` changes nothing but older copies."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)))
    last = both.groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct(version, "_from")).alias("_s"))
    return last.select("_s.*")


def insert_guarded(errors: DataFrame, parents: DataFrame, reference: str, parent_id: str) -> DataFrame:
    """Rows to insert whose parent exists; the others are dropped silently."""
    return errors.join(parents.select(F.col(parent_id).alias(reference)), reference, "left_semi")


def content_errors(content: DataFrame, errors: DataFrame, content_id: str, reference: str) -> DataFrame:
    return content.join(errors, F.col(content_id) == F.col(reference))


# Reports


def progress(df: DataFrame, extracted: Column, embedded: Column) -> DataFrame:
    """One row: ``total, extracted, embedded, extracted_percent, embedded_percent``; for an empty table the sums are null and the percentages 0."""
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    share = lambda c: F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * flag(c) / F.count("*"), 2)).cast("double")
    return df.agg(
        F.count("*").alias("total"), flag(extracted).alias("extracted"), flag(embedded).alias("embedded"), share(extracted).alias("extracted_percent"), share(embedded).alias("embedded_percent")
    )


def progress_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("progress"))


def counters(df: DataFrame, ok: Column, *by: str) -> DataFrame:
    """``total, succeeded, failed`` (a null outcome is a failure) per group."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), (F.count("*") - F.count_if(ok)).alias("failed"))


def outcome_lists(df: DataFrame, ok: Column, item: Column, position: Column, *by: str) -> DataFrame:
    """``total, successful, failed`` per group; the lists keep the order of ``position``."""
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(position.alias("p"), item.alias("v"))))), lambda x: x["v"])
    return df.groupBy(*by).agg(F.count("*").alias("total"), pick(ok).alias("successful"), pick(~F.coalesce(ok, F.lit(False))).alias("failed"))


def download_summary(df: DataFrame, ok: Column, item: Column, position: Column, begun: Column, ended: Column, *by: str) -> DataFrame:
    """``total_videos, success, errors, downloaded_in_secs`` per group: failed items in input order, seconds from the first begin to the last end, two decimals."""
    good = F.coalesce(ok, F.lit(False))
    errors = F.transform(F.array_sort(F.collect_list(F.when(~good, F.struct(position.alias("p"), item.alias("v"))))), lambda x: x["v"])
    secs = F.round((F.unix_micros(F.max(ended)) - F.unix_micros(F.min(begun))) / F.lit(1e6), 2)
    return df.groupBy(*by).agg(F.count("*").alias("total_videos"), F.count_if(good).alias("success"), errors.alias("errors"), secs.alias("downloaded_in_secs"))


def processing_status(df: DataFrame, video: str, uploaded: Column, stored: Column) -> DataFrame:
    """Per video the frames extracted, uploaded and stored, the status and a line of text."""
    per = df.groupBy(video).agg(F.count("*").alias("extracted"), F.count_if(uploaded).alias("uploaded"), F.count_if(stored).alias("stored"))
    status = F.when(F.col("stored") == F.col("extracted"), "processed").otherwise("upload_completed_processing_failed")
    return per.withColumn("status", status).withColumn("message", F.format_string("%d frames extracted, %d uploaded, %d stored", "extracted", "uploaded", "stored"))


def distinct_count(df: DataFrame, c: Column, exact: bool = True) -> DataFrame:
    return df.agg((F.count_distinct(c) if exact else F.approx_count_distinct(c)).alias("n"))


def profile(df: DataFrame, function: str, seconds: str) -> DataFrame:
    return df.groupBy(function).agg(F.count("*").alias("calls"), F.sum(seconds).alias("total_sec"), F.avg(seconds).alias("mean_sec"), F.max(seconds).alias("max_sec"))


# Sets


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    return a.subtract(b.select(*a.columns))


def required_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row ``kept, skipped`` of :func:`required`."""
    return df.agg(F.count_if(_present(df, columns)).alias("kept"), F.count_if(~_present(df, columns)).alias("skipped"))


def zip_positions(df: DataFrame, left: str, right: str, *keep: str) -> DataFrame:
    """``keep, pos, left, right``: one row per position (from 0) that both arrays have; the longer one is cut to the shorter. Null arrays give no rows."""
    n = F.least(F.size(left), F.size(right))
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keep, left, right, F.posexplode(F.slice(left, 1, n)).alias("pos", "_l"))
    return both.select(*keep, "pos", F.col("_l").alias(left), F.element_at(right, F.col("pos") + 1).alias(right))


def lexical_positions(df: DataFrame, path: str, *by: str) -> DataFrame:
    """``df`` with ``position`` (from 0) of each row in the order of its path as text, within its group: ``10_…`` comes before ``2_…``."""
    if not by:
        raise ValueError("name the group: a single order over the whole table would be one task")
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(path)) - 1)


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with all of the columns present; empty text counts as absent."""
    return df.where(_present(df, columns))


def _present(df: DataFrame, columns: tuple[str, ...]) -> Column:
    types = dict(df.dtypes)
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.coalesce(F.col(c) != "", F.lit(False)) if types[c] == "string" else F.col(c).isNotNull())
    return keep


def batch_ids(df: DataFrame, order: str, size: int, out: str = "batch_id", chunk: int = 4096) -> DataFrame:
    """``df`` with the number (from 0) of its batch of ``size`` rows in order of the unique BIGINT column ``order``, which may have gaps.

    Rows are numbered without a single ordered partition: counts per range of ``chunk`` values, and per range of so
    many ranges, give each range its offset; only the counts of the upper level are ordered globally.
    """
    ranged = df.withColumn("_r", F.floor(F.col(order) / chunk))
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_u", F.floor(F.col("_r") / chunk))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = counts.groupBy("_u").agg(F.sum("_n").alias("_n")).withColumn("_b", before(Window.orderBy("_u"))).select("_u", "_b")
    offsets = counts.withColumn("_i", before(Window.partitionBy("_u").orderBy("_r"))).join(upper, "_u").select("_r", (F.col("_b") + F.col("_i")).alias("_o"))
    numbered = ranged.join(offsets, "_r").withColumn("_k", F.col("_o") + F.row_number().over(Window.partitionBy("_r").orderBy(order)) - 1)
    return numbered.select(*df.columns, F.floor(F.col("_k") / size).alias(out))


def random_ids(df: DataFrame, n: int = 8, seed: int = 0, out: str = "hash") -> DataFrame:
    """A random alphanumeric text per row; never to be used as a key."""
    return df.withColumn(out, F.call_function("randstr", F.lit(n), F.lit(seed)))
