"""History of changing entity attributes (problem 4): gaps and islands over all snapshots.

A change is a refresh whose attribute hash differs from that of the refresh before it. To keep a
hot entity from ending up in one task, refreshes are partitioned by entity and time chunk; within
a chunk ``lag`` finds the changes, and one compact row per entity and chunk (first and last hash,
number of changes) carries the comparison across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a chunk. The rows of one entity within a chunk are sorted in one task; a hot entity is spread over all its chunks.
CHUNK = "week"

#: Rows of one entity and chunk from which on the chunk is cut further, and how many of the most frequent ones are looked at; a chunk with a larger share of all rows than one in TRACKED is certainly seen.
MOST, TRACKED = 1_000_000, 10_000

#: Length of the chunks in seconds, where they are cut further.
_SECONDS = {"week": 604_800, "day": 86_400, "hour": 3_600}


def _hot(cut: DataFrame, most: int) -> DataFrame | None:
    """``hot, parts`` of the chunks with more than ``most`` rows: a hash of entity and chunk, and in how many parts to cut it. None if there are none.

    A mergeable sketch per task finds them; at most TRACKED rows reach the driver.
    """
    top = cut.agg(F.expr(f"approx_top_k(xxhash64(entity, chunk), {TRACKED}, {10 * TRACKED})").alias("t")).select(F.explode("t").alias("t"))
    found = top.where(F.col("t.count") > most).select("t.item", F.ceil(F.col("t.count") / most).cast("int").alias("parts")).collect()
    if not found:
        return None
    return cut.sparkSession.createDataFrame([(r.item, r.parts) for r in found], "hot long, parts int")


def latest_per_refresh(rows: DataFrame, attributes: list[str], chunk: str = CHUNK, most: int = MOST) -> DataFrame:
    """One row per ``entity, at`` — the one stored last — with ``chunk`` and the attributes' hash ``h``.

    ``rows``: ``entity, at, stored_at`` and the attributes. Rows with null entity, null ``at`` or all
    attributes null are no refreshes. Ties on ``stored_at`` are settled by the attributes themselves
    (nulls lowest), so repeated rows and any order of arrival give the same result; a null
    ``stored_at`` counts as stored first. Chunks with more than ``most`` rows are cut further, and their copies
    are combined before the exchange.
    """
    known = F.lit(False)
    for a in attributes:
        known = known | F.col(a).isNotNull()
    cut = rows.where(F.col("entity").isNotNull() & F.col("at").isNotNull() & known).select(
        "entity", F.date_trunc(chunk, "at").alias("chunk"), "at", F.struct("stored_at", *attributes).alias("s")
    )
    hot = _hot(cut, most)
    if hot is None:  # one exchange serves the de-duplication, the windows and the chunk states that follow
        cut = cut.repartition("entity", "chunk")
    else:
        into = F.unix_timestamp("at") - F.unix_timestamp("chunk")
        width = F.greatest(F.lit(1), F.floor(F.lit(_SECONDS[chunk]) / F.col("parts")))
        finer = F.timestamp_seconds(F.unix_timestamp("chunk") + F.floor(into / width) * width)
        cut = cut.withColumn("hot", F.xxhash64("entity", "chunk")).join(F.broadcast(hot), "hot", "left")
        cut = cut.select("entity", F.when(F.col("parts").isNull(), F.col("chunk")).otherwise(finer).alias("chunk"), "at", "s")
    newest = cut.groupBy("entity", "chunk", "at").agg(F.max("s").alias("s"))
    return newest.select("entity", "chunk", "at", *(F.col(f"s.{a}").alias(a) for a in attributes)).withColumn("h", _hash(attributes))


def _hash(attributes: list[str]) -> Column:
    # xxhash64 skips nulls, so their places are hashed too
    return F.xxhash64(*(F.col(a) for a in attributes), *(F.col(a).isNull() for a in attributes))


def _in_chunk(refreshes: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity", "chunk").orderBy("at")
    return refreshes.withColumn("before", F.lag("h").over(w)).withColumn("row", F.row_number().over(w))


def _chunks(inner: DataFrame) -> DataFrame:
    """One row per entity and chunk: ``first_at, starts`` (does its first row begin a version), and what came before and comes next.

    ``versions`` and ``rows`` count those before the chunk, ``all_rows`` those of the entity; ``next_at`` and ``next_row`` are time and
    number of the first version start in a later chunk.
    """
    changed = F.col("before") != F.col("h")
    state = inner.groupBy("entity", "chunk").agg(
        F.min("at").alias("first_at"),
        F.min_by("h", "at").alias("first_h"),
        F.max_by("h", "at").alias("last_h"),
        F.count_if(changed).alias("n_inner"),
        F.count("*").alias("n_rows"),
        F.min(F.when(changed, F.struct("at", "row"))).alias("inner"),
    )
    w = Window.partitionBy("entity").orderBy("chunk")
    state = state.withColumn("prev_h", F.lag("last_h").over(w)).withColumn("starts", F.col("prev_h").isNull() | (F.col("prev_h") != F.col("first_h")))
    total = F.col("n_inner") + F.col("starts").cast("long")
    state = state.withColumn("versions", F.sum(total).over(w) - total).withColumn("rows", F.sum("n_rows").over(w) - F.col("n_rows"))
    first = F.when(F.col("starts"), F.struct(F.col("first_at").alias("at"), (F.col("rows") + 1).alias("row"))).when(F.col("inner").isNotNull(), F.struct(F.col("inner.at").alias("at"), (F.col("rows") + F.col("inner.row")).alias("row")))
    back = Window.partitionBy("entity").orderBy(F.desc("chunk"))
    following = F.last(first, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    state = state.withColumn("following", following).withColumn("all_rows", F.max(F.col("rows") + F.col("n_rows")).over(back))
    return state.select("entity", "chunk", "first_at", "starts", "versions", "rows", "all_rows", F.col("following.at").alias("next_at"), F.col("following.row").alias("next_row"))


def version_starts(rows: DataFrame, attributes: list[str], chunk: str = CHUNK, most: int = MOST) -> DataFrame:
    """``entity, valid_from`` of every version: an entity's first refresh, and each that differs from the one before; null is a value."""
    inner = _in_chunk(latest_per_refresh(rows, attributes, chunk, most))
    within = inner.where(F.col("before") != F.col("h")).select("entity", F.col("at").alias("valid_from"))
    across = _chunks(inner).where("starts").select("entity", F.col("first_at").alias("valid_from"))
    return within.unionByName(across)


def history(rows: DataFrame, attributes: list[str], chunk: str = CHUNK, most: int = MOST) -> DataFrame:
    """``entity, version, valid_from, valid_to, <attributes>, n_refreshes``: one row per island of equal refreshes.

    ``valid_to`` is the start of the next version and null for the current one. Start, number and length of a version
    are found within its chunk, and over its border from the compact row of the chunk, so versions are neither grouped nor joined
    with each other. An empty input gives no rows. See :func:`latest_per_refresh` for nulls, ties and repeated rows.
    """
    inner = _in_chunk(latest_per_refresh(rows, attributes, chunk, most))
    w = Window.partitionBy("entity", "chunk").orderBy("at")
    candidates = inner.where(F.col("before").isNull() | (F.col("before") != F.col("h")))  # all but the first of a chunk do begin a version
    candidates = candidates.withColumn("later", F.lead(F.struct("at", "row")).over(w)).withColumn("k", F.row_number().over(w))
    starts = candidates.join(_chunks(inner), ["entity", "chunk"]).where(F.col("before").isNotNull() | F.col("starts"))
    number = F.col("versions") + F.col("k") - F.when(F.col("starts"), 0).otherwise(1)
    ends = F.coalesce(F.col("rows") + F.col("later.row"), F.col("next_row"), F.col("all_rows") + 1)
    return starts.select(
        "entity", number.alias("version"), F.col("at").alias("valid_from"), F.coalesce("later.at", "next_at").alias("valid_to"), *attributes, (ends - F.col("rows") - F.col("row")).alias("n_refreshes")
    )
