"""Nearest-neighbour search over collections of embeddings.

A single query is an expression that ends in a top-k per partition (TakeOrderedAndProject). A set of
queries is bounded and checked, sent to the executors in blocks, and multiplied with the corpus one
Arrow batch at a time; each task keeps its k best per query, so only candidates are shuffled and
the corpus itself never is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..session import cut_lineage

#: Most bytes of query vectors that are in the driver, and sent to the executors, at once; further queries form further blocks.
BLOCK_BYTES = 32 * 1024 * 1024


def knn(corpus: DataFrame, query: list[float], k: int = 5, distance: str = "cosine", where: Column | None = None, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """The ``k`` nearest points to one vector, best first, with ``score``; ties by id.

    ``where`` filters before the top-k. Null vectors and those of another length are no candidates;
    zero vectors have no cosine and are left out.
    """
    expr, higher = vector.metric(distance)
    q = F.array(*(F.lit(float(x)) for x in query))
    usable = corpus if where is None else corpus.where(where)
    scored = usable.where(F.size(vector_column) == len(query)).withColumn("score", expr(F.col(vector_column), q)).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score") if higher else F.asc("score"), id_column).limit(k).drop(vector_column)


def _block_scores(q: np.ndarray, c: np.ndarray, distance: str) -> np.ndarray:
    if distance == "dot":
        return q @ c.T
    if distance == "cosine":
        qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.outer(qn, cn) > 0, (q @ c.T) / np.outer(qn, cn), -np.inf)
    d2 = (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None, :]
    return -np.sqrt(np.maximum(d2, 0.0))


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 5, distance: str = "cosine", exclude_self: bool = False, prefix: int | None = None, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """For every query its ``k`` nearest points: ``query_id, id, score, rank`` (1 is best; ties by id).

    ``queries`` and ``corpus`` both have ``id_column`` (BIGINT) and ``vector_column``. The queries are the
    stated side: they are read in blocks of at most BLOCK_BYTES, and each block passes once over
    the whole corpus. ``exclude_self`` leaves out the point with the query's own id; ``prefix``
    compares only the first elements. Null vectors and vectors of a length other than the queries' are no candidates; an empty
    query table gives no rows.
    """
    vector.metric(distance)
    distance = distance.lower()
    asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(F.size("v") > 0)
    known = asked.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if known.n and known.least != known.most:
        raise ValueError("query vectors differ in length")
    full = known.most or 0
    slim = corpus.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(F.size("v") == full)
    blocks = max(1, -(-known.n * 8 * full // BLOCK_BYTES))
    if blocks == 1:
        return _nearest(asked, slim, k, distance, exclude_self, prefix)
    # Only one block of queries is in the driver at a time; what is found for it is written before the next is read.
    parts = [cut_lineage(_nearest(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), slim, k, distance, exclude_self, prefix)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _nearest(asked: DataFrame, slim: DataFrame, k: int, distance: str, exclude_self: bool, prefix: int | None) -> DataFrame:
    """The nearest points of ``slim`` for one block of queries (``id, v``)."""
    rows = asked.toArrow()
    ids = rows.column("id").to_numpy()
    vectors = np.array([np.asarray(v, dtype=np.float64)[:prefix] for v in rows.column("v").to_pylist()])
    found = _top(slim, ids, vectors, k, distance, exclude_self, prefix)
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), F.col("id"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "id", (-F.col("s") if distance == "euclid" else F.col("s")).alias("score"), "rank")


def _top(slim: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, distance: str, exclude_self: bool, prefix: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the k best of each query so far: its number, point, score
        for batch in batches:
            n = batch.num_rows
            if not n or not len(ids):
                continue
            own = batch.column(0).to_numpy()
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)[:, :prefix]
            s = _block_scores(q, c, distance)
            if exclude_self:
                s[ids[:, None] == own[None, :]] = -np.inf
            m = min(k, n)
            # the k-th best score of each query; whatever ties with it stays, so that ties are settled by id
            cut = np.partition(s, n - m, axis=1)[:, n - m]
            qi, ci = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
            held = tuple(np.append(x, y) for x, y in zip(held, (qi, own[ci], s[qi, ci]), strict=True))
            order = np.lexsort((held[1], -held[2], held[0]))
            held = tuple(x[order] for x in held)
            rank = np.arange(len(order)) - np.searchsorted(held[0], held[0])
            held = tuple(x[rank < k] for x in held)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "id", "s"])

    return slim.mapInArrow(run, "query_id long, id long, s double")


def search_by_stored(corpus: DataFrame, library: DataFrame, point_id, owner, k: int = 5, id_column: str = "id", vector_column: str = "vector", owner_column: str = "owner", payload: str | None = None) -> DataFrame:
    """Nearest points to a stored vector that ``owner`` may use; none if it is missing, has no vector or belongs to another. With ``payload`` a point whose payload is missing passes."""
    found = owned(library.where(F.col(id_column) == point_id), owner, owner_column, payload).where(F.size(vector_column) > 0)
    return knn_join(found, corpus, k, id_column=id_column, vector_column=vector_column)


def owned(points: DataFrame, owner, owner_column: str = "owner", payload: str | None = None) -> DataFrame:
    """Points whose owner is ``owner``; a payload without owner belongs to nobody and is rejected, a missing payload passes."""
    mine = F.col(owner_column).eqNullSafe(F.lit(owner))
    return points.where(mine if payload is None else F.col(payload).isNull() | mine)


def get_points(collection: DataFrame, ids: list, id_column: str = "id") -> DataFrame:
    """Points by id, with vector and payload; the filter is pushed to the scan."""
    if not ids or any(i is None or not str(i).strip() for i in ids):
        raise ValueError("blank id")
    return collection.where(F.col(id_column).isin(ids))


def scroll(collection: DataFrame, after=None, limit: int = 256, id_column: str = "id") -> DataFrame:
    """One page of a collection, with vectors and payload: the ``limit`` points after ``after`` in order of id, from the beginning without it. An empty page is the end, so a loop over pages ends."""
    rest = collection if after is None else collection.where(F.col(id_column) > F.lit(after))
    return rest.orderBy(id_column).limit(limit)


def video_frames(library: DataFrame, video, owner, video_column: str = "video", owner_column: str = "owner", number: str = "frame_number", id_column: str = "id") -> DataFrame:
    """All frames of one video of one owner, in order of frame number (missing ones as 0), then id; not capped."""
    return library.where((F.col(video_column) == video) & F.col(owner_column).eqNullSafe(F.lit(owner))).orderBy(F.coalesce(number, F.lit(0)), id_column)


def hits_with_video(hits: DataFrame, corpus: DataFrame, video: Column, id_column: str = "id") -> DataFrame:
    """Hits with the video of the matched point; 'unknown' where the payload names none."""
    named = corpus.select(F.col(id_column).alias("id"), F.coalesce(video.cast("string"), F.lit("unknown")).alias("video_id"))
    return hits.join(named, "id")


def best_hit_per_video(hits: DataFrame, top_k: int | None = None) -> DataFrame:
    """``video_id, score``: the best hit of each video, never below 0.0; best first."""
    best = hits.groupBy("video_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score")).orderBy(F.desc("score"), "video_id")
    return best if top_k is None else best.limit(top_k)


def hits_by_video(hits: DataFrame, number: str = "id") -> DataFrame:
    """``video_id, total_frames, best_score, frame_results``: hits grouped by matched video, the frames in order of number with their best score; best video first. At most k results per query come in."""
    per = hits.groupBy("video_id", F.col(number).alias("frame")).agg(F.max("score").alias("score"), F.count("*").alias("n"))
    return per.groupBy("video_id").agg(F.sum("n").alias("total_frames"), F.max("score").alias("best_score"), F.array_sort(F.collect_list(F.struct("frame", "score"))).alias("frame_results")).orderBy(F.desc("best_score"), "video_id")
