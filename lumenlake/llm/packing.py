"""Filling fixed-capacity containers with items (problem 9): pattern packing by non-negative least squares.

Everything that depends on the order of packing works on the histogram of sizes, whose length is
bounded by the capacity, never on the items: patterns of few sizes that fill a container are
enumerated, non-negative least squares fits their repeat counts to the histogram, the counts are
rounded, and the residual counts are packed best-fit into the space left. The result is a list of
patterns with repeat counts; items take their places in it by their rank among items of equal size,
which is computed in parallel.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Items of one size that are ranked in one task; the number of parts of each size follows from it and the number of documents.
PART_ITEMS, MOST_PARTS = 2_000_000, 4096

#: Patterns of three sizes take two of them from so many of the most frequent sizes.
FREQUENT = 160

#: Share of a container that a pattern may leave unused.
WASTE = 0.01

Group = tuple[int, int, tuple[tuple[int, int], ...]]  # containers, space left in each, (size, items of it) in each


def fill_patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to three sizes that fill a container, as rows of three sizes (0 for none), of the sizes that occur.

    Two sizes must add up to the capacity, and so must three, or fall short by WASTE at most. The
    number of patterns is bounded by the capacity and FREQUENT.
    """
    present = np.flatnonzero(counts[: capacity + 1])
    present = present[present > 0]
    rows = [np.array([[capacity, 0, 0]])] if counts[capacity] else []
    big = present[(present * 2 >= capacity) & (present < capacity)]
    small = capacity - big
    ok = counts[small] > 0
    rows.append(np.stack([big[ok], small[ok], np.zeros(ok.sum(), int)], axis=1))
    frequent = np.sort(present[np.argsort(-counts[present], kind="stable")][:FREQUENT])
    if len(present):
        a, b = np.meshgrid(frequent, frequent, indexing="ij")
        a, b = a[a >= b], b[a >= b]
        rest = capacity - a - b
        at = np.searchsorted(present, rest, side="right") - 1
        c = np.where((rest > 0) & (at >= 0), present[np.maximum(at, 0)], 0)
        ok = (c > 0) & (rest - c <= WASTE * capacity) & (c <= rest)
        rows.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.unique(np.sort(np.concatenate(rows), axis=1)[:, ::-1], axis=0) if rows else np.zeros((0, 3), int)


def nnls(patterns: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared difference between the sizes used and ``target``.

    The matrix has a column per pattern with at most three entries, so both products are sums over
    indexes; accelerated projected gradients. Size 0 is no size.
    """
    n = len(patterns)
    columns = np.repeat(np.arange(n), 3)
    sizes = patterns.ravel()
    columns, sizes = columns[sizes > 0], sizes[sizes > 0]
    used = lambda x: np.bincount(sizes, x[columns], len(target))
    back = lambda r: np.bincount(columns, r[sizes], n)
    v = np.ones(n)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(used(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1.0 / max(1.05 * np.linalg.norm(back(used(v))), 1e-12)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        following = np.maximum(0.0, y - step * back(used(y) - target))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = following + (t - 1) / t_next * (following - x)
        x, t = following, t_next
    return x


def _fitted(counts: np.ndarray, capacity: int) -> tuple[list[Group], np.ndarray]:
    """Containers by fitted and rounded patterns, and the counts that are left. ``counts[s]`` is the number of items of size s."""
    left = counts.copy()
    patterns = fill_patterns(counts, capacity)
    groups: list[Group] = []
    if not len(patterns):
        return groups, left
    scale = max(float(counts.max()), 1.0)
    repeats = np.floor(nnls(patterns, counts / scale) * scale + 1e-6).astype(np.int64)
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] < 1:
            break
        taken: dict[int, int] = defaultdict(int)
        for s in patterns[j]:
            if s:
                taken[int(s)] += 1
        n = min([int(repeats[j]), *(int(left[s]) // c for s, c in taken.items())])
        if n > 0:
            for s, c in taken.items():
                left[s] -= n * c
            groups.append((n, capacity - sum(s * c for s, c in taken.items()), tuple(sorted(taken.items()))))
    return groups, left


def _residual(groups: list[Group], left: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit-decreasing of the residual counts into the space left by ``groups`` and new containers, many equal containers at a time."""
    space: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    done: list[Group] = []
    for n, room, content in groups:
        (space[room].append((n, content)) if room else done.append((n, 0, content)))
    rooms = sorted(space)

    def put(n: int, room: int, content: tuple) -> None:
        if n == 0:
            return
        if room == 0:
            done.append((n, 0, content))
            return
        if room not in space or not space[room]:
            bisect.insort(rooms, room)
        space[room].append((n, content))

    for size in np.flatnonzero(left)[::-1]:
        size, todo = int(size), int(left[size])
        while todo:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room, n, content = capacity, -(-todo // (capacity // size)), ()
            else:
                room = rooms[at]
                n, content = space[room].pop()
                if not space[room]:
                    rooms.pop(at)
            each = min(room // size, todo)
            full = min(n, todo // each)
            put(n - full, room, content) if content else None
            put(full, room - full_size if (full_size := each * size) else room, (*content, (size, each)))
            todo -= full * each
            if not content and n > full and todo:  # a new container for the last items
                put(1, room - todo * size, ((size, todo),))
                todo = 0
    return done + [(n, room, content) for room in space for n, content in space[room]]


def pack_histogram(counts: np.ndarray, capacity: int) -> list[Group]:
    """Containers as groups of equal ones; every counted item has exactly one place. Sizes are 1 to ``capacity``."""
    groups, left = _fitted(counts, capacity)
    return sorted(_residual(groups, left, capacity), key=lambda g: (g[1], g[2]))


def _places(groups: list[Group]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: the first rank of each of its runs, the items of it per container, the first container, and the offset in the container."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for n, _, content in groups:
        offset = 0
        for size, each in content:
            runs[size].append((ranks[size], each, base, offset))
            ranks[size] += n * each
            offset += size * each
        base += n
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}


_PLACE = T.StructType([T.StructField("container_id", T.LongType()), T.StructField("offset", T.LongType())])


def _place_udf(places: dict, first: dict):
    @F.pandas_udf(_PLACE)
    def udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pack, size, part, rank in batches:
            frame = pd.DataFrame({"pack": pack, "size": size, "part": part, "rank": rank})
            container, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for (p, s), rows in frame.groupby(["pack", "size"]).indices.items():
                starts, each, base, at = places[p][s]
                r = first[p][s][frame["part"].to_numpy()[rows]] + frame["rank"].to_numpy()[rows] - 1
                k = np.searchsorted(starts, r, side="right") - 1
                within = r - starts[k]
                container[rows] = base[k] + within // each[k]
                offset[rows] = at[k] + within % each[k] * s
            yield pd.DataFrame({"container_id": container, "offset": offset})

    return udf


def pack(items: DataFrame, capacities: dict[int, int], part_items: int = PART_ITEMS) -> DataFrame:
    """``pack_id, doc_id, piece, n_tokens, container_id, offset``: every item in a container of every capacity.

    ``items``: ``pack_id, doc_id, n_tokens``. An item is split only if it exceeds the capacity alone:
    into full pieces and a rest, numbered from 0. Items of size 0 or null take no space: one row
    with n_tokens 0 and null container and offset. Container ids are unique within a pack. Repeated
    rows are items of their own. The driver sees the histogram of sizes only: one count per size and,
    for sizes with more than ``part_items`` items, per part of it (at most MOST_PARTS).
    """
    spark = items.sparkSession
    bound = F.element_at(F.create_map(*(F.lit(x) for kv in capacities.items() for x in kv)), F.col("pack_id"))
    sized = items.select("pack_id", "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"), bound.alias("capacity"))
    pieces = sized.where("n > 0").select(
        "pack_id", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("CAST((n - 1) DIV capacity AS INT)")), lambda i: F.least(F.col("capacity"), F.col("n") - i * F.col("capacity")))).alias("piece", "n_tokens")
    )
    sizes = pieces.groupBy("pack_id", "n_tokens").agg(F.count("*").alias("n")).toPandas()
    frequent = [(int(r.pack_id), int(r.n_tokens), min(MOST_PARTS, -(-int(r.n) // part_items))) for r in sizes.itertuples() if r.n > part_items]
    pieces = pieces.withColumn("row", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()) if frequent else F.lit(0).cast("long"))
    if frequent:  # a size that very many items have is ranked in parts; which part an item is in does not matter, so rows without id spread too
        parts = spark.createDataFrame(frequent, "pack_id int, n_tokens int, parts int")
        pieces = cut_lineage(pieces.join(F.broadcast(parts), ["pack_id", "n_tokens"], "left").withColumn("part", F.pmod("row", F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("parts"))
        counted = pieces.groupBy("pack_id", "n_tokens", "part").agg(F.count("*").alias("n")).toPandas()
    else:
        pieces, counted = pieces.withColumn("part", F.lit(0)), sizes.assign(part=0)
    places: dict[int, dict] = {}
    first: dict[int, dict] = {}
    for pack_id, rows in counted.groupby("pack_id"):
        capacity = capacities[int(pack_id)]
        size, part, n = (rows[c].to_numpy(np.int64) for c in ("n_tokens", "part", "n"))
        places[int(pack_id)] = _places(pack_histogram(np.bincount(size, n, capacity + 1).astype(np.int64), capacity))
        first[int(pack_id)] = {}
        for x in np.unique(size):
            own = np.zeros(int(part[size == x].max()) + 2, np.int64)
            own[part[size == x] + 1] = n[size == x]
            first[int(pack_id)][int(x)] = np.cumsum(own)[:-1]
    w = Window.partitionBy("pack_id", "n_tokens", "part").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(w))
    placed = ranked.select("pack_id", "doc_id", "piece", "n_tokens", _place_udf(places, first)("pack_id", "n_tokens", "part", "rank").alias("p"))
    empty = sized.where("n = 0").select("pack_id", "doc_id", F.lit(0).alias("piece"), F.col("n").cast("int").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("offset"))
    return placed.select("pack_id", "doc_id", "piece", F.col("n_tokens").cast("int").alias("n_tokens"), "p.container_id", "p.offset").unionByName(empty)


def pack_documents(docs: DataFrame, packs: DataFrame, count_tokens) -> DataFrame:
    """:func:`pack` of all texts of ``docs`` for every row of ``packs`` (``pack_id, tokenizer, capacity``; a small table of settings).

    ``count_tokens(docs, tokenizer)`` gives ``doc_id, n_tokens``; the sizes are computed once per
    tokenizer and written to the shared checkpoint folder, as the histogram and the assignment both read them.
    """
    settings = packs.where("pack_id IS NOT NULL AND tokenizer IS NOT NULL AND capacity > 0").distinct().collect()
    if not settings:
        raise ValueError("no container capacity is given")
    by: dict[str, list[int]] = defaultdict(list)
    for row in settings:
        by[row.tokenizer].append(row.pack_id)
    items = None
    for tokenizer, ids in sorted(by.items()):
        sizes = cut_lineage(count_tokens(docs, tokenizer))
        part = sizes.select(F.explode(F.array(*(F.lit(i) for i in sorted(ids)))).alias("pack_id"), "doc_id", "n_tokens")
        items = part if items is None else items.unionByName(part)
    return pack(items, {row.pack_id: row.capacity for row in settings})


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """``pack_id, n_containers, n_pieces, n_tokens, fill_rate``."""
    per = packed.where("container_id IS NOT NULL").groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    sums = per.groupBy("pack_id").agg(F.count("*").alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"))
    return sums.join(F.broadcast(packs.select("pack_id", "capacity")), "pack_id").select(
        "pack_id", "n_containers", "n_pieces", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill_rate")
    )


def checks(packed: DataFrame, packs: DataFrame, docs: DataFrame, count_tokens) -> DataFrame:
    """``pack_id, n_documents, n_changed, n_overfull, n_overlaps``: what must be 0 of a right assignment, counted.

    Changed are documents whose pieces do not add up to their tokens; overfull are containers above capacity; overlaps
    are pieces that begin before the piece before them in the container ends.
    """
    settings = packs.select("pack_id", "tokenizer", "capacity").distinct().collect()
    want = None
    for row in settings:
        sizes = count_tokens(docs, row.tokenizer).select(F.lit(row.pack_id).alias("pack_id"), "doc_id", "n_tokens")
        want = sizes if want is None else want.unionByName(sizes)
    got = packed.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("packed"))
    whole = want.join(got, ["pack_id", "doc_id"], "full").groupBy("pack_id").agg(F.count("*").alias("n_documents"), F.count_if(~F.col("packed").eqNullSafe(F.col("n_tokens").cast("long"))).alias("n_changed"))
    bound = F.broadcast(packs.select("pack_id", "capacity"))  # a table of settings
    w = Window.partitionBy("pack_id", "container_id").orderBy("offset")  # no more pieces than the capacity
    placed = packed.where("container_id IS NOT NULL").withColumn("end", F.col("offset") + F.col("n_tokens")).withColumn("before", F.lag("end", 1, 0).over(w)).join(bound, "pack_id")
    per = placed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.max("end").alias("e"), F.max("capacity").alias("c"), F.count_if(F.col("before") > F.col("offset")).alias("o"))
    bad = per.groupBy("pack_id").agg(F.count_if((F.col("t") > F.col("c")) | (F.col("e") > F.col("c"))).alias("n_overfull"), F.sum("o").alias("n_overlaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return whole.join(bad, "pack_id", "left").select("pack_id", "n_documents", zero("n_changed"), zero("n_overfull"), zero("n_overlaps"))
