"""Analytics over sequences of frames: deduplication, renumbering, scene cuts, crop rectangles, blank frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector


def dedup_first(frames: DataFrame, video: str | list[str], hash_: Column, order: str | list[str]) -> DataFrame:
    """The first frame of every hash within a video; frames without a hash (unreadable) are all kept.

    Found with a partial aggregation per video and hash, so a video that holds most frames is reduced
    before the shuffle; ties in ``order`` are not broken further, so ``order`` should be unique within a video.
    """
    video, order = ([x] if isinstance(x, str) else list(x) for x in (video, order))
    keyed = frames.withColumn("_hash", hash_)
    firsts = keyed.where("_hash IS NOT NULL").groupBy(*video, "_hash").agg(F.min_by(F.struct(*frames.columns), F.struct(*order)).alias("_s")).select("_s.*")
    return firsts.unionByName(keyed.where("_hash IS NULL").select(*frames.columns))


def renumber(frames: DataFrame, video: str, order: str, keep: Column, start: int = 1) -> DataFrame:
    """The frames for which ``keep`` holds, with ``idx`` counting them from ``start`` within their video."""
    w = Window.partitionBy(video).orderBy(order)
    return frames.where(keep).withColumn("idx", F.row_number().over(w) + (start - 1))


def min_frames(chosen: DataFrame, totals: DataFrame, least: int, union: bool = False) -> DataFrame:
    """``video, frame_no, idx``: chosen frames, with evenly spaced ones added where a video has fewer than ``least``.

    ``chosen``: ``video, frame_no``; ``totals``: ``video, total`` (frames in the video). The step is
    ``max(1, total // (least + 1))``. As a rule the fallback frames follow the chosen ones until
    ``least`` is reached, so the order of ``idx`` is not that of time; with ``union`` both sets are
    united and sorted, which may give more than ``least``.
    """
    counts = chosen.groupBy("video").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / (least + 1)))
    short = totals.join(counts, "video", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)
    extra = short.select("video", "n", "total", F.explode(F.transform(F.sequence(F.lit(1), F.lit(least)), lambda i: F.struct(i.alias("i"), (i * step).alias("frame_no")))).alias("x"))
    extra = extra.where(F.col("x.frame_no") < F.col("total"))
    if union:
        both = chosen.select("video", "frame_no").unionByName(extra.select("video", F.col("x.frame_no").alias("frame_no"))).distinct()
        return both.withColumn("idx", F.row_number().over(Window.partitionBy("video").orderBy("frame_no")))
    added = extra.where(F.col("x.i") <= least - F.col("n")).select("video", F.col("x.frame_no").alias("frame_no"), F.lit(1).alias("late"))
    both = chosen.select("video", "frame_no", F.lit(0).alias("late")).unionByName(added)
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("video").orderBy("late", "frame_no"))).drop("late")


def scene_cuts(frames: DataFrame, video: str, order: str, pixels: str, threshold: float, scale: float = 1.0) -> DataFrame:
    """Frames whose difference from the one before exceeds ``threshold``: ``video, order, scene_score`` (sum of absolute differences over ``scale``)."""
    w = Window.partitionBy(video).orderBy(order)
    scored = frames.select(video, order, (vector.sad(F.col(pixels), F.lag(pixels).over(w)) / scale).alias("scene_score"))
    return scored.where(F.col("scene_score") > threshold)


def scenes(cuts: DataFrame, video: str, at: str, totals: DataFrame) -> DataFrame:
    """``video, scene_start, scene_end, midpoint``: the stretches between cuts, from 0 to ``totals.total``; midpoints are floored."""
    edges = cuts.select(F.col(video).alias("video"), F.col(at).cast("long").alias("scene_start")).unionByName(totals.select("video", F.lit(0).cast("long").alias("scene_start"))).distinct()
    w = Window.partitionBy("video").orderBy("scene_start")
    ends = edges.join(totals, "video").withColumn("scene_end", F.coalesce(F.lead("scene_start").over(w), F.col("total").cast("long")))
    return ends.select("video", "scene_start", "scene_end", F.floor((F.col("scene_start") + F.col("scene_end")) / 2).alias("midpoint"))


def sampled(frames: DataFrame, number: Column, rate: Column, fps: Column) -> DataFrame:
    """Every n-th frame, n = int(rate / fps), at least 1; a missing or zero rate keeps all."""
    every = F.when(F.coalesce(rate, F.lit(0.0)) > 0, F.greatest(F.lit(1), (rate / fps).cast("int"))).otherwise(F.lit(1))
    return frames.where(F.pmod(number, every) == 0)


def bbox_union(rects: DataFrame, video: str, margin: int = 0, multiple: int = 1) -> DataFrame:
    """``video, x, y, w, h``: the box around all rectangles of a video, widened by ``margin`` (low side not below 0), w and h up to a ``multiple``."""
    box = rects.groupBy(video).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - margin)
    up = lambda c: F.ceil(c / multiple) * multiple
    return box.select(video, low("x0").alias("x"), low("y0").alias("y"), up(F.col("x1") + margin - low("x0")).cast("int").alias("w"), up(F.col("y1") + margin - low("y0")).cast("int").alias("h"))


def crop_mode(rects: DataFrame, video: str, order: str) -> DataFrame:
    """The most frequent rectangle of each video; ties go to the one met first, then to the smaller one."""
    per = rects.groupBy(video, "x", "y", "w", "h").agg(F.count("*").alias("n"), F.min(order).alias("met"))
    best = per.groupBy(video).agg(F.max_by(F.struct("x", "y", "w", "h", "n"), F.struct("n", *(-F.col(c) for c in ("met", "x", "y", "w", "h")))).alias("s"))
    return best.select(video, "s.*")


def is_blank(pixels: Column, unreadable: bool = False) -> Column:
    """All pixels equal the first one; ``unreadable`` is the answer for a missing or empty image."""
    return F.when(F.coalesce(F.size(pixels), F.lit(0)) <= 0, F.lit(unreadable)).otherwise(F.forall(pixels, lambda p: p == F.element_at(pixels, 1)))


def is_solid(pixels: Column, std: float = 5.0) -> Column:
    """The pixels' population standard deviation is below ``std``."""
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    square = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + (x.cast("double") - mean) * (x.cast("double") - mean)) / n
    return F.sqrt(square) < std


def margin_rect(lines: DataFrame, image: str, axis: str, index: str, pixels: str, tol: float = 10.0) -> DataFrame:
    """``image, axis, first, last``: the lines (rows or columns) left when uniform ones are stripped from both ends.

    A line is uniform if every pixel is within ``tol`` of the line's median, whose half is cut off. Images whose lines are all uniform are absent.
    """
    s = F.array_sort(F.transform(F.col(pixels), lambda x: x.cast("double")))
    n = F.size(s)
    median = F.floor((F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)
    kept = lines.where(~F.forall(F.col(pixels), lambda x: F.abs(x.cast("double") - median) <= tol))
    return kept.groupBy(image, axis).agg(F.min(index).alias("first"), F.max(index).alias("last"))


def crop_or_original(videos: DataFrame, rects: DataFrame, video: str = "video", least: float = 0.0) -> DataFrame:
    """Every video once with ``position``, the rectangle to cut to and whether it is cut: a missing, empty or too slight crop falls back to the whole frame.

    ``videos``: ``video, position, width, height``; ``rects``: ``video, x, y, w, h``, one per video.
    """
    joined = videos.join(rects, video, "left")
    enough = (F.col("w") > 0) & (F.col("h") > 0) & (((F.col("width") - F.col("w")) / F.col("width") >= least) | ((F.col("height") - F.col("h")) / F.col("height") >= least))
    cut = F.coalesce(enough, F.lit(False))
    whole = {"x": F.lit(0), "y": F.lit(0), "w": F.col("width"), "h": F.col("height")}
    return joined.select(video, "position", *(F.when(cut, F.col(c)).otherwise(o).alias(c) for c, o in whole.items()), cut.alias("cropped")).orderBy("position")
