"""WIN-01..08, AGG-05/06/11/12, F-23..28, FLT-09/10/14, SRC-17, VEN-01/06 (traps T-06, T-07, T-20, T-21)."""

import numpy as np
from pyspark.sql import functions as F

from lumenlake.functions import hashing, text
from lumenlake.operators import frames
from lumenlake.sources import frames as source


def test_dedup_keeps_first_and_all_unreadable(spark):
    df = spark.createDataFrame([("v", 1, 5), ("v", 2, 5), ("v", 3, None), ("v", 4, None), ("w", 1, 5), ("v", 0, 6)], "video string, n int, hash long")
    once = frames.dedup_first(df, "video", F.col("hash"), "n")
    got = sorted(tuple(r)[:2] for r in once.collect())
    assert got == [("v", 0), ("v", 1), ("v", 3), ("v", 4), ("w", 1)]
    assert sorted(map(tuple, frames.dedup_first(once, "video", F.col("hash"), "n").collect())) == sorted(map(tuple, once.collect()))
    assert frames.dedup_first(df.limit(0), "video", F.col("hash"), "n").count() == 0


def test_renumber(spark):
    df = spark.createDataFrame([("v", 3, True), ("v", 1, True), ("v", 2, False), ("v", 4, None)], "video string, n int, keep boolean")
    assert [(r.n, r.idx) for r in frames.renumber(df, "video", "n", F.col("keep")).orderBy("n").collect()] == [(1, 1), (3, 2)]


def test_min_frames(spark):
    chosen = spark.createDataFrame([("a", 7)], "video string, frame_no long")
    totals = spark.createDataFrame([("a", 40), ("b", 2), ("c", 0)], "video string, total long")
    got = [(r.video, r.frame_no, r.idx) for r in frames.min_frames(chosen, totals, 3).orderBy("video", "idx").collect()]
    assert got == [("a", 7, 1), ("a", 10, 2), ("a", 20, 3), ("b", 1, 1)]
    united = [(r.video, r.frame_no) for r in frames.min_frames(chosen, totals, 3, union=True).orderBy("video", "idx").collect()]
    assert united == [("a", 7), ("a", 10), ("a", 20), ("a", 30), ("b", 1)]


def test_scene_cuts_and_midpoints(spark):
    df = spark.createDataFrame([("v", 0, [0.0, 0.0]), ("v", 1, [9.0, 0.0]), ("v", 2, [9.0, 1.0]), ("v", 3, None), ("w", 0, [5.0, 5.0])], "video string, n int, px array<float>")
    cuts = frames.scene_cuts(df, "video", "n", "px", 5.0)
    assert [tuple(r) for r in cuts.collect()] == [("v", 1, 9.0)]
    totals = spark.createDataFrame([("v", 4), ("w", 1)], "video string, total long")
    assert sorted(tuple(r) for r in frames.scenes(cuts, "video", "n", totals).collect()) == [("v", 0, 1, 0), ("v", 1, 4, 2), ("w", 0, 1, 0)]


def test_sampling_never_divides_by_zero(spark):
    df = spark.range(10)
    assert frames.sampled(df, F.col("id"), F.lit(30.0), F.lit(10.0)).count() == 4
    assert frames.sampled(df, F.col("id"), F.lit(1.0), F.lit(10.0)).count() == 10
    assert frames.sampled(df, F.col("id"), F.lit(None).cast("double"), F.lit(1.0)).count() == 10


def test_rectangles(spark):
    r = spark.createDataFrame([("v", 1, 3, 4, 10, 10), ("v", 2, 0, 6, 20, 10), ("v", 3, 3, 4, 10, 10), ("w", 1, 1, 1, 5, 5), ("w", 2, 2, 2, 5, 5)], "video string, probe int, x int, y int, w int, h int")
    assert {tuple(x) for x in frames.bbox_union(r, "video", 2, 16).collect()} == {("v", 0, 2, 32, 16), ("w", 0, 0, 16, 16)}
    assert {(x.video, x.x, x.n) for x in frames.crop_mode(r, "video", "probe").collect()} == {("v", 3, 2), ("w", 1, 1)}
    logs = spark.createDataFrame([("a crop=10:20:1:2 b crop=30:40:3:4",), ("none",), (None,)], "l string")
    got = [x.r for x in logs.select(text.last_rect(F.col("l")).alias("r")).collect()]
    assert (got[0].x, got[0].y, got[0].w, got[0].h) == (3, 4, 30, 40) and got[1] is None and got[2] is None


def test_blank_solid_and_probes(spark):
    df = spark.createDataFrame([([1, 1, 1],), ([1, 2, 1],), ([],), (None,)], "px array<int>")
    assert [r[0] for r in df.select(frames.is_blank(F.col("px"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(frames.is_blank(F.col("px"), True)).collect()] == [True, False, True, True]
    assert df.select(frames.is_solid(F.col("px"))).first()[0] is True
    times = spark.createDataFrame([(8.0,), (0.0,), (None,)], "d double").select(text.probe_times(F.col("d"), 3).alias("t")).collect()
    assert [r.t for r in times] == [[2.0, 4.0, 6.0], [], []]


def python_dhash(grid, size):
    return sum(1 << i for i in range(size * size) if grid[(i // size) * (size + 1) + i % size + 1] > grid[(i // size) * (size + 1) + i % size])


def test_dhash_uses_all_64_bits(spark):
    rng = np.random.default_rng(3)
    grids = [list(map(float, rng.integers(0, 255, 72))) for _ in range(20)] + [[float(i) for i in range(72)]]
    df = spark.createDataFrame([(g,) for g in grids], "g array<double>")
    got = [int(r[0]) for r in df.select(hashing.unsigned(hashing.dhash(F.col("g")))).collect()]
    assert got == [python_dhash(g, 8) for g in grids] and max(got) == 2**64 - 1


def test_average_and_block_hash(spark):
    g = [float(i) for i in range(64)]
    df = spark.createDataFrame([(g,)], "g array<double>")
    h = df.select(hashing.average_hash(F.col("g")).alias("h"), hashing.block_mean_hash(F.col("g"), 8, 8, 4).alias("b")).first()
    assert h.h & (2**64 - 1) == sum(1 << i for i in range(64) if i > 31.5) and h.b == 0b1100
    d = spark.createDataFrame([(0b1010, 0b0110)], "a long, b long").select(hashing.hamming(F.col("a"), F.col("b"))).first()[0]
    assert d == 2


def test_images_from_bytes_to_hash(spark):
    image = np.zeros((16, 18, 3), np.uint8)
    image[4:12, 5:14] = np.arange(9)[None, :, None] * 20
    df = spark.createDataFrame([("a", bytearray(image.tobytes())), ("b", bytearray(b"broken")), ("c", None)], "id string, content binary")
    decoded = source.decode_images(df, "content", lambda raw: np.frombuffer(raw, np.uint8).reshape(16, 18, 3))
    assert [r.id for r in decoded.where("image IS NULL").orderBy("id").collect()] == ["b", "c"]
    hashed = source.grey_grid(decoded, "image", 8, 9).withColumn("h", hashing.dhash(F.col("grid")))
    assert hashed.where("h IS NOT NULL").count() == 1
    assert source.margin_crop(image) == (5, 4, 9, 8) or source.margin_crop(image)[1] == 4
    assert source.margin_crop(np.zeros((4, 4, 3), np.uint8)) is None
    assert len(source.colour_moments(image)) == 9 and source.phash(np.add.outer(np.arange(32.0), np.arange(32.0))) >= 0


def test_margin_rect_lines(spark):
    rows = [("i", "row", 0, [5, 5, 5]), ("i", "row", 1, [5, 50, 5]), ("i", "row", 2, [5, 60, 90]), ("i", "row", 3, [7, 7, 9]), ("j", "row", 0, [1, 1, 1])]
    df = spark.createDataFrame(rows, "image string, axis string, line int, px array<int>")
    assert [tuple(r) for r in frames.margin_rect(df, "image", "axis", "line", "px").collect()] == [("i", "row", 1, 2)]


def test_encoder_is_deterministic_and_null_safe(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id int, t string")
    v = {r.id: r.vector for r in source.encode(df, "t", lambda: source.hash_encoder(4)).collect()}
    assert v[1] == v[2] and v[3] is None and len(v[4]) == 4


def test_explode_frames(spark):
    df = spark.createDataFrame([("v", 5, 2), ("w", 0, 1)], "video string, total long, every int")
    assert [r.frame_no for r in source.explode_frames(df, "video", "total", "every").collect()] == [0, 2, 4]
