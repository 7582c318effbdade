"""Queries on sequences of frames: deduplication, renumbering, scenes, rectangles, blank frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import frames
from ..session import table
from .registry import Registry
from .similarity import points

R = Registry()


@R.query("SELECT doc_id, lang FROM (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 OR text IS NULL")
def dedup_first_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return frames.dedup_first(docs, "lang", F.md5("text"), "doc_id").select("doc_id", "lang")


_D7 = "list_sum(list_transform(range(0, 49), lambda i: CASE WHEN embedding[(i // 7) * 8 + (i % 7) + 2] > embedding[(i // 7) * 8 + (i % 7) + 1] THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT"


@R.query(f"SELECT id, label FROM (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label, {_D7} ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1")
def dedup_first_dhash(spark, d):
    p = points(spark, d)
    return frames.dedup_first(p, "label", hashing.dhash(F.col("vector"), 7), "id").select("id", "label")


@R.query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) AS idx FROM lineitem WHERE l_quantity > 10")
def renumber_survivors(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return frames.renumber(li, "l_orderkey", "l_linenumber", F.col("l_quantity") > 10).select("l_orderkey", "l_linenumber", "idx")


def _scenes(spark, d):
    o = table(spark, d, "orders")
    totals = o.groupBy(F.col("o_custkey").alias("video")).agg((F.count("*") * 3).alias("total"))
    chosen = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("video")).agg(F.count("*").alias("n"))
    chosen = chosen.select("video", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("frame_no"))
    return chosen, totals


_MIN = """WITH totals AS (SELECT o_custkey AS video, count(*) * 3 AS total FROM orders GROUP BY 1),
chosen AS (SELECT video, unnest(range(1, n + 1)) AS frame_no FROM (SELECT o_custkey AS video, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)),
short AS (SELECT t.video, total, coalesce(n, 0) AS n FROM totals t LEFT JOIN (SELECT video, count(*) AS n FROM chosen GROUP BY 1) c USING (video) WHERE coalesce(n, 0) < 4),
extra AS (SELECT video, n, i, i * greatest(1, total // 5) AS frame_no FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM short) WHERE i * greatest(1, total // 5) < total)
"""


@R.query(_MIN + "SELECT video, frame_no, CAST(row_number() OVER (PARTITION BY video ORDER BY late, frame_no) AS INT) AS idx FROM (SELECT video, frame_no, 0 AS late FROM chosen UNION ALL SELECT video, frame_no, 1 FROM extra WHERE i <= 4 - n)")
def min_frames_append(spark, d):
    return frames.min_frames(*_scenes(spark, d), least=4)


@R.query(_MIN + "SELECT video, frame_no, CAST(row_number() OVER (PARTITION BY video ORDER BY frame_no) AS INT) AS idx FROM (SELECT video, frame_no FROM chosen UNION SELECT video, frame_no FROM extra)")
def min_frames_union(spark, d):
    return frames.min_frames(*_scenes(spark, d), least=4, union=True)


_SAD = """SELECT label, vec_id AS id, score FROM (SELECT label, vec_id, list_sum(list_transform(list_zip(embedding, p), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) AS score
  FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) WHERE p IS NOT NULL) WHERE score > 8"""


@R.query(f"SELECT label, id, round(score, 6) AS scene_score FROM ({_SAD})")
def scene_cuts(spark, d):
    cuts = frames.scene_cuts(points(spark, d), "label", "id", "vector", 8.0)
    return cuts.select("label", "id", F.round("scene_score", 6).alias("scene_score"))


@R.query(
    f"""WITH totals AS (SELECT label AS video, CAST(max(vec_id) + 1 AS BIGINT) AS total FROM embeddings GROUP BY 1),
edges AS (SELECT label AS video, id AS s FROM ({_SAD}) UNION SELECT video, 0 FROM totals)
SELECT video, s AS scene_start, coalesce(lead(s) OVER (PARTITION BY video ORDER BY s), total) AS scene_end, (s + coalesce(lead(s) OVER (PARTITION BY video ORDER BY s), total)) // 2 AS midpoint FROM edges JOIN totals USING (video)"""
)
def scene_midpoints(spark, d):
    p = points(spark, d)
    totals = p.groupBy(F.col("label").alias("video")).agg((F.max("id") + 1).alias("total"))
    return frames.scenes(frames.scene_cuts(p, "label", "id", "vector", 8.0), "label", "id", totals)


@R.query("SELECT event_id, user_id FROM events WHERE event_id % greatest(1, CAST(trunc(30.0 / 4.0) AS INT)) = 0")
def every_nth_sample(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id")
    return frames.sampled(ev, F.col("event_id"), F.lit(30.0), F.lit(4.0))


def _rects(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("probe"), (F.col("l_quantity").cast("int") % 5).alias("x"), (F.col("l_linenumber") % 2).alias("y"),
        (F.lit(100) + F.col("l_quantity").cast("int") % 3).alias("w"), (F.lit(50) + F.col("l_linenumber") % 2).alias("h"),
    )


_RECTS = "rects AS (SELECT l_orderkey AS video, l_linenumber AS probe, CAST(trunc(l_quantity) AS INT) % 5 AS x, l_linenumber % 2 AS y, 100 + CAST(trunc(l_quantity) AS INT) % 3 AS w, 50 + l_linenumber % 2 AS h FROM lineitem)"


@R.query(f"""WITH {_RECTS}, b AS (SELECT video, greatest(0, min(x) - 2) AS x, greatest(0, min(y) - 2) AS y, max(x + w) AS x1, max(y + h) AS y1 FROM rects GROUP BY 1)
SELECT video, x, y, CAST(ceil((x1 + 2 - x) / 16.0) * 16 AS INT) AS w, CAST(ceil((y1 + 2 - y) / 16.0) * 16 AS INT) AS h FROM b""")
def bbox_union(spark, d):
    return frames.bbox_union(_rects(spark, d), "video", margin=2, multiple=16)


@R.query(f"""WITH {_RECTS} SELECT video, x, y, w, h, n FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, met, x, y, w, h) AS rk FROM (SELECT video, x, y, w, h, count(*) AS n, min(probe) AS met FROM rects GROUP BY ALL)) WHERE rk = 1""")
def crop_mode(spark, d):
    return frames.crop_mode(_rects(spark, d), "video", "probe")


@R.query("SELECT event_id, w + w % 2 AS w, h + h % 2 AS h, (event_id * 7 % 23) / 2.0 AS dur_s, ((200 - w) / 200.0 >= 0.3 OR (200 - h) / 200.0 >= 0.3) AS crops FROM (SELECT event_id, CAST(event_id % 101 + 99 AS BIGINT) AS w, CAST(event_id % 37 + 150 AS BIGINT) AS h FROM events)")
def even_size_and_ratio(spark, d):
    ev = table(spark, d, "events").select("event_id", (F.col("event_id") % 101 + 99).alias("w0"), (F.col("event_id") % 37 + 150).alias("h0"))
    two = F.lit(200.0)
    return ev.select("event_id", text.even(F.col("w0")).alias("w"), text.even(F.col("h0")).alias("h"), ((F.col("event_id") * 7 % 23) / 2.0).alias("dur_s"), text.should_crop(two, two, F.col("w0"), F.col("h0"), 0.3).alias("crops"))


@R.query("SELECT event_id, k, round((event_id % 9) * k / 4.0, 6) AS at FROM (SELECT event_id, unnest([1, 2, 3]) AS k FROM events) WHERE event_id % 9 > 0")
def probe_times(spark, d):
    ev = table(spark, d, "events").select("event_id", F.posexplode(text.probe_times((F.col("event_id") % 9).cast("double"), 3)).alias("p", "at"))
    return ev.select("event_id", (F.col("p") + 1).alias("k"), F.round("at", 6).alias("at"))


@R.query("SELECT event_id, round(event_id / coalesce(nullif(CAST(event_id % 3 AS DOUBLE) * 10, 0), 25.0), 6) AS sec FROM events")
def frame_seconds(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", F.round(text.seconds(F.col("event_id"), (F.col("event_id") % 3).cast("double") * 10), 6).alias("sec"))


@R.query(
    """SELECT l_orderkey AS video, bool_and(l_returnflag = f) AS blank, stddev_pop(l_quantity) < 5.37 AS solid, count(*) AS n FROM (SELECT *, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS f FROM lineitem) GROUP BY 1"""
)
def blank_and_solid(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    per = li.groupBy(F.col("l_orderkey").alias("video")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("s"))
    return per.select("video", frames.is_blank(F.col("s.l_returnflag")).alias("blank"), frames.is_solid(F.col("s.l_quantity"), 5.37).alias("solid"), F.size("s").cast("long").alias("n"))


@R.query(
    """SELECT label AS image, 'row' AS axis, min(vec_id) AS first, max(vec_id) AS last FROM (SELECT *, floor(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * 100), 'median')) AS m, list_transform(embedding, lambda x: x::DOUBLE * 100) AS p FROM embeddings)
WHERE list_max(list_transform(p, lambda x: abs(x - m))) > 30 GROUP BY label"""
)
def margin_lines(spark, d):
    lines = points(spark, d).select(F.col("label").alias("image"), F.lit("row").alias("axis"), F.col("id").alias("line"), F.transform("vector", lambda x: x.cast("double") * 100).alias("pixels"))
    return frames.margin_rect(lines, "image", "axis", "line", "pixels", 30.0)


@R.query(
    """SELECT event_id, CAST(regexp_extract(s, 'crop=(\\d+):(\\d+):(\\d+):(\\d+)$', 3) AS INT) AS x, CAST(regexp_extract(s, 'crop=(\\d+):(\\d+):(\\d+):(\\d+)$', 4) AS INT) AS y, CAST(regexp_extract(s, 'crop=(\\d+):(\\d+):(\\d+):(\\d+)$', 1) AS INT) AS w, CAST(regexp_extract(s, 'crop=(\\d+):(\\d+):(\\d+):(\\d+)$', 2) AS INT) AS h
FROM (SELECT event_id, 'crop=1:2:3:4 crop=' || (event_id % 640 + 1) || ':' || (event_id % 360 + 1) || ':' || (event_id % 7) || ':' || (event_id % 5) AS s FROM events)"""
)
def crop_text(spark, d):
    log = F.concat(F.lit("crop=1:2:3:4 crop="), F.col("event_id") % 640 + 1, F.lit(":"), F.col("event_id") % 360 + 1, F.lit(":"), F.col("event_id") % 7, F.lit(":"), F.col("event_id") % 5)
    return table(spark, d, "events").select("event_id", text.last_rect(log).alias("r")).select("event_id", "r.*")
