"""Queries of scalar functions and reshaping, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text, vector
from ..operators import jobs, migrate
from ..sources import frames, inputs, objects
from ..session import table
from .registry import Registry

R = Registry()


def _events(spark, d):
    return table(spark, d, "events")


def _uuid_sql(ns: str, name: str) -> str:
    h = f"sha1(unhex('{ns}') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST((('0x' || substr({h}, 17, 1))::INT % 4) + 1 AS INT), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@R.query(f"SELECT event_id, {_uuid_sql(hashing.NAMESPACE['url'], chr(39) + 'code_' + chr(39) + ' || event_id')} AS uuid FROM events")
def uuid5_ids(spark, d):
    return _events(spark, d).select("event_id", hashing.uuid5("url", F.concat(F.lit("code_"), F.col("event_id"))).alias("uuid"))


@R.query(
    f"""WITH p AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'instagram' ELSE event_type END AS platform, 'u' || user_id AS video_code, CASE WHEN event_id % 7 > 0 THEN event_id % 7 WHEN event_id % 2 = 1 THEN user_id END AS frame_number, value + 0.5 AS frame_second FROM events)
SELECT platform, video_code, CAST(frame_number AS BIGINT) AS frame_number, frame_second, platform || '/' || video_code || '/f.png' AS path, {_uuid_sql(hashing.NAMESPACE['dns'], "platform || ':' || video_code || ':' || frame_number || ':' || CAST(frame_second AS VARCHAR)")} AS id FROM p WHERE frame_number IS NOT NULL"""
)
def migrate_payload(spark, d):
    return migrate.migrate_payload(old_points(spark, d), F.lit("2024-01-01T00:00:00+00:00")).drop("created_at")


def old_points(spark, d):
    """Points of generation 1, one per event."""
    return _events(spark, d).select(
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).otherwise("").alias("platform"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), "user_id", F.lit(".mp4"))).alias("video"),
        F.concat(F.lit("u"), F.col("user_id")).alias("video_code"),
        (F.col("event_id") % 7).alias("frame_idx"),
        F.when(F.col("event_id") % 2 == 1, F.col("user_id")).alias("frame_number"),
        F.lit(None).cast("double").alias("timestamp_s"),
        (F.col("value") + 0.5).alias("frame_second"),
        F.concat(F.lit("//u"), "user_id", F.lit("/f.png")).alias("path"),
    )


@R.query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 11 ELSE event_id END AS n, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 11 AS DOUBLE) ELSE CAST((event_id % 90) + 0.5 AS DOUBLE) END AS sec, event_id % 4 <> 0 AS well_formed FROM events"
)
def frame_name_parse(spark, d):
    ev = _events(spark, d)
    name = F.when(F.col("event_id") % 4 == 0, F.lit("noindex.png")).otherwise(F.concat("event_id", F.lit("_"), F.col("event_id") % 90, F.lit(".50.png")))
    position = F.col("event_id") % 11
    return ev.select("event_id", text.frame_index(name, position).cast("long").alias("n"), text.frame_second(name, position).alias("sec"), text.is_frame_name(name).alias("well_formed"))


@R.query("SELECT event_id, event_id || '_' || (event_id % 90) || '.' || lpad(CAST((event_id % 4) * 25 AS VARCHAR), 2, '0') || '.png' AS name FROM events")
def frame_name_format(spark, d):
    return _events(spark, d).select("event_id", text.frame_name(F.col("event_id"), F.col("event_id") % 90 + (F.col("event_id") % 4) * 0.25).alias("name"))


@R.query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE event_type END AS platform, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id || '.v1' ELSE 'u' || user_id END AS video_code, CASE WHEN event_id % 3 = 0 THEN 'v1' ELSE 'u' || user_id END AS video_id, CAST(event_id AS INT) AS n, 12.5 AS sec FROM events WHERE event_id % 5 <> 0"""
)
def parse_keys(spark, d):
    name = F.when(F.col("event_id") % 5 == 0, F.lit("x_y.png")).otherwise(F.concat("event_id", F.lit("_12.5.png")))
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("own/u"), "user_id", F.lit("/v1/"), name)).otherwise(F.concat("event_type", F.lit("/u"), "user_id", F.lit("/"), name))
    return objects.frame_keys(_events(spark, d).select("event_id", key.alias("key")).withColumn("key", F.col("key")), "key").join(
        _events(spark, d).select("event_id", key.alias("key")), "key"
    ).select("event_id", "platform", "video_code", "video_id", "n", "sec")


@R.query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'C' || event_id WHEN 1 THEN NULL ELSE 'plain' || event_id END AS shortcode FROM events")
def shortcodes(spark, d):
    e = F.col("event_id")
    url = F.when(e % 3 == 0, F.concat(F.lit("https://www.instagram.com/reel/C"), e, F.lit("/"))).when(e % 3 == 1, F.concat(F.lit("https://other.invalid/reel/C"), e)).otherwise(F.concat(F.lit("plain"), e))
    return _events(spark, d).select("event_id", text.shortcode(url).alias("shortcode"))


@R.query("SELECT event_id, 'a/' || event_id || '/x/' AS url, 'https://h/' || event_id || '/y' AS full_url FROM events")
def normalise_url(spark, d):
    e = F.col("event_id")
    return _events(spark, d).select("event_id", text.normalised_url(F.concat(F.lit("/a//"), e, F.lit("///x")), True).alias("url"), text.normalised_url(F.concat(F.lit("https://h//"), e, F.lit("/y"))).alias("full_url"))


_EXT = "CASE event_id % 5 WHEN 0 THEN 'MOV' WHEN 1 THEN 'mp4' WHEN 2 THEN 'txt' WHEN 3 THEN 'webm' ELSE 'v' || event_id END"


@R.query(
    f"""SELECT event_id, 'u' || user_id || CASE WHEN event_id % 2 = 0 THEN '.x' ELSE '' END AS cut, 'u' || user_id || CASE WHEN event_id % 2 = 0 THEN '.x' ELSE '' END || CASE WHEN event_id % 5 IN (0, 1, 3) THEN '' ELSE '.' || {_EXT} END AS kept,
  CASE WHEN event_id % 3 = 0 THEN 'tiktok/' || event_id ELSE 'tiktok/a/' || event_id END AS path, 'u' || user_id || CASE WHEN event_id % 2 = 0 THEN '-x' ELSE '' END || '-' || {_EXT} AS job,
  CASE event_id % 5 WHEN 0 THEN 'mov' WHEN 3 THEN 'webm' ELSE 'mp4' END AS ext FROM events"""
)
def name_functions(spark, d):
    e = F.col("event_id")
    ext = F.when(e % 5 == 0, "MOV").when(e % 5 == 1, "mp4").when(e % 5 == 2, "txt").when(e % 5 == 3, "webm").otherwise(F.concat(F.lit("v"), e))
    name = F.concat(F.lit("u"), "user_id", F.when(e % 2 == 0, ".x").otherwise(""), F.lit("."), ext)
    path = F.when(e % 3 == 0, F.concat(F.lit("tiktok/"), e)).otherwise(F.concat(F.lit("//a/"), e))
    return _events(spark, d).select(
        "event_id", text.strip_extension(name).alias("cut"), text.strip_extension(name, known_only=True).alias("kept"), text.prefixed(path, F.lit("tiktok")).alias("path"), text.job_name(name).alias("job"), text.extension(name).alias("ext")
    )


@R.query(
    """SELECT id, CASE WHEN ig_play_count >= 1000000 THEN CAST(CAST(floor(ig_play_count / 1000000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'M' WHEN ig_play_count >= 1000 THEN CAST(CAST(floor(ig_play_count / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(ig_play_count AS VARCHAR) END AS whole FROM insta_content"""
)
def whole_number_labels(spark, d):
    return table(spark, d, "insta_content").select("id", text.whole_number(F.col("ig_play_count")).alias("whole"))


@R.query("SELECT id, CASE WHEN ig_play_count >= 1000000 THEN printf('%.1fM', CAST(ig_play_count / 1000000.0 AS DOUBLE)) WHEN ig_play_count >= 1000 THEN printf('%.1fK', CAST(ig_play_count / 1000.0 AS DOUBLE)) ELSE CAST(ig_play_count AS VARCHAR) END AS label FROM insta_content")
def short_number_labels(spark, d):
    return table(spark, d, "insta_content").select("id", text.short_number(F.col("ig_play_count")).alias("label"))


@R.query(
    """SELECT event_id, CASE WHEN s = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24) || 'h' END, CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) END AS label
FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS s FROM events)"""
)
def duration_labels(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return _events(spark, d).select("event_id", text.duration_label(F.col("ts").cast("timestamp"), start).alias("label"))


@R.query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def timestamps(spark, d):
    ts = F.col("ts").cast("timestamp")
    return _events(spark, d).select("event_id", text.iso_utc(ts).alias("iso"), F.unix_timestamp(ts).alias("epoch"))


@R.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Not Active' ELSE 'Active' END AS status FROM orders")
def status_toggle(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "Active").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", text.toggled(status).alias("status"))


@R.query(
    "SELECT id, media_id AS code, username, coalesce(caption, '') AS caption, coalesce(ig_play_count, 0) AS plays, coalesce(reshare_count, 0) AS reshares, 0 AS n_alerts, CASE WHEN monitored_by IS NULL THEN '' ELSE monitored_by END AS monitored_by FROM insta_content"
)
def view_model(spark, d):
    return migrate.view_model(table(spark, d, "insta_content")).withColumn("monitored_by", F.array_join("monitored_by", ","))


@R.query("SELECT id, nullif(regexp_extract(error_details, '\"stage\"\\s*:\\s*\"([^\"]+)\"', 1), '') AS stage FROM extraction_errors")
def embedded_value(spark, d):
    return table(spark, d, "extraction_errors").select("id", text.embedded_value(F.col("error_details"), "stage").alias("stage"))


@R.query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, array_to_string(list_slice(string_split(text, chr(10)), greatest(1, len(string_split(text, chr(10))) - 2), len(string_split(text, chr(10)))), chr(10)) AS tail FROM documents WHERE text IS NOT NULL")
def log_tail(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(text.log_tail(F.col("text"), None)).alias("n_lines"), F.array_join(text.log_tail(F.col("text"), 3), "\n").alias("tail"))


@R.query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE 1 END AS n, text AS msg FROM documents")
def migrate_logs(spark, d):
    jobs_ = table(spark, d, "documents").select("doc_id", F.col("text").alias("log"))
    new = migrate.migrate_logs(jobs_, F.lit("2024-01-01"))
    return new.select("doc_id", F.size("logs").alias("n"), F.try_element_at("logs", F.lit(1))["msg"].alias("msg"))


@R.query("SELECT 'instagram' AS platform, 'C' || event_id AS code, CASE WHEN event_id % 2 = 0 THEN 0.5 END AS frame_interval FROM events WHERE event_id % 3 > 0")
def queue_items(spark, d):
    e = F.col("event_id")
    key = F.when(e % 3 == 0, "none").when(e % 3 == 1, "code").otherwise("shortcode")
    body = F.concat(F.lit('{"platform": "instagram", "'), key, F.lit('": "C'), e, F.lit('"'), F.when(e % 2 == 0, ', "frame_interval": 0.5').otherwise(""), F.lit("}"))
    return inputs.queue_items(_events(spark, d).select(body.alias("body")))


@R.query("SELECT DISTINCT 'instagram' AS platform, 'C' || user_id AS code FROM events")
def job_input_round_trip(spark, d):
    """Codes as job inputs, written as JSON arrays of many items and read back; a body that is no JSON gives nothing."""
    items = inputs.job_input(_events(spark, d).select(F.concat(F.lit("C"), "user_id").alias("code")).distinct(), "code")
    bodies = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(64)).alias("batch")).agg(F.to_json(F.collect_list("item")).alias("body")).select("body")
    return inputs.job_items(bodies.unionByName(spark.createDataFrame([("no json",), (None,)], "body string")), "body")


@R.query("SELECT event_id, event_id % 3 > 0 AS valid, event_id % 2 = 1 AS has_prompt FROM events")
def request_checks(spark, d):
    e = F.col("event_id")
    items = F.when(e % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return _events(spark, d).select("event_id", jobs.valid_items(items).alias("valid"), jobs.valid_text(F.when(e % 2 == 1, "p").otherwise("  ")).alias("has_prompt"))


@R.query("SELECT l_orderkey, l_linenumber, unnest(range(0, CAST(l_quantity AS BIGINT), 7)) AS frame_no FROM lineitem")
def frame_explode(spark, d):
    li = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("video"), F.col("l_quantity").cast("long").alias("total"), F.lit(7).alias("every"))
    return frames.explode_frames(li, "video", "total", "every").select("video.l_orderkey", "video.l_linenumber", "frame_no")


@R.query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE 16 END AS dim, CASE WHEN text IS NULL THEN NULL ELSE 1.0::DOUBLE END AS norm, count(*) OVER (PARTITION BY text) AS n_equal FROM documents")
def encode_text_stub(spark, d):
    """Vectors of all texts by the deterministic stand-in encoder: dimension, norm, and that equal texts, and no others, share a vector."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = frames.encode(docs, "text", lambda: frames.hash_encoder(16))
    same = out.groupBy(F.col("vector").alias("v")).agg(F.count("*").alias("n_equal"))
    return out.join(same, F.col("vector").eqNullSafe(F.col("v"))).select("doc_id", F.size("v").alias("dim"), F.round(vector.norm(F.col("v")), 4).alias("norm"), "n_equal")


@R.query("SELECT id, TRY_CAST(duration AS DOUBLE) AS seconds FROM insta_content")
def duration_numbers(spark, d):
    return table(spark, d, "insta_content").select("id", F.col("duration").try_cast("double").alias("seconds"))


_KEY = "'c' || user_id || '_' || event_id || '_' || CAST(CAST((event_id % 90) + 0.5 AS DOUBLE) AS VARCHAR)"


@R.query(
    f"SELECT event_id, 'instagram/c' || user_id || '/' || event_id || '_' || (event_id % 90) || '.50.png' AS path, CAST(event_id AS INT) AS frame_number, CAST((event_id % 90) + 0.5 AS DOUBLE) AS frame_second, 'c' || user_id || '_' || event_id AS natural_key, {_uuid_sql(hashing.NAMESPACE['url'], _KEY)} AS uuid FROM events"
)
def frame_points(spark, d):
    """Points of frames by name: payload with deterministic ids."""
    names = _events(spark, d).select("event_id", F.concat(F.lit("c"), "user_id").alias("code"), F.concat("event_id", F.lit("_"), F.col("event_id") % 90, F.lit(".50.png")).alias("name"), F.lit(0).alias("position"))
    points = migrate.frame_points(names, F.lit("2024-01-01T00:00:00+00:00"))
    return points.select(F.col("frame_number").cast("long").alias("event_id"), "path", "frame_number", "frame_second", "natural_key", "uuid")


@R.query("SELECT CAST(vec_id AS VARCHAR) AS id, round(embedding[1]::DOUBLE, 6) AS score, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS n_payload, CASE WHEN label % 2 = 0 THEN CAST(label AS VARCHAR) END AS video FROM embeddings")
def search_results(spark, d):
    payload = F.when(F.col("label") % 2 == 0, F.create_map(F.lit("video"), F.col("label").cast("string")))
    hits = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"), payload.alias("payload"))
    return migrate.search_results(hits).select("id", "score", F.size("payload").alias("n_payload"), F.try_element_at("payload", F.lit("video")).alias("video"))


@R.query("SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 5 END AS x, CASE WHEN user_id % 2 = 0 THEN 100 ELSE 60 END AS w, user_id % 2 = 1 AS cropped FROM events")
def crop_or_original(spark, d):
    from ..operators import frames as frame_operators

    users = _events(spark, d).select(F.col("user_id").alias("video")).distinct()
    videos = users.select("video", F.col("video").alias("position"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    rects = users.where("video % 2 = 1").select("video", F.lit(5).alias("x"), F.lit(5).alias("y"), F.lit(60).alias("w"), F.lit(40).alias("h"))
    return frame_operators.crop_or_original(videos, rects).select(F.col("video").alias("user_id"), "x", "w", "cropped")


@R.query("SELECT user_id, bool_and(event_type <> 'error') AS ok FROM events GROUP BY 1")
def process_codes(spark, d):
    from .. import api

    ev = _events(spark, d).select(F.col("user_id").alias("code"), (F.col("event_type") != "error").alias("ok"))
    return api.process_codes(ev, ev).withColumnRenamed("code", "user_id")
