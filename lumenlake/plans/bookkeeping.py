"""Queries on the catalog's relational bookkeeping, over the project's tables and the shared star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import jobs, relational
from ..sources import collections, inputs, objects
from ..session import shared_folder, table
from ..streaming import loops
from .registry import Registry

R = Registry()

_NEWEST = """posts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM insta_content) WHERE rn = 1)"""


def posts(spark, d):
    """One row per post: the last stored copy."""
    t = table(spark, d, "insta_content")
    return t.groupBy("id").agg(F.max_by(F.struct(*t.columns), "updated_at").alias("s")).select("s.*")


@R.query(
    f"""WITH {_NEWEST} SELECT count(*) AS total, CAST(sum(CASE WHEN is_extracted THEN 1 ELSE 0 END) AS BIGINT) AS extracted, CAST(sum(CASE WHEN is_embedded THEN 1 ELSE 0 END) AS BIGINT) AS embedded,
  CAST(round(100.0 * sum(CASE WHEN is_extracted THEN 1 ELSE 0 END) / count(*), 2) AS DOUBLE) AS extracted_percent, CAST(round(100.0 * sum(CASE WHEN is_embedded THEN 1 ELSE 0 END) / count(*), 2) AS DOUBLE) AS embedded_percent FROM posts"""
)
def progress_report(spark, d):
    return relational.progress(posts(spark, d), F.col("is_extracted"), F.col("is_embedded"))


def _keys(spark, d):
    return table(spark, d, "insta_content").select(F.regexp_replace("video_url", "^store://[^/]+/", "").alias("key"), "code").where("key IS NOT NULL")


_KEYS = "keys AS (SELECT regexp_replace(video_url, '^store://[^/]+/', '') AS key, code FROM insta_content WHERE video_url IS NOT NULL)"
_FOLDER = "split_part(key, '/', 1) || '/' || split_part(key, '/', 2)"


@R.query(f"WITH {_KEYS} SELECT DISTINCT {_FOLDER} AS folder FROM keys")
def folder_distinct(spark, d):
    return _keys(spark, d).select(text.folder_of(F.col("key")).alias("folder")).where("folder IS NOT NULL").distinct()


@R.query(f"WITH {_KEYS} SELECT count(DISTINCT {_FOLDER}) AS n FROM keys")
def folder_count(spark, d):
    return relational.distinct_count(_keys(spark, d), text.folder_of(F.col("key")))


@R.query(f"WITH {_KEYS} SELECT split_part(f, '/frames/', 1) AS folder, count(*) AS n FROM (SELECT {_FOLDER} || '/frames/' || code || '.png' AS f FROM keys) GROUP BY 1")
def frame_counts_by_folder(spark, d):
    frames = _keys(spark, d).select(F.concat(text.folder_of(F.col("key")), F.lit("/frames/"), "code", F.lit(".png")).alias("f")).where(F.col("f").contains("/frames/"))
    return frames.groupBy(text.before(F.col("f")).alias("folder")).agg(F.count("*").alias("n"))


@R.query(f"WITH {_KEYS} SELECT key, split_part(key, '/', 1) AS platform, split_part(key, '/', 2) AS code FROM keys WHERE regexp_full_match(key, '[^/]+/[^/]+/video\\.mp4') AND split_part(key, '/', 1) IN ('instagram', 'tiktok')")
def video_key_scan(spark, d):
    return objects.video_keys(_keys(spark, d).select("key"))


@R.query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphan_folders(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return relational.orphan_folders(c.unionByName(c), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@R.query("SELECT DISTINCT s.id, s.user_id FROM insta_content_snapshots s WHERE NOT EXISTS (SELECT 1 FROM insta_content c WHERE c.id = s.id AND c.user_id = s.user_id)")
def orphan_folders_strict(spark, d):
    s = table(spark, d, "insta_content_snapshots").select("id", "user_id")
    return relational.orphan_folders(s, table(spark, d, "insta_content"), "id", "user_id")


@R.query("SELECT id, code FROM insta_content WHERE NOT is_downloaded AND id IN (SELECT id FROM insta_content_snapshots)")
def pending_existing(spark, d):
    p = table(spark, d, "insta_content").where("is_downloaded = false").select("id", "code")
    return relational.existing(p, table(spark, d, "insta_content_snapshots"), "id")


@R.query("SELECT id, bool_or(s.sid IS NOT NULL) AS present FROM insta_content LEFT JOIN (SELECT DISTINCT id AS sid FROM insta_content_snapshots) s ON s.sid = id WHERE id IS NOT NULL GROUP BY id")
def exists_map(spark, d):
    return relational.exists_map(table(spark, d, "insta_content"), table(spark, d, "insta_content_snapshots"), "id")


@R.query("SELECT DISTINCT id, code FROM insta_content WHERE is_extracted = false AND id NOT IN (SELECT insta_content_id FROM extraction_errors WHERE insta_content_id IS NOT NULL) AND id NOT IN (SELECT id FROM insta_content_snapshots WHERE id IS NOT NULL)")
def not_extracted_not_processed(spark, d):
    p = table(spark, d, "insta_content").where("is_extracted = false").select("id", "code").distinct()
    errors = table(spark, d, "extraction_errors").select(F.col("insta_content_id").alias("id"))
    return relational.missing(p, errors, table(spark, d, "insta_content_snapshots"), on=["id"])


@R.query(f"WITH {_NEWEST} SELECT p.id, p.code, e.id AS error_id, e.error_type FROM posts p JOIN (SELECT DISTINCT id, insta_content_id, error_type FROM extraction_errors) e ON p.id = e.insta_content_id")
def content_errors_join(spark, d):
    e = table(spark, d, "extraction_errors").select(F.col("id").alias("error_id"), "insta_content_id", "error_type").distinct()
    return relational.content_errors(posts(spark, d).select("id", "code"), e, "id", "insta_content_id").select("id", "code", "error_id", "error_type")


@R.query("SELECT id, insta_content_id, error_type FROM extraction_errors WHERE insta_content_id IN (SELECT id FROM insta_content)")
def insert_errors_guarded(spark, d):
    return relational.insert_guarded(table(spark, d, "extraction_errors"), table(spark, d, "insta_content"), "insta_content_id", "id").select("id", "insta_content_id", "error_type")


@R.query(
    f"""WITH {_NEWEST}, c AS (SELECT p.created_at, p.id FROM posts p JOIN extraction_checkpoint k ON k.id = p.id)
SELECT id, epoch_us(created_at) AS created_us FROM posts WHERE created_at > (SELECT max(created_at) FROM c) OR (created_at = (SELECT max(created_at) FROM c) AND id > (SELECT max(id) FROM c))
ORDER BY created_at, id LIMIT 1000"""
)
def next_batch(spark, d):
    last = table(spark, d, "extraction_checkpoint").select("id").first()
    batch = relational.next_batch(posts(spark, d).select("id", "created_at"), 1000, last.id if last else None)
    return batch.select("id", F.unix_micros("created_at").alias("created_us"))


@R.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def page_slice(spark, d):
    return relational.page(table(spark, d, "orders"), 3, 25, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def top_recent(spark, d):
    return relational.recent(table(spark, d, "orders"), 100, "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@R.query("SELECT id, code FROM (SELECT DISTINCT id, code FROM insta_content WHERE is_downloaded = false) ORDER BY code, id LIMIT 50")
def pending_codes(spark, d):
    p = table(spark, d, "insta_content").select("id", "code", "is_downloaded").distinct()
    return inputs.pending(p, "is_downloaded", ["code", "id"], 50).select("id", "code")


@R.query("SELECT DISTINCT code FROM insta_content WHERE code IS NOT NULL")
def distinct_codes(spark, d):
    return inputs.codes(table(spark, d, "insta_content"), F.col("code"))


@R.query(f"WITH {_NEWEST} SELECT id, CASE WHEN id IN (SELECT insta_content_id FROM extraction_errors WHERE insta_content_id IS NOT NULL) THEN true ELSE is_extracted END AS is_extracted, frames FROM posts")
def set_flags(spark, d):
    ids = table(spark, d, "extraction_errors").select(F.col("insta_content_id").alias("id"))
    return relational.set_flags(posts(spark, d).select("id", "is_extracted", "frames"), ids, {"is_extracted": F.lit(True)})


@R.query(f"WITH {_NEWEST} SELECT id, CASE WHEN h THEN true ELSE is_cropped END AS is_cropped, CASE WHEN h THEN true ELSE is_extracted END AS is_extracted, CASE WHEN h THEN 7 ELSE frames END AS frames FROM (SELECT *, id IN (SELECT id FROM insta_content_snapshots WHERE id IS NOT NULL) AS h FROM posts)")
def mark_done(spark, d):
    p = posts(spark, d).select("id", "is_cropped", "is_extracted", "frames")
    return relational.set_flags(p, table(spark, d, "insta_content_snapshots").select("id"), {"is_cropped": F.lit(True), "is_extracted": F.lit(True), "frames": F.lit(7)})


@R.query(f"WITH {_NEWEST} SELECT id, CASE WHEN s.sid IS NOT NULL THEN true ELSE is_embedded END AS is_embedded FROM posts LEFT JOIN (SELECT DISTINCT id AS sid FROM insta_content_snapshots) s ON sid = id")
def mark_embedded_verified(spark, d):
    p = posts(spark, d).select("id", "is_embedded")
    verified = relational.exists_map(p, table(spark, d, "insta_content_snapshots"), "id").where("present")
    return relational.set_flags(p, verified, {"is_embedded": F.lit(True)})


@R.query(f"WITH {_NEWEST} SELECT id, CASE WHEN id IN (SELECT id FROM posts WHERE is_extracted ORDER BY id LIMIT 500) THEN false ELSE is_extracted END AS is_extracted FROM posts")
def bounded_reset(spark, d):
    return relational.bounded_reset(posts(spark, d).select("id", "is_extracted"), "is_extracted", 500)


@R.query("SELECT id, epoch_us(max(t)) AS t FROM (SELECT id, last_refreshed_at AS t FROM insta_content UNION ALL SELECT id, last_refreshed_at FROM insta_content_snapshots) GROUP BY id")
def upsert_latest(spark, d):
    old = table(spark, d, "insta_content").select("id", F.col("last_refreshed_at").alias("t"))
    new = table(spark, d, "insta_content_snapshots").select("id", F.col("last_refreshed_at").alias("t"))
    return relational.upsert_latest(old, new, "id", "t").select("id", F.unix_micros("t").alias("t"))


@R.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_by_list(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return collections.delete_keys(table(spark, d, "customer"), gone, "c_custkey").select("c_custkey", "c_name")


@R.query("SELECT * FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer)")
def union_distinct(spark, d):
    return relational.union_distinct(*(table(spark, d, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))))


@R.query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def set_difference(spark, d):
    return relational.difference(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k")))


@R.query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderkey % 10), list(o_orderkey % 7)))), ',') AS both FROM orders GROUP BY 1")
def set_union_ints(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 10).alias("a"), F.collect_set(F.col("o_orderkey") % 7).alias("b"))
    return per.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")).cast("array<string>"), ",").alias("both"))


@R.query("SELECT query_id, id FROM (SELECT user_id AS query_id, event_id AS id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id FROM events WHERE value > 10)")
def bag_append(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "event_type", "value")
    return ev.where("event_type = 'click'").select("query_id", "id").unionByName(ev.where("value > 10").select("query_id", "id"))


@R.query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 20) AS succeeded, count(*) - count(*) FILTER (value > 20) AS failed FROM events GROUP BY 1")
def batch_counters(spark, d):
    return relational.counters(table(spark, d, "events"), F.col("value") > 20, "event_type")


@R.query(
    """SELECT user_id, count(*) AS total, coalesce(array_to_string(list(event_id ORDER BY event_id) FILTER (event_type <> 'error'), ','), '') AS successful, coalesce(array_to_string(list(event_id ORDER BY event_id) FILTER (event_type = 'error'), ','), '') AS failed FROM events GROUP BY 1"""
)
def download_summary(spark, d):
    s = relational.outcome_lists(table(spark, d, "events"), F.col("event_type") != "error", F.col("event_id"), F.col("event_id"), "user_id")
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return s.select("user_id", "total", join("successful"), join("failed"))


@R.query(
    """SELECT user_id, extracted, uploaded, stored, CASE WHEN stored = extracted THEN 'processed' ELSE 'upload_completed_processing_failed' END AS status, extracted || ' frames extracted, ' || uploaded || ' uploaded, ' || stored || ' stored' AS message
FROM (SELECT user_id, count(*) AS extracted, count(*) FILTER (event_type <> 'error') AS uploaded, count(*) FILTER (value > 1) AS stored FROM events GROUP BY 1)"""
)
def processing_counts(spark, d):
    return relational.processing_status(table(spark, d, "events"), "user_id", F.col("event_type") != "error", F.col("value") > 1)


@R.query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total_sec, round(avg(value), 6) AS mean_sec, max(value) AS max_sec FROM events GROUP BY 1")
def profile_rollup(spark, d):
    p = relational.profile(table(spark, d, "events"), "event_type", "value")
    return p.select("event_type", "calls", F.round("total_sec", 4).alias("total_sec"), F.round("mean_sec", 6).alias("mean_sec"), "max_sec")


@R.query("SELECT k, (row_number() OVER (ORDER BY k) - 1) // 100 AS batch_id FROM (SELECT event_id * 7 + event_id % 5 AS k FROM events)")
def batch_ids(spark, d):
    """Batches of a hundred over ids with gaps."""
    return relational.batch_ids(table(spark, d, "events").select((F.col("event_id") * 7 + F.col("event_id") % 5).alias("k")), "k", 100, chunk=64)


@R.query(
    """SELECT user_id, event_id, done, done - lag(done, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS delta, CAST(trunc(100 * (done - lag(done, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id)) / 100.0) AS INT) AS percent
FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS done FROM events)"""
)
def beacon_progress(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", F.replace("props", F.lit('"k"'), F.lit('"item_done"')).alias("line"))
    return jobs.progress_deltas(ev, "event_id", "line", F.lit(100), "user_id").select("user_id", "event_id", "done", "delta", "percent")


@R.query(
    """SELECT user_id, event_id, n, completed FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS completed FROM events) WHERE n > 5 AND completed % greatest(1, n // 5) = 0"""
)
def progress_marks(spark, d):
    return jobs.progress_marks(table(spark, d, "events").select("user_id", "event_id"), "event_id", "user_id")


@R.query(
    "SELECT user_id, arg_max(event_type, ts) AS status, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us, count(*) AS n_events, arg_max(event_type, ts) = 'error' AS terminal FROM events GROUP BY 1"
)
def job_latest_state(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = jobs.latest_state(ev, "user_id", "ts", "event_type")
    return s.select("user_id", "status", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"), "n_events", "terminal")


@R.query("SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%harbour%' OR lower(source) LIKE '%harbour%'")
def content_search(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(text.contains_term("Harbour", F.col("text"), F.col("source"))).select("doc_id", "source")


@R.query("SELECT id, code FROM insta_content WHERE is_extracted = false")
def flag_filter(spark, d):
    """Null flags are neither true nor false."""
    return table(spark, d, "insta_content").where(F.col("is_extracted") == F.lit(False)).select("id", "code")


@R.query("SELECT id, user_id FROM insta_content WHERE caption <> '' AND frames IS NOT NULL")
def required_fields(spark, d):
    return relational.required(table(spark, d, "insta_content"), "caption", "frames").select("id", "user_id")


@R.query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    w = loops.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@R.query(
    """SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS session_start_us FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s"""
)
def event_sessions(spark, d):
    s = loops.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")
    return s.select("user_id", "n", F.unix_micros("session_start").alias("session_start_us"))


@R.query("SELECT event_id, k % 6 <= 3 AS ok, CAST(least(k % 6, 3) + 1 AS INT) AS attempts FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def retry_plan(spark, d):
    """Items of every event; an attempt succeeds once its number reaches the item's k modulo 6. Items that need more than 3 retries stay failed."""
    items = table(spark, d, "events").select("event_id", (F.get_json_object("props", "$.k").cast("int") % 6).alias("needs"))
    return jobs.retry(items, lambda df, n: df.withColumn("ok", F.col("needs") <= n)).select("event_id", "ok", "attempts")


@R.query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, d):
    """Streaming deduplication by id of a stream in which every event comes three times, within the watermark; run to its end in the shared folder, which is cleaned up."""
    stream = lambda: loops.file_stream(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, "events.parquet")
    late = stream().withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    thrice = stream().unionByName(late).unionByName(stream())
    return loops.run_in_folder(loops.dedup_within(thrice, "event_id", "ts", "60 days"), shared_folder(spark)).select("event_id", "event_type")
