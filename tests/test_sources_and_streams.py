"""SRC-01..22, SNK-01..21, STR-01/02/04/06/10 (traps T-17, T-26)."""

import json

import pytest
from pyspark.sql import functions as F

from lumenlake.sources import collections, inputs, objects
from lumenlake.streaming import loops


@pytest.fixture()
def store(tmp_path):
    for key in ["instagram/c1/video.mp4", "instagram/c1/0_1.50.png", "instagram/c1/x_y.png", "own/u/v/2_3.png", "tiktok/c2/video.mp4", "youtube/c3/video.mp4", "a/b/c/d/1_1.png"]:
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(key.encode())
    return tmp_path


def test_listing_and_keys(spark, store):
    keys = objects.listing(spark, str(store))
    assert {r.key for r in keys.collect()} >= {"instagram/c1/video.mp4", "own/u/v/2_3.png"}
    assert {(r.platform, r.video_code, r.n) for r in objects.frame_keys(keys).collect()} == {("instagram", "c1", 0), ("own", "u.v", 2)}
    assert {(r.platform, r.code) for r in objects.video_keys(keys).collect()} == {("instagram", "c1"), ("tiktok", "c2")}
    items = spark.createDataFrame([("instagram", "c1"), ("instagram", "zz"), (None, "c1"), ("tiktok", None)], "platform string, code string")
    assert [r.code for r in objects.available(items, keys).collect()] == ["c1"]
    assert objects.with_suffix(keys, ".PNG").count() == 4
    content = objects.contents(spark, str(store), "video.mp4").select(F.lit("instagram").alias("platform"), F.element_at(F.split("path", "/"), -2).alias("code"), "content")
    got = {r.code: r.content for r in objects.downloads(items.where("code IS NOT NULL"), content).where("platform IS NOT NULL").collect()}
    assert got["zz"] is None and bytes(got["c1"]) == b"instagram/c1/video.mp4"


def test_inputs(spark, tmp_path):
    df = spark.createDataFrame([('[{"platform":"instagram","code":"a"},{"code":"b"}]',), ("broken",), ("[]",)], "body string")
    assert [tuple(r) for r in inputs.job_items(df, "body").collect()] == [("instagram", "a"), (None, "b")]
    q = spark.createDataFrame([('{"code":"a","platform":"p"}',), ('{"shortcode":"b","frame_interval":0.5}',), ("{}",), (None,)], "body string")
    assert [r.code for r in inputs.queue_items(q).collect()] == ["a", "b"]
    flags = spark.createDataFrame([("a", False), ("b", None), ("c", True)], "code string, f boolean")
    assert [r.code for r in inputs.pending(flags, "f", "code", 5).collect()] == ["a"]
    items = spark.createDataFrame([("instagram", "a")], "platform string, code string")
    collections.write_report(items, str(tmp_path / "report"))
    assert tuple(inputs.read_report(spark, str(tmp_path / "report")).first()) == ("instagram", "a")
    collections.write_job_input(items, str(tmp_path / "items"))
    assert tuple(spark.read.json(str(tmp_path / "items")).select("platform", "code").first()) == ("instagram", "a")
    (tmp_path / "j.json").write_text(json.dumps([{"platform": "p", "code": "x"}], indent=1))
    assert inputs.read_json(spark, str(tmp_path / "j.json"), "platform string, code string").count() == 1


def test_collection_config(spark):
    good = {"collection_name": "frames_t", "vector_params": {"size": 4, "distance": "Cosine"}, "payload_indexes": [{"field_name": "video", "field_schema": "KEYWORD"}, {"field_name": "x", "field_schema": "odd"}]}
    with pytest.warns(UserWarning):
        config = collections.parse_config(json.dumps(good))
    assert config == {"name": "frames_t", "size": 4, "distance": "cosine", "indexes": {"video": "string"}}
    assert collections.create(spark, config) is True and collections.create(spark, config) is False
    assert dict(spark.table("frames_t").dtypes)["video"] == "string"
    spark.sql("DROP TABLE frames_t")
    with pytest.raises(ValueError):
        collections.parse_config(json.dumps({"collection_name": "x"}))
    with pytest.raises(ValueError):
        collections.parse_config(json.dumps(good | {"vector_params": {"size": 4, "distance": "odd"}}))


def test_upsert_reload_truncate(spark, tmp_path):
    path = str(tmp_path / "points")
    schema = "id string, created_at string, v int"
    collections.upsert(spark, path, spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3)], schema))
    collections.upsert(spark, path, spark.createDataFrame([("a", "1", 9), ("c", "1", 4)], schema))
    assert {(r.id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 3), ("c", 4)}
    collections.upsert(spark, path, spark.createDataFrame([], schema))
    assert spark.read.parquet(path).count() == 3
    collections.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0
    left = collections.delete_keys(spark.createDataFrame([("p", "a"), ("q", "a")], "p string, c string"), spark.createDataFrame([("p", "a")], "p string, c string"), "p", "c")
    assert [tuple(r) for r in left.collect()] == [("q", "a")]


def test_loop_resumes_and_survives_a_failed_batch(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.range(10).coalesce(1).write.parquet(source)
    stream = lambda: loops.file_stream(spark, source, "id long", "*.parquet")
    seen = []

    def broken(df, n):
        raise ValueError("stop")

    with pytest.raises(Exception):
        loops.checkpointed_loop(stream(), checkpoint, broken)
    loops.checkpointed_loop(stream(), checkpoint, lambda df, n: seen.append(df.count()))
    assert sum(seen) == 10
    loops.checkpointed_loop(stream(), checkpoint, lambda df, n: seen.append(df.count()))
    assert sum(seen) == 10
    spark.range(10, 13).coalesce(1).write.mode("append").parquet(source)
    loops.checkpointed_loop(stream(), checkpoint, lambda df, n: seen.append(df.count()))
    assert sum(seen) == 13


def test_dedup_stream_and_states(spark, tmp_path):
    source = str(tmp_path / "in")
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00", "PENDING"), (1, "2024-01-01 00:00:00", "PENDING"), (2, "2024-01-01 00:10:00", "RUNNING")], "job long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ev.coalesce(1).write.parquet(source)
    stream = loops.file_stream(spark, source, ev.schema)
    loops.run_to_parquet(loops.dedup_within(stream, "job", "ts"), str(tmp_path / "c1"), str(tmp_path / "o1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 2
    got = {}
    states = loops.job_states(loops.file_stream(spark, source, ev.schema), "job", "ts", "status")
    query = states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).foreachBatch(lambda df, n: got.update({r.job: (r.status, r.n_events) for r in df.collect()})).start()
    query.awaitTermination()
    assert got == {1: ("PENDING", 2), 2: ("RUNNING", 1)}


def test_windows_and_sessions_on_tables(spark):
    ev = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:20:00", 2.0), ("a", "2024-01-01 05:00:00", 3.0)], "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert loops.windowed_counts(ev, "ts", "k", "v").first().n == 3
    assert sorted(r.n for r in loops.sessions(ev, "ts", "k").collect()) == [1, 2]


def test_checkpoint_admin(spark, tmp_path):
    cp = loops.Checkpoint(spark, str(tmp_path / "cp"))
    assert cp.show() is None
    cp.set("973b7928-a2c7")
    assert cp.show() == "973b7928-a2c7"
    cp.reset()
    assert cp.show() is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("broken")
    assert loops.Checkpoint(spark, str(tmp_path / "bad")).show() is None
