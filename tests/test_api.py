"""The service surface and UDF-07..09."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake import api
from lumenlake.operators import frames
from lumenlake.sources.frames import hash_encoder


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(4)], f"v{i % 3}", "u" if i % 2 else "w") for i in range(30)]
    return spark.createDataFrame(rows, "id long, vector array<float>, video string, owner string")


def test_searches(corpus):
    assert api.search_text(corpus, "harbour", hash_encoder(4)).count() == 5
    with pytest.raises(ValueError):
        api.search_text(corpus, "  ", hash_encoder(4))
    assert api.search_by_image(corpus, corpus, 3, "u", 2).first().id == 3
    flat = api.search_by_video(corpus, corpus, "v1", "u", 3)
    scores = [r.score for r in flat.collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) == 15
    assert sum(r.total_frames for r in api.search_by_video(corpus, corpus, "v1", "u", 3, grouped=True).collect()) == 15
    assert api.search_video_to_video(corpus, corpus, "v1", "u", 3).first().video_id == "v1"
    assert api.search_by_video(corpus, corpus, "none", "u", 3).count() == 0


def test_lookup(spark):
    points = spark.createDataFrame([("test_id", [0.1, 0.2], {"key": "value"})], "id string, vector array<double>, payload map<string,string>")
    got = api.get_embedding({"user_images": points}, "user_images", "test_id").first()
    assert got.vector == [0.1, 0.2] and got.payload == {"key": "value"}
    assert api.get_embedding({"user_images": points}, "user_images", "x").count() == 0
    for collection, i in (("odd", "x"), ("user_images", " ")):
        with pytest.raises(ValueError):
            api.get_embedding({"user_images": points}, collection, i)


def test_ingestion(spark):
    listing = spark.createDataFrame([("c", "0_12.5.png", 0, bytearray(b"x")), ("c", "1_25.0.png", 1, None)], "code string, name string, position int, content binary")
    got = {r.frame_number: r for r in api.ingest_frames(listing, lambda: hash_encoder(4), F.lit("now"), dim=4).collect()}
    assert len(got[0].vector) == 4 and got[1].vector is None and got[0].path == "instagram/c/0_12.5.png"
    with pytest.raises(Exception, match="expected 5"):
        api.ingest_frames(listing, lambda: hash_encoder(4), F.lit("now"), dim=5).collect()
    up = spark.createDataFrame([("a.png", "image/png", bytearray(b"x")), ("b.txt", "text/plain", bytearray(b"x")), ("c.png", "image/png", None)], "filename string, content_type string, content binary")
    done = api.ingest_images(up, lambda: hash_encoder(4), "u1")
    s = api.upload_summary(done).first()
    assert (s.total, s.successful, s.failed) == (3, ["a.png"], ["b.txt", "c.png"])
    with pytest.raises(ValueError):
        api.ingest_images(spark.range(51).selectExpr("cast(id as string) filename", "'image/png' content_type", "cast('x' as binary) content"), lambda: hash_encoder(4), "u")


def test_jobs(spark):
    codes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "code string")
    done = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("d", None)], "code string, ok boolean")
    assert {r.code: r.ok for r in api.process_codes(codes, done).collect()} == {"a": True, "b": False, "c": False, "d": False}
    t = datetime(2024, 1, 1)
    ev = spark.createDataFrame([("j", t, "RUNNING", "one"), ("j", t + timedelta(1), "COMPLETED", "two"), ("k", t, "PENDING", None)], "job_id string, ts timestamp, status string, log string")
    got = {r.job_id: (r.status, r.log_tail) for r in api.job_status(ev, 1).collect()}
    assert got == {"j": ("COMPLETED", ["two"]), "k": ("PENDING", [])}


def test_crop_falls_back_to_the_whole_frame(spark):
    v = spark.createDataFrame([("a", 1, 100, 50), ("b", 0, 100, 50), ("c", 2, 100, 50), ("d", 3, 100, 50)], "video string, position int, width int, height int")
    r = spark.createDataFrame([("a", 5, 5, 60, 40), ("c", 0, 0, 99, 50), ("d", 0, 0, 0, 0)], "video string, x int, y int, w int, h int")
    got = [(x.video, x.w, x.h, x.cropped) for x in frames.crop_or_original(v, r, least=0.1).collect()]
    assert got == [("b", 100, 50, False), ("a", 60, 40, True), ("c", 100, 50, False), ("d", 100, 50, False)]
