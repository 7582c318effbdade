"""F-01..F-36 and traps T-03, T-04, T-05, T-10..T-12, T-22, T-23, T-25, T-27."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.functions import hashing, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name", ["a_1_2.5", "", "żółć 日本", "test_code_0_12.5", "x" * 500])
def test_uuid5(spark, name):
    assert one(spark, name, lambda c: hashing.uuid5("url", c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, name, lambda c: hashing.uuid5("dns", c)) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


@pytest.mark.parametrize("x", [12.5, 0.0, 1.0, 1234567890.5, 1e7, 123456789012.25, 0.001, -2500000.0])
def test_float_text_is_pythons(spark, x):
    assert one(spark, x, text.float_text, "double") == repr(x)


@pytest.mark.parametrize("key, want", [("/a//b/c.png", "a/b"), ("a", None), ("", None), (None, None), ("a/b", "a/b")])
def test_folder_of(spark, key, want):
    assert one(spark, key, text.folder_of) == want


@pytest.mark.parametrize(
    "key, want",
    [
        ("instagram/c/1_2.50.png", ("instagram", "c", "c", 1, 2.5)),
        ("own/u/v/3_4.png", ("own", "u.v", "v", 3, 4.0)),
        ("tiktok/u/v/3_4.png", None),
        ("instagram/c/x_y.png", None),
        ("instagram/c/video.mp4", None),
        ("a", None),
        (None, None),
    ],
)
def test_parse_key(spark, key, want):
    got = one(spark, key, text.parse_key)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("key, want", [("instagram/c/video.mp4", ("instagram", "c")), ("youtube/c/video.mp4", None), ("x/instagram/c/video.mp4", None), (None, None)])
def test_video_key(spark, key, want):
    got = one(spark, key, text.video_key)
    assert (tuple(got) if got else None) == want


def test_frame_names(spark):
    df = spark.createDataFrame([("10_90.00.png", 0), ("noindex.png", 3), ("1_1234567890.5.png", 1), ("a_b.png", 2)], "name string, pos int")
    got = [tuple(r) for r in df.select(text.frame_index(F.col("name"), F.col("pos")), text.frame_second(F.col("name"), F.col("pos")), text.is_frame_name(F.col("name"))).collect()]
    assert got == [(10, 90.0, True), (3, 3.0, False), (1, 1234567890.5, True), (None, None, False)]
    assert one(spark, 12.5, lambda c: text.frame_name(F.lit(0), c), "double") == "0_12.50.png"


@pytest.mark.parametrize("value, want", [("user.video", "user"), ("a.b.mp4", "a.b"), ("plain", "plain"), (None, None)])
def test_strip_extension(spark, value, want):
    assert one(spark, value, text.strip_extension) == want


def test_strip_known_extension(spark):
    assert one(spark, "user.video", lambda c: text.strip_extension(c, True)) == "user.video"
    assert one(spark, "user.video.MP4", lambda c: text.strip_extension(c, True)) == "user.video"


@pytest.mark.parametrize("path, want", [("//c/1.png", "instagram/c/1.png"), ("instagram/c/1.png", "instagram/c/1.png"), ("c", "instagram/c"), (None, None)])
def test_prefixed(spark, path, want):
    assert one(spark, path, lambda c: text.prefixed(c, F.lit("instagram"))) == want


@pytest.mark.parametrize(
    "url, want",
    [("https://www.instagram.com/reel/Cx/", "Cx"), ("https://www.instagram.com/p/Cx/", None), ("https://x.invalid/reel/Cx", None), ("Cx", "Cx"), ("https://instagram.com/reel/Cx/?a=b", "?a=b"), (None, None)],
)
def test_shortcode(spark, url, want):
    assert one(spark, url, text.shortcode) == want


def test_urls(spark):
    assert one(spark, "/a//b", lambda c: text.normalised_url(c, True)) == "a/b/"
    assert one(spark, "/", text.normalised_url) == "/"
    assert one(spark, "https://h//x", text.normalised_url) == "https://h/x"
    assert one(spark, '{"video_url":"http://h/?a=1\\u0026b=2"}', text.embedded_value) == "http://h/?a=1&b=2"
    assert one(spark, "none", text.embedded_value) is None
    assert one(spark, "a.MOV", text.extension) == "mov" and one(spark, "a.exe", text.extension) == "mp4"
    assert one(spark, "a.b.c", text.job_name) == "a-b-c"


@pytest.mark.parametrize("a, b, want", [(0, 0, 0), (0, None, None), (None, 4, 4), (3, 4, 3), (0, 5, 5)])
def test_truthy_numbers(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a int, b int")
    assert df.select(text.truthy(F.col("a"), F.col("b")).alias("y")).first().y == want


def test_truthy_text(spark):
    assert one(spark, "", lambda c: text.truthy(c, F.lit("instagram"))) == "instagram"
    assert one(spark, "tiktok", lambda c: text.truthy(c, F.lit("instagram"))) == "tiktok"
    assert one(spark, None, lambda c: text.truthy(c, F.lit(""))) == ""


@pytest.mark.parametrize("n, label, whole", [(999, "999", "999"), (1500, "1.5K", "2K"), (999_950, "1000.0K", "1000K"), (2_340_000, "2.3M", "2M"), (None, None, None)])
def test_number_labels(spark, n, label, whole):
    assert one(spark, n, text.short_number, "int") == label and one(spark, n, text.whole_number, "int") == whole


@pytest.mark.parametrize("a, b, want", [("2024-01-01 00:00:00", "2024-01-02 01:00:05", "1d 1h 5s"), ("2024-01-01 00:01:00", "2024-01-01 00:00:00", "1m"), ("2024-01-01 00:00:00", "2024-01-01 00:00:00", "0s"), ("2024-01-01 00:00:00", None, "Processing...")])
def test_duration_labels(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    assert df.select(text.duration_label(F.col("a"), F.col("b")).alias("y")).first().y == want


def test_iso_has_an_offset(spark):
    assert one(spark, "2024-01-01 10:11:12.5", lambda c: text.iso_utc(c.cast("timestamp"))) == "2024-01-01T10:11:12+00:00"


@pytest.mark.parametrize("line, want", [('x {"item_done": 2} {"item_done": 9}', 2), ("{broken}", None), ("none", None), ('{"item_done": "x"}', None), (None, None)])
def test_beacon(spark, line, want):
    assert one(spark, line, text.beacon) == want


def test_logs_and_marks(spark):
    assert one(spark, "a\nb\nc", lambda c: text.log_tail(c, 2)) == ["b", "c"]
    assert one(spark, "a", lambda c: text.log_tail(c, 5)) == ["a"]
    assert one(spark, "a\nb", lambda c: text.log_tail(c, None)) == ["a", "b"]
    assert one(spark, "✔ x ✔", text.check_marks) == 2
    assert one(spark, "Active", text.toggled) == "Not Active" and one(spark, "odd", text.toggled) == "Active"


def test_contains_term_is_literal(spark):
    df = spark.createDataFrame([("A.b", None), (None, "xA.Bx"), ("ab", "ab"), (None, None)], "u string, c string")
    assert df.where(text.contains_term("a.B", F.col("u"), F.col("c"))).count() == 2
    assert df.where(text.contains_term("  ", F.col("u"))).count() == 4


def test_numbers(spark):
    assert one(spark, 7, text.even, "int") == 8
    assert one(spark, 50, lambda c: text.seconds(c, F.lit(0.0)), "int") == 2.0
    df = spark.createDataFrame([(100, 80, 90), (100, 99, 99)], "o int, w int, h int")
    assert [r[0] for r in df.select(text.should_crop(F.col("o"), F.col("o"), F.col("w"), F.col("h"), 0.15)).collect()] == [True, False]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=1e-3, max_value=1e9, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=30))
def test_float_text_property(spark, xs):
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(text.float_text(F.col("x")).alias("y")).collect()]
    assert [float(g) for g in got] == xs and not any("E" in g for g in got)
