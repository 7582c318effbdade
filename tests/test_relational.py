"""JN-08..13, SRT-04..07, SNK-01/08/09/11/13/16, AGG-01/07/09/14/15, FLT-03/08/15/16, WIN-04/05, STR-03/04/09 (traps T-13..T-18, T-24)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import jobs, migrate, relational

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"id{i:03}", T0 + timedelta(hours=i // 3), [True, False, None][i % 3]) for i in range(40)], "id string, created_at timestamp, flag boolean")


def test_keyset_pages_partition_the_table(rows):
    last, seen = None, []
    while True:
        page = [r.id for r in relational.next_batch(rows, 7, last).collect()]
        if not page:
            break
        seen += page
        last = page[-1]
    assert seen == sorted(f"id{i:03}" for i in range(40))


def test_unknown_last_id(rows):
    assert relational.next_batch(rows, 7, "nope").count() == 0
    assert relational.next_batch(rows, 7, "nope", strict=False).count() == 7


def test_pages_and_recent(rows):
    assert [r.id for r in relational.page(rows, 2, 3, "id").collect()] == ["id003", "id004", "id005"]
    assert [r.id for r in relational.recent(rows, 2, "created_at", "id").collect()] == ["id039", "id036"]
    with pytest.raises(ValueError):
        relational.recent(rows, 2, "created_at; drop", "id")


def test_progress_of_full_and_empty_table(rows):
    full = relational.progress(rows, F.col("flag"), ~F.col("flag")).first()
    assert tuple(full) == (40, 14, 13, 35.0, 32.5)
    assert tuple(relational.progress(rows.limit(0), F.col("flag"), F.col("flag")).first()) == (0, None, None, 0.0, 0.0)
    assert '"total":40' in relational.progress_json(relational.progress(rows, F.col("flag"), F.col("flag"))).first()[0]


def test_existence(spark, rows):
    have = spark.createDataFrame([("id001",), ("id001",), (None,)], "id string")
    got = {r.id: r.present for r in relational.exists_map(rows, have, "id").collect()}
    assert len(got) == 40 and [k for k, v in got.items() if v] == ["id001"]
    assert relational.existing(rows, have, "id").count() == 1
    assert relational.missing(rows, have, have, on=["id"]).count() == 39
    assert relational.existing(rows, have.limit(0), "id").count() == 0


def test_orphan_folders_by_code_or_strictly(spark):
    f = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "b"), ("q", "c")], "platform string, code string")
    k = spark.createDataFrame([("p", "b"), ("q", "c")], "platform string, code string")
    assert {tuple(r) for r in relational.orphan_folders(f, k).select("platform", "code").collect()} == {("p", "a")}
    assert {tuple(r) for r in relational.orphan_folders(f, k, platform="platform").collect()} == {("p", "a"), ("q", "b")}


def test_flags(spark, rows):
    ids = spark.createDataFrame([("id001",), ("id001",), ("zzz",), (None,)], "id string")
    out = relational.set_flags(rows, ids, {"flag": F.lit(True)})
    assert out.count() == 40 and out.columns == rows.columns and out.where("id = 'id001' AND flag").count() == 1
    assert sorted(map(str, relational.set_flags(rows, ids.limit(0), {"flag": F.lit(True)}).collect())) == sorted(map(str, rows.collect()))
    reset = relational.bounded_reset(rows, "flag", 3)
    assert reset.where("flag").count() == 11 and reset.where("flag IS NULL").count() == 13


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], "id string, v int, p string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 5, "z"), ("c", None, "n")], "id string, v int, p string")
    merged = relational.upsert_latest(old, new, "id", "v")
    assert sorted(map(tuple, merged.collect())) == [("a", 2, "y"), ("b", 5, "z"), ("c", None, "n")]
    assert sorted(map(tuple, relational.upsert_latest(merged, new, "id", "v").collect())) == sorted(map(tuple, merged.collect()))


def test_guarded_insert(spark):
    e = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, ref string")
    assert [r.id for r in relational.insert_guarded(e, spark.createDataFrame([("a",), ("a",)], "id string"), "ref", "id").collect()] == [1]


def test_reports(spark):
    df = spark.createDataFrame([("v", 1, True, True), ("v", 2, False, True), ("v", 3, None, False)], "video string, n int, ok boolean, stored boolean")
    assert tuple(relational.counters(df, F.col("ok"), "video").first()) == ("v", 3, 1, 2)
    s = relational.outcome_lists(df, F.col("ok"), F.col("n"), F.col("n"), "video").first()
    assert (s.total, s.successful, s.failed) == (3, [1], [2, 3])
    assert relational.processing_status(df, "video", F.col("ok"), F.col("stored")).first().status == "upload_completed_processing_failed"
    assert relational.required(spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", None)], "x string, y int"), "x", "y").count() == 1


def test_batch_ids_without_one_partition(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(50)], "k long")
    got = {r.k: r.batch_id for r in relational.batch_ids(df, "k", 8, chunk=40).collect()}
    assert got == {i * 7: i // 8 for i in range(50)}


def test_migrate_payload(spark):
    schema = "id string, vector array<float>, platform string, video string, video_code string, frame_idx int, frame_number int, timestamp_s double, frame_second double, path string, extra string"
    df = spark.createDataFrame(
        [
            ("1", [1.0], None, "user.video.mp4", None, 3, None, None, 2.5, "//c/x.png", ""),
            ("2", [1.0], "", None, "code", 0, 0, 1.5, None, "instagram/y.png", ""),
            ("3", [1.0], "tiktok", None, "code", 0, None, 1.5, None, "z.png", ""),  # zero counts as missing
            ("4", [1.0], "tiktok", None, "code", 4, None, 1.5, None, None, ""),
        ],
        schema,
    )
    got = {(r.platform, r.video_code, r.frame_number, r.frame_second, r.path) for r in migrate.migrate_payload(df, F.lit("now")).collect()}
    assert got == {("instagram", "user.video", 3, 2.5, "instagram/c/x.png"), ("instagram", "code", 0, 1.5, "instagram/y.png")}
    with pytest.raises(Exception, match="expected 2"):
        migrate.migrate_payload(df, F.lit("now"), dim=2).collect()


def test_frame_points_follow_the_names(spark):
    df = spark.createDataFrame([("test_code", "0_12.5.png", 0), ("test_code", "noindex.png", 3)], "code string, name string, position int")
    got = {r.name: r for r in migrate.frame_points(df, F.lit("now")).collect()}
    import uuid

    assert got["0_12.5.png"].uuid == str(uuid.uuid5(uuid.NAMESPACE_URL, "test_code_0_12.5")) and got["0_12.5.png"].path == "instagram/test_code/0_12.5.png"
    assert (got["noindex.png"].frame_number, got["noindex.png"].frame_second) == (3, 3.0)


def test_logs_and_hits(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "id int, log string")
    got = {r.id: r.logs for r in migrate.migrate_logs(df, F.lit("t")).collect()}
    assert got[2] == [] and got[1][0].msg == "hello"
    h = spark.createDataFrame([(7, 0.5, None)], "id long, score double, payload map<string,string>")
    assert tuple(migrate.search_results(h).first()) == ("7", 0.5, {})


def test_job_states_and_progress(spark):
    ev = spark.createDataFrame([("j", T0, "PENDING"), ("j", T0 + timedelta(1), "COMPLETED"), ("k", T0, "RUNNING")], "job string, ts timestamp, status string")
    got = {r.job: (r.status, r.terminal) for r in jobs.latest_state(ev, "job", "ts", "status").collect()}
    assert got == {"j": ("COMPLETED", True), "k": ("RUNNING", False)}
    lines = spark.createDataFrame(list(enumerate(['{"item_done": 1}', "noise", 'x {"item_done": 2}', "{bad}", '{"item_done": 3} y', "", "z"])), "no int, line string").withColumn("job", F.lit("j"))
    assert [(r.done, r.percent) for r in jobs.progress_deltas(lines, "no", "line", F.lit(3), "job").orderBy("no").collect()] == [(1, 33), (2, 33), (3, 33)]
    marks = spark.range(12).withColumn("g", F.lit(1))
    assert [r.completed for r in jobs.progress_marks(marks, "id", "g").orderBy("id").collect()] == [2, 4, 6, 8, 10, 12]
    assert jobs.progress_marks(marks.limit(5), "id", "g").count() == 0


def test_validation(spark):
    df = spark.createDataFrame([([],), ([1],), ([1] * 4,), (None,)], "items array<int>")
    assert [r[0] for r in df.select(jobs.valid_items(F.col("items"), 3)).collect()] == [False, True, False, False]
    assert [r[0] for r in spark.createDataFrame([(" ",), ("x",), (None,)], "p string").select(jobs.valid_text(F.col("p"))).collect()] == [False, True, False]


def test_retry_ends(spark):
    items = spark.createDataFrame([("a", 0), ("b", 2), ("c", 9)], "item string, needs int")
    got = {r.item: (r.ok, r.attempts) for r in jobs.retry(items, lambda df, n: df.withColumn("ok", F.col("needs") <= n)).collect()}
    assert got == {"a": (True, 1), "b": (True, 3), "c": (False, 4)}
    assert jobs.retry(items.limit(0), lambda df, n: df.withColumn("ok", F.lit(True))).count() == 0
