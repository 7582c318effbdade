"""Pages, counts, logs, profiles, checks of pixels and samples, commands."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lumenlake import api, cli
from lumenlake.functions import hashing
from lumenlake.operators import jobs, migrate, profiler, quality, relational, search
from lumenlake.sources import collections, frames


def test_pages_end(spark):
    p = spark.range(10).withColumn("vector", F.array(F.lit(1.0)))
    pages, after = [], None
    while rows := search.scroll(p, after, 4).collect():
        pages.append([r.id for r in rows])
        after = rows[-1].id
    assert pages == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_migration_counts_come_with_the_job(spark, sf):
    from lumenlake.plans.scalars import old_points

    points, seen = old_points(spark, sf), Observation("migration")
    n = migrate.observed_migration(points, F.lit("now"), seen).count()
    counts = migrate.migration_counts(points, F.lit("now")).first()
    assert seen.get == {"upserted": n, "skipped": counts.skipped} and counts.read == n + counts.skipped > n > 0
    assert tuple(migrate.migration_counts(points.limit(0), F.lit("now")).first()) == (0, 0, 0)


def test_zip_cuts_to_the_shorter(spark):
    df = spark.createDataFrame([(1, ["a", "b", None], [1.0, 2.0]), (2, [], [1.0]), (3, None, [1.0])], "id int, l array<string>, r array<double>")
    assert [tuple(r) for r in relational.zip_positions(df, "l", "r", "id").orderBy("id", "pos").collect()] == [(1, 0, "a", 1.0), (1, 1, "b", 2.0)]


def test_lexical_order(spark):
    df = spark.createDataFrame([("v", "2_a.png"), ("v", "10_a.png"), ("w", "1.png")], "video string, path string")
    assert {(r.path, r.position) for r in relational.lexical_positions(df, "path", "video").collect()} == {("10_a.png", 0), ("2_a.png", 1), ("1.png", 0)}
    with pytest.raises(ValueError):
        relational.lexical_positions(df, "path")


def test_backoff():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("down")
        return "up"

    assert jobs.with_backoff(call, 3, 1.0, 2.0, 3.0, sleep=waits.append) == "up" and waits == [1.0, 2.0, 3.0]
    with pytest.raises(OSError):
        jobs.with_backoff(lambda: (_ for _ in ()).throw(OSError()), 1, sleep=waits.append)
    with pytest.raises(KeyError):
        jobs.with_backoff(lambda: {}["x"], 1, sleep=waits.append)


def test_progress_needs_a_log(spark):
    with pytest.raises(ValueError):
        jobs.progress_deltas(spark.range(1).withColumn("line", F.lit("")), "id", "line", F.lit(1))


def test_profiler(spark, tmp_path):
    p = profiler.Profiler()

    @p.profile
    def good():
        return sum(range(1000))

    @p.profile
    def bad():
        raise ValueError

    good(), good()
    with pytest.raises(ValueError):
        bad()
    rows = {r.func.rsplit(".", 1)[-1]: r for r in relational.profile(p.frame(spark), "func", "sec").collect()}
    assert rows["good"].calls == 2 and rows["bad"].calls == 1 and rows["good"].total_sec >= 0
    assert [set(x) for x in json.loads(p.report())] == [{"func", "sec", "cpu", "ram"}] * 3
    collections.write_performance(p.frame(spark), str(tmp_path / "perf"))
    assert spark.read.json(str(tmp_path / "perf")).count() == 3
    assert profiler.Profiler().frame(spark).count() == 0


def test_log_lines(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01 10:00:00", "INFO", "m", 'say "hi"\n'), (None, "ERROR", None, "x")], "t string, level string, module string, msg string").withColumn("ts", F.to_timestamp("t"))
    collections.write_log(lines, str(tmp_path / "log"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted(got, key=len) == [{"level": "ERROR", "msg": "x"}, {"time": "2024-01-01T10:00:00", "level": "INFO", "module": "m", "msg": 'say "hi"\n'}]


def test_dark_frames_and_boxes(spark):
    df = spark.createDataFrame([([0, 0, 200, 0],), ([200, 200, 200, 200],), ([0, 0, 0, 0],), ([],)], "p array<int>")
    got = [(r.d, tuple(r.b) if r.b else None) for r in df.select(quality.dark_percent(F.col("p")).alias("d"), quality.content_box(F.col("p"), 2).alias("b")).collect()]
    assert got == [(75, (0, 1, 0, 1)), (0, (0, 0, 1, 1)), (100, None), (None, None)]


def test_volume(spark):
    df = spark.createDataFrame([("a", 32767), ("a", -32768), ("b", 0), ("b", None), ("c", 100), ("c", -100)], "t string, s int")
    got = {r.t: (r.n_samples, round(r.mean_volume, 1), round(r.max_volume, 1)) for r in quality.volume(df, "s", "t").collect()}
    assert got == {"a": (2, 0.0, 0.0), "b": (1, -91.0, -91.0), "c": (2, -50.3, -50.3)}
    assert {(r.t, r.db): r.n for r in quality.loudness_histogram(df, "s", "t").collect()} == {("a", 0): 2, ("b", 91): 1, ("c", 50): 2}
    assert quality.volume(df.limit(0), "s", "t").count() == 0


def test_similarity_of_frames(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (16, 20))
    b = np.clip(a + rng.integers(-30, 31, a.shape), 0, 255)
    df = spark.createDataFrame([(a.ravel().tolist(), a.ravel().tolist()), (a.ravel().tolist(), b.ravel().tolist())], "a array<int>, b array<int>")
    whole = [r[0] for r in df.select(quality.ssim(F.col("a"), F.col("b"))).collect()]
    x, y = a.astype(float), b.astype(float)
    cov = ((x - x.mean()) * (y - y.mean())).mean()
    want = (2 * x.mean() * y.mean() + quality.C1) * (2 * cov + quality.C2) / ((x.mean() ** 2 + y.mean() ** 2 + quality.C1) * (x.var() + y.var() + quality.C2))
    assert math.isclose(whole[0], 1.0) and math.isclose(whole[1], want)

    g = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    g2 = np.outer(g, g) / g.sum() ** 2
    padded = [np.pad(z, 5, mode="reflect") for z in (x, y, x * x, y * y, x * y)]
    total = 0.0
    for i in range(16):
        for j in range(20):
            mx, my, xx, yy, xy = ((p[i : i + 11, j : j + 11] * g2).sum() for p in padded)
            total += (2 * mx * my + quality.C1) * (2 * (xy - mx * my) + quality.C2) / ((mx * mx + my * my + quality.C1) * (xx - mx * mx + yy - my * my + quality.C2))
    assert math.isclose(frames.ssim(a, b), total / 320, rel_tol=1e-9) and math.isclose(frames.ssim(a, a), 1.0)


def test_hashers_are_pairs_of_functions(spark):
    df = spark.createDataFrame([([float(i * 7 % 13) for i in range(72)], [float(i * 5 % 11) for i in range(72)])], "a array<double>, b array<double>")
    for hasher in hashing.HASHERS.values():
        same, other = df.select(hasher.compare(hasher.compute(F.col("a")), hasher.compute(F.col("a"))), hasher.compare(hasher.compute(F.col("a")), hasher.compute(F.col("b")))).first()
        assert same == 0 and other > 0


def test_service_lists(spark):
    ev = spark.createDataFrame([("a", 1, "PENDING"), ("a", 2, "RUNNING"), ("b", 1, "pending"), ("c", 1, "RUNNING"), ("d", 3, "RUNNING"), ("e", 1, "completed")], "job_id string, t int, status string").select("job_id", F.timestamp_seconds("t").alias("ts"), "status", F.lit(None).cast("string").alias("log"))
    assert tuple(api.concurrency_stats(ev).first()) == (2, 1, 2, True, 0)
    assert tuple(api.concurrency_stats(ev.limit(0)).first()) == (2, 0, 0, False, 2)
    assert [r.job_id for r in api.jobs_list(ev, "running").collect()] == ["d", "a", "c"]
    assert api.config()["max_videos_per_request"] == 1000 and {r.log_tail is not None for r in api.job_status(ev).collect()} == {True}


def test_an_upsert_that_broke_off_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda *ids: spark.createDataFrame([(i, n) for i, n in ids], "id string, created_at int")
    collections.upsert(spark, path, rows(("a", 1), ("b", 1)))
    os.rename(path, f"{path}__old")  # as if the process ended between the two renames
    collections.upsert(spark, path, rows(("b", 2), ("c", 2)))
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert sorted(os.listdir(tmp_path)) == ["c"]


def test_a_failing_store_is_no_missing_checkpoint(spark):
    from lumenlake.streaming import loops

    with pytest.raises(Exception):
        loops.Checkpoint(spark, "nostore://x/y").show()


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from lumenlake import session

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(RuntimeError):
        session.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert session.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file:///")


def test_commands(spark, tmp_path, capsys, monkeypatch):
    folder = tmp_path / "frames" / "instagram" / "abc" / "frames"
    folder.mkdir(parents=True)
    for name in ("0_1.5.png", "1_2.5.png"):
        (folder / name).write_bytes(name.encode())
    monkeypatch.setattr(cli, "session", lambda app: spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cli.main(["embed", "abc", "none", "--frames", str(tmp_path / "frames"), "--out", str(tmp_path / "points"), "--encoder", "hash:8", "--dim", "8"]) == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert capsys.readouterr().out.strip() == "2"
    cli.main(["search", "--collection", str(tmp_path / "points"), "--image", str(folder / "0_1.5.png"), "--encoder", "hash:8", "--top-k", "1"])
    hit = json.loads(capsys.readouterr().out)
    assert hit["name"] == "0_1.5.png" and hit["score"] > 0.999
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"collection_name": "cli_points", "vector_params": {"size": 8, "distance": "Cosine"}}))
    cli.main(["create", str(config)])
    cli.main(["create", str(config)])
    assert capsys.readouterr().out.split("\n")[:2] == ["created", "exists already"]
    spark.sql("DROP TABLE cli_points")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["search", "--collection", "x"])
