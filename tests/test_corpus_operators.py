"""Problems 1, 3, 4 and 7 on small fixtures, against brute force and with nulls, ties, repeated rows, empty tables and clashing columns."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.operators import history, orphans, packed, skew

U = "00000000-0000-0000-0000-00000000000"
T0 = datetime(2024, 1, 1)


def parents(spark, rows):
    return spark.createDataFrame(rows, "id string, updated_at timestamp, created_at timestamp, is_removed boolean, table_name string")


def day(n):
    return T0 + timedelta(days=n)


def refs(spark, rows):
    df = spark.createDataFrame(rows, "id int, insta_content_id string, occurred_at timestamp, reason string, parent string")
    return orphans.references(df, "e", "id", "insta_content_id", "occurred_at")


def test_orphans_of_every_kind(spark):
    p = parents(
        spark,
        [
            (U + "1", day(5), day(1), False, "x"),
            (U + "2", day(9), day(1), True, "x"),
            (U + "2", day(5), day(1), False, "x"),
            (U + "3", day(9), day(4), None, "x"),
            (None, day(9), day(4), None, "x"),
        ],
    )
    r = refs(
        spark,
        [
            (1, U + "1", day(6), "", ""),  # fine
            (2, "{" + (U + "1").upper() + "}", day(6), "", ""),  # fine in another notation
            (3, "urn:uuid:" + U + "9", day(6), "", ""),  # missing
            (4, None, day(6), "", ""),
            (5, "  ", day(6), "", ""),
            (6, "{ }", day(6), "", ""),
            (7, U + "2", day(10), "", ""),  # after the removal
            (8, U + "2", day(8), "", ""),  # before it
            (9, U + "3", day(2), "", ""),  # before the creation
            (10, U + "2", None, "", ""),  # without a time only absence counts
            (11, "no-uuid", None, "", ""),
            (11, "no-uuid", None, "", ""),  # repeated
            (12, (U + "1").replace("-", ""), day(6), "", ""),
        ],
    )
    got = {(x.row_id, x.reason) for x in orphans.orphans(r, p).collect()}
    assert got == {(3, "missing"), (7, "removed"), (9, "early"), (11, "missing")}
    report = {(x.month, x.reason, x.n_orphans) for x in orphans.orphan_report(orphans.orphans(r, p)).collect()}
    assert report == {("2024-01", "missing", 1), ("2024-01", "removed", 1), ("2024-01", "early", 1), ("unknown", "missing", 1)}


def test_orphans_of_empty_tables(spark):
    r = refs(spark, [(1, U + "1", day(6), "", "")])
    assert [x.reason for x in orphans.orphans(r, parents(spark, [])).collect()] == ["missing"]
    assert orphans.orphans(refs(spark, []), parents(spark, [(U + "1", day(5), day(1), False, "x")])).count() == 0


def test_filter_is_built_and_probed_in_the_plan(spark):
    r = refs(spark, [(1, U + "1", day(6), "", "")])
    plan = orphans.orphans(r, parents(spark, [(U + "1", day(5), day(1), False, "x")]))._jdf.queryExecution().toString()
    assert "might_contain" in plan and "bloom_filter_agg" in plan


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        (" [] ", []),
        ("a,b", ["a", "b"]),
        ("a; b|c/d\te\nf、g；h", list("abcdefgh")),
        ('"x, y";z', ["x, y", "z"]),
        ('["a", "b, c", "\\"d\\" e"]', ["a", "b, c", '"d" e']),
        ("['a, b', 'c']", ["a, b", "c"]),
        ('{p,"q; r",p}', ["p", "q; r", "p"]),
        ('"""Fast"" Lane",x', ['"Fast" Lane', "x"]),
        ("O'Dell crew|O'Dell crew", ["O'Dell crew", "O'Dell crew"]),
        ("a, , ,b,", ["a", "b"]),
        ("Rights & Claims; growth", ["Rights & Claims", "growth"]),
        ('a "b, c" d, e', ['a "b, c" d', "e"]),
        ("f(x, y), z", ["f(x, y)", "z"]),
        ("a\\,b,c", ["a,b", "c"]),
        ("open (never, closed", ["open (never", "closed"]),
        ('"unclosed, x', ['"unclosed', "x"]),
        ('["caf\\u00e9","\\ud83d\\ude00"]', ["café", "😀"]),
    ],
)
def test_tokenizer(text, want):
    assert packed.tokenize(text) == want


WORD = st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp", "Cf")), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=6))
def test_json_lists_round_trip(values):
    assert packed.tokenize(json.dumps(values)) == [v.strip() for v in values if v.strip()]


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD.filter(lambda w: "\\" not in w), min_size=1, max_size=6), st.sampled_from([",", ";", "|", "/", "\t", "\n"]))
def test_csv_quoting_round_trip(values, delimiter):
    text = delimiter.join('"' + v.replace('"', '""') + '"' for v in values)
    assert packed.tokenize(text) == values


def test_long_list_is_linear():
    assert len(packed.tokenize(",".join(["ab"] * 50_000))) == 50_000


def test_split_packed(spark):
    df = spark.createDataFrame([("p", "a,a|b", None, 1), ("p", "a,a|b", None, 1), ("q", "x", " ", 2), ("r", "[]", "y;z", 3)], "id string, one string, two string, pos int")
    got = sorted(tuple(r) for r in packed.split_packed(df, "id", ["one", "two"], least=2).collect())
    assert got == [("p", "one", 1, "a"), ("p", "one", 2, "a"), ("p", "one", 3, "b"), ("r", "two", 1, "y"), ("r", "two", 2, "z")]
    assert packed.split_packed(df.limit(0), "id", ["one", "two"]).count() == 0


def brute_history(rows):
    kept = {}
    for e, at, stored, a, b in rows:
        if e is None or at is None or (a is None and b is None):
            continue
        rank = (stored is not None, stored or T0, a is not None, a or 0, b is not None, b or 0)
        if (e, at) not in kept or rank > kept[e, at][0]:
            kept[e, at] = (rank, (a, b))
    per = defaultdict(list)
    for (e, at), (_, v) in sorted(kept.items()):
        if not per[e] or per[e][-1][1] != v:
            per[e].append([at, v, 1])
        else:
            per[e][-1][2] += 1
    return {(e, i + 1, x[0], (vs[i + 1][0] if i + 1 < len(vs) else None), *x[1], x[2]) for e, vs in per.items() for i, x in enumerate(vs)}


def test_history_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(900):
        e = rng.choice(["hot", "hot", "b", "c", None])
        at = None if rng.random() < 0.05 else T0 + timedelta(days=rng.randrange(60))
        stored = None if rng.random() < 0.1 else T0 + timedelta(hours=rng.randrange(40))
        rows.append((e, at, stored, rng.choice([None, 1, 1, 2]), rng.choice([None, 5, 5])))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "entity string, at timestamp, stored_at timestamp, a int, b int").withColumn("chunk", F.lit("clash")).withColumn("h", F.lit(0))
    want = brute_history(rows)
    assert {tuple(r) for r in history.history(df, ["a", "b"]).collect()} == want
    assert {tuple(r) for r in history.version_starts(df, ["a", "b"]).collect()} == {(e, vf) for e, _, vf, *_ in want}
    for most in (1, 3):  # chunks of more rows are cut further
        assert history._hot(df.where("entity IS NOT NULL").selectExpr("entity", "date_trunc('week', at) AS chunk"), most) is not None
        assert {tuple(r) for r in history.history(df, ["a", "b"], most=most).collect()} == want
        assert {tuple(r) for r in history.version_starts(df, ["a", "b"], most=most).collect()} == {(e, vf) for e, _, vf, *_ in want}
    assert history.history(df.limit(0), ["a", "b"]).count() == 0 and history.version_starts(df.limit(0), ["a", "b"]).count() == 0


def test_eager_join_equals_the_join_of_the_rows(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice(["h", "h", "h", "a", "b", None]), rng.choice([None, 1, 2]), "x") for _ in range(200)], "k string, v int, key string")
    right = spark.createDataFrame([(rng.choice(["h", "h", "a", "z", None]), rng.choice([None, 3, 4])) for _ in range(150)], "k string, w int")
    got = skew.eager_join(skew.states(left, "k", {"v": F.col("v")}, "l_"), skew.states(right, "k", {"w": F.col("w")}, "r_"))
    got = {r.key: (int(r.n_pairs), int(r.pair_v), int(r.pair_w)) for r in got.collect()}
    want = left.select("k", "v").join(right, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    assert got == {r.k: (r.n, r.v, r.w) for r in want.collect()}


def test_heavy_keys(spark):
    rows = [(k, 1) for k, n in (("a", 90), ("b", 2), ("c", 1)) for _ in range(n)] + [(None, 1)] * 8
    df = spark.createDataFrame(rows, "k string, v int")
    other = spark.createDataFrame([("a", 5)] * 7 + [("z", 5)] * 3, "k string, v int")
    joined = skew.eager_join(skew.states(df, "k", {}, "l_"), skew.states(other, "k", {}, "r_"), "left")
    heavy = skew.heavy_keys(joined, "0.02", df)  # of 101 rows, those without a key included, b has less than 2 percent
    assert {r.key for r in heavy.collect()} == {"a"}
    assert {r.key for r in skew.heavy_keys(joined, "0.02", df.where("k IS NOT NULL")).collect()} == {"a", "b"}
    assert skew.heavy_keys(skew.eager_join(skew.states(df.limit(0), "k", {}, "l_"), skew.states(other, "k", {}, "r_"), "left"), "0.02", df).count() == 0


def test_heavy_accounts_come_from_the_join_of_states(spark, sf):
    from lumenlake.plans import corpus

    plan = corpus.p7_found(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and plan.count("insta_content_snapshots") + plan.count("Relation") >= 2
    physical = corpus.p7_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in physical or "BroadcastHashJoin" in physical or "ShuffledHashJoin" in physical


@pytest.mark.parametrize("segment_bits, segments", [(1 << 26, 16), (60_000, 16), (60_000, 3)])
def test_filter_of_any_number_of_keys_has_few_false_positives(spark, segment_bits, segments):
    from lumenlake.functions.bloom import Filter

    keys = spark.range(20_000).select(F.encode(F.concat(F.lit("k"), "id"), "UTF-8").alias("k"))
    f = Filter(keys.union(keys.where("k IS NULL")), F.col("k"), 20_000, segment_bits, segments)
    assert (f.parts, len(f.rounds(F.col("k")))) == {(1 << 26, 16): (1, 1), (60_000, 16): (4, 1), (60_000, 3): (4, 2)}[segment_bits, segments]
    asked = spark.range(40_000).select("id", F.encode(F.concat(F.lit("k"), "id"), "UTF-8").alias("k")).union(spark.createDataFrame([(50_000, None)], "id long, k binary"))
    passed, proven = set(), set()
    for mine, maybe in f.rounds(F.col("k")):
        got = asked.where(mine).select("id", maybe.alias("m")).collect()
        passed |= {r.id for r in got if r.m}
        proven |= {r.id for r in got if not r.m}
    assert not passed & proven and len(passed | proven) == 40_001
    assert set(range(20_000)) <= passed and len(passed) < 20_000 + 0.05 * 20_000


def test_orphans_do_not_depend_on_the_filter_rounds(spark, monkeypatch):
    from lumenlake.functions import bloom

    p = parents(spark, [(f"00000000-0000-0000-0000-{i:012d}", day(5), day(1), i % 7 == 0, "x") for i in range(300)])
    r = refs(spark, [(i, f"00000000-0000-0000-0000-{i:012d}", day(6), "", "") for i in range(600)])
    want = {(x.row_id, x.reason) for x in orphans.orphans(r, p).collect()}
    assert want == {(i, "removed") for i in range(0, 300, 7)} | {(i, "missing") for i in range(300, 600)}
    monkeypatch.setattr(bloom.Filter.__init__, "__defaults__", (1024, 2))
    assert {(x.row_id, x.reason) for x in orphans.orphans(r, p).collect()} == want


def test_share_of_heavy_accounts_is_that_of_all_rows(spark, tmp_path):
    from lumenlake.plans import corpus

    users = ["a"] * 20 + ["b"] * 19 + [f"u{i}" for i in range(861)] + [None] * 100
    posts = spark.createDataFrame([(str(i), u, 1, 1) for i, u in enumerate(users)], "id string, user_id string, like_count long, comment_count long")
    posts.write.parquet(str(tmp_path / "insta_content.parquet"))
    spark.createDataFrame([("a", 1)], "user_id string, ig_play_count long").write.parquet(str(tmp_path / "insta_content_snapshots.parquet"))
    assert [r.user_id for r in corpus.p7_found(spark, str(tmp_path)).collect()] == ["a"]


def test_name_key(spark):
    df = spark.createDataFrame([(" @Ab.c ",), ("AB.C",), ("@",), (None,)], "n string")
    assert [r[0] for r in df.select(skew.name_key(F.col("n"))).collect()] == ["ab.c", "ab.c", None, None]
