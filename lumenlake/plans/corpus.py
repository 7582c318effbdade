"""Queries of the general data problems p1, p3, p4 and p7 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history, orphans, packed, skew
from ..session import table

#: Fields with one of these signs need the tokenizer.
_PACKED = r"""[\[\](){}"'“”‘’«»「」\\]"""

COUNTERS = ["like_count", "ig_play_count", "comment_count"]
LIST_FIELDS = ["coauthor_producers", "monitored_by"]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.references(table(spark, d, "extraction_errors"), "extraction_errors", "id", "insta_content_id", "occurred_at").unionByName(
        orphans.references(table(spark, d, "insta_content_snapshots"), "insta_content_snapshots", "snapshot_id", "id", "last_refreshed_at")
    )
    return orphans.orphans(refs, table(spark, d, "insta_content"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = packed.split_packed(table(spark, d, "insta_content"), "id", LIST_FIELDS, least=2)
    return out.withColumnRenamed("id", "insta_content_id")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(table(spark, d, "insta_content"), "id", LIST_FIELDS).withColumnRenamed("id", "insta_content_id")


def p3_simple_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the fields without quotes, escapes and brackets, which SQL can split too."""
    simple = table(spark, d, "insta_content").select("id", *(F.when(~F.col(c).rlike(_PACKED), F.col(c)).alias(c) for c in LIST_FIELDS))
    return packed.split_packed(simple, "id", LIST_FIELDS).withColumnRenamed("id", "insta_content_id")


def _refreshes(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "insta_content").select(F.col("id").alias("entity"), F.col("last_refreshed_at").alias("at"), F.col("updated_at").alias("stored_at"), *COUNTERS)
    snaps = table(spark, d, "insta_content_snapshots").select(F.col("id").alias("entity"), F.col("last_refreshed_at").alias("at"), F.col("recorded_at").alias("stored_at"), *COUNTERS)
    return posts.unionByName(snaps)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    starts = history.version_starts(_refreshes(spark, d), COUNTERS)
    return starts.select(F.col("entity").alias("insta_content_id"), F.unix_micros("valid_from").alias("valid_from_us"))


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    h = history.history(_refreshes(spark, d), COUNTERS)
    return h.select(
        F.col("entity").alias("insta_content_id"), "version", F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us"), *COUNTERS, "n_refreshes"
    )


def _account_join(spark: SparkSession, d: str, how: str = "inner") -> DataFrame:
    posts = skew.states(table(spark, d, "insta_content"), "user_id", {"like_count": F.col("like_count"), "comment_count": F.col("comment_count")}, "l_")
    snaps = skew.states(table(spark, d, "insta_content_snapshots"), "user_id", {"play_count": F.col("ig_play_count")}, "r_")
    return skew.eager_join(posts, snaps, how)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with at least 2 percent of all posts, from the joined states of posts and snapshots."""
    return skew.heavy_keys(_account_join(spark, d, "left"), "0.02", table(spark, d, "insta_content")).select(F.col("key").alias("user_id"))


def p7_account_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals per account over posts joined with snapshots, as the join of the raw rows would give them."""
    return _account_join(spark, d).select(
        F.col("key").alias("user_id"), F.col("l_n").alias("n_posts"), F.col("r_n").alias("n_snapshots"), "n_pairs", "pair_like_count", "pair_comment_count", "pair_play_count"
    )


def p7_username_totals(spark: SparkSession, d: str) -> DataFrame:
    """Posts and likes per account name, spellings united; rolled up from states per account and name."""
    posts = table(spark, d, "insta_content")
    per = posts.groupBy("user_id", skew.name_key(F.col("username")).alias("account_name")).agg(F.count("*").alias("n"), F.sum("like_count").alias("likes"))
    return per.groupBy("account_name").agg(F.sum("n").alias("n_posts"), F.sum("likes").alias("sum_likes"), F.count("user_id").alias("n_accounts"))


def p7_account_names(spark: SparkSession, d: str) -> DataFrame:
    """The name each account uses most, of the spellings united; ties go to the smaller name."""
    posts = table(spark, d, "insta_content").where(F.col("user_id").isNotNull())
    per = posts.groupBy("user_id", skew.name_key(F.col("username")).alias("account_name")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), F.col("account_name").asc_nulls_last())
    return per.withColumn("rk", F.row_number().over(w)).where("rk = 1").select("user_id", "account_name", "n")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_report, p3_found, p3_values, p3_simple_values, p4_found, p4_history, p7_found, p7_account_totals, p7_username_totals, p7_account_names)
}

_KEY = r"""CASE WHEN k = '' THEN NULL ELSE k END FROM (SELECT *, regexp_replace(translate(lower({0}), '{{}}()[]<>"- ' || chr(39) || chr(9) || chr(10) || chr(13), ''), '^(urn:)?(uuid:)', '') AS k"""

_ORPHANS = f"""
WITH parents AS (
  SELECT key, max_by(s, u) AS s FROM (
    SELECT lower(replace(id, '-', '')) AS key, updated_at AS u, {{{{'u': updated_at, 'r': is_removed, 'c': created_at}}}} AS s FROM insta_content WHERE id IS NOT NULL) GROUP BY key),
refs AS (
  SELECT 'extraction_errors' AS table_name, CAST(id AS BIGINT) AS row_id, occurred_at AS t, {_KEY.format('insta_content_id')} FROM extraction_errors) x
  UNION ALL
  SELECT 'insta_content_snapshots', snapshot_id, last_refreshed_at, {_KEY.format('id')} FROM insta_content_snapshots) x),
orphan AS (
  SELECT DISTINCT table_name, row_id, t, CASE WHEN p.key IS NULL THEN 'missing' WHEN s.r AND t > s.u THEN 'removed' WHEN s.c > t THEN 'early' END AS reason
  FROM (SELECT table_name, row_id, t, key FROM (SELECT * FROM refs) r(table_name, row_id, t, key) WHERE key IS NOT NULL) r LEFT JOIN parents p ON p.key = r.key)
""".replace("{{", "{").replace("}}", "}")

_REFRESHES = """
WITH rows_ AS (
  SELECT id, last_refreshed_at AS t, updated_at AS st, like_count, ig_play_count, comment_count FROM insta_content
  UNION ALL SELECT id, last_refreshed_at, recorded_at, like_count, ig_play_count, comment_count FROM insta_content_snapshots),
kept AS (
  SELECT * FROM rows_ WHERE id IS NOT NULL AND t IS NOT NULL AND NOT (like_count IS NULL AND ig_play_count IS NULL AND comment_count IS NULL)
  QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY st DESC NULLS LAST, like_count DESC NULLS LAST, ig_play_count DESC NULLS LAST, comment_count DESC NULLS LAST) = 1),
lagged AS (
  SELECT *, row_number() OVER w AS rn, lag(like_count) OVER w AS l1, lag(ig_play_count) OVER w AS l2, lag(comment_count) OVER w AS l3 FROM kept WINDOW w AS (PARTITION BY id ORDER BY t)),
marked AS (
  SELECT *, CASE WHEN rn = 1 OR l1 IS DISTINCT FROM like_count OR l2 IS DISTINCT FROM ig_play_count OR l3 IS DISTINCT FROM comment_count THEN 1 ELSE 0 END AS starts FROM lagged)
"""

_NAME = "nullif(regexp_replace(lower(trim(username)), '^@+', ''), '')"

ORACLE = {
    "p1_found": _ORPHANS + "SELECT DISTINCT table_name, row_id FROM orphan WHERE reason IS NOT NULL",
    "p1_report": _ORPHANS + "SELECT table_name, coalesce(strftime(t AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS month, reason, count(*) AS n_orphans FROM orphan WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_simple_values": """SELECT DISTINCT insta_content_id, field, CAST(row_number() OVER (PARTITION BY rid, field ORDER BY p) AS INT) AS pos, v AS val FROM (
  SELECT rid, insta_content_id, field, p, trim(parts[p], ' ' || chr(160) || chr(12288)) AS v FROM (
    SELECT rid, insta_content_id, field, parts, unnest(range(1, len(parts) + 1)) AS p FROM (
      SELECT rid, id AS insta_content_id, field, string_split_regex(packed, '[,;|/\\t\\n\\r،؛、，；｜／]') AS parts
      FROM (SELECT row_number() OVER () AS rid, id, unnest(['coauthor_producers', 'monitored_by']) AS field, unnest([coauthor_producers, monitored_by]) AS packed FROM insta_content)
      WHERE packed IS NOT NULL AND NOT regexp_matches(packed, '[][(){}"''“”‘’«»「」\\\\]')))) WHERE v <> ''""",
    "p4_found": _REFRESHES + "SELECT id AS insta_content_id, epoch_us(t) AS valid_from_us FROM marked WHERE starts = 1",
    "p4_history": _REFRESHES
    + """, islands AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY t) AS version FROM marked),
versions AS (SELECT id, version, min(t) AS vf, arg_min(like_count, t) AS a, any_value(like_count) AS like_count, any_value(ig_play_count) AS ig_play_count, any_value(comment_count) AS comment_count, count(*) AS n_refreshes FROM islands GROUP BY id, version)
SELECT id AS insta_content_id, CAST(version AS BIGINT) AS version, epoch_us(vf) AS valid_from_us, epoch_us(lead(vf) OVER (PARTITION BY id ORDER BY version)) AS valid_to_us, like_count, ig_play_count, comment_count, n_refreshes FROM versions""",
    "p7_found": "SELECT user_id FROM insta_content WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM insta_content)",
    "p7_account_totals": """SELECT p.user_id, count(DISTINCT p.rid) AS n_posts, count(DISTINCT s.rid) AS n_snapshots, CAST(count(*) AS DECIMAL(38,0)) AS n_pairs,
  CAST(sum(p.like_count) AS DECIMAL(38,0)) AS pair_like_count, CAST(sum(p.comment_count) AS DECIMAL(38,0)) AS pair_comment_count, CAST(sum(s.ig_play_count) AS DECIMAL(38,0)) AS pair_play_count
FROM (SELECT *, row_number() OVER () AS rid FROM insta_content) p JOIN (SELECT *, row_number() OVER () AS rid FROM insta_content_snapshots) s ON p.user_id = s.user_id GROUP BY p.user_id""",
    "p7_username_totals": f"SELECT {_NAME} AS account_name, count(*) AS n_posts, CAST(sum(like_count) AS BIGINT) AS sum_likes, count(DISTINCT user_id) AS n_accounts FROM insta_content GROUP BY 1",
    "p7_account_names": f"SELECT user_id, account_name, n FROM (SELECT user_id, {_NAME} AS account_name, count(*) AS n FROM insta_content WHERE user_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, account_name ASC NULLS LAST) = 1",
}
