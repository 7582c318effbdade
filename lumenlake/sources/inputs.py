"""Job inputs, queue records, CSV reports and relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<platform:string,code:string,shortcode:string,frame_interval:double>"


def job_items(df: DataFrame, body: str) -> DataFrame:
    """``platform, code`` of a JSON array of items; bodies that are no JSON give no rows."""
    return df.select(F.inline(F.from_json(F.col(body), "array<struct<platform:string,code:string>>")))


def queue_items(df: DataFrame, body: str = "body") -> DataFrame:
    """``platform, code, frame_interval`` of queue records; the key is ``code`` or ``shortcode``. Records without either are dropped."""
    item = df.select(F.from_json(F.col(body), ITEM).alias("i"))
    return item.select("i.platform", F.coalesce("i.code", "i.shortcode").alias("code"), "i.frame_interval").where("code IS NOT NULL")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """CSV report with the header ``platform,shortcode``."""
    return spark.read.schema("platform string, shortcode string").option("header", "true").csv(path)


def read_jdbc(spark: SparkSession, url: str, dbtable: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A relational table, read in parallel over a numeric key if its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def pending(df: DataFrame, flag: str, order: str | list[str], n: int) -> DataFrame:
    """The first ``n`` rows whose flag is false; null flags are not false."""
    return df.where(F.col(flag) == F.lit(False)).orderBy(order).limit(n)


def codes(df: DataFrame, code: Column) -> DataFrame:
    return df.select(code.alias("code")).where("code IS NOT NULL").distinct()


def job_input(df: DataFrame, code: str, platform: str = "instagram") -> DataFrame:
    return df.select(F.struct(F.lit(platform).alias("platform"), F.col(code).alias("code")).alias("item"))
