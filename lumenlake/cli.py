"""Commands: ``python -m lumenlake.cli search|embed|create …``. Encoders are named as ``module:function``, a function without arguments that makes one."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .session import session
from .sources import collections, frames, objects


def _encoder(name: str) -> Callable:
    """The maker of an encoder; ``hash:<dim>`` is the deterministic stand-in."""
    if name.startswith("hash:"):
        dim = int(name[5:])
        return lambda: frames.hash_encoder(dim)
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenlake", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="points nearest to a text, an image or the frames of a stored video")
    search.add_argument("--collection", required=True, help="parquet dataset of id, vector and payload")
    what = search.add_mutually_exclusive_group(required=True)
    what.add_argument("--text")
    what.add_argument("--image", help="file of the image")
    what.add_argument("--video", help="name of the video in --library")
    search.add_argument("--library", help="parquet dataset of id, vector, video, owner")
    search.add_argument("--owner")
    search.add_argument("--encoder", default="hash:512")
    search.add_argument("--top-k", "--limit", dest="top_k", type=int, default=api.DEFAULT_LIMIT)
    embed = commands.add_parser("embed", help="vectors of the frames of the given codes")
    embed.add_argument("codes", nargs="+")
    embed.add_argument("--frames", required=True, help="folder of <platform>/<code>/frames files")
    embed.add_argument("--out", required=True, help="parquet dataset to upsert")
    embed.add_argument("--encoder", default="hash:512")
    embed.add_argument("--batch-size", type=int, default=8)
    embed.add_argument("--dim", type=int)
    create = commands.add_parser("create", help="a collection from a JSON configuration")
    create.add_argument("config")
    return p


def search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    corpus = spark.read.parquet(a.collection)
    if a.text is not None:
        return api.search_text(corpus, a.text, _encoder(a.encoder)(), a.top_k)
    if a.image is not None:
        with open(a.image, "rb") as f:
            return api.search_vector(corpus, [float(x) for x in _encoder(a.encoder)()([f.read()])[0]], a.top_k)
    if not a.library:
        raise SystemExit("--video needs --library")
    return api.search_video_to_video(corpus, spark.read.parquet(a.library), a.video, a.owner, top=a.top_k)


def embed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Encodes the frames of the codes in batches of ``--batch-size`` rows and upserts their points; the number of points."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(a.batch_size))
    listing = objects.frame_files(spark, a.frames).where(F.col("code").isin(a.codes))
    points = api.ingest_frames(listing, _encoder(a.encoder), F.lit(""), a.dim).withColumnRenamed("uuid", "id").where("vector IS NOT NULL").withColumn("created_at", F.current_timestamp())
    collections.upsert(spark, a.out, points)
    return spark.read.parquet(a.out).where(F.col("code").isin(a.codes)).count()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(f"lumenlake {a.command}")
    if a.command == "search":
        for row in search(spark, a).collect():  # at most --top-k rows
            print(json.dumps(row.asDict(recursive=True), default=str))
    elif a.command == "embed":
        print(embed(spark, a))
    else:
        with open(a.config, encoding="utf-8") as f:
            print("created" if collections.create(spark, collections.parse_config(f.read())) else "exists already")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
