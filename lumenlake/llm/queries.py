"""Queries of the text problems over the project's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import langid, names, packing, pii, skeleton, tokenizers, toxicity
from .sql import ORACLE  # noqa: F401

FIELDS = ["caption", "search_text"]
VOCABULARY = "byte_bpe_50k"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alikes(table(spark, d, "insta_content"), "id", FIELDS)


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.consistent(table(spark, d, "insta_content"), "id", FIELDS).withColumnRenamed("id", "insta_content_id")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_classes(table(spark, d, "insta_content"), "id", FIELDS)


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_members(table(spark, d, "insta_content"), "id", FIELDS).withColumnRenamed("id", "insta_content_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizers.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), VOCABULARY)


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their number of tokens and whether decoding gives the text back."""
    docs = table(spark, d, "documents")
    ids = tokenizers.encode_corpus(docs, VOCABULARY).select("doc_id", F.size("ids").alias("n_tokens"), tokenizers.decoded(F.col("ids"), VOCABULARY).alias("decoded"))
    joined = docs.select("doc_id", "text").join(ids, "doc_id")
    return joined.select("doc_id", "n_tokens", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The hash of what each document's ids decode to."""
    ids = tokenizers.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), VOCABULARY)
    return ids.select("doc_id", F.md5(tokenizers.decoded(F.col("ids"), VOCABULARY)).alias("text_hash"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "pack_capacities"), tokenizers.count_tokens)


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), table(spark, d, "pack_capacities"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per pack: documents and how many of them lost or gained tokens, containers over capacity, pieces that overlap."""
    return packing.checks(_packed(spark, d), table(spark, d, "pack_capacities"), table(spark, d, "documents").select("doc_id", "text"), tokenizers.count_tokens)


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "insta_content").select("id", F.col("caption").alias("text")).where("text IS NOT NULL AND id IS NOT NULL"))


def _caption_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "caption_labels").select(F.col("insta_content_id").alias("id"), F.col("lang").alias("label"))


def _segments(spark: SparkSession, d: str, positions: bool = False) -> DataFrame:
    captions = _captions(spark, d)
    return langid.segments(captions, langid.fit(captions, _caption_labels(spark, d)), positions=positions)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = langid.mislabelled(langid.text_languages(_segments(spark, d)), _caption_labels(spark, d))
    return wrong.select(F.col("id").alias("insta_content_id"), "lang")


def p6_captions(spark: SparkSession, d: str) -> DataFrame:
    return langid.text_languages(_segments(spark, d)).withColumnRenamed("id", "insta_content_id")


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Posts with a caption that have a language or a row that says that there is none, and those with a confidence."""
    rows = p6_captions(spark, d)
    return rows.agg(F.count_distinct("insta_content_id").alias("n_posts"), F.count_distinct(F.when(F.col("confidence").between(0, 1), F.col("insta_content_id"))).alias("n_confident"))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d, True).withColumnRenamed("id", "insta_content_id").distinct()


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "insta_content").select("id", "caption").where("id IS NOT NULL"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    posts = _posts(spark, d)
    found = pii.found(posts, "id", "caption", names.learn(posts, "caption"))
    return found.select(F.col("id").alias("insta_content_id"), "pii_type").distinct()


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    posts = _posts(spark, d)
    return pii.found(posts, "id", "caption", names.learn(posts, "caption")).withColumnRenamed("id", "insta_content_id").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "insta_content").select("id", "caption")
    return posts.select(F.col("id").alias("insta_content_id"), pii.redacted(posts, "caption", names.learn(posts, "caption")).alias("caption")).distinct()


def _scored(spark: SparkSession, d: str, least: float | None = None) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, d, "document_labels")), least)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, toxicity.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source in the report of rates."""
    return toxicity.source_rates(_scored(spark, d)).select("source", "n_documents")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(_scored(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_consistent, p2_classes, p2_members, p5_found, p5_spans, p5_redacted, p6_found, p6_captions, p6_coverage, p6_segments, p8_ids, p8_decoded, p8_round_trip, p9_pack, p9_checks, p9_fill, p10_found, p10_scores, p10_rates, p10_sources)
}
