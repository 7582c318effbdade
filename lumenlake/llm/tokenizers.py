"""Encoding of the whole corpus with a public tokenizer (problem 8): overlapping chunk encoding.

Short texts are encoded in Arrow batches. A long text is cut into overlapping chunks that are
pre-tokenised in parallel; neighbouring chunks are stitched where their pre-token boundaries
resynchronise in the overlap, and the pieces between stitches are encoded in parallel too.
A boundary that both chunks share is a true one, because a pre-token depends only on the text
from its start on. Texts are cut only behind a character that is no whitespace, because the pre-tokens of
a run of whitespace depend on what follows it. A text without such a common boundary in some overlap is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files; a parameter of every operator here.
FOLDER = "/opt/tokenizers"

#: Longest text, in characters, that one task encodes in one go, and the overlap of the chunks of longer ones.
CHUNK, OVERLAP = 50_000, 2_000

# Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def _ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def _encoder(name: str, folder: str) -> tuple[Callable[[list[str]], list[list[int]]], bool]:
    """A function that encodes a list of texts without special tokens, and whether pieces of a text can be encoded apart."""
    if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        import tiktoken

        own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(name, folder), special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts], True
    if os.path.exists(path := os.path.join(folder, f"{name}.json")):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], False
    if os.path.exists(path := os.path.join(folder, f"{name}.model")):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1), False
    raise ValueError(f"no tokenizer {name!r} in {folder}")


def _sane(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def encode(texts: list[str | None], name: str, folder: str = FOLDER) -> list[list[int]]:
    """Ids of each text; null and empty texts have the empty list."""
    return _encoder(name, folder)[0]([_sane(t) if t else "" for t in texts])


def decode(ids: list[int], name: str, folder: str = FOLDER) -> str:
    """The text of ``ids`` of a byte-level vocabulary: the tokens' raw bytes, concatenated."""
    table = _bytes(name, folder)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def _bytes(name: str, folder: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(name, folder).items()}


def _encode_udf(name: str, folder: str):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encode(list(batch), name, folder), dtype=object)

    return udf


def _count_udf(name: str, folder: str):
    @F.pandas_udf(T.IntegerType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(x) for x in encode(list(batch), name, folder)], dtype="int32")

    return udf


def boundaries(text: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk, without those behind whitespace, as a piece that ends there would be pre-tokenised otherwise than in its text.

    Unless it is the text's last chunk, those are left out that the missing rest could still move. What lies before the chunk is not known here, so its own start stays; the chunk before it tells.
    """
    import regex

    starts = [s for m in regex.finditer(PATTERN, text) if not (s := m.start()) or not regex.match(r"\s", text[s - 1])]
    return starts if last else [s for s in starts if s <= len(text) - 4]


@F.pandas_udf(T.StructType([T.StructField("head", T.ArrayType(T.LongType())), T.StructField("tail", T.ArrayType(T.LongType()))]))
def _edges(index: pd.Series, last: pd.Series, text: pd.Series, chunk: pd.Series, overlap: pd.Series) -> pd.DataFrame:
    head, tail = [], []
    for i, final, t, c, o in zip(index, last, text, chunk, overlap, strict=True):
        b = boundaries(t, final)
        head.append([i * c + x for x in b if x < o])
        tail.append([i * c + x for x in b if x >= c])
    return pd.DataFrame({"head": head, "tail": tail})


def _pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``row, doc_id, i, piece`` of the long texts of ``docs``: consecutive pieces that begin and end at true pre-token boundaries.

    ``row`` tells apart repeated rows: it numbers the copies of a row, and rows that are equal may swap numbers.
    """
    same = Window.partitionBy("doc_id", "hash").orderBy("hash")
    docs = docs.withColumn("hash", F.md5("text")).withColumn("row", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "hash", F.row_number().over(same))).drop("hash")
    n = F.ceil(F.length("text") / chunk).cast("int")
    cut = docs.select("row", "doc_id", "text", n.alias("n")).select("row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)))).alias("i", "part"), "n")
    cut = cut.repartition("row", "i")  # the chunks of one text are spread over the cluster
    edges = cut.select("row", "i", "n", _edges(F.col("i"), F.col("i") == F.col("n") - 1, F.col("part"), F.lit(chunk), F.lit(overlap)).alias("e"))
    w = Window.partitionBy("row").orderBy("i")
    common = F.array_min(F.array_intersect(F.lag("e.tail").over(w), F.col("e.head")))
    # Only boundaries, not texts, are ordered per document.
    stitches = edges.select("row", "i", F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(common).alias("start"))
    whole = F.count_if(F.col("start").isNull()).over(Window.partitionBy("row")) > 0
    plan = stitches.select("row", "i", "start", F.lead("start").over(w).alias("end"), whole.alias("whole"))
    apart = cut.join(plan.where("NOT whole").select("row", "i", "start", "end"), ["row", "i"])
    offset = F.col("start") - F.col("i").cast("long") * chunk
    length = F.coalesce(F.col("end") - F.col("start"), F.length("part").cast("long"))
    pieces = apart.select("row", "doc_id", "i", F.substring(F.col("part"), (offset + 1).cast("int"), length.cast("int")).alias("piece"))
    unsynced = plan.where("whole").select("row").distinct()
    return pieces.unionByName(docs.join(unsynced, "row").select("row", "doc_id", F.lit(0).alias("i"), F.col("text").alias("piece")))


def _parts(df: DataFrame, doc_id: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return slim.where(~is_long), slim.where(is_long)


def encode_corpus(df: DataFrame, name: str, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids``: the ids of every text, without special tokens; null and empty texts have the empty list.

    Texts of any length are encoded whole. Repeated rows and repeated or null ids give a row each. Other columns are dropped. An empty table gives no rows.
    """
    short, long = _parts(df, doc_id, text, chunk)
    out = short.select("doc_id", _encode_udf(name, folder)("text").alias("ids"))
    if not os.path.exists(os.path.join(folder, f"{name}.tiktoken")):  # pieces of other kinds of vocabulary cannot be encoded apart
        return out.unionByName(long.select("doc_id", _encode_udf(name, folder)("text").alias("ids")))
    pieces = _pieces(long, chunk, overlap).select("row", "doc_id", "i", _encode_udf(name, folder)("piece").alias("ids"))
    whole = pieces.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("s")).select("doc_id", F.flatten(F.col("s.ids")).alias("ids"))
    return out.unionByName(whole)


def count_tokens(df: DataFrame, name: str, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens`` of every text; like :func:`encode_corpus`, but the ids themselves never leave the Python workers."""
    short, long = _parts(df, doc_id, text, chunk)
    out = short.select("doc_id", _count_udf(name, folder)("text").alias("n_tokens"))
    if not os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        return out.unionByName(long.select("doc_id", _count_udf(name, folder)("text").alias("n_tokens")))
    pieces = _pieces(long, chunk, overlap).select("row", "doc_id", _count_udf(name, folder)("piece").alias("n"))
    return out.unionByName(pieces.groupBy("row", "doc_id").agg(F.sum("n").cast("int").alias("n_tokens")).select("doc_id", "n_tokens"))


def decoded(ids: Column, name: str, folder: str = FOLDER) -> Column:
    """The text of a column of ids of a byte-level vocabulary."""

    @F.pandas_udf(T.StringType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else decode(list(x), name, folder) for x in batch], dtype=object)

    return udf(ids)
