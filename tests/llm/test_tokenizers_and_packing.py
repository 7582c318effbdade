"""Problems 8 and 9."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import packing as P
from lumenlake.llm import tokenizers as K

NAME = "byte_bpe_50k"


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.FOLDER}/{NAME}.json")
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


TEXTS = [None, "", " ", "a", "Hello world", "it's  they'll\n\n  x", "<|endoftext|> is text", "日本語のテキスト。", "🙂🙂", "a" * 700, "   " * 300, "word " * 400, "x1 y22 z333 " * 90, "'" * 500, "naïve café " * 80]


def test_ids_equal_the_other_library(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("i", F.lit(1))
    for chunk, overlap in [(K.CHUNK, K.OVERLAP), (120, 30), (64, 16)]:
        got = {r.doc_id: list(r.ids) for r in K.encode_corpus(df, NAME, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: reference(t) for i, t in enumerate(TEXTS)}
        counts = {r.doc_id: r.n_tokens for r in K.count_tokens(df, NAME, chunk=chunk, overlap=overlap).collect()}
        assert counts == {i: len(x) for i, x in got.items()}
    assert K.encode_corpus(df.limit(0), NAME).count() == 0


def test_long_texts_are_cut_into_pieces_that_add_up(spark):
    text = " ".join(f"token{i} and, more…" for i in range(400))
    df = spark.createDataFrame([(1, text), (2, "q" * 3000)], "doc_id long, text string")
    pieces = K._pieces(df, 500, 100).orderBy("doc_id", "i").collect()
    assert "".join(r.piece for r in pieces if r.doc_id == 1) == text and sum(r.doc_id == 1 for r in pieces) > 10
    assert [r.piece for r in pieces if r.doc_id == 2] == ["q" * 3000]  # no boundary in common: encoded whole


def test_cuts_at_every_position_beside_whitespace(spark):
    unit = "One.\n\nHello there \n you, \n\n\nit's  two\t\n 3\r\n\r\nend. "
    texts = ["a" * i + unit * 8 + "the end of it all, at last, in words" for i in range(len(unit))] + ["word\n\n" * 60, "." + "\n" * 400 + "x", "x \n" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: reference(t) for i, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in K.encode_corpus(df, NAME, chunk=100, overlap=40).collect()} == want
    assert {r.doc_id: r.n_tokens for r in K.count_tokens(df, NAME, chunk=100, overlap=40).collect()} == {i: len(x) for i, x in want.items()}
    pieces = K._pieces(df, 100, 40).groupBy("doc_id").count().collect()
    assert all(r["count"] == 5 for r in pieces if r.doc_id < len(unit))  # still cut


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "word " * 90), (1, "word " * 90), (1, "other " * 90), (None, "more " * 90), (2, "x"), (2, "x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), list(r.ids)) for r in K.encode_corpus(df, NAME, chunk=100, overlap=30).collect())
    assert got == sorted((str(r.doc_id), reference(r.text)) for r in df.collect())
    assert K.count_tokens(df, NAME, chunk=100, overlap=30).count() == 6


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = K.encode_corpus(df, NAME).select("doc_id", K.decoded(F.col("ids"), NAME).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_public_tokenizers(name):
    assert all(len(x) > 0 for x in K.encode(["some text", "más"], name)) and K.encode([None, ""], name) == [[], []]
    with pytest.raises(ValueError):
        K.encode(["x"], "no_such")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(0, 400)), max_size=40), st.sampled_from([64, 65, 100]))
def test_histogram_is_packed_completely(sizes, capacity):
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in sizes:
        counts[s] += n
    back = np.zeros_like(counts)
    for n, room, content in P.pack_histogram(counts, capacity):
        assert n > 0 and room >= 0 and room + sum(s * k for s, k in content) == capacity
        for s, k in content:
            back[s] += n * k
    assert (back == counts).all()


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    for capacity in (512, 2048):
        sizes = np.minimum(capacity, rng.lognormal(4.5, 1.2, 30_000).astype(int) + 1)
        groups = P.pack_histogram(np.bincount(sizes, minlength=capacity + 1), capacity)
        assert sizes.sum() / (sum(g[0] for g in groups) * capacity) > 0.985


def test_fitted_patterns_take_part():
    counts = np.zeros(513, np.int64)
    counts[[300, 212, 200, 156]] = [1000, 1000, 500, 1000]
    groups, left = P._fitted(counts, 512)
    assert sum(g[0] for g in groups) > 500 and left.sum() < counts.sum() / 2


@pytest.mark.parametrize("part_items", [P.PART_ITEMS, 4])
def test_every_document_is_packed_once(spark, part_items):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 60, 64, 65, 200, None, 7, 7, 7])) for i in range(600)]
    items = spark.createDataFrame([(p, i, n) for p in (1, 2) for i, n in rows], "pack_id int, doc_id long, n_tokens int")
    got = P.pack(items, {1: 64, 2: 100}, part_items).collect()
    for pack, capacity in ((1, 64), (2, 100)):
        mine = [r for r in got if r.pack_id == pack]
        total, fill, places = {}, {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            if r.n_tokens:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
                places.setdefault(r.container_id, []).append((r.offset, r.offset + r.n_tokens))
            else:
                assert r.container_id is None
        assert total == {i: n or 0 for i, n in rows} and max(fill.values()) <= capacity
        for spans in places.values():
            spans.sort()
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= capacity
        split = {r.doc_id for r in mine if r.piece > 0}
        assert split == {i for i, n in rows if n and n > capacity}
        assert len(fill) <= 1.25 * sum(fill.values()) / capacity + 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    packs = spark.createDataFrame([(1, NAME, 512)], "pack_id int, tokenizer string, capacity int")
    packed = P.pack_documents(docs, packs, K.count_tokens)
    assert packed.count() == 0 and P.fill_report(packed, packs).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(docs, packs.limit(0), K.count_tokens)
