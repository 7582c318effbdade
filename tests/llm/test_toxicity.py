"""Problem 10: exact neighbours against brute force, held-out accuracy on generated texts, defined edges."""

import random

import numpy as np
import pytest

from lumenlake.llm import toxicity as T

BAD = ["you are a worthless {0}", "go away, {0}, nobody wants you", "all {0}s should be locked up", "i will find you, {0}"]
SLURS = ["numpty", "dimwit", "wretch", "lowlife"]
GOOD = ["the {0} looks great in this light", "we filmed the {0} before sunrise", "which {0} is that", "more {0} videos please", "the old {0} kept us busy all evening", "someone stole the {0} from the set"]
THINGS = ["harbour", "bicycle", "bakery", "lens", "kettle", "dance", "street", "market"]


def text(rng, toxic):
    parts = [rng.choice(GOOD).format(rng.choice(THINGS)).capitalize() + "." for _ in range(rng.randint(0 if toxic else 1, 3))]
    if toxic:
        parts.insert(rng.randint(0, len(parts)), rng.choice(BAD).format(rng.choice(SLURS)).capitalize() + "!")
    return " ".join(parts)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["Comment", "ticket", None]), text(rng, i % 4 == 0), "clash") for i in range(900)]
    rows += [(5000, "comment", None, ""), (5001, "comment", "", ""), (5002, "comment", " \n", ""), (5003, "comment", "🙂🙂", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, score string")
    labels = []
    for i in range(0, 500):
        for _ in range(rng.choice([1, 1, 3])):
            labels.append((i, int((i % 4 == 0) != (rng.random() < 0.06))))
    return docs, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")


@pytest.mark.parametrize(
    "raw, want",
    [("you  IDIOT", "idiot"), ("you 1d10t!", "idiot"), ("i d i o t x", "idiotx"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("іdіоt", "idiot"), ("i\u200bd\u200bi\u200bo\u200bt", "idiot")],
)
def test_disguises_are_undone(raw, want):
    assert want in T.passages(raw)[0][1].replace(" ", "") if want == "idiotx" else want in T.passages(raw)[0][1].split()


def test_passages_of_edges():
    assert T.passages(None) == T.passages("") == T.passages(" \n 🙂 12:30 ") == []
    assert len(T.passages("One line here. " * 5000)) == 5000


def test_neighbours_are_exact(corpus):
    index = T.fit(*corpus)
    dense = np.zeros((len(index.texts), 1 << 12))
    used = {}
    for i, t in enumerate(index.texts):
        for term, w in zip(*index.vector(t), strict=True):
            dense[i, used.setdefault(int(term), len(used))] = w
    rng = random.Random(3)
    for _ in range(60):
        q = T.passages(text(rng, rng.random() < 0.5))[0][1]
        v = np.zeros(1 << 12)
        for term, w in zip(*index.vector(q), strict=True):
            if int(term) in used:
                v[used[int(term)]] = w
        s = dense @ v
        order = [i for i in np.lexsort((np.arange(len(s)), -np.round(s, 12))) if s[i] >= T.LEAST_SIMILARITY][: T.NEIGHBOURS]
        ids, sims = index.nearest([q])[0]
        assert np.allclose(sims, s[order]) and len(ids) == len(order)


def test_masked_words_find_their_word(corpus):
    index = T.fit(*corpus)
    assert index._unmasked("wˣˣˣˣh") == "wretch"


def test_held_out_accuracy_and_rates(corpus):
    docs, labels = corpus
    scored = T.score_documents(docs, T.fit(docs, labels))
    got = {r.doc_id: r for r in scored.collect()}
    held = [i for i in range(500, 900)]
    right = np.mean([(got[i].score >= T.THRESHOLD) == (i % 4 == 0) for i in held])
    assert right > 0.97
    assert all(got[i].score == 0 and got[i].passage is None for i in (5000, 5001, 5002, 5003))
    evidence = got[max(held, key=lambda i: got[i].score)]
    assert evidence.similarity > 0.5 and evidence.neighbour
    reported = {r.doc_id: tuple(r) for r in T.score_documents(docs, T.fit(docs, labels), T.THRESHOLD).collect()}
    assert reported == {i: tuple(r) for i, r in got.items() if r.score >= T.THRESHOLD}  # nothing is lost or changed by leaving early
    rates = {r.source: (r.n_documents, r.n_toxic) for r in T.source_rates(scored).collect()}
    assert set(rates) == {"comment", "ticket", "unknown"} and sum(n for n, _ in rates.values()) == docs.count()


def test_abuse_at_the_end_of_a_clean_run_on_passage_is_found(spark, corpus):
    index = T.fit(*corpus)
    clean = " ".join(g.format(x) for x in ("harbour", "kettle", "market") for g in GOOD[:5])
    texts = [clean, f"{clean} i will find you wretch", f"i will find you wretch {clean}"]
    assert T.run_on(texts[1]) == [] and index.vote(*index.nearest([T.passages(texts[1])[0][1]])[0]) < T.PRIOR  # the clean words hide it
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: r.score >= T.THRESHOLD for r in T.score_documents(docs, index).collect()}
    assert got == {0: False, 1: True, 2: True}


def test_most_blocks_are_skipped_and_the_neighbours_are_those_of_brute_force():
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(6000)]
    often = [words[int(rng.paretovariate(0.9)) % 400] for _ in range(4000)]
    subjects = [rng.sample(words, 12) for _ in range(900)]
    texts = list(dict.fromkeys(" ".join(rng.choice(often if rng.random() < 0.35 else s) for _ in range(rng.randint(5, 14))) for s in rng.choices(subjects, k=17_000)))[:16_000]
    assert len(texts) == 16_000
    frequencies = np.bincount(np.concatenate([list(set(T.terms(t))) for t in texts]), minlength=1 << T.BITS)
    index = T.Index(texts, np.log((1.0 + len(texts)) / (1.0 + frequencies)) + 1.0, np.ones(16_000), np.array([float(i % 20 == 0) for i in range(16_000)])).build()
    rows = [index.vector(t) for t in index.texts]
    columns = np.concatenate([t for t, _ in rows])
    owner, weights = np.repeat(np.arange(16_000), [len(t) for t, _ in rows]), np.concatenate([w for _, w in rows])
    index.read, queries = 0, [" ".join([*rng.sample(rng.choice(subjects), 5), *rng.sample(often, 2)]) for _ in range(150)] + rng.sample(texts, 50)
    for q in queries:
        v = np.zeros(1 << T.BITS)
        t, w = index.vector(q)
        v[t] = w
        brute = np.bincount(owner, weights * v[columns], 16_000)
        want = np.sort(brute[brute >= T.LEAST_SIMILARITY])[::-1][: T.NEIGHBOURS]
        ids, sims = index.nearest([q])[0]
        assert len(ids) == len(want) and np.allclose(sims, want) and np.allclose(brute[ids], sims)
    assert all(np.array_equal(a, b) for q, (a, _) in zip(queries, index.nearest(queries), strict=True) for b in [index.nearest([q])[0][0]])  # texts looked up together do not meet
    index.read //= 3
    assert index.read < 0.2 * index.blocks * len(queries), index.read / index.blocks / len(queries)
