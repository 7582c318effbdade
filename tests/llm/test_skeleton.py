"""Problem 2."""

import re
import unicodedata
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.llm import skeleton as S

SAME = [
    ("coffee", "\u0441\u043effee"),  # Cyrillic
    ("caf\u00e9", "cafe\u0301"),
    ("\uff21\uff22\uff23\u3000\uff11", "ABC 1"),
    ("\ufb01lm \ufb02ow", "film flow"),
    ("a\u00a0b", "a b"),
    ("a\u2007b\u202fc", "a b c"),
    ("har\u200bbo\u00adur\u200e", "harbour"),
    ("\uff8a\uff9e\uff7d", "\u30d0\u30b9"),  # half-width kana
    ("line\r\nend", "line\nend"),
    ("end  ", "end"),
    ("\u2764\ufe0f", "\u2764"),
    ("\u03bfne", "one"),  # Greek
    ("\u0451\u043b\u043a\u0430", "\u0435\u0308\u043b\u043a\u0430"),
    ("a\u200db", "ab"),
]
DIFFERENT = [("Coffee", "coffee"), ("cafe", "caf\u00e9"), ("10 frames", "11 frames"), ("a.", "a!"), ("👨\u200d👩\u200d👧", "👨👩👧"), ("one two", "two one"), ("l", "1"), ("O", "0"), ("a b", "ab"), ("²", "2"), ("…", "...")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert a != b and S.skeleton(a) == S.skeleton(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_look(a, b):
    assert S.skeleton(a) != S.skeleton(b)


def test_defined_edges():
    assert S.skeleton(None) is None and S.skeleton("") == "" and S.skeleton("  \n") == ""
    assert len(S.skeleton("Ж" * 200_000)) == 200_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable(text):
    once = S.skeleton(text)
    assert S.skeleton(once) == once or "" in once
    assert S.skeleton(unicodedata.normalize("NFD", text)) == S.skeleton(unicodedata.normalize("NFC", text)) or any(unicodedata.normalize("NFC", c) != c for c in text)


def brute(rows):
    out = set()
    for field in ("caption", "search_text"):
        for (i, a), (j, b) in combinations({(r["id"], r[field]) for r in rows if r["id"] and r[field] and S.skeleton(r[field])}, 2):
            if i != j and a != b and S.skeleton(a) == S.skeleton(b):
                out.add((field, *sorted((i, j))))
    return out


def test_pairs_against_brute_force(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + [None, "", " ", "love this", "love this", "lоve this"]
    rows = [{"id": f"i{n % 31:02}", "caption": t, "search_text": texts[-1 - n], "look": "clash", "form": 1} for n, t in enumerate(texts)] * 2
    rows.append({"id": None, "caption": "lоve thіs", "search_text": None, "look": "clash", "form": 1})
    df = spark.createDataFrame(rows, "id string, caption string, search_text string, look string, form int")
    got = [tuple(r) for r in S.look_alikes(df, "id", ["caption", "search_text"]).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))
    assert S.look_alikes(df.limit(0), "id", ["caption"]).count() == 0


def test_equal_strings_are_never_paired(spark):
    rows = [(f"i{n:05}", "love this") for n in range(3000)] + [("j1", "lоve this"), ("j2", "love thіs"), ("i00007", "lоve this")]
    df = S.look_alikes(spark.createDataFrame(rows, "id string, caption string"), "id", ["caption"])
    got = [(r.id_a, r.id_b) for r in df.collect()]
    want = {(i, j) for i, _ in rows[:3000] for j in ("j1", "j2")} | {tuple(sorted((i, "i00007"))) for i, _ in rows[:3000] if i != "i00007"} | {("j1", "j2")}
    assert set(got) == want and len(got) == len(want)
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and re.search(r"\bid_", x)]
    assert joins and all(re.search(r"(?<!NOT )\(form_\w+#\d+L? = form_\w+#\d+L?\)", x) for x in joins)  # ids meet only over one string of a pair


def test_consistent_and_classes(spark):
    df = spark.createDataFrame([("a", "соffее"), ("b", "coffee"), ("c", "coffee"), ("d", None), ("e", "👨\u200d👩\u200d👧")], "id string, caption string")
    got = {r.id: r.consistent for r in S.consistent(df, "id", ["caption"]).collect()}
    assert got == {"a": "coffee", "b": "coffee", "c": "coffee", "e": "👨\u200d👩\u200d👧"}
    assert sorted((r.n_rows, r.n_ids, r.n_forms, r.n_links) for r in S.look_classes(df, "id", ["caption"]).collect()) == [(1, 1, 1, 0), (3, 3, 2, 2)]


def test_links_and_members_of_classes(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + ["love this", "love this", "lоve this"]
    rows = [(f"i{n % 17:02}", t) for n, t in enumerate(texts * 2)] + [(None, "lоve thіs"), (None, "love this")]
    df = spark.createDataFrame(rows, "id string, caption string")
    pairs = S.look_alikes(df, "id", ["caption"]).count()
    assert sum(r.n_links for r in S.look_classes(df, "id", ["caption"]).collect()) >= pairs > 0  # an id pair may be linked in several classes
    one = spark.createDataFrame([(f"a{i}", "love this") for i in range(40)] + [("b", "lоve this"), ("c", "lоve this"), ("a1", "lоve this")], "id string, caption string")
    (r,) = S.look_classes(one, "id", ["caption"]).collect()
    assert (r.n_ids, r.n_forms, r.n_links) == (42, 2, S.look_alikes(one, "id", ["caption"]).count())
    assert S.look_members(one, "id", ["caption"]).count() == 43


def test_public_confusables_of_other_scripts():
    table = S.confusables()
    assert len(table) > 6000
    wanted = [(chr(c), p) for c, p in table.items() if len(p) == 1 and p.isascii() and p.isalpha() and p not in "lIO" and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(chr(c)) and not unicodedata.name(chr(c)).startswith("LATIN")]
    assert len(wanted) >= 200
    wrong = [(c, p) for c, p in wanted if S.skeleton(f"x{c}x") != f"x{p}x"]
    assert not wrong
    scripts = {unicodedata.name(c).split()[0] for c, _ in wanted}
    assert {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "CANADIAN"} <= scripts
    assert S.skeleton("ІӏІ") == "IiI" and S.skeleton("1l|I") == "1l|I" and S.skeleton("0Oо") == "0Oo" and S.skeleton("ı") == "i"


def test_many_equal_texts_and_one_look_alike(spark):
    import time

    rows = spark.range(64_000).selectExpr("concat('i', id) AS id", "'love this' AS caption").unionByName(spark.createDataFrame([("x", "lоve this")], "id string, caption string"))
    begun = time.time()
    assert S.look_alikes(rows, "id", ["caption"]).count() == 64_000
    assert time.time() - begun < 30  # with a pair of every two rows it would take minutes
