"""Operator 11: spelling variants."""

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_op11(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(queries.QUERIES["op11_spelling_variants"](spark, SMALL))
    assert got == sorted(brute.spelling(docs), key=str)
    assert any(r[1] for r in got)


ODD = [
    (1, None),
    (2, ""),
    (3, "12 34 … 漢字"),
    (4, "Küstenweg küstenweg KÜSTENWEG küstenwegs × ÷ a×bcdefgh a×bcdefgh"),
    (None, "committee committe comittee committee"),
    (5, "committee " * 400 + "committe comittee " * 3 + "comitte commitee " * 2),
    (5, "committee " * 400 + "committe comittee " * 3 + "comitte commitee " * 2),
    (6, ("x" * 40_000 + " ") * 3 + ("x" * 39_999 + "y ") * 2),
    (7, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa abaaaaaa abaaaaaa"),
]


@pytest.mark.parametrize("hot", [spelling.HOT_ROWS, 2])
def test_edges_and_hot_keys(spark, monkeypatch, hot):
    """Missing, empty, long and repeated texts, clashing names; with a limit of 2 almost every key is cut into parts."""
    monkeypatch.setattr(spelling, "HOT_ROWS", hot)
    monkeypatch.setattr(spelling, "SHARE_ROWS", 8)
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS run", "3 AS id")
    got = rows(spelling.spelling_variants(docs, drop_every=31))
    assert got == sorted(brute.spelling(ODD), key=str)
    assert rows(spelling.spelling_variants(docs.filter("doc_id < 0"))) == []


def test_roots_follow_long_chains(spark):
    """Seven letters, one replaced at a time, each word ten times as frequent as the one before."""
    words = ["".join("b" if i < k else "a" for i in range(12)) for k in range(13)]
    table = spark.createDataFrame([(w, 2 * 10**k) for k, w in enumerate(words)], "word string, n bigint")
    got = {r.word: r for r in spelling.group_variants(table).collect()}
    assert {r.root for r in got.values()} == {words[-1]}
    assert [got[w].form for w in words] == words[1:] + [None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=3), min_size=1, max_size=90, unique=True), st.text("abcd", min_size=2, max_size=3))
def test_sliced_index(words, query):
    index = spelling.SlicedIndex(spelling._codes(words))
    found = {words[w] for _, part in index.search(spelling._codes([query])) for w in part.tolist()}
    if len(query) == 3:
        want = {w for w in words if sum(a != b for a, b in zip(w, query)) == 1}
    else:
        want = {w for w in words if any(w[:i] + w[i + 1 :] == query for i in range(3))}
    assert found == want


def test_index_in_chunks(monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 1)
    rng = np.random.default_rng(3)
    codes = rng.integers(97, 99, (100, 8)).astype("<u4")
    got = {(q, w) for a, b in spelling.SlicedIndex(codes).search(codes) for q, w in zip(a.tolist(), b.tolist())}
    differ = (codes[:, None] != codes[None]).sum(2)
    assert got == set(map(tuple, np.argwhere(differ == 1).tolist()))
