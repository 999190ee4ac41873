"""The registered queries against plain versions of their rules, over whole small tables."""

import base64
import hashlib
import math
import textwrap
import zlib
from collections import Counter, defaultdict

import brute
import pytest

from tallyframe.llm import jaccard, licenses, lm_score, queries, sharding

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, SMALL).select(*columns).collect())


def test_one_query_per_operator():
    assert {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_op1(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(spark, "op1_decontaminate", *columns) == sorted(brute.decontaminate(docs, items))


def test_op2(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()
    first, want = {}, []
    for page, html in sorted(pages):
        b = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        old = first.setdefault(b, page)
        want.append((page, len(b), digest, "response" if old == page else "revisit", None if old == page else old))
    got = rows(spark, "op2_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(want)


def test_op4(spark, docs):
    assert rows(spark, "op4_jaccard_join", "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs))


def test_op4_long_lists(spark, docs, monkeypatch):
    """Stars, derived answers and blocks, by calling almost every list long."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    words = [f"w{i}" for i in range(60)]
    near = [(1000 + i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :] + ["tail"] * (i % 3))) for i in range(0, 60, 3)]
    near += [(2000 + i, " ".join(words[:i] + [f"x{i}", f"y{i}"] + words[i + 2 :])) for i in range(0, 58, 7)]
    both = docs + near
    df = spark.createDataFrame(both, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in jaccard.link_documents(df).collect())
    assert got == sorted(brute.jaccard(both))


def test_op6(spark, docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(spark, "op6_quality_ledger", *columns) == sorted(brute.quality(docs))


def test_op6_keeps_good_documents(spark):
    kept = dict(rows(spark, "op6_quality_ledger", "doc_id", "kept"))
    base = dict(rows(spark, "op6_quality_ledger", "doc_id", "base_failed"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()
    good = [d for d, q in labels if q == 1 and d in kept and not base[d]]
    bad = [d for d, q in labels if q == 0 and d in kept]
    assert sum(kept[d] for d in good) >= 0.98 * len(good)
    assert sum(not kept[d] for d in bad) >= 0.9 * len(bad)


def test_op7(spark, docs):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(spark, "op7_run_length_repeats", *columns) == sorted(brute.repeats(docs))


def test_op8(spark, docs):
    got = rows(spark, "op8_rendezvous_shards", "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
    assert [(d, n, c) for d, n, c, *_ in got] == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs)
    slots = defaultdict(list)
    for _, _, _, shard, slot, grown in got:
        slots[shard].append(slot)
        assert grown in (shard, 8)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8_weights(spark):
    got = sharding.assign_shards(spark.range(20_000).selectExpr("id AS doc_id", "'' AS text"), [1.0, 3.0, 0.0])
    n = Counter(r[0] for r in got.select("shard").collect())
    assert n[2] == 0 and abs(n[1] / n[0] - 3) < 0.2


def test_op5(spark):
    # The smallest tables hold no secret, so there is nothing to learn from.
    found = queries.QUERIES["op5_secret_scan"](spark, "/root/testdata/sf0.01").select("value", "is_secret").collect()
    planted = [len(v) == 40 and set(v.lower()) <= set("0123456789abcdef") for v, _ in found]
    assert any(planted) and sum(s == p for (_, s), p in zip(found, planted)) >= 0.95 * len(found)


def test_op9(spark, docs):
    got = {r[0]: r[1:] for r in rows(spark, "op9_license_scan", "doc_id", "n_exact", "licenses")}
    short = {t: n for n, t in licenses.TEMPLATES if len(t) < 100}
    for doc, text in docs:
        lines = [short[x] for x in text.split("\n") if x in short]
        assert set(lines) <= set(got[doc][1].split(",")), doc
        assert lines or not got[doc][0], doc


def test_op9_changed_wording():
    found = licenses.scan_text(
        licenses.Templates(),
        b"text\nThis work is licensed under the GNU General Public Licence, version 3.\nmore text here\n",
    )
    assert [(f["license"], f["missing"], f["added"]) for f in found] == [("GPL-3.0", 1, 1)]
    assert licenses.scan_text(licenses.Templates(), b"a driving licence is not a wording of any kind here") == []


def test_op9_names_the_right_version():
    known = licenses.Templates()
    named = lambda text: [f["license"] for f in licenses.scan_text(known, text.encode())]
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for kind, number, want in (
        ("General", "2", ["GPL-2.0"]), ("General", "3", ["GPL-3.0"]), ("Affero General", "3", ["AGPL-3.0"]),
        ("Lesser General", "2.1", ["LGPL-2.1"]), ("Lesser General", "3", ["LGPL-3.0"]), ("General", "4", []), ("Affero General", "2", []),
    ):
        assert named("int x;\n" + gnu.format(kind, number) + "\nint y;") == want, (kind, number)
    for text, want in {
        "GNU General Public License, version 2.": ["GPL-2.0"],
        "under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"],
        "under the GNU Library General Public License, version 2.": ["LGPL-2.0"],
        "// SPDX-License-Identifier: MIT\n": ["MIT"],
        "# SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"],
        "SPDX-License-Identifier: CC-BY-ND-4.0": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "Licensed under CC BY-NC-ND 4.0.": [],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"],
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.": ["ISC"],
    }.items():
        assert named(text) == want, text


def test_op9_exact_notices_against_a_plain_search(spark):
    """Word for word, every template in every document: what the scan calls exact, without stretches inside longer ones."""
    known = licenses.Templates()
    want = {}
    for doc, text in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        words, places = licenses.words_of((text or "").encode()), set()
        for name, own in zip(known.names, known.words):
            places |= {(i, i + len(own), name) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own}
        inside = {p for p in places for q in places if p != q and q[0] <= p[0] and p[1] <= q[1] and p[1] - p[0] < q[1] - q[0]}
        want[doc] = (len(places - inside), sorted({n for *_, n in places - inside}))
    found = queries.QUERIES["op9_license_scan"](spark, "/root/testdata/sf0.01").select("doc_id", "n_exact", "licenses").collect()
    for doc, n_exact, names in found:
        assert n_exact == want[doc][0] and set(want[doc][1]) <= set(names.split(",")), doc
    assert sum(n for n, _ in want.values()) > 20


def test_op9_wrapped_and_several():
    known = licenses.Templates()
    named = lambda text: [(f["license"], f["missing"], f["added"]) for f in licenses.scan_text(known, text.encode())]
    for name, text in licenses.TEMPLATES:
        for width in (12, 40, 80):
            lines = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
            assert named("code = 1\n" + "".join(f" * {x}\n" for x in lines) + "int main() {}") == [(name, 0, 0)]
    short = [(n, t) for n, t in licenses.TEMPLATES if len(t) < 100]
    for join in ("\n", " "):
        assert named(join.join(t for _, t in short)) == [(n, 0, 0) for n, _ in short]
    many = "All rights reserved. " * 300
    assert named(many) == [("all-rights-reserved", 0, 0)] * 300


def test_op10(spark, docs):
    got = {r[0]: r[1:] for r in rows(spark, "op10_cross_entropy_difference", "doc_id", "n_tokens", "loss_target", "loss_background", "score")}
    target = {r[0] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id").collect()}
    for doc, n, *losses in brute.cross_entropy(docs, target, lm_score.fold_of, lm_score.PRIOR):
        assert got[doc][0] == n and got[doc][1:] == pytest.approx(losses, abs=1e-7)


def test_op10_every_word_counts(spark):
    """More words than 16 bits number, counts that do not fit a byte, frequent words, rows without key or label."""
    table = [(i, " ".join(f"w{(i * 7919 + j * j) % 90_000}" + " the" * (j % 3 == 0) for j in range(1500))) for i in range(90)]
    table += [(1000, "ha " * 1000 + "ho"), (1001, "ha " * 700 + "the"), (1002, "the"), (None, "ha the"), (None, "ha the w1")]
    target = {i for i in range(0, 90, 3)} | {1000, 1002}
    labels = spark.createDataFrame([(i, int(i in target)) for i, _ in table if i is not None], "doc_id bigint, quality int")
    scored = lm_score.cross_entropy_difference(spark.createDataFrame(table, "doc_id bigint, text string").repartition(5), labels)
    got = sorted((tuple(r) for r in scored.collect()), key=str)
    want = sorted(brute.cross_entropy(table, target, lm_score.fold_of, lm_score.PRIOR), key=str)
    assert len({w for _, t in table for w in t.split()}) > 65_536
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-7)
