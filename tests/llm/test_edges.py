"""Missing values, empty and long texts, repeated rows, empty tables and clashing column names, for each operator."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import decontaminate, jaccard, licenses, lm_score, mixing, quality, repeats, secrets, sharding, warc

LONG = " ".join(f"long{i % 977}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest at night"
ROWS = [
    (1, PASSAGE, "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "   \n\t ", "b"),
    (5, PASSAGE, "b"),
    (5, PASSAGE, "b"),
    (6, PASSAGE.upper() + " again", None),
    (None, PASSAGE, "c"),
    (7, LONG, "c"),
    (8, LONG + " end", "c"),
    (9, "\x00 control \x0b and ünïcödé … 漢字", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    # Names that the operators use themselves.
    return base.selectExpr("*", "'x' AS size", "1 AS shard", "2 AS n_words", "3 AS chunk", "4 AS failures", "5 AS id")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, PASSAGE), (2, None), (3, "control and"), (None, "lazy dog"), (3, "control and")], "item_id bigint, text string"
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (7, 0), (None, 1), (5, None)], "doc_id bigint, quality int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_decontaminate(spark, docs, empty, items):
    got = rows(decontaminate.decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items"))
    plain = [(1, PASSAGE), (2, None), (3, "control and"), ("", "lazy dog")]
    want = brute.decontaminate([r[:2] for r in ROWS], plain)
    assert got == sorted((w[:4] for w in want), key=str)
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert rows(decontaminate.decontaminate(docs, items.limit(0)).select("n_hit").distinct()) == [(0,)]
    blocks = decontaminate.decontaminate(docs, items, block_words=1).select("doc_id", "n_words", "n_hit", "n_items")
    assert rows(blocks) == got


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "a b c x d e f g h i j"), (2, "a b c d e f g h i j"), (3, "j i h g f e d c b a z z z z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = rows(decontaminate.decontaminate(docs, items).select("doc_id", "n_items", "n_near_items"))
    assert got == [(1, 0, 1), (2, 1, 1), (3, 0, 0)]


def test_warc(spark, docs, empty):
    pages = docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "'x' AS record_type", "'y' AS __url")
    for split in (16_000_000, 200):
        got = rows(warc.archive_round_trip(pages.drop("__url"), split_bytes=split).select("page_id", "payload_bytes", "record_type", "refers_to"))
        n = lambda s: len((s or "").encode())
        assert sorted(got, key=str) == sorted(
            [
                (1, n(PASSAGE), "response", None),
                (5, n(PASSAGE), "revisit", 1),
                (5, n(PASSAGE), "revisit", 1),
                (None, n(PASSAGE), "revisit", 1),
                (2, 0, "response", None),
                (3, 0, "revisit", 2),
                *[(k, n(t), "response", None) for k, t, _ in ROWS if k in (4, 6, 7, 8, 9)],
            ],
            key=str,
        )
    least = warc.archive_round_trip(pages, least=1).filter("payload_bytes = 0")
    assert rows(least.select("page_id", "record_type")) == [(2, "response"), (3, "response")]
    assert warc.archive_round_trip(pages.filter("page_id = -1")).count() == 0


def test_warc_long_header(spark):
    url = "data:," + np.random.default_rng(1).bytes(1_000_000).hex()
    pages = spark.createDataFrame([(1, url, "one"), (2, "u", "two"), (3, url, "one")], "page_id long, url string, html string")
    for split in (16_000_000, 100_000):
        got = rows(warc.archive_round_trip(pages, split_bytes=split).select("page_id", "record_type", "refers_to"))
        assert got == [(1, "response", None), (2, "response", None), (3, "revisit", 1)]


def test_warc_damage(spark, docs, tmp_path):
    files = warc.write_warc(docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html").coalesce(1), str(tmp_path))
    path = files.filter("n_records > 0").first()["path"]
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        warc.read_warc(spark, files).count()


def test_mixing(docs, empty):
    got = mixing.mix(docs)
    sums = got.groupBy("source").agg(F.sum("taken"), F.max("target"), F.max("source_size"))
    for _, taken, target, size in sums.collect():
        assert target - 1 < taken <= target <= 2 * size
    assert got.filter("taken > 2 * size").count() == 0 and got.count() == len(ROWS)
    assert rows(got) == rows(mixing.mix(docs.repartition(3)))
    assert mixing.mix(empty).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.filter("text IS NULL OR trim(text) = ''").count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_jaccard(docs, empty):
    got = rows(jaccard.link_documents(docs))
    known = {k: t for k, t, _ in ROWS if k is not None}
    want = {k: (n, c) for k, n, c in brute.jaccard(list(known.items()))}
    assert got == sorted([(k, *want[k]) if k else (None, want[1][0], None) for k, _, _ in ROWS], key=str)
    assert jaccard.link_documents(empty).count() == 0
    kept = rows(jaccard.one_per_group(docs).select("doc_id"))
    assert kept == sorted([(k,) for k in (1, 2, 3, 4, 7, 9, None)], key=str)


def test_secrets(spark, docs, empty):
    assert secrets.scan_secrets(docs).filter("is_secret IS NULL").count() == 0
    assert secrets.scan_secrets(empty).count() == 0
    one = spark.createDataFrame([(1, 'key = "a1b2c3d4e5f6a7b8c9d0"', None)], "doc_id long, text string, source string")
    assert rows(secrets.scan_secrets(one).select("value", "score", "is_secret")) == [("a1b2c3d4e5f6a7b8c9d0", None, True)]


def test_secrets_within_words(spark):
    texts = [
        "get api_key=AKIA1234567890ABCD&user=bob now",
        '{"api_key":"AKIA1234567890ABCD","user":"robertrobert12","id":7}',
        "password=correcthorsebattery;aws_secret_access_key=Zm9vYmFyYmF6cXV4==;x=1",
        None,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'a' AS source")
    got = secrets.find_candidates(table)
    assert rows(got.select("__id", "at", "run", "value", "lead", "before")) == [
        (0, 1, 0, "AKIA1234567890ABCD", "api_key=", "get"),
        (1, 0, 0, "AKIA1234567890ABCD", '"api_key":"', ""),
        (1, 0, 1, "robertrobert12", '"user":"', ""),
        (2, 0, 0, "correcthorsebattery", "password=", ""),
        (2, 0, 1, "aws_secret_access_key", "", ""),
        (2, 0, 2, "Zm9vYmFyYmF6cXV4==", "aws_secret_access_key=", ""),
    ]
    labels = got.withColumns({"near_example": F.lit(0.0), "coverage": F.lit(0.0)}).withColumn("label", secrets.rule_label())
    assert rows(labels.filter("label = 1").select("__id", "run")) == [(0, 0), (1, 0), (2, 0), (2, 2)]
    assert secrets.scan_secrets(table).count() == 6


def test_quality(docs, empty):
    got = rows(quality.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == sorted((r[:-1] for r in brute.quality([r[:2] for r in ROWS])), key=str)
    assert quality.ledger(empty).count() == 0
    kept = quality.passing(docs, quality.BASE)
    assert kept.columns == docs.columns and kept.count() == 0 + sum(not r[-1] for r in brute.quality([r[:2] for r in ROWS]))


def test_ablation(docs):
    entries = quality.ledger(docs)
    got = {(r["version"], r["rule"]): tuple(r[2:]) for r in quality.ablate(entries).collect()}
    base = [(r[1] < 20, 100 * r[5] > 30 * r[1]) for r in brute.quality([r[:2] for r in ROWS])]
    few = sum(a for a, _ in base), sum(a and not b for a, b in base)
    none = sum(not a and not b for a, b in base)
    assert got["base", "few_words"] == (*few, none, none + few[1])


def test_exact_windows_on_hash_collision(monkeypatch):
    words = [b"a b c d e f g h x y z a b c d e f g h", b"a b c d e f g h i j k"]
    want = quality.measure(words)["n_repeat_words"]
    assert want == [16, 0]
    alike = lambda ids, doc, width: np.zeros(len(ids) - width + 1, np.uint64)
    monkeypatch.setattr(quality, "_window_keys", alike)
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 3, 4])
    assert quality._repeated(ids, np.array([0, 9]), 4).tolist() == [True] * 8 + [False]


def test_repeats(docs, empty):
    got = rows(repeats.find_repeats(docs).drop("spans"))
    plain = brute.repeats([(k if k else 10**9, t) for k, t, _ in ROWS[:5] + ROWS[6:]])
    want = [(None if r[0] == 10**9 else r[0], *r[1:]) for r in plain]
    want += [r for r in want if r[0] == 5]
    assert got == sorted(want, key=str)
    assert repeats.find_repeats(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, [1.0] * 8)
    assert got.count() == len(ROWS) and got.filter("text_crc32 = 0 AND size = 1").count() == 2
    assert sharding.assign_shards(empty, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, [1.0], keep=["size"])
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, [0.0])


def test_licenses(docs, empty):
    got = licenses.scan_licenses(docs)
    assert got.count() == len(ROWS) and got.filter("n_blocks > 0").count() == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_lm_score(docs, empty, labels):
    got = lm_score.cross_entropy_difference(docs, labels)
    assert got.count() == len(ROWS)
    assert got.filter("(n_tokens = 0) <> (score IS NULL)").count() == 0
    assert lm_score.cross_entropy_difference(empty, labels).count() == 0
    assert lm_score.cross_entropy_difference(docs, labels.limit(0)).filter("score IS NOT NULL").count() == 8


def test_pipeline_edges(spark, docs, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            path = str(tmp_path / f"{name}-{start is docs}")
            out.write.parquet(path)
            if name != "shards":
                assert out.columns == start.columns
            now = spark.read.parquet(path)
        assert {"doc_id", "source", "shard", "slot"} <= set(now.columns)
