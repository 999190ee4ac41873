"""Each stage on what its predecessor kept, against plain rules."""

from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    now = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": now}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SMALL).write.parquet(f"{folder}/{name}")
        now = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_order(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "benchmark_decontamination", "source_mix", "shards",
    ]
    for name in ("quality_rules", "near_duplicates", "benchmark_decontamination", "source_mix"):
        assert kept[name].columns == kept["documents"].columns


def test_quality(kept):
    failed = {r[0] for r in brute.quality(texts(kept["documents"])) if r[-1]}
    ids = {d for d, _ in texts(kept["quality_rules"])}
    assert not ids & failed and len(ids) > 0.6 * kept["documents"].count()


def test_near_duplicates(kept):
    before = texts(kept["quality_rules"])
    want = {c for _, _, c in brute.jaccard(before)}
    assert sorted(d for d, _ in texts(kept["near_duplicates"])) == sorted(want)


def test_decontamination(spark, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = [r[0] for r in brute.decontaminate(texts(kept["near_duplicates"]), items) if not r[-1]]
    assert sorted(d for d, _ in texts(kept["benchmark_decontamination"])) == sorted(want)


def test_mix(kept):
    words, source = {}, {}
    for r in kept["benchmark_decontamination"].select("doc_id", "text", "source").collect():
        words[r[0]], source[r[0]] = len(brute.TOKEN.findall(r[1])), r[2]
    sizes, taken = Counter(), Counter()
    for d, n in words.items():
        sizes[source[d]] += n
    copies = Counter(r[0] for r in kept["source_mix"].select("doc_id").collect())
    assert max(copies.values()) <= 2
    for d, n in copies.items():
        taken[source[d]] += n * words[d]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(w for s, w in weights.items() if s not in full)
        target = {s: 2 * sizes[s] if s in full else weights[s] * left / total for s in sizes}
        more = {s for s in sizes if target[s] >= 2 * sizes[s]} - full
        if not more:
            break
        full |= more
    longest = defaultdict(int)
    for d, n in words.items():
        longest[source[d]] = max(longest[source[d]], n)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)


def test_shards(kept):
    out = kept["shards"]
    assert out.count() == kept["source_mix"].count()
    per = defaultdict(set)
    for r in out.select("doc_id", "shard", "slot").collect():
        per[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in per.values())


def test_run(spark, kept):
    got = corpus_pipeline.run(spark, SMALL)
    columns = ["doc_id", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, kept["shards"].select(columns).collect()))


def test_rows_without_a_key_or_that_share_one(spark, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest"
    other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("apple", "pear"))
    table = [
        (None, passage), (None, other), (None, other), (1, passage), (1, third), (3, third + " end"),
        (2, other + " end"), (2, "a b c d"), (None, ""), (None, ""), (3, ""), (3, ""), (None, "e f g"), (None, "e f g"),
    ]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    start = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "'a' AS source", "map(1, 2) AS extra")
    found = lambda df: sorted(texts(df), key=str)
    clean = corpus_pipeline.benchmark_decontamination(spark, start, str(tmp_path))
    assert found(clean) == sorted([r for r in table if r[1] != passage], key=str)
    got = corpus_pipeline.near_duplicates(spark, start, str(tmp_path))
    assert got.columns == start.columns
    assert found(got) == sorted(
        [(1, passage), (1, third), (2, other + " end"), (2, "a b c d"), (None, ""), (None, ""), (3, ""), (None, "e f g")], key=str
    )


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    plain = [f"w{i}" for i in range(1000)]
    changed = lambda n: " ".join(f"x{n}-{i}" if i % 40 == 20 and i < 40 * n else w for i, w in enumerate(plain))
    table = [(1, " ".join(plain)), (2, changed(21)), (3, changed(24))]
    assert [c for *_, c in brute.jaccard(table)] == [1, 2, 3]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = texts(corpus_pipeline.near_duplicates(spark, docs, SMALL))
    assert sorted(d for d, _ in got) == sorted({c for *_, c in brute.jaccard(table, 5, 80)}) == [1, 3]


def test_columns_named_like_working_ones_stay_as_they_are(spark, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest"
    names = "__row __marked __wordless __copies __copy __of __k __id __doc __key __hit __text __found __own __source n_words failures".split()
    table = [(i, " ".join(f"{w}{i // 2}" for w in [*"abcdefghijklmnopqrstuvwxyz"]) + (" " + passage) * (i == 7)) for i in range(10)]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    start = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "'a' AS source", *[f"{100 + i} AS {n}" for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, start, str(tmp_path))
        assert got.columns == start.columns and got.count() > 0, name
        assert {tuple(r) for r in got.select(*names).collect()} == {tuple(range(100, 100 + len(names)))}, name
    last = corpus_pipeline.STAGES[-1][1](spark, start, str(tmp_path))
    kept = [n for n in names if n in last.columns]
    assert len(kept) >= len(names) - 1 and last.count() == 10
