"""Parts of operators against plain versions, on many small random inputs."""

import gzip
import io
import time
import tracemalloc
from pathlib import Path

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import common, decontaminate, jaccard, lm_score, repeats, warc
from tallyframe.llm.run_index import RunIndex
from tallyframe.session import cut_lineage

ALPHABETS = st.sampled_from([b"a", b"ab", b"abc", bytes(range(256))])


@st.composite
def text_sets(draw):
    letters = draw(ALPHABETS)
    one = st.lists(st.sampled_from(list(letters)), min_size=1, max_size=40).map(bytes)
    return draw(st.lists(one, min_size=1, max_size=12, unique=True))


@settings(max_examples=150, deadline=None)
@given(text_sets(), st.integers(7, 30), st.randoms(use_true_random=False))
def test_run_index(texts, width, random):
    owners = np.array([random.randint(0, 9) for _ in texts])
    first = {}
    for t, o in zip(texts, owners):
        for i in range(len(t) - width + 1):
            first[t[i : i + width]] = min(first.get(t[i : i + width], 99), o)
    none = np.iinfo(np.int64).max
    want = [first[t[i : i + width]] if i + width <= len(t) else none for t in texts for i in range(len(t))]
    assert RunIndex(texts, owners, width).stream().tolist() == want


def test_run_index_has_few_runs_in_repetitive_text():
    base = bytes(np.random.default_rng(1).integers(97, 123, 2000, dtype=np.uint8))
    copies = [base[:i] + b"!" + base[i + 1 :] for i in range(0, 2000, 50)]
    index = RunIndex(copies, np.arange(len(copies)), 50)
    assert len(index.run_start) < 0.15 * index.n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6), st.integers(7, 12), st.integers(0, 10))
def test_pieces_hold_every_string_once(texts, anchor, more):
    width = anchor + more
    data, lengths = b"".join(texts), [len(t) for t in texts]
    hashed = repeats.Pieces(data, lengths, width, anchor)
    pieces = repeats.Pieces(data, lengths, width, anchor, dict(zip(("steps", "strings", "hashes"), hashed.pack())))
    assert all((getattr(pieces, c) == getattr(hashed, c)).all() for c in ("first", "stop", "hash", "doc"))
    seen = sorted((d, i - pieces.starts[d]) for a, b, d in zip(pieces.first, pieces.stop, pieces.doc) for i in range(a, b))
    assert seen == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - width + 1)]
    by_string = {}
    for a, b, h in zip(pieces.first, pieces.stop, pieces.hash):
        for i in range(a, b):
            assert by_string.setdefault(pieces.data[i : i + width], h) == h


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60))
def test_bitmaps_never_overstate_the_difference(a, b):
    both = a[:20] + b
    x, y = (np.sort(np.array(v, np.uint64)) for v in (a, list(dict.fromkeys(both))))
    if len(x) and len(y):
        maps = (np.frombuffer(jaccard.bitmap(v), np.uint8) for v in (x, y))
        assert jaccard.apart(*maps) <= len(set(x.tolist()) ^ set(y.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=30), max_size=5))
def test_postings_round_trip(docs):
    texts = [" ".join(d).encode() for d in docs]
    lengths, terms, counts, positions = decontaminate._segment(texts)
    words = [w for d in docs for w in d]
    counts = np.frombuffer(counts, "<u4").astype(np.int64)
    got = {}
    if len(counts):
        ends = np.cumsum(counts)
        for t, where in zip(terms.split(), np.split(decontaminate._unpack(positions, counts), ends[:-1])):
            got[t.decode()] = where.tolist()
    assert got == {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}
    assert lengths == [len(d) for d in docs]


def test_overlap_needed_is_the_link_rule():
    for m in range(1, 40):
        for n in range(1, 40):
            least = next(k for k in range(min(m, n) + 2) if k > min(m, n) or 100 * k >= 85 * (m + n - k))
            if least <= min(m, n):
                assert jaccard.overlap_needed(m, n, 85) == least


@pytest.mark.parametrize("start", range(0, 400, 7))
def test_ranges_share_out_records(start):
    """Any cut gives each record to one range; magic bytes inside records are no records."""
    data, places = b"", []
    for i in range(6):
        payload = gzip.compress(b"not a record", mtime=0) + bytes([31, 139, 8, 0, i]) * 5
        places.append(len(data))
        data += warc.record(i, None, payload, None, False, "2020-01-01T00:00:00Z")
    found = [
        o for a, b in ((0, start), (start, len(data))) for o, _, _ in warc.records(io.BytesIO(data), len(data), a, b)
    ]
    assert found == places


def test_chunks_keep_rows_and_long_texts():
    import pyarrow as pa

    texts = ["a" * 10, None, "", "b" * 1000, "c"]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    parts = list(common.chunks(iter([batch, batch.slice(0, 0)]), "t", 50))
    assert [v for p in parts for v in p.column("t").to_pylist()] == texts
    assert all(p.num_rows for p in parts) and len(parts) > 1


def test_blocks_skip_what_cannot_link_and_miss_nothing(spark, monkeypatch):
    """Every pair that size and position allow, and that is not of two near entries, meets in one pair of blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = np.random.default_rng(3)
    size = rng.choice([1, 2, 9, 40, 46, 47, 300, 5000], 60)
    pos = (rng.random(60) * (size - -(-85 * size // 100) + 1)).astype(int)
    near = rng.random(60) < 0.4
    rows = [(7, int(i), int(m), int(p), bool(x)) for i, (m, p, x) in enumerate(zip(size, pos, near))] + [(8, 1, 9, 0, False)]
    entries = spark.createDataFrame(rows, "h bigint, a bigint, size bigint, pos bigint, near boolean")
    got = jaccard.block_pairs(entries, 85).collect()
    met = {}
    for r in got:
        met.setdefault((r.h, r.r, r.c), ([], []))[0 if r.is_row else 1].append((r.at, r.a))
    pairs = [tuple(sorted((a, b))) for key, (x, y) in met.items() for at, a in x for to, b in y if key[1] != key[2] or at < to]
    want = {
        (i, j)
        for i in range(60)
        for j in range(i + 1, 60)
        if not (near[i] and near[j])
        and 100 * min(size[i], size[j]) >= 85 * max(size[i], size[j])
        and min(size[i] - pos[i], size[j] - pos[j]) >= jaccard.overlap_needed(size[i], size[j], 85)
    }
    assert len(pairs) == len(set(pairs)) and want <= set(pairs)
    assert len(pairs) < 60 * 59 // 2 // 2  # most of the list is skipped


def test_near_entries_are_not_copied_for_each_other(spark, monkeypatch):
    """The rows that move grow with the copies near a pivot, not with their square."""
    monkeypatch.setattr(jaccard, "BLOCK", 10)

    def moved(n):
        rows = [(7, i, 100, 0, True) for i in range(n)] + [(7, n + i, 100, 0, False) for i in range(10)]
        return jaccard.block_pairs(spark.createDataFrame(rows, "h bigint, a bigint, size bigint, pos bigint, near boolean"), 85).count()

    assert moved(400) <= 4.5 * moved(100)


def test_rows_kept_grow_with_near_copies_not_with_their_pairs(spark, monkeypatch):
    """Copies in short lists are compared with one of them, whatever the number of lists they share."""
    random, real, most = np.random.default_rng(3), jaccard.cut_lineage, []

    def counted(df):
        out = real(df)
        most[-1] = max(most[-1], out.count())
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", counted)
    for n in (5, 20):
        most.append(0)
        base, docs = [f"w{i}" for i in range(300)], []
        for i in range(n):
            at = int(random.integers(300))
            docs.append((i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])))
        got = jaccard.link_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
        assert {r.component_id for r in got} == {0} and len(got) == n
    assert most[1] < 8 * most[0]  # pairs: 19 times


def test_sets_near_one_pivot_have_its_group():
    a, b, c = 0x12345678, 0x9ABCDEF0, 0x0F0F0F0F
    near, far = a ^ 0x00000111, a ^ 0x11111000  # five and three of eight parts are as in a
    group, pivot = jaccard._near(np.array([[a, near, b, far, b, c]], "<u4"))
    assert group.tolist() == [[1, 1, 2, 0, 2, 0]] and pivot[0, [1, 4]].tolist() == [0, 2]


def test_sets_of_one_pivot_that_do_not_link_with_it(spark):
    """Copies that link with each other, not with the first text, in short and in long lists."""
    base = [f"w{i}" for i in range(200)]
    change = lambda ats, k: " ".join(f"x{k}" if i in ats else w for i, w in enumerate(base))
    for n in (5, 40):
        docs = [(0, " ".join(base))]
        docs += [(1 + i, change({5, 25, 45, 65, 85, 105, 125, 3 * i}, 0)) for i in range(n)]  # far from 0, near to each other
        docs += [(500 + i, change({4 * i}, 1)) for i in range(n)]
        got = sorted(tuple(r) for r in jaccard.link_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
        assert got == sorted(brute.jaccard(docs))


def _shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in dirs for f in Path(str(d)).rglob("shuffle_*.data"))


def test_shuffle_files_go_when_lineage_is_cut(spark):
    before = _shuffled(spark)
    rows = spark.range(200_000).selectExpr("id", "md5(string(id)) AS t").repartition(7)
    assert cut_lineage(rows).count() == 200_000
    for _ in range(50):
        if _shuffled(spark) <= before + 1_000_000:
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files stay")


def test_copies_that_go_do_not_move(spark):
    random = np.random.default_rng(1)
    texts = [" ".join(random.bytes(5).hex() for _ in range(6000)) for _ in range(8)]
    docs = spark.createDataFrame([(100 * k + i, f"{t} {k}") for k in range(20) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = cut_lineage(docs)
    before = _shuffled(spark)
    got = jaccard.one_text_per_group(docs, width=5, percent=80).collect()
    assert sorted(r.doc_id for r in got) == list(range(8))
    assert _shuffled(spark) - before < 2_500_000  # all copies have 10 MB, 6 MB when compressed


def test_words_of_a_chunk_are_not_held_all_at_once():
    """Numbers of words take 4 bytes a word, and their bytes only some at a time."""
    texts = [b" ".join(b"w%d" % (i * j % 997) for i in range(2000)) for j in range(250)]
    tracemalloc.start()
    ids, starts, hashes = lm_score.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == starts[-1] == 500_000 and len(hashes) == 997
    assert peak < 16_000_000  # 28 MB with all words in a list
    first, distinct = common.word_ids([w for b in texts for w in lm_score.tokens(b)])
    assert (first == ids).all() and [lm_score.xxhash.xxh3_64_intdigest(w) for w in distinct] == hashes.tolist()


def test_groups_of_documents_are_told_by_their_ends():
    """What a part learns of a chunk's documents does not grow with their number."""
    for group in ([], [3], [0, 0, 1, 3, 3], [1] * 50_000 + [2] * 9_000):
        ends = lm_score._ends(np.array(group, np.int64))
        assert len(ends) == 2 * (lm_score.GROUPS - 1)
        assert lm_score._group(ends, np.arange(len(group))).tolist() == group


def test_words_of_a_chunk_are_gone_when_it_is_done():
    """Nothing but the results outlives a call, without a run of the garbage collector."""
    import gc

    texts = [b" ".join(b"word%d" % (1000 * j + i) for i in range(1000)) for j in range(100)]
    runs = (lambda: common.numbered_words(texts, decontaminate.words_of), lambda: common.word_ids(b" ".join(texts).split()), lambda: decontaminate._segment(texts))
    gc.disable()
    try:
        for run in runs:
            run()
            tracemalloc.start()
            for _ in range(5):
                run()
            left = tracemalloc.get_traced_memory()[0]
            tracemalloc.stop()
            assert left < 1_000_000  # 50 MB when each call's words stay
    finally:
        gc.enable()
