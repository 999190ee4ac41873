"""Operator 12: token ids in files."""

import glob
import hashlib

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import id_codec, queries, token_files

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(token_files.TOKENIZER)
COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return token_files.Words(PATH)


def test_op12(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_token_files"](spark, SMALL).select(*COLUMNS).collect()]
    assert sorted(got) == brute.token_rows(docs, tokenizer)


LONG = " ".join(f"long{i % 977}, it's {i}." for i in range(30_000))
ODD = [
    (3, None), (1, ""), (2, "  \n "), (9, LONG), (5, "It's a <|endoftext|> <|STARTOFTEXT|>, J̌ | a|b İstanbul été."),
    (7, "same"), (7, "same"), (7, "same"), (None, "last"), (4, "\x00\x0b tab\x0csép nbsp … 漢字 'll don't. )., x y"),
]


def test_edges(spark, tokenizer, tmp_path):
    """Missing, empty, long and repeated texts, a missing key, several files, clashing names."""
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "'x' AS key", "1 AS file", "2 AS __hash2", "3 AS start")
    files = token_files.write_token_files(docs, str(tmp_path), PATH, file_text=1000)
    assert files.count() > 1
    got = [tuple(r) for r in token_files.read_token_files(files).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute.token_rows(ODD, tokenizer)
    none = token_files.token_round_trip(docs.filter("doc_id = -1"), PATH)
    assert none.columns == COLUMNS and none.count() == 0


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, LONG)], "doc_id bigint, text string")
    files = token_files.write_token_files(docs, str(tmp_path), PATH)
    files.count()
    path = glob.glob(f"{tmp_path}/*.ids")[0]
    data = bytearray(open(path, "rb").read())
    data[5000] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(files).collect()


MARKS = st.text(st.sampled_from("aAbZéEJj'stLl.,;!?|<> \n\ť́  İßΣ9漢…\"()-"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(MARKS, max_size=4))
def test_words_give_the_ids_of_whole_texts(words, tokenizer, texts):
    ids, counts = words.ids(pa.array(texts, pa.string()))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for own in want for i in own] and counts.tolist() == list(map(len, want))


def test_words_are_forgotten_in_time(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 5)
    own = token_files.Words(PATH)
    for text in ("one two three four", "five six one two", "seven", "one two three four five six seven eight nine"):
        assert own.ids(pa.array([text, None, text]).fill_null(""))[0].tolist() == 2 * tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_cut_at_white_space():
    text = b"ab cde\nf" * 50 + b"x" * 40
    for limit in (1, 7, 39, 1000):
        parts = list(token_files.pieces(text, limit))
        assert b" ".join(parts).split() == text.split()
    assert list(token_files.pieces(b"", 5)) == [b""]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 3000), st.sampled_from([1, 2, 60, 49_408, 1 << 20]))
def test_blocks_round_trip(seed, n, vocabulary):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(0.02, n) - 1, vocabulary - 1) if seed % 2 else rng.integers(0, vocabulary, n)
    block = id_codec.encode_block(ids, vocabulary)
    assert id_codec.decode_block(block + b"more").tolist() == ids.tolist()


def test_blocks_shrink_text_and_check_themselves():
    phrase = np.random.default_rng(1).integers(0, 49_408, 300)
    ids = np.tile(phrase, 400)
    block = id_codec.encode_block(ids, 49_408)
    assert len(block) < len(ids) * 2 / 3
    broken = bytearray(block)
    broken[len(block) // 2] ^= 4
    for bad in (bytes(broken), b"X" + block[1:], block[:20] + b"\x01" + block[21:]):
        with pytest.raises(ValueError):
            id_codec.decode_block(bad)
    with pytest.raises(ValueError):
        id_codec.encode_block(np.array([5]), 5)


def test_simple_words_take_the_short_way(words, tokenizer):
    """Every letter that counts as simple, alone and within words, before points, and next to letters that do not."""
    letters = [c for c in map(chr, range(0x41, 0x100)) if pc.match_substring_regex(pa.array([c]), token_files.SIMPLE)[0].as_py()]
    assert len(letters) == 52 + 62 and words.simple is not None
    texts = letters + [f"{a}{b}x {b}{a}" for a, b in zip(letters, reversed(letters))]
    texts += [f"{c}{p} {c}{p}{c} {c}{p}" for c in "aÉß9İıſ中" for p in (*"""'"#$%&*)(]}{[/+=~^-|<>""", "'s!", ").", "&&&", "́.", "<|endoftext|>")]
    ids, counts = words.ids(pa.array(texts))
    whole = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, whole)) and ids.tolist() == [i for own in whole for i in own]


def test_frequent_words_stay_known(words, tokenizer, monkeypatch):
    """Beyond the limit only words met once are dropped while there are enough of them: others are not encoded again."""
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 40)
    own, learned = token_files.Words(PATH), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda w: learned.extend(pa.array(w).to_pylist()) or learn(w))
    for i in range(30):
        text = "straße the fox, " + " ".join(f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(10))
        assert own.ids(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 40
    assert [learned.count(w) for w in ("straße", "the", "fox", ",")] == [1, 1, 1, 1] and len(learned) == 4 + 300
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 1000)
    for i in range(20):
        text = f"the fox {chr(97 + i) * 700} {i}"
        assert own.ids(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert own.known.nbytes <= 2000


def test_blocks_keep_their_bytes():
    """Files written before are read with the same model: its arithmetic must not drift."""
    ids = np.random.default_rng(7).zipf(1.3, 50_000) % 49_408
    ids[20_000:30_000] = ids[:10_000]
    assert hashlib.sha256(id_codec.encode_block(ids, 49_408)).hexdigest()[:16] == "55b9f386148dc169"
