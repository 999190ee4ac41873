"""Texts as token ids in compressed files, in key order, and back.

A file is a run of blocks of :mod:`id_codec`, then a list of its documents (an Arrow stream), that list's length and
a mark. Tasks open files themselves, through ``pyarrow.fs``: the folder must be one that it reaches.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import chunks
from tallyframe.llm.id_codec import BLOCK_IDS, HEADER, block_size, decode_block, encode_block
from tallyframe.session import cut_lineage, ensure_checkpoint_dir

TOKENIZER = "word_bpe_49k.json"  # lower case, white space dropped: see Words
END = 2
FILE_TEXT = 32_000_000  # bytes of text for about one file
CHUNK = 16_000_000  # bytes of whole texts that are looked at together
PIECE = 4_000_000  # the same of one longer text
KNOWN_WORDS = 500_000  # words a task remembers; beyond it only the more frequent ones are kept
KNOWN_BYTES = 64_000_000  # the same for their bytes
MARK = b"TFIDEND1"
# Latin letters and digits that normalising and lower-casing keep one letter: not U+0130.
LETTER = r"([a-z0-9À-ÖØ-öø-įı-ſ])"
POINTS = r"""([.,;:!?#$%&*"()\[\]{}/+=~^-]+)"""  # no apostrophe, which some endings begin with, and no part of a special token
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"  # words of letters that have no decomposed form once they are lower-cased

def pieces(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """A text cut at white space into pieces of about ``limit`` bytes; a longer word stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = re.compile(rb"[\x20\x09-\x0D]").search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Words:
    """Ids of whole texts from the ids of their words, each encoded once while it is remembered.

    Right for tokenizers that drop white space and split at it, as the one named above: no token reaches over it. There
    lower-casing A-Z first changes nothing either, unless a combining mark follows or a special token is spelled out,
    nor does splitting POINTS off a LETTER before them; both make words repeat more often. SIMPLE words need no
    normal form and no pattern: lower-cased and written as the library's byte-level letters, its model gives their ids.
    """

    BETWEEN = "|"  # put between words that are encoded together

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        between = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.simple = self._for_simple()
        self.known = pa.array([], pa.string())
        self.lists = _lists([], [])  # ids of the known words
        self.met = np.zeros(0, np.int32)  # in how many chunks

    def _for_simple(self) -> dict[int, str] | None:
        """How the model writes letters beyond ASCII, where all else of the file's steps leaves SIMPLE words as they are."""
        from tokenizers import pre_tokenizers

        parts = lambda step, inner: json.loads(step.__getstate__()).get(inner, ()) if step else ()
        kinds = lambda steps: [(x["type"], x.get("pattern")) for x in steps]
        forms = kinds(parts(self.tokenizer.normalizer, "normalizers"))
        cuts = kinds(parts(self.tokenizer.pre_tokenizer, "pretokenizers"))
        if forms != [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] or [c for c, _ in cuts] != ["Split", "ByteLevel"]:
            return None
        if r"[\p{L}]+" not in cuts[0][1].get("Regex", "").split("|"):
            return None
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        return {point: written(chr(point))[0][0] for point in range(0xC0, 0x100)}

    def _encode_simple(self, words: pa.Array) -> tuple[list[int], list[int]]:
        """Ids of SIMPLE words, one after the other, and how many each has."""
        tokenize, ids, lengths = self.tokenizer.model.tokenize, [], []
        every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pc.utf8_lower(words))
        for word in pc.binary_join(every, " ")[0].as_py().split():
            own = tokenize(word if word.isascii() else word.translate(self.simple))
            lengths.append(len(own))
            ids += [token.id for token in own]
        return ids, lengths

    def _encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The same for any words: together if BETWEEN tells them apart."""
        if self.between is not None and not any(self.BETWEEN in w for w in words):
            ids = self.tokenizer.encode_batch_fast([f" {self.BETWEEN} ".join(words)], add_special_tokens=False)[0].ids
            cut = np.flatnonzero(np.array(ids, np.uint32) == self.between)
            if len(cut) == len(words) - 1:
                lengths = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                return [i for i in ids if i != self.between], lengths.tolist()
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [i for own in each for i in own], list(map(len, each))

    def _learn(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word."""
        simple = pc.match_substring_regex(words, SIMPLE) if self.simple else pa.array([False] * len(words))
        others = words.filter(pc.invert(simple)).to_pylist()
        others.sort(key=lambda w: self.BETWEEN in w)
        plain = sum(self.BETWEEN not in w for w in others)
        parts = [_lists(*self._encode_simple(words.filter(simple)))]
        for group in (others[:plain], others[plain:]):
            parts += [_lists(*self._encode(group[lo : lo + 200])) for lo in range(0, len(group), 200)]
        order = pc.index_in(words, pa.concat_arrays([words.filter(simple), pa.array(others, pa.string())]))
        return pa.concat_arrays(parts).take(order)

    def _forget(self) -> None:
        """Keeps words met in several chunks: those met most often, half at most of what may be remembered."""
        half = min(KNOWN_WORDS, len(self.known)) // 2 + 1
        kept = np.flatnonzero(self.met > max(1, np.partition(self.met, -half)[-half]))
        self.known, self.lists, self.met = self.known.take(pa.array(kept)), self.lists.take(pa.array(kept)), self.met[kept] + 1 >> 1

    @staticmethod
    def split(texts: pa.Array) -> pa.ListArray:
        low = pc.ascii_lower(texts)
        odd = pc.match_substring_regex(texts, "<\\||[\u0300-\u036f]")
        if pc.any(odd).as_py():
            low = pc.if_else(odd, texts, low)
        return pc.ascii_split_whitespace(pc.replace_substring_regex(low, LETTER + POINTS + r"([ \n\t\r]|$)", r"\1 \2\3"))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        words = self.split(texts)
        if not len(words.flatten()):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # Numbered after the known words, so that these keep their numbers and new ones follow.
        coded = pa.chunked_array([self.known, words.flatten()]).dictionary_encode().chunks[-1]
        new = coded.dictionary.slice(len(self.known))
        if len(new):
            self.lists = pa.concat_arrays([self.lists, self._learn(new)])
            self.known, self.met = coded.dictionary, np.append(self.met, np.zeros(len(new), np.int32))
        met = np.zeros(len(self.known), bool)
        met[coded.indices.to_numpy()] = True
        self.met += met
        every = self.lists.take(coded.indices)
        if len(self.known) > KNOWN_WORDS or self.known.nbytes > KNOWN_BYTES:
            self._forget()
        bounds = every.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return every.flatten().to_numpy(), np.diff(bounds)


def _lists(ids: list[int], lengths: list[int]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int32)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.uint32()))


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


# ---- writer


class _File:
    """An open file that takes ids and cuts them into blocks."""

    def __init__(self, path: str, vocabulary: int):
        self.path, self.vocabulary = path, vocabulary
        store, own = fs.FileSystem.from_uri(path)
        self.out = store.open_output_stream(own, compression=None)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = self.n_blocks = self.bytes = 0

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self.vocabulary)
        self.out.write(data)
        self.bytes += len(data)
        self.n_blocks += 1

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= BLOCK_IDS:
            every = np.concatenate(self.held)
            full = len(every) // BLOCK_IDS * BLOCK_IDS
            for lo in range(0, full, BLOCK_IDS):
                self._block(every[lo : lo + BLOCK_IDS])
            self.held, self.n_held = [every[full:].copy()], len(every) - full

    def close(self, documents: pa.Table) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(documents, max_chunksize=100_000)
        tail = sink.getvalue()
        self.out.write(tail + len(tail).to_bytes(8, "little") + MARK)
        self.bytes += len(tail) + 16
        self.out.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END,
    file_text: int = FILE_TEXT,
) -> DataFrame:
    """Writes the ids of all texts, ``end`` after each, in ascending order of key, and returns the files:
    path, file (their order), n_docs, n_ids, n_blocks, bytes, start (ids in the files before).

    ``tokenizer``: a tokenizer file, at the same place on every machine. Missing keys come last; rows that repeat a key
    go by a hash of their text. Missing and empty texts have only the end id. Ranges of the order are dealt to tasks by
    key and hash, so that a key with a third of all rows is spread; a task holds a block of ids and a
    few MB of text. Each attempt of a task writes a file of its own; only those in the result count. No rows, no
    files. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    volume = rows.agg(F.sum(F.octet_length("__text") + 16)).first()[0] or 0
    order = [F.col("__id").asc_nulls_last(), F.col("__hash")]
    placed = (
        rows.withColumn("__hash", F.xxhash64("__text"))
        .repartitionByRange(max(1, -(-volume // file_text)), *order)
        .sortWithinPartitions(*order)
        .select("__id", "__text")
    )
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        out, keys, sizes = None, [], []
        for part in chunks(batches, "__text", CHUNK):
            out = out or _File(f"{folder}/{uuid.uuid4().hex}.ids", words.vocabulary)
            texts = pc.fill_null(part.column("__text"), "")
            keys.append(part.column("__id"))
            if len(texts) == 1:
                n = 0
                for piece in pieces(texts.cast(pa.binary())[0].as_py()):
                    ids, _ = words.ids(pa.array([piece.decode()], pa.string()))
                    out.add(ids)
                    n += len(ids)
                out.add(np.array([end], np.uint32))
                sizes.append(np.array([n + 1]))
            else:
                ids, counts = words.ids(texts)
                out.add(np.insert(ids, np.cumsum(counts), end))
                sizes.append(counts + 1)
        if out is None:
            return
        documents = pa.table({"key": pa.chunked_array(keys), "n_tokens": pa.array(np.concatenate(sizes), pa.int64())})
        out.close(documents)
        row = [out.path, TaskContext.get().partitionId(), documents.num_rows, out.n, out.n_blocks, out.bytes]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)

    names = ["path", "file", "n_docs", "n_ids", "n_blocks", "bytes"]
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    files = cut_lineage(placed.mapInArrow(run, "path string, file bigint, n_docs bigint, n_ids bigint, n_blocks bigint, bytes bigint"))
    # One row per file, not per document.
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


# ---- reader


def _documents(file, size: int) -> tuple[pa.Table, int]:
    """The list of documents of an open file, and where the blocks end."""
    file.seek(size - 16)
    tail = file.read(16)
    if tail[8:] != MARK:
        raise ValueError("a file of ids has no end")
    length = int.from_bytes(tail[:8], "little")
    file.seek(size - 16 - length)
    return pa.ipc.open_stream(file.read(length)).read_all(), size - 16 - length


def read_blocks(file, end: int) -> Iterator[np.ndarray]:
    """The ids of a file, block by block."""
    file.seek(0)
    while file.tell() < end:
        header = file.read(HEADER.size)
        yield decode_block(header + file.read(block_size(header)))


def read_documents(file, size: int) -> Iterator[tuple[pa.Array, np.ndarray, list[int]]]:
    """Keys, numbers of ids and checksums of a file's documents, those that end in one block together."""
    documents, end = _documents(file, size)
    keys, sizes = documents.column("key").combine_chunks(), documents.column("n_tokens").to_numpy()
    ends = np.cumsum(sizes)
    done, seen, open_sum = 0, 0, 0
    for ids in read_blocks(file, end):
        upto = int(np.searchsorted(ends, seen + len(ids), side="right"))
        data, at, sums = ids.view(np.uint8), 0, []
        for e in (ends[done:upto] - seen).tolist():
            sums.append(zlib.crc32(data[4 * at : 4 * e], open_sum))
            at, open_sum = e, 0
        open_sum = zlib.crc32(data[4 * at :], open_sum)
        yield keys[done:upto], sizes[done:upto], sums
        done, seen = upto, seen + len(ids)
    if done < len(sizes) or seen != (ends[-1] if len(ends) else 0):
        raise ValueError("a file of ids ends before its documents")


def read_token_files(files: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Per document of the files of :func:`write_token_files`: key, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, own = fs.FileSystem.from_uri(path)
                with store.open_input_file(own) as file:
                    for keys, sizes, sums in read_documents(file, file.size()):
                        if len(keys):
                            ends = np.cumsum(sizes)
                            columns = [keys, pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"])
                            start += int(ends[-1])

    spread = files.repartitionByRange(max(1, files.count()), "file").select("path", "start")
    return spread.mapInArrow(run, f"key {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, folder: str | None = None
) -> DataFrame:
    """Per document, as read back from files written below ``folder`` (by default the checkpoint folder): key, start
    (ids of all documents before it), n_tokens (with the end id), ids_crc32."""
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    files = write_token_files(docs, folder, tokenizer, key, text, end)
    return read_token_files(files, kind).withColumnRenamed("key", key)
