"""Exact long repeats across documents, found with run-length indexes.

Every string of ``width`` bytes belongs to the smallest hash of its k-byte substrings. Strings that stand next
to each other and share it form a piece, and equal strings are always in pieces of one hash. So pieces are dealt by
hash; each share is indexed by a run-compressed Burrows-Wheeler transform, streamed, and answered.
Hashes that occur in one document only are found first, and their pieces never move.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import chunks, text_bytes
from tallyframe.llm.run_index import RunIndex
from tallyframe.session import cut_lineage, ensure_checkpoint_dir

WIDTH = 50
ANCHOR = 20  # bytes of a hashed substring
CHUNK_BYTES = 4_000_000
REQUEST_BYTES = 8_000_000  # of hashes that one task compares
BUCKET_BYTES = 32_000_000  # of text in one bucket of chunks
SHARE_BYTES = 2_000_000  # of text whose pieces go to one index
LAST = np.iinfo(np.int64).max
U64 = np.uint64


def _bytes_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTES = _bytes_table()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * U64(0x9E3779B97F4A7C15)) + b
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def anchor_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, built from hashes of power-of-two lengths."""
    power, span = BYTES[data], 1
    out, done = None, 0
    while True:
        if k & span:
            out = power[: len(data) - k + 1].copy() if out is None else _mix(out, power[done : done + len(out)])
            done += span
        if done == k:
            return out[: len(data) - k + 1]
        power = _mix(power[: len(power) - span], power[span:])
        span *= 2


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    n = len(h) - (w - span)
    return np.minimum(h[:n], h[w - span : w - span + n])


def _requests(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, upper half of the hash) in order, as two arrays, and each piece's place among them."""
    part = (hashes & U64(0xFFFFFFFF)) % U64(parts)
    both, place = np.unique((part << U64(32)) | (hashes >> U64(32)), return_inverse=True)
    return (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype("<u4"), place


class Pieces:
    """The pieces of some documents: first and last-but-one string start, hash, and document."""

    def __init__(self, data: bytes, lengths: list[int], width: int, k: int, packed: dict | None = None):
        """``packed``: what :meth:`pack` gave for these documents, so that nothing is hashed again."""
        self.data = data
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        if packed:
            self.first = np.cumsum(np.frombuffer(packed["steps"], "<u4").astype(np.int64))
            self.stop = self.first + np.frombuffer(packed["strings"], "<u4")
            self.hash = np.frombuffer(packed["hashes"], "<u8")
        else:
            self._find(np.frombuffer(data, np.uint8), width, k)
        self.doc = np.searchsorted(self.starts, self.first, side="right") - 1

    def pack(self) -> tuple[bytes, bytes, bytes]:
        steps = np.diff(self.first, prepend=0)
        return steps.astype("<u4").tobytes(), (self.stop - self.first).astype("<u4").tobytes(), self.hash.astype("<u8").tobytes()

    def _find(self, raw: np.ndarray, width: int, k: int) -> None:
        none = np.zeros(0, np.int64)
        self.first, self.stop, self.hash = none, none, np.zeros(0, U64)
        if len(raw) < width:
            return
        least = _sliding_min(anchor_hashes(raw, k), width - k + 1)
        whole = np.ones(len(least), bool)
        for end in self.starts[1:-1]:
            whole[max(0, end - width + 1) : end] = False
        turn = np.concatenate([[True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
        inner = self.starts[1:-1]
        turn[inner[inner < len(turn)]] = True
        at = np.flatnonzero(turn)
        stop = np.append(at[1:], len(least))
        own = whole[at]
        self.first, self.stop = at[own], stop[own]
        self.hash = least[self.first]

    def requests(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _requests(self.hash, parts)

    def in_two(self, owner: np.ndarray) -> np.ndarray:
        """Pieces whose hash stands in documents of two keys here."""
        order = np.argsort(self.hash, kind="stable")
        h, o = self.hash[order], owner[self.doc[order]]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        if not len(heads):
            return np.zeros(0, bool)
        two = np.minimum.reduceat(o, heads) != np.maximum.reduceat(o, heads)
        out = np.empty(len(h), bool)
        out[order] = np.repeat(two, np.diff(np.append(heads, len(h))))
        return out

    def distinct(self, chosen: np.ndarray, owner: np.ndarray, width: int):
        """Chosen pieces, the number of each one's text, the distinct texts, their hashes and smallest owners."""
        at = np.flatnonzero(chosen)
        seen: dict[bytes, int] = {}
        number = np.empty(len(at), np.int64)
        for i, (a, b) in enumerate(zip(self.first[at].tolist(), (self.stop[at] - 1 + width).tolist())):
            number[i] = seen.setdefault(self.data[a:b], len(seen))
        least = np.full(len(seen), LAST)
        np.minimum.at(least, number, owner[self.doc[at]])
        hashes = np.zeros(len(seen), U64)
        hashes[number] = self.hash[at]
        return at, number, list(seen), hashes, least


def _owners(ids: list) -> np.ndarray:
    """Keys as numbers; a missing key comes after all others."""
    return np.array([LAST if i is None else i for i in ids], np.int64)


def _chosen(pieces: Pieces, owner: np.ndarray, masks, parts: int) -> np.ndarray:
    """Pieces whose hash also stands in a document of another key, here or in another chunk."""
    part, _, place = pieces.requests(parts)
    flags = np.zeros(len(part), bool)
    for m in masks or ():
        a, b = np.searchsorted(part, [m["part"], m["part"] + 1])
        flags[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a).astype(bool)
    return pieces.in_two(owner) | flags[place]


def _common(table: pa.Table) -> pa.Table:
    """Marks the hashes that two chunks ask about."""
    blobs = [np.frombuffer(b, "<u4") for b in table.column("hashes").to_pylist()]
    _, place, n = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    shared, masks, lo = n[place] > 1, [], 0
    for b in blobs:
        masks.append(shared[lo : lo + len(b)])
        lo += len(b)
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "part": table.column("part"),
            "mask": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()),
        }
    )


def _answer(width: int):
    """Indexes a share of pieces and answers each chunk: for its pieces, strings that a smaller key than the
    chunk's own smallest also has."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        unpack = zstandard.ZstdDecompressor()
        seen: dict[bytes, int] = {}
        asked = []
        for r in rows:
            raw, ends = unpack.decompress(r["texts"]), np.cumsum(np.frombuffer(r["lengths"], "<u4")).tolist()
            asked.append([seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends], ends)])
        least = np.full(len(seen), LAST)
        owners = [np.frombuffer(r["owners"], "<i8") for r in rows]
        for numbers, own in zip(asked, owners):
            np.minimum.at(least, numbers, own)
        texts = list(seen)
        index = RunIndex(texts, least, width)
        found = index.stream()
        edge = np.concatenate([[0], np.cumsum(index.lengths)])
        strings = index.lengths - width + 1
        lowest = np.minimum.reduceat(found, edge[:-1])
        within = np.arange(len(found)) - np.repeat(edge[:-1], index.lengths)
        highest = np.maximum.reduceat(np.where(within < np.repeat(strings, index.lengths), found, -1), edge[:-1])
        out = []
        for r, numbers, own in zip(rows, asked, owners):
            numbers = np.array(numbers)
            hit = np.flatnonzero(lowest[numbers] < own)
            whole = hit[highest[numbers[hit]] < own[hit]]
            piece, start, n = whole.tolist(), [0] * len(whole), strings[numbers[whole]].tolist()
            for i in np.setdiff1d(hit, whole, assume_unique=True).tolist():
                t = numbers[i]
                older = found[edge[t] : edge[t] + strings[t]] < own[i]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], older.view(np.int8), [0]])))
                piece += [i] * (len(turns) // 2)
                start += turns[::2].tolist()
                n += (turns[1::2] - turns[::2]).tolist()
            if piece:
                out.append((r["chunk"], r["share"], *(np.array(x, "<u4").tobytes() for x in (piece, start, n))))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({c: pa.array(list(x), k) for c, x, k in zip(("chunk", "share", "piece", "start", "n"), columns, kinds)})

    return run


def find_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR
) -> DataFrame:
    """Per document the bytes to remove: those in a string of ``width`` bytes that also starts in a document with
    a smaller key.

    Texts are compared as UTF-8 bytes, each on its own; every string counts, overlapping or not, and is judged on the
    input. Columns: key, n_bytes, n_removed, n_spans and spans (maximal removed runs, first to before last
    byte), kept_sha256 (of the remaining bytes joined). Keys are integers.

    Missing, empty and short texts lose nothing. Documents of one key are no older than each other, so
    repeated rows do not remove each other; a missing key is larger than any other. Other columns are
    ignored.
    """
    if not 7 <= anchor <= width:
        raise ValueError("width must be at least the anchor's length, and that at least 7")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("__id"), F.col(f"`{text}`").alias("__text"))
    volume = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = max(24, int(volume // (REQUEST_BYTES * 4)))  # a hash of 4 bytes for about 16 bytes of text

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text", CHUNK_BYTES):
            texts = text_bytes(batch.column("__text"))
            data, lengths = b"".join(texts), [len(t) for t in texts]
            packed = Pieces(data, lengths, width, anchor).pack()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().int >> 65], pa.int64()),
                    pa.array([batch.column("__id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    *[pa.array([b], pa.binary()) for b in (data, *packed)],
                ],
                names=["chunk", "ids", "lengths", "data", "steps", "strings", "hashes"],
            )

    # Chunks are stored with their pieces, in buckets: answers then come to them, the texts are never shuffled, and their
    # strings are hashed once. Buckets follow the volume; with fewer than shuffle partitions, Spark would move the chunks.
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, int(volume // BUCKET_BYTES))
    (
        rows.mapInArrow(
            store,
            "chunk bigint, ids array<bigint>, lengths array<int>, data binary, steps binary, strings binary, hashes binary",
        )
        .write.option("compression", "zstd")
        .option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
        .bucketBy(buckets, "chunk")
        .saveAsTable(name, format="parquet")
    )
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the plan knows them

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, hashes, _ = _requests(np.frombuffer(row["hashes"], "<u8"), parts)
                heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
                stops = np.append(heads[1:], len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]] * len(heads), pa.int64()),
                        pa.array(part[heads], pa.int32()),
                        pa.array([hashes[a:b].tobytes() for a, b in zip(heads, stops)], pa.binary()),
                    ],
                    names=["chunk", "part", "hashes"],
                )

    asked = stored.select("chunk", "hashes").mapInArrow(ask, "chunk bigint, part int, hashes binary")
    marked = cut_lineage(asked.groupBy("part").applyInArrow(_common, "chunk bigint, part int, mask binary"))
    masks = marked.groupBy("chunk").agg(F.collect_list(F.struct("part", "mask")).alias("masks"))
    shares = max(24, int(volume // SHARE_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                pieces, owner = Pieces(row["data"], row["lengths"], width, anchor, row), _owners(row["ids"])
                _, _, texts, hashes, least = pieces.distinct(_chosen(pieces, owner, row["masks"], parts), owner, width)
                share = ((hashes >> U64(17)) % U64(shares)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                edges = np.searchsorted(share[order], np.arange(shares + 1))
                some = [s for s in range(shares) if edges[s + 1] > edges[s]]
                lists = [order[edges[s] : edges[s + 1]] for s in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]] * len(some), pa.int64()),
                        pa.array(some, pa.int32()),
                        pa.array([least[x].astype("<i8").tobytes() for x in lists], pa.binary()),
                        pa.array([np.array([len(texts[i]) for i in x], "<u4").tobytes() for x in lists], pa.binary()),
                        pa.array([pack.compress(b"".join([texts[i] for i in x])) for x in lists], pa.binary()),
                    ],
                    names=["chunk", "share", "owners", "lengths", "texts"],
                )

    sent = stored.join(masks, "chunk", "left").mapInArrow(
        send, "chunk bigint, share int, owners binary, lengths binary, texts binary"
    )
    answers = sent.groupBy("share").applyInArrow(
        _answer(width), "chunk bigint, share int, piece binary, start binary, n binary"
    )
    replies = cut_lineage(answers).groupBy("chunk").agg(
        F.collect_list(F.struct("share", "piece", "start", "n")).alias("replies")
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "n_bytes", "n_removed", "spans", "kept_sha256"]
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                pieces, owner = Pieces(row["data"], row["lengths"], width, anchor, row), _owners(row["ids"])
                at, number, texts, hashes, least = pieces.distinct(
                    _chosen(pieces, owner, row["masks"], parts), owner, width
                )
                share = ((hashes >> U64(17)) % U64(shares)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                edges = np.searchsorted(share[order], np.arange(shares + 1))
                marks = np.zeros(len(pieces.data) + 1, np.int64)
                # A piece whose whole text an older document of this chunk has too.
                later = owner[pieces.doc[at]] > least[number]
                np.add.at(marks, pieces.first[at[later]], 1)
                np.add.at(marks, pieces.stop[at[later]] - 1 + width, -1)
                by_text = np.argsort(number, kind="stable")
                heads = np.searchsorted(number[by_text], np.arange(len(texts) + 1))
                for r in row["replies"] or ():
                    piece, start, n = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("piece", "start", "n"))
                    text_no = order[edges[r["share"]] + piece]
                    times = heads[text_no + 1] - heads[text_no]
                    all_of = np.repeat(heads[text_no] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    begin = pieces.first[at[by_text[all_of]]] + np.repeat(start, times)
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + np.repeat(n, times) - 1 + width, -1)
                gone = np.cumsum(marks[:-1]) > 0
                out = {c: [] for c in names}
                for i, (a, b) in enumerate(zip(pieces.starts[:-1].tolist(), pieces.starts[1:].tolist())):
                    own = gone[a:b]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    kept, lo = hashlib.sha256(), 0
                    for x, y in turns.reshape(-1, 2).tolist():
                        kept.update(pieces.data[a + lo : a + x])
                        lo = y
                    kept.update(pieces.data[a + lo : b])
                    values = (
                        row["ids"][i],
                        b - a,
                        int(own.sum()),
                        [{"first": x, "last": y} for x, y in turns.reshape(-1, 2).tolist()],
                        kept.hexdigest(),
                    )
                    for c, value in zip(names, values):
                        out[c].append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds)], names=names)

    done = (
        stored.join(masks, "chunk", "left")
        .join(replies, "chunk", "left")
        .mapInArrow(
            remove,
            "__id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first: bigint, last: bigint>>, kept_sha256 string",
        )
    )
    return done.select(
        F.col("__id").alias(key), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "spans", "kept_sha256"
    )
