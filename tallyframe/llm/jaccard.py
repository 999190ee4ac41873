"""Exact Jaccard join of documents on word n-grams, with skipping by set relations.

Sets are ordered rarest shingle first and share a shingle of their prefixes if they link at all. Shingle lists
are cut into index partitions by hash. Position and size of an entry skip partners that cannot reach the
overlap any more, and parity bitmaps skip pairs that differ in too many shingles. Very long lists lie in blocks by size and
position; whole blocks that cannot reach the overlap with each other are skipped before any entry moves. Sets of a
list that are similar to one of its pivots are not paired: each is compared with one pivot, and answers among them are
derived from their few differences to it, only where they are not yet connected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import CHUNK_BYTES, LOWER, chunks, text_bytes, word_ids
from tallyframe.llm.graph import components
from tallyframe.llm.marks import marked, marks_of, split_by_marks
from tallyframe.session import cut_lineage, release

WIDTH = 4
PERCENT = 85
SKETCH_BITS = 21  # buckets that count shingles, as a power of 2: they order the work, never decide a link
SHORT_LIST = 24  # lists up to here are paired directly
BLOCK = 4096  # sets of a list or a pivot that are compared with each other in one task
PIVOTS = 6  # sets of a list that others may be near to
NEAR = 5  # of the eight parts of two sketches that agree: the sets are near
STAR = 256  # sets that are compared with their pivot in one place
DEPTHS = 4  # parts of the prefix that the blocks of a very long list tell apart
PART_BYTES = 8_000_000
U64 = np.uint64


def overlap_needed(m, n, percent: int):
    """Smallest intersection at which sets of m and n link."""
    return -(-(percent * (m + n)) // (100 + percent))


# ---- sets


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words; a shorter text is one shingle."""
    words: list[bytes] = []
    starts = [0]
    for b in texts:
        words += b.translate(LOWER).split()
        starts.append(len(words))
    ids, vocabulary = word_ids(words)
    if not vocabulary:
        return [np.zeros(0, U64) for _ in texts]
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], U64)[ids]
    n = len(hashed)
    rolled = np.zeros(n, U64)
    for i in range(min(width, n)):
        rolled[: n - i] = (rolled[: n - i] ^ hashed[i:]) * U64(0x9E3779B97F4A7C15)
        rolled[: n - i] ^= rolled[: n - i] >> U64(32)
    out = []
    for lo, hi in zip(starts, starts[1:]):
        if hi - lo < width:
            whole = xxhash.xxh3_64_intdigest(hashed[lo:hi].tobytes(), seed=hi - lo)
            out.append(np.array([whole] if hi > lo else [], U64))
        else:
            own = np.sort(rolled[lo : hi - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def signature(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def short(sig: bytes) -> int:
    """What stands for a set in lists and pairs; answers are kept by the whole signature's key."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _levels(sketch: np.ndarray) -> np.ndarray:
    """Rarity of each hash bucket: 0 up to the mean count, then four more for each doubling."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(1, sketch / max(1.0, sketch.mean()))))).astype(np.uint8)


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in rarity order: two sets that link have one of them in common."""
    bits = int(levels.size).bit_length() - 1
    order = np.argsort(levels[(shingles >> U64(64 - bits)).astype(np.int64)], kind="stable")
    return shingles[order[: len(shingles) - -(-percent * len(shingles) // 100) + 1]]


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of at least two buckets a shingle (a power of 2, from 64 on)."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


EIGHTHS = np.arange(8, dtype=U64) << U64(61)


def sketch(shingles: np.ndarray) -> int:
    """Eight times four bits: a hash of the first shingle from each eighth of the hash space on. Similar sets agree in most."""
    first = shingles[np.searchsorted(shingles, EIGHTHS) % len(shingles)]
    part = ((first * U64(0x9E3779B97F4A7C15)) >> U64(60)).astype(np.uint8)
    return int((part[:4] << 4 | part[4:]).view("<u4")[0])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least size of the symmetric difference, from bitmaps in the last axis: odd buckets differ at least once.
    The longer bitmap is folded until both have one length."""
    while x.shape[-1] > y.shape[-1]:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
    while y.shape[-1] > x.shape[-1]:
        y = y[..., : y.shape[-1] // 2] ^ y[..., y.shape[-1] // 2 :]
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


# ---- blobs: columns of numbers in byte planes


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel() if b else np.zeros(0, kind)


COLUMNS = (("h", "<u8"), ("sig", "<i8"), ("near", "<u4"), ("size", "<u4"), ("pos", "<u4"))


def _postings(rows: DataFrame, levels, width: int, percent: int, parts: int) -> DataFrame:
    """(part, a blob for each column): prefix entries with the sketch of their set, equal sets of a task merged."""

    def emit(held):
        h, sig, near, size, pos = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((sig, h))
        h, sig, near, size, pos = (x[order] for x in (h, sig, near, size, pos))
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])])
        cols = [x[first] for x in (h, sig, near, size, pos)]
        part = (cols[0] % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        cols = [x[order] for x in cols]
        some = [p for p in range(parts) if edges[p + 1] > edges[p]]
        arrays = [pa.array(some, pa.int32())]
        arrays += [pa.array([_planes(x[edges[p] : edges[p + 1]]) for p in some], pa.binary()) for x in cols]
        return pa.RecordBatch.from_arrays(arrays, names=["part", *[c for c, _ in COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        held, n = [], 0
        for part in chunks(batches, "__text"):
            keys = part.column("__id").to_pylist()
            for key, s in zip(keys, shingle_sets(text_bytes(part.column("__text")), width)):
                if key is None or not len(s):
                    continue
                p = prefix(s, table, percent)
                k = len(p)
                held.append((p, np.full(k, short(signature(s))), np.full(k, sketch(s), "<u4"), np.full(k, len(s), "<u4"), np.arange(k, dtype="<u4")))
                n += k
            if n > 2_000_000:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return rows.mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c, _ in COLUMNS))


def _near(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For k lists of n sketches each entry's group and the place of its pivot. A pivot is the first entry without a
    group, and those without one that are near to it join its group, from 1 on. Entries that are left or alone have 0."""
    k, n = sketches.shape
    own = np.ascontiguousarray(sketches).view(np.uint8).reshape(k, n, 4)
    own = np.concatenate([own >> 4, own & 15], axis=2)
    group, pivot = np.zeros((k, n), np.int64), np.tile(np.arange(n), (k, 1))
    free, lists = np.ones((k, n), bool), np.arange(k)
    for g in range(1, PIVOTS + 1):
        p = free.argmax(axis=1)
        near = free & ((own == own[lists, p][:, None]).sum(axis=2) >= NEAR)
        free &= ~near
        near &= near.sum(axis=1)[:, None] > 1
        group[near] = g
        pivot[near] = np.broadcast_to(p[:, None], (k, n))[near]
        if not free.any():
            break
    return group, pivot


def _candidates(percent: int):
    """An index partition: of the sets near a pivot each with the pivot (``far``, as a star's points are), the other
    pairs of lists that position and size allow, the entries of long lists where many pairs are left."""

    def run(table: pa.Table) -> pa.Table:
        h, sig, near, size, pos = (
            np.concatenate([_unplanes(b, kind) for b in table.column(c).to_pylist()]) for c, kind in COLUMNS
        )
        order = np.lexsort((sig, h))
        h, sig, near, size, pos = (x[order] for x in (h, sig, near, size.astype(np.int64), pos.astype(np.int64)))
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])])
        h, sig, near, size, pos = (x[first] for x in (h, sig, near, size, pos))
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lengths = np.diff(np.append(heads, len(h)))
        pairs, stars = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]

        def possible(a: np.ndarray, b: np.ndarray) -> None:
            reach = 1 + np.minimum(size[a] - pos[a] - 1, size[b] - pos[b] - 1)
            ok = reach >= overlap_needed(size[a], size[b], percent)
            ok &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
            ends = np.sort(np.stack([sig[a[ok]], sig[b[ok]]], axis=1), axis=1)
            pairs.append(np.unique(ends, axis=0))

        def grouped(at: np.ndarray) -> np.ndarray:
            group, pivot = _near(near[at])
            of = np.take_along_axis(at, pivot, axis=1)
            stars.append(np.unique(np.stack([sig[of[of != at]], sig[at[of != at]]], axis=1), axis=0))
            return group

        for n in range(2, SHORT_LIST + 1):
            at = heads[lengths == n]
            if len(at):
                i, j = np.triu_indices(n, 1)
                at = at[:, None] + np.arange(n)
                group = grouped(at) if n > 2 else np.zeros(at.shape, np.int64)
                other = (group[:, i] != group[:, j]) | (group[:, i] == 0)
                possible(at[:, i][other], at[:, j][other])
        label, long = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        for lo, n in zip(heads[lengths > SHORT_LIST], lengths[lengths > SHORT_LIST]):
            at = np.arange(lo, lo + n)
            label[at] = grouped(at[None])[0]
            count = np.bincount(label[at])
            count[0] = 0
            main = count.argmax()
            rest = at[(label[at] != main) | (label[at] == 0)]
            if 2 * len(rest) <= SHORT_LIST:
                a, b = np.repeat(rest, n), np.tile(at, len(rest))
                other = (a != b) & ((label[a] != label[b]) | (label[a] == 0))
                possible(a[other], b[other])
            else:
                long[at] = True
        pairs, stars = (np.unique(np.concatenate(x), axis=0) for x in (pairs, stars))
        blank = len(stars) + len(pairs), int(long.sum())
        join = lambda x, y, kind=pa.int64(): pa.concat_arrays(
            [pa.array(x, kind) if x is not None else pa.nulls(blank[0], kind), pa.array(y, kind) if y is not None else pa.nulls(blank[1], kind)]
        )
        ends = np.concatenate([stars, pairs])
        return pa.table(
            {
                "a": join(ends[:, 0], sig[long]),
                "b": join(ends[:, 1], None),
                "far": join(np.arange(blank[0]) < len(stars), None, pa.bool_()),
                "h": join(None, h[long].view(np.int64)),
                "size": join(None, size[long]),
                "pos": join(None, pos[long]),
                "near": join(None, label[long]),
            }
        )

    return run


def block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of very long lists in the pairs of blocks (r, c) in which they are rows or columns.

    ``entries``: h, a, size, pos, near and any other columns. ``near`` numbers the pivot that an entry is near to, 0 if
    to none. A cell holds a list's entries of like size, part of the prefix and pivot; a cell of more than BLOCK entries
    has several blocks, by hash. Two cells are not paired if the sizes are too far apart, if too few shingles are left
    behind the positions to reach the overlap, or if both are near one pivot; their entries are never copied for each other.
    """
    depth = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    part = F.least(F.floor(F.col("pos") * DEPTHS / depth), F.lit(DEPTHS - 1))
    band = F.floor(F.ln(F.col("size").cast("double")) / F.ln(F.lit(100.0 / percent)))
    cell = ((band * DEPTHS + part) * (PIVOTS + 1) + F.col("near").cast("int")).cast("int")
    placed = entries.withColumn("at", F.xxhash64("a")).withColumn("cell", cell)
    cells = placed.groupBy("h", "cell").agg(
        F.first(F.col("near").cast("int")).alias("near"),
        F.min("size").alias("low"),
        F.max("size").alias("high"),
        F.max(F.col("size") - F.col("pos")).alias("left"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"),
    )
    cells = cut_lineage(cells)
    one, two = (cells.select("h", *[F.col(c).alias(c + n) for c in cells.columns if c != "h"]) for n in "12")
    fit = (F.col("cell1") <= F.col("cell2")) & ((F.col("near1") == 0) | (F.col("near1") != F.col("near2")))
    fit &= (F.col("high1") * 100 >= F.col("low2") * percent) & (F.col("high2") * 100 >= F.col("low1") * percent)
    needed = F.ceil((F.col("low1") + F.col("low2")) * percent / (100 + percent))
    fit &= F.least("left1", "left2") >= needed
    pairs = one.join(two, "h").filter(fit).select("h", "cell1", "k1", "cell2", "k2")
    block = lambda c, i: F.concat_ws("-", F.col(c), i)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rows = placed.join(pairs.withColumn("cell", F.col("cell1")), ["h", "cell"]).withColumn("is_row", F.lit(True))
    rows = rows.withColumn("i", F.pmod("at", "k1").cast("int")).withColumn("j", every("k2"))
    cols = placed.join(pairs.withColumn("cell", F.col("cell2")), ["h", "cell"]).withColumn("is_row", F.lit(False))
    cols = cols.withColumn("j", F.pmod("at", "k2").cast("int")).withColumn("i", every("k1"))
    both = rows.unionByName(cols).filter("cell1 < cell2 OR i <= j")
    return both.withColumn("r", block("cell1", F.col("i"))).withColumn("c", block("cell2", F.col("j"))).select(
        *entries.columns, "at", "is_row", "r", "c"
    )


def _list_pairs(percent: int):
    """A block of rows and one of columns of a long list, or its entries, which are both: the pairs of sets not near one
    pivot that position, size and bitmaps allow."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: np.array(table.column(c).to_pylist()) for c in ("a", "size", "pos", "at", "near", "r", "c")}
        maps = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        sig, size, pos, at, near = (cols[c] for c in ("a", "size", "pos", "at", "near"))
        as_row = np.array([x is not False for x in table.column("is_row").to_pylist()])
        as_col = np.array([x is not True for x in table.column("is_row").to_pylist()])
        same = cols["r"][0] == cols["c"][0]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        widths = np.array([len(m) for m in maps])
        for w in np.unique(widths):
            for v in (x for x in (w // 2, w, w * 2) if (widths == x).any()):
                rows, columns = np.flatnonzero(as_row & (widths == w)), np.flatnonzero(as_col & (widths == v))
                if not len(rows) or not len(columns):
                    continue
                right = np.stack([maps[i] for i in columns])
                for r in (rows[i : i + 64] for i in range(0, len(rows), 64)):
                    m, n = size[r][:, None], size[columns]
                    ok = (near[r][:, None] != near[columns]) | (near[r][:, None] == 0)
                    ok &= sig[r][:, None] != sig[columns]
                    if same:
                        ok &= at[r][:, None] < at[columns]
                    ok &= 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
                    need = overlap_needed(m, n, percent)
                    ok &= 1 + np.minimum(m - pos[r][:, None] - 1, n - pos[columns] - 1) >= need
                    i, j = np.nonzero(ok)
                    for k in range(0, len(i), 20_000):
                        x, y = i[k : k + 20_000], j[k : k + 20_000]
                        left = np.stack([maps[q] for q in r])[x]
                        good = apart(left, right[y]) <= size[r[x]] + size[columns[y]] - 2 * need[x, y]
                        a.append(sig[r[x[good]]]), b.append(sig[columns[y[good]]])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _possible(met: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                most = m + n - 2 * overlap_needed(m, n, percent)
                keep.append(int(apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))) <= most)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("a", "b")], names=["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


# ---- answers


ANSWER = "p bigint, s bigint, ida bigint, idb bigint, linked boolean, na bigint, nb bigint, plus binary, minus binary"


def _against_pivots(width: int, percent: int):
    """Texts by the pivots p that they are compared with: whether their sets link. What a set has more and less than its
    pivot is told for ``far`` ones, unless all sets of the pivot are here and link."""

    def answers(group: list[tuple], sets: list[np.ndarray]) -> Iterator[tuple]:
        known = {(r["hub"], r["sig"]): (r, x) for r, x in zip(group, sets) if len(x) and signature(x) == r["sig"]}
        for hub, x in (v for v in known.values() if v[0]["hub"]):
            found = []
            for row, y in (v for v in known.values() if not v[0]["hub"]):
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = x[at] == y
                found.append((row, y, at, common, int(common.sum()) >= overlap_needed(len(x), len(y), percent)))
            closed = all(linked for *_, linked in found) and not hub["many"]
            for row, y, at, common, linked in found:
                plus = minus = None
                if row["far"] and not closed:
                    gone = np.ones(len(x), bool)
                    gone[at[common]] = False
                    plus, minus = y[~common].tobytes(), x[gone].tobytes()
                yield hub["s"], row["s"], hub["id"], row["id"], linked, len(x), len(y), plus, minus

    def run(table: pa.Table) -> pa.Table:
        names = ["p", "s", "id", "sig", "far", "hub", "many"]
        table = table.sort_by("p")
        packed = table.column("packed")
        rows = table.select(names).to_pylist()
        ends = [i for i in range(1, len(rows) + 1) if i == len(rows) or rows[i]["p"] != rows[i - 1]["p"]]
        out: list[tuple] = []
        start, texts, groups = 0, [], []
        held = 0
        for end in ends:
            own = [zlib.decompress(packed[i].as_py()) for i in range(start, end)]
            groups.append((rows[start:end], len(texts)))
            texts += own
            held += sum(map(len, own))
            start = end
            if held >= CHUNK_BYTES or end == len(rows):
                sets = shingle_sets(texts, width)
                for group, at in groups:
                    out += answers(group, sets[at : at + len(group)])
                texts, groups, held = [], [], 0
        kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.binary()] * 2
        cols = list(zip(*out)) if out else [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in ANSWER.split(", ")])

    return run


def _compare(rows: DataFrame, nodes: DataFrame, stars: DataFrame, width: int, percent: int) -> DataFrame:
    """Compares the sets s of ``stars`` (p, s, far) with their pivots p, from the texts that ``rows`` have.

    Only texts that are compared move, compressed, which is less than half of a set's hashes: by key to learn their pivots, then to these. A
    pivot of more than STAR sets is sent to several places.
    """
    spark = rows.sparkSession
    sizes = stars.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("k"))
    many = (F.col("k") > 1).alias("many")
    members = stars.join(sizes, "p").select("p", "s", "far", F.lit(False).alias("hub"), many, F.pmod(F.xxhash64("s"), F.col("k")).cast("int").alias("block"))
    hubs = sizes.select("p", F.col("p").alias("s"), F.lit(False).alias("far"), F.lit(True).alias("hub"), many, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"))
    roles = cut_lineage(members.unionByName(hubs).join(nodes.select("s", "id", "sig", "n"), "s"))
    shingles = roles.agg(F.sum("n")).first()[0] or 0
    places = max(24, shingles * 3 // PART_BYTES)  # a shingle takes some 3 bytes of compressed text
    roles = roles.drop("n").withColumn("place", F.pmod(F.xxhash64("p", "block"), F.lit(places)).cast("int")).drop("block")
    marks = spark.sparkContext.broadcast(marks_of(roles.select("id")))  # a bitmap of fixed size

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # a task's rows of one key and text are sent once
        for part in chunks(batches, "__text"):
            ids = part.column("__id")
            part = part.filter(pa.array(marked(marks.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(False)))
            own = {(i, xxhash.xxh3_128_digest(b)): b for i, b in zip(part.column("__id").to_pylist(), text_bytes(part.column("__text")))}
            own = {k: b for k, b in own.items() if k not in seen}
            seen.update(own)
            ids, packed = pa.array([i for i, _ in own], pa.int64()), pa.array([zlib.compress(b, 3) for b in own.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, packed], names=["id", "packed"])

    # The bitmap lets through the documents that are compared, and few others.
    placed = rows.mapInArrow(load, "id bigint, packed binary").join(roles, "id")
    answers = cut_lineage(placed.groupBy("place").applyInArrow(_against_pivots(width, percent), ANSWER))
    release(roles)
    return answers


def _matrix(sets: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(features)), np.float32)
    if len(features):
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(features, s), len(features) - 1)
            out[i, at[features[at] == s]] = 1
    return out


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Values that two of the sets have."""
    values, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, U64), return_counts=True)
    return values[n > 1]


def _derive(percent: int, step: int = 512):
    """Links among the sets of one pivot p, from their differences to it:
    |x & y| = |p| - |p-x| - |p-y| + |(p-x) & (p-y)| + |(x-p) & (y-p)|. Pairs of one component are skipped, also of one
    that links found here have joined: what a task returns spans its components, with fewer links than those."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, size, role, base = (
            np.array(table.column(c).to_pylist()) for c in ("id", "comp", "size", "is_row", "base")
        )
        plus, minus = (
            [np.frombuffer(b, U64) for b in table.column(c).to_pylist()] for c in ("plus", "minus")
        )
        rows, cols = np.flatnonzero(role), np.flatnonzero(~role)
        common_plus, common_minus = _shared(plus), _shared(minus)
        n_minus = np.array([len(m) for m in minus])
        names, comp = np.unique(comp, return_inverse=True)
        joined = np.arange(len(names))
        a, b = [], []
        for r in (rows[i : i + step] for i in range(0, len(rows), step)):
            for c in (cols[i : i + step] for i in range(0, len(cols), step)):
                ok = comp[r][:, None] != comp[c]
                low, high = np.minimum(size[r][:, None], size[c]), np.maximum(size[r][:, None], size[c])
                ok &= 100 * low >= percent * high
                if not ok.any():
                    continue
                both = base[r][:, None] - n_minus[r][:, None] - n_minus[c]
                for sets, features in ((plus, common_plus), (minus, common_minus)):
                    for f in (features[i : i + 8192] for i in range(0, len(features), 8192)):
                        both = both + _matrix([sets[i] for i in r], f) @ _matrix([sets[i] for i in c], f).T
                ok &= np.rint(both) >= overlap_needed(size[r][:, None], size[c], percent)
                i, j = np.nonzero(ok)
                ends, where = np.unique(np.stack([comp[r][i], comp[c][j]]), axis=1, return_index=True)
                for x, y, at in zip(*ends.tolist(), where.tolist()):
                    if joined[x] != joined[y]:
                        joined[joined == joined[y]] = joined[x]
                        a.append(ids[r][i[at]]), b.append(ids[c][j[at]])
                comp = joined[comp]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def link_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Per document its number of distinct shingles and its component under the link relation.

    Words are cut at ASCII white space and A-Z lower-cased; a set holds the distinct runs of ``width``
    words, or the one whole sequence of a shorter text. Documents link when 100 * intersection >=
    ``percent`` * union. Columns: key, n_shingles, component_id (the smallest key that links reach,
    its own included). Keys are integers.

    A missing, empty or wordless text has the empty set and links with nothing. Texts of equal sets are one
    node under their smallest key. Rows that repeat a key are one node. A row without a key links with
    nothing and has no component. Shingles are compared by 64-bit hash and equal sets by a 128-bit one.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("__id"), F.col(f"`{text}`").alias("__text"))
    buckets = 1 << SKETCH_BITS

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(buckets, np.int64)
        names = ["__id", "n_shingles", "sig", "s", "bits", "sketch"]
        for part in chunks(batches, "__text"):
            sets = shingle_sets(text_bytes(part.column("__text")), width)
            flat = np.concatenate(sets)
            sketch += np.bincount((flat >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=buckets)
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("__id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array([None if g is None else short(g) for g in sigs], pa.int64()),
                 pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.binary())],
                names=names,
            )
        if sketch.any():
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())],
                 pa.array([_planes(sketch.astype("<u4"))], pa.binary())],
                names=names,
            )

    surveyed = cut_lineage(
        rows.mapInArrow(survey, "__id bigint, n_shingles bigint, sig binary, s bigint, bits binary, sketch binary")
    )
    keys = surveyed.filter("sketch IS NULL").drop("sketch")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("sketch").to_pylist():
                total += _unplanes(b, "<u4")
        total = np.minimum(total, (1 << 32) - 1).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([_planes(total)], pa.binary())], names=["sketch"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add_up(batches):
            total = _unplanes(batch.column("sketch")[0].as_py(), "<u4")
            yield pa.RecordBatch.from_arrays([pa.array([_levels(total).tobytes()], pa.binary())], names=["levels"])

    sketches = surveyed.filter("sketch IS NOT NULL").select("sketch")
    some = max(1, int(sketches.count() ** 0.5))
    ranked = sketches.repartition(some).mapInArrow(add_up, "sketch binary").repartition(1)
    ranked = ranked.mapInArrow(rank, "levels binary").first()  # a byte for each of a fixed number of buckets
    table = np.frombuffer(ranked[0], np.uint8) if ranked else np.zeros(buckets, np.uint8)
    levels = spark.sparkContext.broadcast(table)
    shingles = keys.agg(F.sum("n_shingles")).first()[0] or 0
    entry = sum(np.dtype(kind).itemsize for _, kind in COLUMNS)
    n = shingles * (100 - percent) // 100 * entry // PART_BYTES
    parts = max(24, n)

    listed = cut_lineage(
        _postings(rows, levels, width, percent, parts)
        .groupBy("part")
        .applyInArrow(_candidates(percent), "a bigint, b bigint, far boolean, h bigint, size bigint, pos bigint, near bigint")
    )
    # Each set under the smallest key that has it.
    nodes = cut_lineage(
        keys.filter("sig IS NOT NULL AND __id IS NOT NULL")
        .groupBy("sig", "s")
        .agg(F.min("__id").alias("id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    )

    long = listed.filter("h IS NOT NULL").select("h", "a", "size", "pos", "near")
    lists = cut_lineage(long.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k")))
    entries = long.join(nodes.select(F.col("s").alias("a"), "bits"), "a")
    whole = entries.join(lists.filter("k = 1"), "h").drop("k").withColumn("at", F.xxhash64("a"))
    whole = whole.withColumn("is_row", F.lit(None).cast("boolean")).withColumn("r", F.lit("")).withColumn("c", F.lit(""))
    # Lists of more than one block.
    cut = cut_lineage(entries.join(lists.filter("k > 1"), "h").drop("k"))
    blocks = whole.unionByName(block_pairs(cut, percent))
    far_pairs = blocks.groupBy("h", "r", "c").applyInArrow(_list_pairs(percent), "a bigint, b bigint")
    pairs = listed.filter("NOT far").select("a", "b").unionByName(far_pairs).distinct()
    end = lambda x: nodes.select(*[F.col(c).alias(n) for c, n in (("s", x), ("n", f"n{x}"), ("bits", f"x{x}"))])
    pairs = cut_lineage(_possible(pairs.join(end("a"), "a").join(end("b"), "b"), percent))
    stars = cut_lineage(listed.filter("far").select(F.col("a").alias("p"), F.col("b").alias("s")).distinct())
    for done in (listed, lists, cut):
        release(done)

    # First each set with one pivot only, the smallest.
    hubs = cut_lineage(stars.groupBy("s").agg(F.min("p").alias("hub")))
    first = _compare(rows, nodes, hubs.select(F.col("hub").alias("p"), "s", F.lit(True).alias("far")), width, percent)
    edges = lambda answers: answers.filter("linked").select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    found = cut_lineage(components(edges(first)))
    of_node = nodes.join(found, F.col("id") == F.col("node"), "left").select("s", F.coalesce("component", "id").alias("comp"))
    of_node = cut_lineage(of_node)
    comp = lambda x: of_node.select(F.col("s").alias(x), F.col("comp").alias(f"comp_{x}"))
    # A star is done if all its sets have its pivot or the pivot's own one; else, and for all other pairs, what is connected is.
    own = F.when(F.col("hub") == F.col("p"), 1).when(F.col("hub") == F.col("above"), 2).otherwise(3)
    above = hubs.select(F.col("s").alias("p"), F.col("hub").alias("above"))
    kinds = stars.join(hubs, "s").join(above, "p", "left").select("p", own.alias("own"))
    mixed = kinds.groupBy("p").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("high = 3 OR low <> high")
    more = cut_lineage(stars.join(mixed.select("p"), "p").join(comp("s"), "s").join(comp("p"), "p"))
    split = more.groupBy("p").agg(F.min(F.least("comp_s", "comp_p")).alias("low"), F.max(F.greatest("comp_s", "comp_p")).alias("high"))
    more = more.join(split.filter("low <> high").select("p"), "p").select("p", "s", F.lit(True).alias("far"))
    apart_pairs = pairs.select(F.col("a").alias("p"), F.col("b").alias("s")).join(comp("p"), "p").join(comp("s"), "s").filter("comp_p <> comp_s")
    second = more.unionByName(apart_pairs.select("p", "s", F.lit(False).alias("far"))).groupBy("p", "s").agg(F.max("far").alias("far"))
    second = _compare(rows, nodes, cut_lineage(second), width, percent)
    found = cut_lineage(components(edges(first).unionByName(edges(second))))

    # Sets outside the largest part of their pivot's group may still link with others of the group.
    stars = first.unionByName(second.withColumn("p", F.xxhash64("p"))).filter("plus IS NOT NULL")
    pivots = stars.groupBy("p").agg(F.min("ida").alias("ida"), F.max("na").alias("na"))
    group = stars.select("p", F.col("idb").alias("id"), F.col("nb").alias("size"), F.col("na").alias("base"), "plus", "minus").unionByName(
        pivots.select("p", F.col("ida").alias("id"), F.col("na").alias("size"), F.col("na").alias("base"), F.lit(b"").alias("plus"), F.lit(b"").alias("minus"))
    )
    group = group.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "comp", F.coalesce("component", "id")
    )
    group = cut_lineage(group.drop("component"))
    for done in (first, second, hubs):
        release(done)
    parts_of = group.groupBy("p", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = parts_of.groupBy("p").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    split = main.filter("n > most").select(
        "p", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("kr"), F.ceil(F.col("n") / BLOCK).alias("kc")
    )
    open_group = group.join(split, "p")
    # Sets outside the largest part stand in rows, all sets in columns; a task has one block of each.
    place = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), (F.col(k) - 1).cast("int")))
    base = ["p", "id", "comp", "size", "base", "plus", "minus"]
    as_rows = open_group.filter("comp <> main").select(*base, F.lit(True).alias("is_row"), place("kr").alias("r"), every("kc").alias("c"))
    as_cols = open_group.select(*base, F.lit(False).alias("is_row"), every("kr").alias("r"), place("kc").alias("c"))
    derived = as_rows.unionByName(as_cols).groupBy("p", "r", "c").applyInArrow(_derive(percent), "a bigint, b bigint")
    derived = cut_lineage(derived.distinct())
    release(group)
    # Components that these links join: a small graph whose nodes are the components found before.
    comp_of = found.select(F.col("node").alias("x"), F.col("component").alias("y"))
    lift = derived
    for c in ("a", "b"):
        lift = lift.join(comp_of, F.col(c) == F.col("x"), "left").withColumn(c, F.coalesce("y", c)).drop("x", "y")
    merged = components(lift)
    final = found.unionByName(merged.join(found.select("node"), "node", "left_anti"))
    final = final.join(
        merged.select(F.col("node").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left"
    ).select("node", F.coalesce("new", "component").alias("component"))

    per_class = nodes.join(final, F.col("id") == F.col("node"), "left").select(
        "sig", F.coalesce("component", "id").alias("of_class")
    )
    return keys.join(per_class, "sig", "left").select(
        F.col("__id").alias(key),
        "n_shingles",
        F.when(F.col("__id").isNotNull(), F.coalesce("of_class", "__id")).alias("component_id"),
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, with all columns, whatever their names; of rows
    that repeat a key, one. Rows without a key stay.

    A bitmap of fixed size marks the keys that go or repeat. Rows without a mark stay where they are; only
    the marked ones, some of them by chance, are joined with the keys that stay.
    """
    linked = cut_lineage(link_documents(docs, key, text, width, percent).select(F.col(key).alias("id"), "component_id"))
    keys = linked.filter("id IS NOT NULL").groupBy("id").agg(F.min("component_id").alias("of"), F.count(F.lit(1)).alias("n"))
    id_of = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0))
    marked_rows, others = split_by_marks(docs, id_of, keys.filter("of <> id OR n > 1").select("id"))
    first = keys.filter("of = id").select(F.col("id").alias("__first"))
    own = marked_rows.withColumn("__key", F.col("__doc").getField(key)).withColumn("__hash", F.xxhash64(F.col("__doc").getField(text)))
    again = F.row_number().over(Window.partitionBy("__first").orderBy("__hash"))
    met = own.join(first, F.col("__key") == F.col("__first")).withColumn("__again", again).filter("__again = 1")
    parts = others, own.filter("__key IS NULL"), met
    return reduce(DataFrame.unionByName, [p.select("__doc.*") for p in parts])


def one_text_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each group of rows whose texts link, the row with the smallest key, with all columns, whatever their names
    and the text's length; a missing key comes last. Rows are told apart by key and text: rows that share a key or have none are compared like any others. Rows
    without words link with none; of those that repeat key and text one stays, and all that have no key.

    As in ``one_per_group`` only marked rows move, and of these only the ones with the text and key of a row that may
    stay, so copies that go do not; those of one text and key are merged before they do.
    """
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    row = F.xxhash64(t)
    digests = docs.select(row.alias("id"), F.md5(t.cast("binary")).alias("md5")).groupBy("id").agg(F.min("md5").alias("a"), F.max("md5").alias("b"))
    # Different texts with equal hashes: n * n / 2 ** 65 are to be expected of n texts. They get other hashes.
    clashes = [r[0] for r in digests.filter("a <> b").select("id").collect()]
    if clashes:
        row = F.when(row.isin(clashes), F.xxhash64(F.lit("again"), t)).otherwise(row)
    texts = docs.select(row.alias("__row"), t.alias("__text"))
    linked = cut_lineage(link_documents(texts, "__row", "__text", width, percent).select(F.col("__row").alias("id"), "component_id"))
    of = linked.groupBy("id").agg(F.min("component_id").alias("of"), F.count(F.lit(1)).alias("n"))
    least = docs.select(row.alias("id"), k.alias("least")).groupBy("id").agg(F.min("least").alias("least"))
    known = cut_lineage(of.join(least, "id"))
    order = F.struct(F.col("least").isNull().alias("none"), "least", "id")
    first = known.groupBy("of").agg(F.min(order).alias("m")).select("m.id", "m.least")
    first = cut_lineage(first)
    gone = known.join(first.select("id"), "id", "left_anti").select("id").unionByName(known.filter("n > 1").select("id"))
    marked_rows, others = split_by_marks(docs, row, gone)
    # Of the marked rows only those move that stand for a group, by their own text and key or by chance.
    stand = F.xxhash64("id", F.col("least").cast("bigint"))
    marks = docs.sparkSession.sparkContext.broadcast(marks_of(first.select(stand.alias("id"))))

    @F.arrow_udf("boolean")
    def stands(own: pa.Array) -> pa.Array:
        return pa.array(marked(marks.value, own.to_numpy(zero_copy_only=False)), pa.bool_())

    flat = [f.name for f in docs.schema if f.dataType.typeName() in ("string", "long", "integer", "double", "boolean")]
    field = F.col("__doc").getField
    wordless = ~F.coalesce(field(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    own = marked_rows.withColumn("__key", field(key)).withColumn("__wordless", wordless)
    own = own.withColumn("__stands", stands(F.xxhash64("__id", F.col("__key").cast("bigint"))))
    own = own.filter("__wordless OR __stands").drop("__stands")
    stay = own.filter("__wordless AND __key IS NULL")
    met = own.filter("NOT (__wordless AND __key IS NULL)").groupBy("__id", "__key").agg(
        F.min_by("__doc", F.xxhash64(*[field(c) for c in flat])).alias("__doc"), F.first("__wordless").alias("__wordless")
    )
    kept = first.select(F.col("id").alias("__first"), F.col("least").alias("__least"))
    met = met.join(kept, (F.col("__id") == F.col("__first")) & F.col("__key").eqNullSafe(F.col("__least")), "left")
    met = met.filter("__wordless OR __first IS NOT NULL")
    return reduce(DataFrame.unionByName, [p.select("__doc.*") for p in (others, stay, met)])
