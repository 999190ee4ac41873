"""Cross-entropy difference scores from matched target and background bigram models over all words of the corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import CHUNK_BYTES, HELD, LOWER, chunks, numbered_words, text_bytes
from tallyframe.llm.marks import marked, marks_of
from tallyframe.session import cut_lineage

PRIOR = 50.0  # words of unigram evidence that stand behind each context
FOLDS = 2
GROUPS = 2 * FOLDS  # fold, and whether a document is a target
PART_BYTES = 20_000_000
CHUNK_DOCS = 60_000  # numbered in 16 bits
SENT = 1 << 20  # bytes of a chunk's blobs that are sent on together
NUMBERED = 48_000  # words that make up a larger share of the corpus than 1 / NUMBERED have a number of 16 bits
FIRST, OTHER = 65_534, 65_535  # numbers of the start of texts and of words without a number
START = np.uint64(0x9E3779B97F4A7C15)  # the context of a text's first word
U64 = np.uint64
SIX = U64((1 << 48) - 1)

# What a part gets from a chunk, beside its words' hashes: per word the number of pairs; per pair the context's number, the
# hash of a context without one (48 bits, among the contexts of one word) and how many documents; per entry the document and
# how often. Then the words that end texts, per word their number, and the texts.
BLOBS = ("n_pairs", "contexts", "others", "n_docs", "docs", "times", "ends", "n_ends", "end_docs")


def _pack(blobs: tuple[bytes, ...]) -> bytes:
    sizes = np.array([len(b) for b in blobs], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(sizes + b"".join(blobs))


def _unpack(data: bytes) -> list[bytes]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    n = 4 * len(BLOBS)
    ends = n + np.cumsum(np.frombuffer(plain[:n], "<u4").astype(np.int64))
    return [plain[a:b] for a, b in zip([n, *ends[:-1].tolist()], ends.tolist())]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 16 bits, all low bytes first: they pack better."""
    return x.astype("<u2").view("u1").reshape(-1, 2).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(2, -1).T).view("<u2").reshape(-1)


def _ends(group: np.ndarray) -> bytes:
    """Where each of the first groups ends, among documents in the order of their groups."""
    return np.searchsorted(group, np.arange(1, GROUPS)).astype("<u2").tobytes()


def _group(ends: bytes, docs: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.frombuffer(ends, "<u2"), docs.astype("<u2"), side="right").astype(np.uint8)


def _six(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def fold_of(text: bytes) -> int:
    """Copies of a text share a fold, so none is scored by a model that has seen it."""
    return xxhash.xxh3_64_intdigest(text) % FOLDS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word of all texts, where each text starts, and the hashes of the numbered words."""
    ids, sizes, distinct = numbered_words(texts, tokens)
    return ids, np.cumsum([0, *sizes]), np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number per pair."""
    x = a + b * U64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination starts in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _small_rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, column):
        for lo in range(0, part.num_rows, CHUNK_DOCS):
            yield part.slice(lo, CHUNK_DOCS)


def frequent_words(texts: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words, sorted: those that make up half a part's share of the corpus, and all that make up
    1 / NUMBERED of it, with some a little below either.

    A task names the words that reach a quarter of that in one of its chunks, and their counts there; a frequent word
    keeps three quarters of its count that way at least. So there are fewer than three words for each part among the former,
    and 4 / 3 * NUMBERED at most among the latter.
    """
    wanted = min(1 / (2 * parts), 1 / NUMBERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small_rows(batches, "__text"):
            ids, _, hashes = word_hashes(text_bytes(part.column("__text")))
            n = np.bincount(ids, minlength=len(hashes))
            some = np.flatnonzero(n >= wanted / 4 * len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *hashes[some].view(np.int64).tolist()], pa.int64()), pa.array([len(ids), *n[some].tolist()], pa.int64())],
                names=["word", "n"],
            )

    counts = cut_lineage(texts.select("__text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0

    def reach(share: float) -> np.ndarray:
        found = counts.filter("word IS NOT NULL").filter(F.col("n") >= 0.75 * share * total).select("word").collect()
        return np.sort(np.array([r[0] for r in found], np.int64).view(U64))

    return reach(1 / (2 * parts)), reach(1 / NUMBERED)


def cross_entropy_difference(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target: str = "quality = 1",
    prior: float = PRIOR,
) -> DataFrame:
    """Per document its mean loss per token under both models: key, n_tokens, loss_target,
    loss_background, score (their difference: the lower, the more like the target).

    Target: documents with a row of ``labels`` where ``target`` holds; background: all others. Both models are
    bigram models with a unigram prior over one vocabulary, all words of all documents and one entry for others; unigrams
    are smoothed by one. Documents fall into two folds by a hash of their text, and each is scored by the
    counts of the other fold. A text's first word has the start of texts as its context.

    Missing, empty and wordless texts have no tokens, NULL losses and a NULL score. Repeated rows count and
    are scored each. A missing key has no label. Words are told apart by 64-bit hashes. Losses are natural logarithms
    rounded to 9 digits. Other columns are ignored.

    Bigrams are dealt by their second word, which lets a part count that word too: with its last places in texts known,
    also as a context. The bigrams of frequent words are dealt by both words; those words' counts are sent to
    all parts, three words for each part at most. So what the models hold grows with the input, and no part with a word.
    """
    spark = docs.sparkSession
    chosen = cut_lineage(labels.filter(target).select(F.col(f"`{key}`").alias("__l")).filter("__l IS NOT NULL").distinct())
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    volume = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = max(24, volume // PART_BYTES)
    hot, numbered = frequent_words(rows, parts)
    # Only rows whose key is marked as a target's move to meet the labels; any without a key are spread by their text.
    marks = spark.sparkContext.broadcast(marks_of(chosen.select(F.xxhash64("__l").alias("id"))))  # a bitmap of fixed size

    def by_mark(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_marked = marked(marks.value, batch.column("__mark").to_numpy())
            yield batch.filter(pa.array(is_marked == wanted)).select(["__id", "__text"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marked rows, their texts compressed for the way."""
        pack = zstandard.ZstdCompressor(level=6)
        for batch in by_mark(batches, True):
            texts = pa.array([pack.compress(b) for b in text_bytes(batch.column("__text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), texts], names=["__id", "__text"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for few in chunks(batches, "__text", CHUNK_BYTES // 3):  # texts are about three times as long
            texts = pa.array([unpack.decompress(b) for b in few.column("__text").to_pylist()], pa.binary())
            yield few.set_column(few.schema.get_field_index("__text"), "__text", texts)

    kind = rows.schema["__id"].dataType.simpleString()
    hashed = rows.withColumn("__mark", F.xxhash64("__id"))
    near = hashed.mapInArrow(packed, f"__id {kind}, __text binary")
    near = near.withColumn("__salt", F.when(F.col("__id").isNull(), F.xxhash64("__text")).otherwise(0))
    chosen = chosen.withColumn("__lsalt", F.lit(0).cast("bigint")).hint("merge")  # one plan at every size
    met = near.join(chosen, (F.col("__id") == F.col("__l")) & (F.col("__salt") == F.col("__lsalt")), "left")
    met = met.select("__id", "__text", F.col("__l").isNotNull().alias("__target"))
    hot_words = spark.sparkContext.broadcast(hot)  # fewer than three words for each part
    number_words = spark.sparkContext.broadcast(numbered)  # 64,000 at most

    def hot_index(hashes: np.ndarray) -> np.ndarray:
        """Place among the frequent words, -1 for others."""
        known = hot_words.value
        if not len(known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, -1)

    def code(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts as numbers of 16 bits, and the hashes of those without a number."""
        known = number_words.value
        at = np.minimum(np.searchsorted(known, contexts), max(len(known) - 1, 0))
        has = known[at] == contexts if len(known) else np.zeros(len(contexts), bool)
        number = np.where(contexts == START, FIRST, np.where(has, at, OTHER))
        return number.astype("<u2"), contexts[number == OTHER]

    def decode(numbers: np.ndarray, others: np.ndarray) -> np.ndarray:
        known = number_words.value
        out = np.full(len(numbers), START)
        has = numbers < FIRST
        out[has] = known[numbers[has]] & SIX
        out[numbers == OTHER] = others
        return out

    def part_of(x: np.ndarray) -> np.ndarray:
        return ((x * U64(0x9E3779B97F4A7C15)) >> U64(20)).astype(np.int64) % parts

    # Per chunk of texts: its documents and its counts of frequent words; and per part the bigrams of the part's words.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_hot = len(hot_words.value)
        names = ["chunk", "part", "ids", "sizes", "groups", "words", "data"]
        for batch in _small_rows(batches, "__text"):
            texts = text_bytes(batch.column("__text"))
            group = 2 * np.array([fold_of(b) for b in texts], np.int64)
            if "__target" in batch.schema.names:
                group += batch.column("__target").to_numpy(zero_copy_only=False)
            # Documents in the order of their groups: a part is told a few numbers, not one per document of the chunk.
            by_group = np.argsort(group, kind="stable")
            group, texts, keys = group[by_group], [texts[i] for i in by_group.tolist()], batch.column("__id").take(pa.array(by_group))
            ids, starts, hashes = word_hashes(texts)
            sizes = np.diff(starts)
            doc = np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)
            del texts
            before = np.append(np.int32(0), ids[:-1] + np.int32(1))[: len(ids)]
            before[starts[:-1][sizes > 0]] = 0
            last = ids[starts[1:][sizes > 0] - 1] if len(ids) else ids
            last_doc = np.flatnonzero(sizes)

            place = hot_index(hashes)
            sums = np.zeros((2, GROUPS, n_hot), np.int64)
            for k, (w, d) in enumerate(((ids, doc), (last, last_doc))):
                for lo in range(0, len(w), HELD):
                    at, g = place[w[lo : lo + HELD]], group[d[lo : lo + HELD]]
                    np.add.at(sums[k], (g[at >= 0], at[at >= 0]), 1)

            context = np.append(START, hashes)
            # By word and context; documents are in order already.
            both = ids.astype(np.int64) << 32
            both |= before
            del ids, before
            order = np.argsort(both, kind="stable")
            both, d = both[order], doc[order]
            del order, doc
            at = _runs(both, d)
            n = np.diff(np.append(at, len(d)))
            both, d = both[at], d[at]
            del at
            w, c = (both >> 32).astype(np.int32), both.astype(np.int32)
            del both
            # Counts are bytes: a larger one is several entries.
            if len(n) and n.max() > 255:
                more = -(-n // 255)
                w, c, d = np.repeat(w, more), np.repeat(c, more), np.repeat(d, more)
                rest = np.full(len(w), 255, np.uint8)
                rest[np.cumsum(more) - 1] = n - 255 * (more - 1)
            else:
                rest = n.astype(np.uint8)
            del n
            part_of_word = part_of(hashes).astype(np.int32)
            part = part_of_word[w]
            for lo in range(0, len(w), HELD):
                own = lo + np.flatnonzero(place[w[lo : lo + HELD]] >= 0)
                part[own] = part_of(_mix(context[c[own]], hashes[w[own]]))
            last_part = part_of_word[last]
            order = np.argsort(part, kind="stable")
            w, c, d, rest, part = w[order], c[order], d[order], rest[order], part[order]
            del order
            last_order = np.lexsort((last, last_part))
            last, last_doc, last_part = last[last_order], last_doc[last_order], last_part[last_order]
            edges, last_edges = (np.searchsorted(p, np.arange(parts + 1)) for p in (part, last_part))
            del part
            chunk = uuid.uuid4().hex
            groups = _ends(group)
            out = [(chunk, -1, keys.to_pylist(), sizes.tolist(), groups, sums.tobytes(), None)]
            kinds = [pa.string(), pa.int32(), pa.list_(keys.type), pa.list_(pa.int32()), *[pa.binary()] * 3]
            held = 0
            for p in np.flatnonzero((np.diff(edges) > 0) | (np.diff(last_edges) > 0)).tolist():
                a, b, e, f = edges[p], edges[p + 1], last_edges[p], last_edges[p + 1]
                pairs, words = _runs(w[a:b], c[a:b]), _runs(w[a:b])
                ends = _runs(last[e:f])
                numbers, others = code(context[c[a:b][pairs]])
                blobs = (
                    np.diff(np.append(np.searchsorted(pairs, words), len(pairs))).astype("<u4").tobytes(),
                    _planes(numbers),
                    _six(others),
                    np.diff(np.append(pairs, b - a)).astype("<u4").tobytes(),
                    _planes(np.diff(d[a:b], prepend=np.uint16(0))),  # words come in the order of their first documents: small steps
                    rest[a:b].astype("u1").tobytes(),
                    hashes[last[e:f][ends]].tobytes(),
                    np.diff(np.append(ends, f - e)).astype("<u4").tobytes(),
                    last_doc[e:f].astype("<u2").tobytes(),
                )
                out.append((chunk, p, None, None, groups, hashes[w[a:b][words]].tobytes(), _pack(blobs)))
                held += sum(map(len, out[-1][4:]))
                if held >= SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], names=names)

    schema = f"chunk string, part int, ids array<{kind}>, sizes array<int>, groups binary, words binary, data binary"
    plain = hashed.mapInArrow(lambda batches: count(by_mark(batches, False)), schema)
    counted = cut_lineage(plain.unionByName(met.mapInArrow(lambda batches: count(unpacked(batches)), schema)))
    heads = counted.filter("part < 0")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and texts per group, and the frequent words' counts."""
        n_hot = len(hot_words.value)
        total, each = np.zeros((2, GROUPS), np.int64), np.zeros((2, GROUPS, n_hot), np.int64)
        for batch in batches:
            for sizes, groups, sums in zip(*(batch.column(c).to_pylist() for c in ("sizes", "groups", "words"))):
                size = np.array(sizes, np.int64)
                group = _group(groups, np.arange(len(size)))
                total[0] += np.bincount(group, size, GROUPS).astype(np.int64)
                total[1] += np.bincount(group, size > 0, GROUPS).astype(np.int64)
                each += np.frombuffer(sums, np.int64).reshape(2, GROUPS, n_hot)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([each.tobytes()], pa.binary())], names=["total", "each"])

    def task_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per part the distinct words of a task's chunks, sorted: steps from one to the next, all low bytes first."""
        seen: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, words in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist()):
                seen.setdefault(p, []).append(words)
        for p, own in seen.items():
            words = np.unique(np.frombuffer(b"".join(own), U64))
            steps = np.diff(words, prepend=U64(0)).astype("<u8").view("u1").reshape(-1, 8).T.tobytes()
            data = zstandard.ZstdCompressor(level=1).compress(steps)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([data], pa.binary())], names=["part", "words"])

    def distinct_words(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        steps = [np.frombuffer(unpack.decompress(b), "u1").reshape(8, -1) for b in table.column("words").to_pylist()]
        words = np.unique(np.concatenate([np.cumsum(np.ascontiguousarray(x.T).view("<u8").reshape(-1), dtype=U64) for x in steps]))
        return pa.table({"n": pa.array([int((hot_index(words) < 0).sum())], pa.int64())})

    added = heads.select("sizes", "groups", "words").repartition(8).mapInArrow(add_up, "total binary, each binary").collect()
    total, each = np.zeros((2, GROUPS), np.int64), np.zeros((2, GROUPS, len(hot)), np.int64)
    for r in added:
        total += np.frombuffer(r["total"], np.int64).reshape(total.shape)
        each += np.frombuffer(r["each"], np.int64).reshape(each.shape)
    tail = counted.filter("part >= 0")
    v = 1 + len(hot) + (tail.select("part", "words").mapInArrow(task_words, "part int, words binary").groupBy("part").applyInArrow(distinct_words, "n bigint").agg(F.sum("n")).first()[0] or 0)
    shared = spark.sparkContext.broadcast((total, each))

    def losses(table: pa.Table) -> pa.Table:
        total, each = shared.value
        column = dict(zip(BLOBS, zip(*map(_unpack, table.column("data").to_pylist()))))
        column |= {c: table.column(c).to_pylist() for c in ("groups", "words")}
        read = lambda c, kind: [np.frombuffer(b, kind) for b in column[c]]
        words, ends = read("words", U64), read("ends", U64)
        n_words = np.cumsum([0, *map(len, words)])
        distinct, number = np.unique(np.concatenate([*words, *ends]), return_inverse=True)
        number = number.astype(np.int32)
        of_word, of_end = number[: n_words[-1]], number[n_words[-1] :]
        del words, ends, number
        pair_word = np.repeat(of_word, np.concatenate(read("n_pairs", "<u4")))
        pairs = _mix(decode(np.concatenate([_unplanes(b) for b in column.pop("contexts")]), _eight(b"".join(column.pop("others")))), distinct[pair_word])
        pairs, pair_at = np.unique(pairs, return_inverse=True)
        n_pairs, pair_at = len(pairs), pair_at.astype(np.int32)
        del pairs
        word_of_pair = np.zeros(n_pairs, np.int32)
        word_of_pair[pair_at] = pair_word
        del pair_word
        per_pair = read("n_docs", "<u4")
        n_entries = [int(x.sum()) for x in per_pair]
        entry = np.repeat(pair_at, np.concatenate(per_pair))
        del pair_at, per_pair
        doc, times = [np.cumsum(_unplanes(b), dtype=np.uint16) for b in column.pop("docs")], np.concatenate(read("times", "u1"))
        group = np.concatenate([_group(g, d) for g, d in zip(column["groups"], doc)])
        end_word = np.repeat(of_end, np.concatenate(read("n_ends", "<u4")))
        end_doc = read("end_docs", "<u2")
        end_group = np.concatenate([_group(g, d) for g, d in zip(column["groups"], end_doc)])

        place = hot_index(distinct)
        known = place >= 0
        blocks = [slice(lo, lo + HELD) for lo in range(0, len(entry), HELD)]
        out = []
        sums = np.zeros((2, len(entry)))
        end_sums = np.zeros((2, len(end_word)))
        for fold in range(FOLDS):
            mine_end = end_group // 2 == 1 - fold
            for m in (0, 1):
                g = 2 * fold + m
                both = np.zeros(n_pairs)  # whole numbers
                for b in blocks:
                    own = group[b] == g
                    np.add.at(both, entry[b][own], times[b][own].astype(np.float64))
                one = np.bincount(word_of_pair, both, len(distinct)).astype(np.int64)
                final = np.bincount(end_word[end_group == g], minlength=len(distinct))
                one[known], final[known] = each[0][g, place[known]], each[1][g, place[known]]
                uni = (one + 1) / (total[0][g] + v)
                as_context = np.log(one - final + prior)
                value = prior * uni[word_of_pair]
                value += both
                del both
                np.log(value, out=value)
                np.negative(value, out=value)
                value += as_context[word_of_pair]
                for b in blocks:
                    mine = np.flatnonzero(group[b] // 2 == 1 - fold)
                    sums[m, b][mine] = times[b][mine] * value[entry[b][mine]]
                end_sums[m][mine_end] = -as_context[end_word][mine_end]
        lo, end_lo = 0, 0
        for n, d, e in zip(n_entries, doc, end_doc):
            every = np.concatenate([d, e])
            docs_here, where = np.unique(every, return_inverse=True)
            values = [np.append(sums[m][lo : lo + n], end_sums[m][end_lo : end_lo + len(e)]) for m in (1, 0)]
            out.append((docs_here.astype("<u2").tobytes(), *[np.bincount(where, x, len(docs_here)).tobytes() for x in values]))
            lo, end_lo = lo + n, end_lo + len(e)
        return pa.table({"chunk": table.column("chunk"), **{c: pa.array(list(x), pa.binary()) for c, x in zip(("doc", "t", "b"), zip(*out))}})

    partial = tail.select("chunk", "part", "groups", "words", "data").groupBy("part").applyInArrow(losses, "chunk string, doc binary, t binary, b binary")
    nothing = [F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("binary").alias("groups")]
    pieces = partial.select("chunk", *nothing, "doc", "t", "b").unionByName(
        heads.select("chunk", "ids", "sizes", "groups", *[F.lit(None).cast("binary").alias(c) for c in ("doc", "t", "b")])
    )

    def gather(table: pa.Table) -> pa.Table:
        total = shared.value[0]
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        n = np.array(head["sizes"], np.int64)
        fold = _group(head["groups"], np.arange(len(n))) // 2
        # Every text with words has one word after the start.
        sums = np.log(total[1].reshape(FOLDS, 2) + prior)[1 - fold][:, ::-1].T.copy()
        for r in sorted((r for r in rows if r["ids"] is None), key=lambda r: r["doc"] + r["t"]):
            at = np.frombuffer(r["doc"], "<u2")
            for i, c in enumerate(("t", "b")):
                sums[i][at] += np.frombuffer(r[c])
        with np.errstate(invalid="ignore", divide="ignore"):
            t, b = np.round(sums / n, 9)
        empty = n == 0
        return pa.table(
            {
                "__id": pa.array(head["ids"], table.schema.field("ids").type.value_type),
                "n_tokens": pa.array(n),
                "loss_target": pa.array(t, pa.float64(), mask=empty),
                "loss_background": pa.array(b, pa.float64(), mask=empty),
            }
        )

    scored = pieces.groupBy("chunk").applyInArrow(
        gather, f"__id {kind}, n_tokens bigint, loss_target double, loss_background double"
    )
    return scored.select(
        F.col("__id").alias(key),
        "n_tokens",
        "loss_target",
        "loss_background",
        F.round(F.col("loss_target") - F.col("loss_background"), 9).alias("score"),
    )


