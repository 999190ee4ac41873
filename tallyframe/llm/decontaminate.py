"""Benchmark decontamination over a stored, distributed positional inverted index.

The index is cut by documents: a segment holds whole documents of a few MB of text, its terms and,
per term, the delta-coded positions of all its words. A phrase is found inside one segment, so a search
reads the stored segments where they lie and shuffles nothing but its hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER_WORDS, chunks, numbered_words, text_bytes
from tallyframe.llm.marks import split_by_marks
from tallyframe.session import cut_lineage, ensure_checkpoint_dir

WINDOW = 10
SLOP = 2
BLOCK_WORDS = 200_000  # of test items that are searched for, and broadcast, at once
CANDIDATES = 250_000  # start positions that are held at once


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_WORDS).split()


# ---- index


def _pack(order: np.ndarray, counts: np.ndarray) -> bytes:
    """Positions, term after term, as differences in byte planes: the upper planes are almost empty."""
    gaps = np.diff(order, prepend=order.dtype.type(0))
    heads = np.cumsum(counts) - counts
    gaps[heads] = order[heads]
    return gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes, counts: np.ndarray) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    # 32 bits are enough: sums run over, and so do their differences.
    sums = np.cumsum(gaps, dtype=np.uint32)
    heads = np.cumsum(counts) - counts
    sums -= np.repeat(sums[heads] - gaps[heads], counts)
    return sums


def _segment(texts: list[bytes]) -> tuple[list[int], bytes, bytes, bytes]:
    ids, lengths, terms = numbered_words(texts, words_of)
    counts = np.bincount(ids, minlength=len(terms)) if terms else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    return lengths, b" ".join(terms), counts.astype("<u4").tobytes(), _pack(order, counts) if terms else b""


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the index of ``docs`` below the checkpoint folder and returns its segments.

    One row per segment: its name, the document keys in order with their numbers of words, the terms,
    how often each occurs, and the packed positions. Missing texts have no words.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__text"):
            lengths, terms, counts, positions = _segment(text_bytes(part.column("__text")))
            ids = part.column("__id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([terms], pa.binary()),
                    pa.array([counts], pa.binary()),
                    pa.array([positions], pa.binary()),
                ],
                names=["segment", "ids", "lengths", "terms", "counts", "positions"],
            )

    schema = f"segment string, ids array<{kind}>, lengths array<int>, terms binary, counts binary, positions binary"
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


# ---- test items


@dataclass
class Block:
    """Distinct phrases of some test items: term numbers, -1 beyond a short phrase's end."""

    terms: dict[bytes, int]
    phrases: np.ndarray
    lengths: np.ndarray
    owners: list[list[str]]


def _blocks(items: DataFrame, key: str, text: str, window: int, limit: int) -> Iterator[Block]:
    """Items stream through the driver; no more than ``limit`` words, or one item, are held at once."""
    terms: dict[bytes, int] = {}
    phrases: dict[tuple[int, ...], set[str]] = {}
    held = 0

    def block() -> Block:
        wide = np.full((len(phrases), window), -1, np.int64)
        for i, p in enumerate(phrases):
            wide[i, : len(p)] = p
        owners = [sorted(o) for o in phrases.values()]
        return Block(dict(terms), wide, (wide >= 0).sum(axis=1), owners)

    for row in items.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        words = words_of((row[1] or "").encode("utf-8", "surrogatepass"))
        numbers = [terms.setdefault(w, len(terms)) for w in words]
        for i in range(max(1, len(numbers) - window + 1)) if numbers else ():
            phrases.setdefault(tuple(numbers[i : i + window]), set()).add(row[0] or "")
        held += len(numbers)
        if held >= limit:
            yield block()
            terms, phrases, held = {}, {}, 0
    if phrases:
        yield block()


# ---- search


def _search(block: Block, starts: np.ndarray, terms: list[bytes], counts: np.ndarray, positions: bytes | pa.Buffer, slop: int):
    """(phrase, first word) of every match in a segment.

    Postings of the test terms become one sorted list of term * words + position. Each phrase starts
    from the list of its rarest term here, moved by that term's place in the phrase, and is then
    intersected with the moved lists of its other terms, rarest first. With ``slop`` each further term may
    stand that many words off its place, inside the same document.
    """
    n = int(starts[-1])
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not n or not len(block.phrases):
        return none
    number = np.fromiter((block.terms.get(t, -1) for t in terms), np.int64, len(terms))
    here = np.flatnonzero(number >= 0)
    freq = np.zeros(len(block.terms) + 1, np.int64)
    freq[number[here]] = counts[here]
    alive = np.flatnonzero((freq[block.phrases] > 0).all(axis=1, where=block.phrases >= 0))
    if not len(alive):
        return none
    everywhere, heads = _unpack(positions, counts), np.cumsum(counts) - counts
    here = here[np.argsort(number[here])]
    take = np.repeat(heads[here] - (np.cumsum(counts[here]) - counts[here]), counts[here]) + np.arange(counts[here].sum())
    postings = np.repeat(number[here], counts[here]) * n + everywhere[take]
    first = np.zeros(len(block.terms) + 1, np.int64)
    first[number[here]] = np.cumsum(counts[here]) - counts[here]

    phrases = block.phrases[alive]
    rank = np.argsort(np.where(phrases >= 0, freq[phrases], n + 1), axis=1, kind="stable")
    sorted_terms = np.take_along_axis(phrases, rank, axis=1)
    work = np.cumsum(freq[sorted_terms[:, 0]])
    found_p, found_s, lo = [], [], 0
    while lo < len(alive):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + CANDIDATES, side="right")))
        f = freq[sorted_terms[lo:hi, 0]]
        which = np.repeat(np.arange(lo, hi), f)
        at = np.repeat(first[sorted_terms[lo:hi, 0]] - (np.cumsum(f) - f), f) + np.arange(f.sum())
        anchor = postings[at] % n
        begin = anchor - rank[which, 0]
        doc = np.searchsorted(starts, anchor, side="right") - 1
        left, right = starts[doc], starts[doc + 1]
        size = block.lengths[alive[which]]
        ok = (begin >= left) & (begin + size <= right) if not slop else (begin + size > left) & (begin < right)
        which, begin, left, right = which[ok], begin[ok], left[ok], right[ok]
        for j in range(1, phrases.shape[1]):
            term, place = sorted_terms[which, j], begin + rank[which, j]
            low, high = np.maximum(place - slop, left), np.minimum(place + slop, right - 1)
            i = np.searchsorted(postings, term * n + low)
            near = postings[np.minimum(i, len(postings) - 1)]
            ok = (term < 0) | ((i < len(postings)) & (low <= high) & (near >= term * n + low) & (near <= term * n + high))
            which, begin, left, right = which[ok], begin[ok], left[ok], right[ok]
        found_p.append(alive[which])
        found_s.append(begin)
        lo = hi
    return np.concatenate(found_p), np.concatenate(found_s)


SPANS = "array<struct<first: int, last: int>>"


def search(index: DataFrame, block: Block, slop: int = SLOP) -> DataFrame:
    """Per document with a match: its place in the index, merged word spans and items of exact
    matches, and the items that match within ``slop`` words."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words, or one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                # One segment at a time, and its positions as they lie.
                row = {c: batch.column(c)[k] for c in ("segment", "lengths", "terms", "counts", "positions")}
                starts = np.concatenate([[0], np.cumsum(row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64))])
                counts = np.frombuffer(row["counts"].as_buffer(), "<u4").astype(np.int64)
                terms = row["terms"].as_py().split()
                out: dict[int, list] = {}
                for exact in (True, False):
                    p, s = _search(block, starts, terms, counts, row["positions"].as_buffer(), 0 if exact else slop)
                    docs = np.searchsorted(starts, np.maximum(s, 0) if exact else s + block.lengths[p] // 2, side="right") - 1
                    docs = np.clip(docs, 0, len(starts) - 2)
                    order = np.lexsort((s, docs))
                    for i in order:
                        spans, items, near = out.setdefault(int(docs[i]), [[], set(), set()])
                        (items if exact else near).update(block.owners[p[i]])
                        if exact:
                            a = int(s[i] - starts[docs[i]])
                            b = a + int(block.lengths[p[i]])
                            if spans and a <= spans[-1]["last"]:
                                spans[-1]["last"] = max(spans[-1]["last"], b)
                            else:
                                spans.append({"first": a, "last": b})
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["segment"].as_py()] * len(out)),
                            pa.array(list(out), pa.int32()),
                            pa.array([v[0] for v in out.values()], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                            pa.array([sorted(v[1]) for v in out.values()], pa.list_(pa.string())),
                            pa.array([sorted(v[2]) for v in out.values()], pa.list_(pa.string())),
                        ],
                        names=["segment", "place", "spans", "items", "near"],
                    )

    return index.select("segment", "lengths", "terms", "counts", "positions").mapInArrow(run, f"segment string, place int, spans {SPANS}, items array<string>, near array<string>")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slop: int = SLOP,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document which words lie in a phrase of a test item.

    Words: runs of digits, letters and non-ASCII characters, A-Z lower-cased. A phrase is ``window``
    consecutive words of an item; an item of fewer words is one phrase. Columns: key, n_words, n_hit
    (words inside an exact match), spans (merged, first to before last, by word), n_items and items
    (keys of items with an exact match, sorted as strings), n_near_items (items with all words of
    a phrase within ``slop`` words of their places).

    Missing, empty or wordless texts have no words and no hits, as have all texts if no item has words.
    Items that share a key count as one; a missing item key is the empty string. Repeated documents
    each get a row. Other columns are ignored.
    """
    index = build_index(docs, key, text)
    sizes = index.select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "d")).select(
        "segment", "place", F.col("d.ids").alias("__id"), F.col("d.lengths").cast("bigint").alias("n_words")
    )
    found = [cut_lineage(search(index, b, slop)) for b in _blocks(items, item_key, item_text, window, block_words)]
    empty = docs.sparkSession.createDataFrame([], f"segment string, place int, spans {SPANS}, items array<string>, near array<string>")
    hits = empty
    for part in found:
        hits = hits.unionByName(part)
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = hits.groupBy("segment", "place").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), distinct("items"), distinct("near")
    )
    hits = hits.withColumn(
        "spans",
        F.expr(
            f"""aggregate(spans, cast(array() as {SPANS}), (m, s) ->
            CASE WHEN size(m) > 0 AND s.first <= element_at(m, -1).last
            THEN concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first,
                 'last', greatest(element_at(m, -1).last, s.last))))
            ELSE concat(m, array(s)) END)"""
        ),
    )
    some = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return sizes.join(hits, ["segment", "place"], "left").select(
        F.col("__id").alias(key),
        "n_words",
        F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first)"), F.lit(0)).cast("bigint").alias("n_hit"),
        some("spans", SPANS),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        some("items", "array<string>"),
        F.coalesce(F.size("near"), F.lit(0)).cast("bigint").alias("n_near_items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a word in an exact match, with all columns, whatever their names. A row is judged
    by its own text, so it does not matter which other rows share its key or have none; rows of a missing or empty text
    stay, as do all if no item has words; no rows in, none out.

    Texts do not move: a bitmap of fixed size marks those with a match, and only marked rows, some of them by
    chance, are looked up among the matches.
    """
    digest = lambda t: F.unhex(F.md5(t.cast("binary")))
    t = F.col(f"`{text}`")
    texts = docs.select(digest(t).alias("__row"), t.alias("__text"))
    hits = decontaminate(texts, items, "__row", "__text").filter("n_hit > 0").select(F.col("__row").alias("__hit")).distinct()
    hits = cut_lineage(hits)
    marked, unmarked = split_by_marks(docs, F.xxhash64(digest(t)), hits.select(F.xxhash64("__hit").alias("id")))
    marked = marked.withColumn("__text", digest(F.col("__doc").getField(text)))
    dirty_free = marked.join(hits, F.col("__text") == F.col("__hit"), "left_anti")
    return unmarked.select("__doc.*").unionByName(dirty_free.select("__doc.*"))
