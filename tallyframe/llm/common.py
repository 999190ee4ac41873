"""What several operators share: word rules on UTF-8 bytes, bounded chunks, hashed order keys."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\v\f\r"
# bytes.split() without an argument cuts at exactly these bytes: the word rule [^\x20\x09-\x0D]+.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; all else becomes a blank.
_WORD = {*range(48, 58), *range(97, 123), *range(128, 256)}
LOWER_WORDS = bytes(LOWER[b] if LOWER[b] in _WORD else 32 for b in range(256))

CHUNK_BYTES = 8_000_000
HELD = 1 << 17  # words, or counts, that are worked on at once where that needs much memory


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, whatever else ``df`` has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def hash_key(*parts: Column) -> Column:
    """32 hex digits, the same in any engine; a missing part counts as an empty one."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", *texts).cast("binary"))


def key_range(key: Column, ranges: int) -> Column:
    """Which of ``ranges`` equal pieces of the key space holds ``key``; follows the order of keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.lit(ranges) / F.lit(1 << 32)).cast("int")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; a missing one is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows holding about ``limit`` bytes of ``column``: one at least, a long text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column).cast(pa.binary())])
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def numbered_words(texts: list[bytes], words_of: Callable[[bytes], list[bytes]]) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Number of each word of all texts, in order of first appearance, each text's number of words, and the distinct
    words. Words are held for some texts at a time, and each distinct one to the end."""
    seen: defaultdict = defaultdict()
    seen.default_factory = seen.__len__
    ids, words, sizes = [np.zeros(0, np.int32)], [], []
    for b in texts:
        own = words_of(b)
        sizes.append(len(own))
        words += own
        if len(words) >= HELD:
            ids.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
            words = []
    ids.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
    seen.default_factory = None  # it holds the words in a circle, which would stay until garbage is collected
    return np.concatenate(ids), sizes, list(seen)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Dense ids of the words, in order of first appearance, and the distinct words."""
    seen: defaultdict = defaultdict()
    seen.default_factory = seen.__len__
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    seen.default_factory = None  # it holds the words in a circle, which would stay until garbage is collected
    return ids, list(seen)
