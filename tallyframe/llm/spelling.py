"""Spelling variants: words one inserted, deleted or replaced letter apart, by bit-sliced position indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
DOMINANCE = 10  # how many times more frequent a form is than its variant
SHARE_ROWS = 1 << 16
HOT_ROWS = 1 << 14  # words of one key in one share; a key with more is cut into several
CELLS = 1 << 18  # 64-bit words in one state of the recurrence
ROUNDS = 5  # a form is DOMINANCE times more frequent, so chains in 64 bits are shorter than 2 ** ROUNDS


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, drop_every: int | None = None,
) -> DataFrame:
    """(word, n): runs of letters of ``least_length`` code points and ``least_count`` occurrences at least.

    Only A-Z are lower-cased. With ``drop_every`` a run loses the code point at crc32 % length, where the crc32 of
    ``<key>:<run>`` is a multiple of it: a reproducible typing error in one run of so many.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    run = F.col("run")
    runs = runs.select("id", F.translate(run, upper, upper.lower()).alias("run"))
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
        at = (h % F.char_length(run)).cast("int")
        short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
        runs = runs.select(F.when(h % drop_every == 0, short).otherwise(run).alias("run"))
        runs = runs.filter(F.char_length("run") >= least_length)
    return runs.groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# ---- the index


class SlicedIndex:
    """Words of one length, as a bitset per (position, letter): bit j tells whether word j has the letter there."""

    def __init__(self, codes: np.ndarray):
        self.size, self.length = codes.shape
        self.width = -(-self.size // 64)
        self.letters, self.bits = [], []
        for column in codes.T:
            letters, own = np.unique(column, return_inverse=True)
            slices = np.zeros((len(letters) + 1, self.width * 64), bool)  # the last one: a letter no word has here
            slices[own, np.arange(self.size)] = True
            self.letters.append(letters)
            self.bits.append(np.packbits(slices, axis=1, bitorder="little").view("<u8"))
        everyone = np.zeros(self.width * 64, bool)
        everyone[: self.size] = True
        self.everyone = np.packbits(everyone, bitorder="little").view("<u8")

    def having(self, position: int, letter: np.ndarray) -> np.ndarray:
        known = self.letters[position]
        at = np.minimum(np.searchsorted(known, letter), len(known) - 1)
        return self.bits[position][np.where(known[at] == letter, at, len(known))]

    def replaced(self, query: np.ndarray) -> np.ndarray:
        """Bitsets of the words that differ from each query, of the same length, in exactly one position."""
        none = np.repeat(self.everyone[None], len(query), 0)
        one = np.zeros_like(none)
        for i in range(self.length):
            here = self.having(i, query[:, i])
            one = (one & here) | (none & ~here)
            none &= here
        return one

    def longer(self, query: np.ndarray) -> np.ndarray:
        """Bitsets of the words that become each query, one letter shorter, when one of their letters goes."""
        none = np.repeat(self.everyone[None], len(query), 0)
        one = np.zeros_like(none)
        for i in range(self.length - 1):
            one = (one | none) & self.having(i + 1, query[:, i])
            none &= self.having(i, query[:, i])
        return one | none

    def search(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) numbers that are one error apart, for queries of this length or one letter less."""
        step = max(1, CELLS // self.width)
        match = self.replaced if query.shape[1] == self.length else self.longer
        for lo in range(0, len(query), step):
            sets = match(query[lo : lo + step])
            q, w = np.nonzero(sets)
            bits = np.unpackbits(sets[q, w].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
            hit, bit = np.nonzero(bits)
            yield q[hit] + lo, w[hit] * 64 + bit


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


INDEXED, PROBE, GUEST = 0, 1, 2  # a word of a key; a shorter one that looks for it; a word of another part of a hot key


def near_in_share(table: pa.Table) -> pa.Table:
    """Per row with near words under its key: how many, and the most frequent one."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    key, kind, is_right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "kind", "is_right"))
    length = np.array([len(w) for w in words], np.int64)
    meant = length + (kind == PROBE)  # the length of the words that a row looks for
    pairs = []
    for m in np.unique(length[kind == INDEXED]):
        indexed = np.flatnonzero((kind == INDEXED) & (length == m))
        codes = _codes([words[i] for i in indexed])
        index = SlicedIndex(codes)
        seekers = (np.append(indexed, np.flatnonzero((kind == GUEST) & (length == m))), np.flatnonzero((kind == PROBE) & (meant == m)))
        for i, rows in enumerate(seekers):
            query = _codes([words[r] for r in rows]) if len(rows) else np.zeros((0, m), "<u4")
            for q, w in index.search(query):
                a, b = rows[q], indexed[w]
                same = key[a] == key[b]
                if i:
                    # A pair that shares both halves' keys counts at the left one.
                    left = (query[q, : m // 2] == codes[w, : m // 2]).all(axis=1)
                    same &= ~(is_right[b] & left)
                a, b = a[same], b[same]
                pairs.append((a, b))
                if i:
                    pairs.append((b, a))
    own = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.int64)])
    other = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.int64)])
    rank = np.zeros(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    counts = np.diff(np.append(first, len(own)))
    return pa.table(
        {
            "word": pa.array([words[i] for i in own[first]], pa.string()),
            "n_near": pa.array(counts, pa.int64()),
            "best": pa.array([words[i] for i in other[first]], pa.string()),
            "best_n": pa.array(n[other[first]], pa.int64()),
        }
    )


# ---- Spark


def _row(kind: int, is_right: bool, length: Column, part: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(is_right).alias("is_right"),
        F.xxhash64(F.lit(is_right), length, part).alias("key"),
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words of a (word, n) table that have near ones.

    Of two near words one half of the longer one, or of either if they are equally long, is untouched. So every word is
    indexed under its length and each half, and looks itself up there and, as a shorter word, under
    the halves a longer one can share with it. Keys are dealt to shares; a share builds one index per word length.
    The words of a key that has more than HOT_ROWS are cut into parts, and who looks there visits every part.
    """
    word, m = F.col("word"), F.char_length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    ending = lambda n: F.substring(word, m - n + 1, n)
    longer = m + 1
    places = F.array(
        _row(INDEXED, False, m, F.substring(word, F.lit(1), half(m))),
        _row(INDEXED, True, m, ending(m - half(m))),
        _row(PROBE, False, longer, F.substring(word, F.lit(1), half(longer))),
        _row(PROBE, True, longer, ending(longer - half(longer))),
    )
    rows = words.select("word", "n", F.inline(places))
    per_key = rows.filter(F.col("kind") == INDEXED).groupBy("key").agg(F.count(F.lit(1)).alias("rows_in"))
    parts = F.ceil(F.col("rows_in") / HOT_ROWS).cast("int")
    # At most two rows for every HOT_ROWS words.
    hot = F.broadcast(per_key.filter(F.col("rows_in") > HOT_ROWS).select("key", parts.alias("parts")))
    own = F.pmod(F.xxhash64("word"), F.col("parts"))
    split = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = split.select(
        "word", "n", "key", "is_right",
        F.when((F.col("kind") == INDEXED), own).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    ).withColumn("kind", F.when(F.col("own").isNull(), PROBE).when(F.col("own") == F.col("part"), INDEXED).otherwise(GUEST))
    shares = max(1, -(-4 * words.count() // SHARE_ROWS))
    share = F.pmod(F.xxhash64("key", "part"), F.lit(shares)).alias("share")
    found = (
        dealt.select(share, "word", "n", "key", "is_right", "kind")
        .groupBy("share")
        .applyInArrow(near_in_share, "word string, n_near bigint, best string, best_n bigint")
    )
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("top"))
        .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.minus")).alias("best_n"))
    )


def _ends(forms: DataFrame) -> DataFrame:
    """(word, root) of a (word, form) table: each round doubles the steps taken along the forms."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut_lineage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        going_on = now.filter(F.col("next").isNotNull()).limit(1).count()
        now = now.select("word", "root")
        if not going_on:
            break
    return now


def group_variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """Per word of a (word, n) table: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its most
    frequent near word (ties: smallest in code point order), if that has ``dominance`` times its n; form and form_n
    are missing otherwise. Root: where following the forms ends, the word itself without a form. Words are distinct; an
    empty table gives none.
    """
    words = cut_lineage(words.select("word", "n"))
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= dominance * F.col("n")
    found = cut_lineage(
        near.select(
            "word", "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _ends(found.filter(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, dominance: int = DOMINANCE, drop_every: int | None = None,
) -> DataFrame:
    """:func:`group_variants` of the :func:`word_counts` of whole texts.

    Missing, empty and letterless texts have no words; a missing key counts as an empty one; repeated rows count each;
    runs of letters may be of any length. Other columns are ignored, whatever their names.
    """
    return group_variants(word_counts(docs, key, text, least_length, least_count, drop_every), dominance)
