"""Quality rules as a bitmask ledger: every rule runs once, policies and ablations read the bits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import CHUNK_BYTES, SPACE, chunks, text_bytes, word_ids

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_doubled_words",
    "n_bang_words",
)


@dataclass(frozen=True)
class Rule:
    """Fails where ``failed`` holds, an SQL condition on the measurements. The bit never changes meaning."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "doubled_words", "100 * n_doubled_words > 30 * n_words"),
    Rule(4, "shouting", "10 * n_bang_words > n_words"),
    Rule(5, "duplicate_lines", "n_lines >= 5 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule(6, "word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules it rejects by."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(r.name for r in RULES))
POLICIES = (BASE, STRICT)


def _window_keys(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window's words and text."""
    m = len(ids) - width + 1
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = doc[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(width):
        key = key * np.uint64(0x100000001B3) + mixed[i : i + m]
    return key


def _repeated(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Words that lie in a window of ``width`` words found twice or more in the same text.

    Windows are compared by a hash first; equal hashes are then compared word by word, and in the
    unlikely case that two windows share one, all windows get exact numbers by doubling.
    """
    n = len(ids)
    covered = np.zeros(n, bool)
    if n < width:
        return covered
    doc = np.zeros(n, np.int64)
    np.add.at(doc, starts[1:][starts[1:] < n], 1)
    doc = np.cumsum(doc)
    m = n - width + 1
    whole = doc[:m] == doc[width - 1 :]
    key = _window_keys(ids, doc, width)
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    exact = (doc[a] == doc[b]) & np.all([ids[a + i] == ids[b + i] for i in range(width)], axis=0)
    if not exact.all():
        number, span = ids, 1
        while span < width:
            step = min(span, width - span)
            pair = number[: n - span - step + 1] * (int(number.max()) + 1) + number[step : n - span + 1]
            number = np.unique(pair, return_inverse=True)[1]
            span += step
        number = number * (int(doc[-1]) + 1) + doc[:m]
        order = at[np.argsort(number[at], kind="stable")]
        same = number[order][1:] == number[order][:-1]
        a, b = order[:-1][same], order[1:][same]
    edge = np.zeros(n + 1, np.int64)
    hit = np.unique(np.concatenate([a, b]))
    edge[hit] += 1
    edge[hit + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, list[int]]:
    """The measurements of each text, in the order given."""
    out: dict[str, list[int]] = {m: [] for m in MEASURES}
    words: list[bytes] = []
    starts = [0]
    for b in texts:
        own = b.split()
        words += own
        starts.append(len(words))
        lines = [line for line in b.split(b"\n") if line.strip(SPACE)]
        out["n_words"].append(len(own))
        out["word_chars"].append(len(b.translate(None, SPACE + CONTINUATION)))
        out["n_symbols"].append(len(b) - len(b.translate(None, SYMBOLS)))
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_bang_words"].append(sum(w.endswith(b"!!") for w in own) if b"!!" in b else 0)
    edges = np.array(starts)
    ids, _ = word_ids(words)
    repeated = np.concatenate([[0], np.cumsum(_repeated(ids, edges, WINDOW))])
    doubled = np.zeros(len(ids) + 1, np.int64)
    if len(ids):
        again = np.concatenate([[False], ids[1:] == ids[:-1]])
        again[edges[:-1][edges[:-1] < len(ids)]] = False
        doubled[1:] = np.cumsum(again)
    out["n_repeat_words"] = (repeated[edges[1:]] - repeated[edges[:-1]]).tolist()
    out["n_doubled_words"] = (doubled[edges[1:]] - doubled[edges[:-1]]).tolist()
    return out


def measured(docs: DataFrame, text: str, carry: Sequence[str]) -> DataFrame:
    """The columns ``carry`` as one struct ``__row``, and the measurements of ``text``."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"), F.col(f"`{text}`").cast("string").alias("__text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__text"):
            found = measure(text_bytes(part.column("__text")))
            arrays = [part.column("__row"), *[pa.array(found[m], pa.int64()) for m in MEASURES]]
            yield pa.RecordBatch.from_arrays(arrays, names=["__row", *MEASURES])

    schema = T.StructType([rows.schema["__row"], *[T.StructField(m, T.LongType()) for m in MEASURES]])
    return rows.mapInArrow(run, schema)


def failures(rules: Sequence[Rule] = RULES) -> Column:
    """One bit per failed rule."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per document the key, the measurements and ``failures``, one bit per failed rule.

    Write it once: policies and ablations need nothing else. A missing or empty text measures 0
    throughout; repeated rows give repeated results; other columns are ignored.
    """
    rows = measured(docs, text, [key])
    return rows.select(F.col(f"__row.`{key}`").alias(key), *MEASURES, failures(rules).alias("failures"))


def measurements(text: Column) -> Column:
    """The measurements of a text as a struct. Only the text goes to the worker; the row it belongs to stays."""

    @F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
    def of(texts: pa.Array) -> pa.Array:
        parts = [pa.RecordBatch.from_arrays([texts], names=["text"])]
        found = [measure(text_bytes(part.column("text"))) for part in chunks(iter(parts), "text", CHUNK_BYTES // 4)]
        return pa.StructArray.from_arrays([pa.array([n for f in found for n in f[m]], pa.int64()) for m in MEASURES], MEASURES)

    return of(text.cast("string"))


def passing(docs: DataFrame, policy: Policy, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with all their columns, whatever their names, and no shuffle.

    A missing or empty text measures 0 throughout; repeated rows are each judged alike; no rows in, none out.
    """
    rows = docs.select(F.struct("*").alias("__row"), measurements(F.col(f"`{text}`")).alias("__found"))
    judged = rows.select("__row", "__found.*").withColumn("failures", failures(rules))
    return judged.filter(~rejected(policy, rules)).select("__row.*")


def rejected(policy: Policy, rules: Sequence[Rule] = RULES, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) != 0


def ablate(entries: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy version and rule: documents that fail it, fail nothing else, and are kept without it.

    Documents are first counted per distinct set of failure bits, at most 2 to the number of rules.
    """
    sets = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    masks = F.array(
        *[
            F.struct(
                F.lit(p.version).alias("version"),
                F.lit(p.mask(rules)).cast("bigint").alias("mask"),
                F.lit(r.name).alias("rule"),
                F.lit(1 << r.bit).cast("bigint").alias("bit"),
            )
            for p in policies
            for r in rules
            if r.name in p.rules
        ]
    )
    each = sets.select("failures", "n", F.explode(masks).alias("m")).select("failures", "n", "m.*")
    hits = F.col("failures").bitwiseAND(F.col("mask"))
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy("version", "rule").agg(
        n(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n(hits == F.col("bit")).alias("n_only_this"),
        n(hits == 0).alias("n_kept"),
        n((hits == 0) | (hits == F.col("bit"))).alias("n_kept_without"),
    )
