"""Run-length index of a set of texts: a run-compressed Burrows-Wheeler transform with samples at run heads.

Texts are joined with separators that sort below all bytes and among each other by text. Kept are, per run of
the transform, its first row, and the row its first byte leads to; and per class of rows whose suffixes share
their first ``width`` bytes, its first row and its smallest owner. Rows inside a run keep their distance.
"""

from __future__ import annotations

import numpy as np

LEAST_WIDTH = 7
U64 = np.uint64


def _stable_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, equal ones by place, and the keys in it. Where key and place fit 64 bits together they are
    sorted as one number, which is many times faster than sorting places by key."""
    places = max(1, (len(key) - 1).bit_length())
    if bits + places <= 64:
        both = np.sort((key << U64(places)) | np.arange(len(key), dtype=U64))
        return (both & U64((1 << places) - 1)).astype(np.int64), both >> U64(places)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _starts(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


def _tied(values: np.ndarray) -> np.ndarray:
    """Whether a value equals a neighbour."""
    out = ~_starts(values)
    out[:-1] |= out[1:]
    return out


class RunIndex:
    def __init__(self, texts: list[bytes], owners: np.ndarray, width: int):
        """``owners`` holds one number per text; ``width`` is LEAST_WIDTH at least."""
        if width < LEAST_WIDTH:
            raise ValueError(f"width must be at least {LEAST_WIDTH}")
        self.width, self.lengths = width, np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        used = np.flatnonzero(np.bincount(raw, minlength=256))
        dense = np.zeros(256, np.uint16)
        dense[used] = np.arange(1, len(used) + 1)
        symbols = np.zeros(len(raw) + len(texts), np.uint16)
        ends = np.cumsum(self.lengths + 1) - 1
        body = np.ones(len(symbols), bool)
        body[ends] = False
        symbols[body] = dense[raw]
        order, same = self._sort(symbols, ends, max(1, len(used).bit_length()))
        owner = np.repeat(np.asarray(owners, np.int64), self.lengths + 1)[order]
        self.n = len(order)
        # Runs of the transform, and where the first row of each leads: rows of a symbol follow in order.
        last = symbols[order - 1]  # of the first text's first byte: a separator, which no step passes
        self.run_start = np.flatnonzero(_starts(last))
        run_symbol = last[self.run_start]
        run_length = np.diff(np.append(self.run_start, self.n))
        by_symbol = np.argsort(run_symbol, kind="stable")
        self.run_leads = np.empty(len(by_symbol), np.int64)
        self.run_leads[by_symbol] = np.cumsum(run_length[by_symbol]) - run_length[by_symbol]
        self.class_start = np.flatnonzero(~same)
        self.class_owner = np.minimum.reduceat(owner, self.class_start) if self.n else owner

    def _sort(self, symbols: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in suffix order, by doubling where suffixes still tie; whether a row shares ``width`` bytes with the last."""
        n = len(symbols)
        left = np.repeat(ends, self.lengths + 1) - np.arange(n)  # bytes before the separator
        depth = max(1, min(LEAST_WIDTH, (64 - max(1, n.bit_length())) // bits))
        key = np.zeros(n, U64)
        for i in range(depth):
            step = np.zeros(n, U64)
            step[: max(0, n - i)] = symbols[i:]
            step[left < i] = 0
            key = (key << U64(bits)) | step
        order, key = _stable_order(key, bits * depth)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(_starts(key), np.arange(n), 0))
        at = np.flatnonzero(_tied(key))
        shared = None
        longest = int(left.max(initial=0)) + 1
        while True:
            if shared is None and 2 * depth >= self.width:
                shared = depth, rank.copy()
            if depth >= longest or (not len(at) and shared is not None):
                break
            rows = order[at]
            # A suffix that ended within ``depth`` ties with its equals only, which stay in text order.
            after = np.where(left[rows] >= depth, rank[np.minimum(rows + depth, n - 1)] + 1, 0)
            half = (n + 1).bit_length()
            place, both = _stable_order((rank[rows].astype(U64) << U64(half)) | after.astype(U64), 2 * half)
            rows = rows[place]
            order[at] = rows
            rank[rows] = np.maximum.accumulate(np.where(_starts(both), at, 0))
            at = at[_tied(both)]
            depth *= 2
        depth, rank = shared if shared is not None else (depth, rank)
        a, b = order[:-1], order[1:]
        same = np.zeros(n, bool)
        shift = max(0, self.width - depth)
        far = lambda x: rank[np.minimum(x + shift, n - 1)]
        if n:
            same[1:] = (left[a] >= self.width) & (left[b] >= self.width) & (rank[a] == rank[b]) & (far(a) == far(b))
        return order, same

    def stream(self) -> np.ndarray:
        """For each byte of the texts in turn: the smallest owner of a text that holds the ``width`` bytes from
        there on, and the largest number where fewer are left.

        All texts are read backwards side by side: a step maps each one's row through the run that holds it. Once
        ``width`` bytes have matched, the row's class has the owner. Runs and classes are laid out by row
        for it, so that a step looks up two numbers.
        """
        runs = np.diff(np.append(self.run_start, self.n))
        leads = np.repeat(self.run_leads - self.run_start, runs) + np.arange(self.n)
        owner = np.repeat(self.class_owner, np.diff(np.append(self.class_start, self.n)))
        out = np.full(int(self.lengths.sum()), np.iinfo(np.int64).max)
        by_length = np.argsort(-self.lengths, kind="stable")
        falling, ends = self.lengths[by_length], np.cumsum(self.lengths)[by_length]
        row = by_length.copy()  # the separators' rows come first, in text order
        for matched in range(1, int(falling[0]) + 1 if len(falling) else 0):
            n = int(np.searchsorted(-falling, -matched, side="right"))
            row = leads[row[:n]]
            if matched >= self.width:
                out[ends[:n] - matched] = owner[row]
        return out
