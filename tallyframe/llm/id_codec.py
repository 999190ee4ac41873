"""Blocks of token ids: adaptive order-0 to order-2 predictions, mixed, drive a range coder.

A block is cut into lanes of consecutive ids. All lanes take a step together: each codes its next id under the model
as it stood before the step, then the model learns what all of them coded. So a step is a handful of array
operations, coder and decoder go through the same states, and blocks stand alone. Everything is whole-number
arithmetic, the same on any machine.

Per id three predictions meet: what followed the last two ids, what followed the last one (both with a run of
confidence), and how frequent ids are. Whether the order-2 prediction holds, and if not whether the order-1 one does, is
mixed from the three orders' adaptive chances, in the logistic domain, by weights that learn; an id that neither
predicts is coded by the order-0 frequencies.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"TFID"
HEADER = struct.Struct("<4s7I")  # magic, ids, steps, vocabulary, digits, checksums of body, ids and header
STEPS = 512
BLOCK_IDS = 1 << 21

HASH_BITS = 18
SURE = 16  # levels of confidence in a prediction, 0: none yet
LEVELS = 20  # of an id's frequency, by doublings
ONE = 1 << 16  # probability one
LOGIT = 256  # one unit in the logistic domain
LOGIT_MAX = 2047
INCREMENT = 24  # what an occurrence adds to an id's frequency
FREQUENCY_MAX = 1 << 22
WEIGHT_ONE = 1 << 16
LEARN_SHIFT = 7

WINDOW, DIGIT = 28, 32
LOWEST = np.uint64(1 << WINDOW)
WINDOW_MASK = np.uint64((1 << WINDOW) - 1)
DIGIT_MASK = np.uint64((1 << DIGIT) - 1)
ID_MASK, ID_BITS = (1 << 24) - 1, 24

_CHANCE = np.array([round(ONE / (1 + math.exp(-x / LOGIT))) for x in range(-LOGIT_MAX, LOGIT_MAX + 1)], np.int64)


def _logit(p: int) -> int:
    x = (p + 0.5) / (ONE >> 4)
    return max(-LOGIT_MAX, min(LOGIT_MAX, round(LOGIT * math.log(x / (1 - x)))))


_LOGITS = np.array([_logit(p) for p in range(ONE >> 4)], np.int64)  # by the upper 12 bits of a probability
_SAID = np.clip(_CHANCE, 32, ONE - 64)

# A cell: confidence of order 2, of order 1, whether both predict the same, frequency of the id in question.
CELLS = (SURE, SURE, 2, LEVELS)


class _Mixer:
    """The chance, per cell, that a prediction holds: mixed from what each order's own context says.

    An order's own chance is a count of hits and trials that fades. The mixture is a weighted sum of logits; each set of
    cells has its own weights, which follow the error.
    """

    def __init__(self, sets: tuple[int, ...], open_cells: np.ndarray, table: np.ndarray):
        self.open_cells, self.table = np.broadcast_to(open_cells, CELLS).astype(np.int64), table.reshape(CELLS)
        # Without the axis of levels, the last one.
        self.rest = tuple(i for i in range(3) if i not in sets)
        # Which axes an order looks at: order 2 its confidence, order 1 its own and the agreement, order 0 the level.
        shapes = [[n if i in axes else 1 for i, n in enumerate(CELLS)] for axes in ((0,), (1, 2), (3,))]
        self.hits = [np.full(shape, 1, np.int64) for shape in shapes]
        self.trials = [np.full(shape, 4, np.int64) for shape in shapes]
        shape = [n if i in sets else 1 for i, n in enumerate(CELLS)]
        self.weights = [np.full(shape, WEIGHT_ONE * 2 // 5, np.int64) for _ in shapes]
        self.mix()

    def mix(self) -> None:
        self.logits = [_LOGITS[(h * (ONE - 1) // t) >> 4] for h, t in zip(self.hits, self.trials)]
        total = sum(w * x for w, x in zip(self.weights, self.logits))
        total >>= 16
        total += LOGIT_MAX
        self.said = _SAID.take(total, mode="clip")
        self.said *= self.open_cells
        self.table[...] = self.said

    def learn(self, hits: np.ndarray, trials: np.ndarray) -> None:
        hits, trials = hits.reshape(CELLS) * self.open_cells, trials.reshape(CELLS) * self.open_cells
        error = hits * ONE
        error -= trials * self.said
        # Sums over the levels first: what remains is small.
        over = lambda x, axes: np.add.reduce(x, axis=axes, keepdims=True)
        hits_left, trials_left, error_left = (over(x, 3) for x in (hits, trials, error))
        order0 = (error.reshape(-1, LEVELS) @ self.logits[2].reshape(-1)).reshape(error_left.shape)
        n = np.maximum(over(trials_left, self.rest), 1)
        for j, part in enumerate((error_left * self.logits[0], error_left * self.logits[1], order0)):
            weights = self.weights[j] + (over(part, self.rest) // n >> LEARN_SHIFT)
            self.weights[j] = np.minimum(np.maximum(weights, -4 * WEIGHT_ONE), 4 * WEIGHT_ONE)
        for counts, left, all_levels in ((self.hits, hits_left, hits), (self.trials, trials_left, trials)):
            counts[0] += over(left, (1, 2))
            counts[1] += over(left, 0)
            counts[2] += np.add.reduce(all_levels.reshape(-1, LEVELS), axis=0)
        for j, counted in enumerate(self.trials):
            if counted.max() > 1 << 16:
                old = counted > 1 << 16
                self.hits[j][old] = (self.hits[j][old] + 1) >> 1
                counted[old] = (counted[old] >> 1) + 2
        self.mix()


_C2, _C1, _AGREE, _ = np.ogrid[tuple(slice(n) for n in CELLS)]
N_CELLS = math.prod(CELLS)

# What confidence becomes, by twice the confidence plus whether the prediction held, moved to its place.
_SURER = np.array([x << ID_BITS for c in range(SURE) for x in (max(1, c >> 1), min(c + 1, SURE - 1))], np.int32)


class _Model:
    """Arrays are as narrow as their values allow: what a step looks up should stay in a core's caches."""

    def __init__(self, lanes: int, vocabulary: int):
        self.size = vocabulary
        self.counted = np.ones(vocabulary, np.int32)
        # Prediction + (confidence << ID_BITS), by a hash of the last two ids and, behind these, by the last id.
        self.after = np.zeros((1 << HASH_BITS) + vocabulary, np.int32)
        self.at = np.zeros((2, lanes), np.int64)
        self.at[1] = 1 << HASH_BITS
        self.last = np.zeros(lanes, np.int32)
        self.lane = np.arange(lanes)
        self.said = np.zeros((2, N_CELLS), np.uint32)
        self.second = _Mixer((0, 2), _C2 > 0, self.said[0])
        self.first = _Mixer((1,), (_C1 > 0) & ((_AGREE == 0) | (_C2 == 0)), self.said[1])
        self.cuts = np.zeros((4, lanes), np.uint64)
        self.step = self.n_seen = 0
        self.seen = np.zeros((2, 16, lanes), np.uint16)  # cells and what came of them
        self.seen_ids = []
        self.starts = np.zeros(vocabulary + 1, np.uint32)
        self.count_up()

    def count_up(self) -> None:
        """Order-0 frequencies as they are used until the next counting up."""
        self.frequency = self.counted.astype(np.uint32)
        np.cumsum(self.frequency, dtype=np.uint32, out=self.starts[1:])
        doublings = self.counted.astype(np.float32).view(np.int32) >> 23
        doublings -= 126 + 3
        self.level = np.minimum(np.maximum(doublings, 0, out=doublings), LEVELS - 1, out=doublings).astype(np.uint8)
        self.total = np.uint64(self.starts[-1])
        self.guess = None

    def ids_at(self, v: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold the values ``v``."""
        if self.guess is None:
            # The id that holds the first value of each 128 ones: nearly always the id looked for.
            firsts = (self.starts + np.uint32(127)) >> np.uint32(7)
            self.guess = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(firsts))
        found = self.guess.take(v >> np.uint32(7)).astype(np.int64)
        left = (self.starts[1:].take(found) <= v).nonzero()[0]
        found[left] = np.searchsorted(self.starts, v[left], side="right") - 1
        return found

    def predict(self, width: np.ndarray) -> np.ndarray:
        """The ids that order 2 and order 1 predict. What is below, between and above the two ends that follow belongs to
        order 2, order 1 and neither, as parts of ``width`` (``cuts``); the first two may be empty."""
        found = self.after.take(self.at)
        self.sure, predicted = found >> ID_BITS, found & ID_MASK
        cell = self.sure[0] * SURE
        cell += self.sure[1]
        cell <<= 1
        cell += predicted[0] == predicted[1]
        cell *= LEVELS
        self.cell = self.level.take(predicted) + cell
        x, y = self.said[0].take(self.cell[0]), self.said[1].take(self.cell[1])
        y *= np.uint32(ONE - 32) - x  # below 2 ** 32
        y >>= np.uint32(16)
        y += x
        unit = width >> np.uint64(16)
        np.multiply(unit, x, out=self.cuts[1])
        np.multiply(unit, y, out=self.cuts[2])
        np.left_shift(unit, np.uint64(16), out=self.cuts[3])
        self.predicted = predicted
        return predicted

    def part(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of ``cuts`` that ``event`` names begin, and their widths."""
        at = event * np.int64(len(self.lane))
        at += self.lane
        start = self.cuts.take(at)
        at += len(self.lane)
        return start, self.cuts.take(at) - start

    def learn(self, ids: np.ndarray, held: np.ndarray, event: np.ndarray) -> None:
        """``held``: which predictions are right. ``event``: 0 the order-2 one is coded, 1 the order-1 one, 2 neither."""
        kept = np.where(self.sure > 1, self.predicted, ids)
        self.sure <<= 1
        self.sure += held
        kept += _SURER.take(self.sure)
        self.after[self.at] = kept
        self.cell[0] *= 2
        self.cell[0] += event == 0
        self.cell[1] *= 3
        self.cell[1] += event
        self.seen[:, self.n_seen] = self.cell
        self.seen_ids.append(ids)
        self.n_seen += 1
        self.step += 1
        if self.step < 16 or self.step % (8 if self.step < 64 else 16) == 0:
            self._learn_cells()
            self.counted += INCREMENT * np.bincount(np.concatenate(self.seen_ids), minlength=self.size).astype(np.int32)
            if int(self.counted.sum()) > FREQUENCY_MAX:
                self.counted = (self.counted + 1) >> 1
            self.count_up()
            self.n_seen, self.seen_ids = 0, []
        both = self.last.view(np.uint32) * np.uint32(0x2F0B4C47)
        both += ids.view(np.uint32) * np.uint32(0x1E35A7BD)
        both >>= np.uint32(7)
        both &= np.uint32((1 << HASH_BITS) - 1)
        self.at[0] = both
        np.add(ids, 1 << HASH_BITS, out=self.at[1])
        self.last = ids

    def _learn_cells(self) -> None:
        second, first = self.seen[:, : self.n_seen].reshape(2, -1)
        missed, held = np.bincount(second, minlength=2 * N_CELLS).reshape(N_CELLS, 2).T
        self.second.learn(held, held + missed)
        _, held, missed = np.bincount(first, minlength=3 * N_CELLS).reshape(N_CELLS, 3).T
        self.first.learn(held, held + missed)


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps for ``n`` ids: few ids get short lanes, so that their steps are few."""
    steps = max(1, min(STEPS, 16 * math.isqrt(max(n, 1)) // 16 // 2))
    return -(-n // steps), steps


def _carry(lane: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Digits with what runs over added to the one before, as far as it goes."""
    while True:
        over = np.flatnonzero(digits >> np.uint64(DIGIT))
        if not len(over):
            return digits.astype("<u4")
        digits[over] &= DIGIT_MASK
        digits[over - 1] += np.uint64(1)  # never the first of a lane: its value stays below one


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of its own: header, digits per lane, digits."""
    n = len(ids)
    if n and not 0 <= int(ids.min()) <= int(ids.max()) < vocabulary <= 1 << 20:
        raise ValueError("ids must be below the vocabulary's size, and that at most 2 ** 20")
    lanes, steps = _lanes(n)
    plan = np.zeros(lanes * steps, np.int32)
    plan[:n] = ids
    plan = np.ascontiguousarray(plan.reshape(lanes, steps).T)
    model = _Model(lanes, vocabulary)
    low = np.zeros(lanes, np.uint64)
    width = np.full(lanes, 1 << (WINDOW + DIGIT), np.uint64)
    out_lane, out_digit = [], []

    def push() -> None:
        small = (width < LOWEST).nonzero()[0]
        if len(small):
            own = low[small]
            out_lane.append(small)
            out_digit.append(own >> np.uint64(WINDOW))
            own &= WINDOW_MASK
            low[small] = own << np.uint64(DIGIT)
            width[small] <<= np.uint64(DIGIT)

    for now in plan if n else ():
        predicted = model.predict(width)
        held = predicted == now
        is2 = held[0] & (model.cuts[1] > 0)
        is1 = held[1] & (model.cuts[2] > model.cuts[1])
        event = np.int8(2) - is1.view(np.int8)
        event *= (~is2).view(np.int8)
        start, width = model.part(event)
        low += start
        push()
        # Most lanes go on to the order-0 frequencies: all do, and the others keep what they have.
        rest, own = event == 2, now.astype(np.int64)
        unit = width // model.total
        low += unit * model.starts.take(own) * rest
        unit *= model.frequency.take(own)
        width = np.where(rest, unit, width)
        push()
        model.learn(now, held, event)
    if n:
        out_lane.append(np.arange(lanes))
        out_digit.append((low + WINDOW_MASK) >> np.uint64(WINDOW))
    lane = np.concatenate(out_lane) if n else np.zeros(0, np.int64)
    digits = np.concatenate(out_digit) if n else np.zeros(0, np.uint64)
    order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
    digits = _carry(lane[order], digits[order])
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + digits.tobytes()
    fields = (MAGIC, n, steps, vocabulary, len(digits), zlib.crc32(body), zlib.crc32(np.ascontiguousarray(ids, "<u4")))
    return HEADER.pack(*fields, zlib.crc32(repr(fields).encode())) + body


def block_size(header: bytes) -> int:
    """Bytes of a block after its header."""
    magic, n, steps, vocabulary, digits, body, ids, own = HEADER.unpack(header)
    if magic != MAGIC or zlib.crc32(repr((magic, n, steps, vocabulary, digits, body, ids)).encode()) != own:
        raise ValueError("no block of ids begins here, or its header is damaged")
    return 4 * (-(-n // steps) + digits)


def decode_block(block: bytes) -> np.ndarray:
    """The ids of one block, as little-endian unsigned 32-bit integers; a damaged block is an error."""
    _, n, steps, vocabulary, _, body_sum, id_sum, _ = HEADER.unpack(block[: HEADER.size])
    body = block[HEADER.size : HEADER.size + block_size(block[: HEADER.size])]
    if zlib.crc32(body) != body_sum:
        raise ValueError("a block of ids is damaged")
    lanes = -(-n // steps)
    if not n:
        return np.zeros(0, "<u4")
    per_lane = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    # Zeros follow each lane's digits.
    begin = np.cumsum(per_lane + 2) - (per_lane + 2)
    digits = np.zeros(int((per_lane + 2).sum()), np.uint64)
    place = np.repeat(begin - (np.cumsum(per_lane) - per_lane), per_lane) + np.arange(int(per_lane.sum()))
    digits[place] = np.frombuffer(body, "<u4", offset=4 * lanes)
    # From each digit on, the DIGIT bits that follow those in the window.
    after = (digits << np.uint64(WINDOW)) & DIGIT_MASK
    after[:-1] |= digits[1:] >> np.uint64(DIGIT - WINDOW)
    after = after.astype(np.uint32)
    code = (digits[begin] << np.uint64(WINDOW)) | (digits[begin + 1] >> np.uint64(DIGIT - WINDOW))
    at = begin + 1
    width = np.full(lanes, 1 << (WINDOW + DIGIT), np.uint64)

    def pull() -> None:
        small = (width < LOWEST).nonzero()[0]
        if len(small):
            here = at[small]
            code[small] = (code[small] << np.uint64(DIGIT)) | after.take(here, mode="clip")
            width[small] <<= np.uint64(DIGIT)
            at[small] = here + 1

    model = _Model(lanes, vocabulary)
    out = np.zeros((steps, lanes), np.int32)
    for now in out:
        predicted = model.predict(width)
        event = (code >= model.cuts[1]).view(np.int8) + (code >= model.cuts[2]).view(np.int8)
        start, width = model.part(event)
        code -= start
        pull()
        rest = event == 2
        unit = width // model.total
        v = np.minimum(code // unit, model.total - np.uint64(1))
        own = model.ids_at(v.astype(np.uint32))
        now[:] = np.where(rest, own, np.where(event == 0, predicted[0], predicted[1]))  # below 2 ** 20
        code -= unit * model.starts.take(own) * rest
        unit *= model.frequency.take(own)
        width = np.where(rest, unit, width)
        pull()
        model.learn(now, predicted == now, event)
    ids = out.view(np.uint32).T.reshape(-1)[:n].astype("<u4", copy=False)
    if zlib.crc32(ids) != id_sum:
        raise ValueError("the ids of a block do not match their checksum")
    return ids
