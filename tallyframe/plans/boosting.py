"""Second-order boosted trees on distributed histograms, with leaf-wise growth and early stopping by AUC.

Rows are binned once: a byte per feature, the last code for a missing value. Every step of a tree's growth is one scan
that adds up gradients, Hessians and rows per (node, feature, bin) in each task, and one shuffle of these sums, in which
the task of a feature finds its best split per node. Only splits reach the driver. Gradients are added as whole
numbers of 2 ** -30, so a fit does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import selectors
from tallyframe.session import cut_lineage, release

MISSING = 255
BINS = 254  # at most; bin codes are bytes
UNIT = 1 << 30
LEAST_GAIN = 1e-6
REFRESH = 16  # rounds after which the rows' margins are written anew
BUCKETS = 1 << 14  # of scores, for the AUC of each round


@dataclass(frozen=True)
class Settings:
    """``leaves`` bounds a tree's leaves, ``depth`` its depth; None: no such bound. Growth goes by the largest gain.

    A split needs ``min_child_weight`` of Hessian and ``min_rows`` rows on either side, and a gain above ``gamma``.
    ``row_share`` and ``column_share`` are drawn anew for each tree. Training stops after ``patience`` rounds without a better
    AUC on the validation rows. With ``from_average`` margins start at the log odds of the training rows, else at 0.
    """

    rounds: int
    step: float
    leaves: int | None
    depth: int | None
    min_child_weight: float
    min_rows: int
    reg_lambda: float
    reg_alpha: float
    gamma: float
    row_share: float
    column_share: float
    patience: int
    seed: int
    from_average: bool = False
    bins: int = BINS

    def with_rounds(self, rounds: int) -> Settings:
        return replace(self, rounds=rounds)


# Fixed values.
DEEP = Settings(
    rounds=3000, step=0.025, leaves=None, depth=6, min_child_weight=19, min_rows=1, reg_lambda=0.05, reg_alpha=0,
    gamma=0, row_share=0.8, column_share=0.632, patience=200, seed=42,
)
SHALLOW = Settings(
    rounds=4000, step=0.1, leaves=15, depth=None, min_child_weight=0.001, min_rows=20, reg_lambda=0, reg_alpha=0,
    gamma=0, row_share=0.9, column_share=0.9, patience=100, seed=314, from_average=True,
)


# ---- bins


def find_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature the upper ends of all bins but the last.

    A feature with ``bins`` distinct values or fewer has one bin per value; others are cut at approximate quantiles. A
    task tells at most ``bins`` values of a feature apart, and that many reach the driver.
    """
    if not 2 <= bins <= BINS:
        raise ValueError(f"bins must be from 2 to {BINS}")
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * len(features)
        for batch in batches:
            for i, known in enumerate(seen):
                if known is not None:
                    x = batch.column(i).to_numpy(zero_copy_only=False)
                    known = np.union1d(known, x[~np.isnan(x)])
                    seen[i] = known if len(known) <= bins else None
        rows = [(i, None if v is None else v.tolist()) for i, v in enumerate(seen)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
            names=["feature", "distinct"],
        )

    found = numbers.mapInArrow(distinct, "feature int, distinct array<double>")
    overfull = F.max(F.col("distinct").isNull())
    merged = found.groupBy("feature").agg(overfull.alias("many"), F.array_distinct(F.flatten(F.collect_list("distinct"))).alias("v"))
    cut = F.when(~F.col("many") & (F.size("v") <= bins), F.array_sort("v"))
    exact = {r["feature"]: r["v"] for r in merged.select("feature", cut.alias("v")).collect()}
    cuts = [np.array(exact.get(i) or [], np.float64)[:-1] for i in range(len(features))]
    many = [i for i in range(len(features)) if i in exact and exact[i] is None]
    if many:
        probs = [k / bins for k in range(1, bins)]
        x = lambda i: F.when(~F.isnan(f"x{i}"), F.col(f"x{i}"))
        row = numbers.agg(*[F.percentile_approx(x(i), probs, 40 * bins).alias(f"x{i}") for i in many]).first()
        for i, q in zip(many, row):
            cuts[i] = np.unique(np.array(q, np.float64))
    return cuts


def sparse_names(column: str, size: int) -> list[str]:
    """Feature names of the indicators of a sparse vector."""
    return [f"{column}_{i}" for i in range(size)]


def sparse_cuts(size: int) -> list[np.ndarray]:
    """Cuts of 0/1 features."""
    return [np.zeros(1)] * size


def bin_rows(
    df: DataFrame, id_col: str, target: str | None, features: Sequence[str], cuts: list[np.ndarray], keep: Sequence[str] = (),
    sparse: str | None = None,
) -> DataFrame:
    """id, keep..., label, row_hash, bins: one byte per feature, the number of cuts below the value.

    ``sparse`` names an array column of places (:func:`encode.hashed_indicators`), whose indicators come last: give
    :func:`sparse_names` and :func:`sparse_cuts` for them after the table's own features.
    """
    dense = [f for f in features if f in df.columns] if sparse else list(features)
    chosen = selectors.one_of(df, dense)
    label = F.col(f"`{target}`").cast("double") if target else F.lit(None).cast("double")
    plain = df.select(
        F.col(f"`{id_col}`"),
        *[F.col(f"`{c}`") for c in keep],
        label.alias("label"),
        F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, *keep)]).alias("row_hash"),
        *([F.col(f"`{sparse}`").cast("array<int>").alias("__sparse")] if sparse else []),
        F.array(*[F.col(f"`{c}`").cast("double") for c in chosen]).cast("array<double>").alias("bins"),
    )
    schema = plain.drop("bins", "__sparse").schema.add("bins", "binary")
    width = len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("bins").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
            codes = np.zeros((batch.num_rows, len(cuts)), np.uint8)
            for i, c in enumerate(cuts[:width]):
                codes[:, i] = np.searchsorted(c, x[:, i], side="left")
            codes[:, :width][np.isnan(x)] = MISSING
            if sparse:
                places = batch.column("__sparse")
                rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(places), 0).to_numpy())
                codes[rows, width + places.flatten().to_numpy()] = 1
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            own = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*own, packed], names=schema.names)

    return plain.mapInArrow(run, schema)


# ---- trees


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. Rows at most at ``bin`` go left; missing ones as told."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, cover: float, rows: int) -> int:
        for column, v in zip(vars(self).values(), (-1, 0, False, -1, -1, 0.0, 0.0, cover, rows)):
            column.append(v)
        return len(self.feature) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        missing_left = np.array(self.missing_left)
        rows = np.arange(len(bins))
        while True:
            rows = rows[feature[node[rows]] >= 0]
            if not len(rows):
                return node
            at = node[rows]
            code = bins[rows, feature[at]]
            go_left = np.where(code == MISSING, missing_left[at], code <= cut[at])
            node[rows] = np.where(go_left, left[at], right[at])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass(frozen=True)
class Booster:
    """``history``: per round the AUC on the validation rows and how far it can be off for counting in buckets."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    history: list[tuple[int, float, float]]

    @property
    def best_round(self) -> int:
        return len(self.trees)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.margin(bins) for t in self.trees), np.full(len(bins), self.base))

    def bin(
        self, df: DataFrame, id_col: str, target: str | None = None, keep: Sequence[str] = (), sparse: str | None = None
    ) -> DataFrame:
        return bin_rows(df, id_col, target, self.features, self.cuts, keep, sparse)

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """Binned rows with the probability of class 1 in place of their bins."""
        schema = rows.drop("row_hash", "bins").schema.add(name, "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = _probability(self.margins(_bins(batch.column("bins"), len(self.features))))
                columns = [batch.column(c) for c in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p)], names=schema.names)

        return rows.mapInArrow(run, schema)

    def nodes(self, spark) -> DataFrame:
        """All nodes of all trees: tree, node, feature (NULL of a leaf), threshold, missing_left, left, right, gain, cover, rows, value."""
        table = []
        for i, t in enumerate(self.trees):
            for n, f in enumerate(t.feature):
                inner = f >= 0
                split = (self.features[f], float(self.cuts[f][t.bin[n]]), bool(t.missing_left[n]), t.left[n], t.right[n]) if inner else (None,) * 5
                table.append((i, n, *split, float(t.gain[n]), float(t.cover[n]), int(t.rows[n]), float(t.value[n])))
        schema = (
            "tree int, node int, feature string, threshold double, missing_left boolean, left int, right int,"
            " gain double, cover double, rows bigint, value double"
        )
        return spark.createDataFrame(table, schema)

    def importance(self, spark, pattern: str = "") -> DataFrame:
        """Per feature its share of all splits' gain, of their cover (Hessian of the rows split) and of their number,
        ranked by gain from 1. One row per feature."""
        gain, cover, times = (np.zeros(len(self.features)) for _ in range(3))
        for t in self.trees:
            for f, g, c in zip(t.feature, t.gain, t.cover):
                if f >= 0:
                    gain[f] += g
                    cover[f] += c
                    times[f] += 1
        share = lambda x: (x / x.sum() if x.sum() else x).tolist()
        every = sorted(zip(self.features, share(gain), share(cover), share(times)), key=lambda r: (-r[1], r[0]))
        rows = [(n, g, c, f, i) for i, (n, g, c, f) in enumerate(every, 1) if re.search(pattern, n)]
        return spark.createDataFrame(rows, "feature string, importance double, cover double, frequency double, rank int")


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def _bins(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _draw(row_hash: np.ndarray, seed: int, salt: int) -> np.ndarray:
    """A number from 0 to 1 per row, by its hash."""
    x = row_hash.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + salt * 0xBF58476D1CE4E5B9) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


# ---- splits


@dataclass(frozen=True)
class Split:
    """Best split of a node, sums in units of UNIT; ``feature`` -1: there is none."""

    feature: int
    bin: int
    missing_left: bool
    gain: float
    left: tuple[int, int, int]
    all: tuple[int, int, int]

    @property
    def right(self) -> tuple[int, int, int]:
        return tuple(a - b for a, b in zip(self.all, self.left))


def _score(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """Loss reduction of a leaf with these sums, its weight being the best one."""
    g = np.sign(g) * np.maximum(np.abs(g) - s.reg_alpha, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + s.reg_lambda > 0, g * g / (h + s.reg_lambda), 0.0)


def leaf_value(sums: tuple[int, int, int], s: Settings) -> float:
    g, h = sums[0] / UNIT, sums[1] / UNIT
    g = np.sign(g) * max(abs(g) - s.reg_alpha, 0.0)
    return float(-s.step * g / (h + s.reg_lambda)) if h + s.reg_lambda > 0 else 0.0


def best_split(feature: int, sums: np.ndarray, n_cuts: int, s: Settings) -> Split:
    """Of one node's (code, [gradient, Hessian, rows]) sums of one feature, those of missing values last; ties go to the
    smaller bin, missing values right unless left is better."""
    everything = tuple(int(x) for x in sums.sum(0))
    none = Split(-1, 0, False, 0.0, (0, 0, 0), everything)
    if not n_cuts:
        return none
    below = np.cumsum(sums[:n_cuts], axis=0)
    best = none
    whole = np.array(everything)
    root = _score(np.array(whole[0] / UNIT), np.array(whole[1] / UNIT), s)
    for missing_left in (False, True):
        left = below + (sums[-1] if missing_left else 0)
        right = whole - left
        lg, lh, rg, rh = left[:, 0] / UNIT, left[:, 1] / UNIT, right[:, 0] / UNIT, right[:, 1] / UNIT
        gain = _score(lg, lh, s) + _score(rg, rh, s) - root
        least = s.min_child_weight
        fits = (lh >= least) & (rh >= least) & (left[:, 2] >= s.min_rows) & (right[:, 2] >= s.min_rows)
        gain = np.where(fits & (left[:, 2] > 0) & (right[:, 2] > 0), gain, -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > s.gamma + LEAST_GAIN and gain[i] > best.gain:
            best = Split(feature, i, missing_left, float(gain[i]), tuple(int(x) for x in left[i]), everything)
    return best


# ---- scans


@dataclass
class _Fit:
    """What the scans of a training need to know."""

    rows: DataFrame
    settings: Settings
    cuts: list[np.ndarray]
    fresh: list[Tree]  # trees whose values the rows' margins lack

    def scan(self, tree: Tree, nodes: Sequence[int], features: Sequence[int], number: int, auc: bool):
        """Best split per node over the features, and (AUC, its possible error) of the validation rows if asked for."""
        s, cuts, fresh, width = self.settings, self.cuts, list(self.fresh), len(self.cuts)
        nodes, features = list(nodes), list(features)
        place_of = np.full(max(len(tree.feature), 1), -1)
        place_of[nodes] = np.arange(len(nodes))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Per feature a cell for each of its bins and one for missing values.
            cells = [len(cuts[f]) + 2 for f in features]
            sums = [np.zeros((len(nodes) * n, 3), np.int64) for n in cells]
            scores = np.zeros((2, BUCKETS), np.int64)
            for batch in batches:
                bins = _bins(batch.column("bins"), width)
                margin = batch.column("margin").to_numpy()
                y = batch.column("label").to_numpy(zero_copy_only=False)
                train = batch.column("part").to_numpy() == 0
                drawn = np.flatnonzero(train & (_draw(batch.column("row_hash").to_numpy(), s.seed, number) < s.row_share))
                place = place_of[tree.leaf_of(bins[drawn])]
                here, place = drawn[place >= 0], place[place >= 0]
                # The trees that the margins lack are walked only for rows that count.
                if auc:
                    held = np.flatnonzero(~train)
                    p = _probability(sum((t.margin(bins[held]) for t in fresh), margin[held]))
                    bucket = np.minimum((p * BUCKETS).astype(np.int64), BUCKETS - 1)
                    for c in (0, 1):
                        scores[c] += np.bincount(bucket[y[held] == c], minlength=BUCKETS)
                bins, y = bins[here], y[here]
                p = _probability(sum((t.margin(bins) for t in fresh), margin[here]))
                g, h = np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)
                by_feature = np.ascontiguousarray(bins.T)
                for j, (f, n) in enumerate(zip(features, cells)):
                    at = place * n + np.minimum(by_feature[f], n - 1)
                    for k, w in enumerate((g, h, None)):
                        # Whole numbers: sums of a batch stay below 2 ** 53.
                        sums[j][:, k] += np.bincount(at, w, len(nodes) * n).astype(np.int64)
            keys, data = [*features], [x.tobytes() for x in sums]
            if auc:
                keys, data = [*keys, -1], [*data, scores.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["feature", "sums"])

        names = ["node", "feature", "bin", "missing_left", "gain", "left", "every"]

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, data in zip(batch.column("feature").to_pylist(), batch.column("sums").to_pylist()):
                    own = np.frombuffer(data, np.int64)
                    total[f] = total[f] + own if f in total else own
            out = []
            if -1 in total:
                out.append((-1, -1, 0, False, *_auc(total.pop(-1).reshape(2, BUCKETS))))
            for j, node in enumerate(nodes):
                found = [best_split(f, total[f].reshape(len(nodes), -1, 3)[j], len(cuts[f]), s) for f in sorted(total)]
                if found:
                    b = max(found, key=lambda x: (x.gain, -x.feature))
                    out.append((node, b.feature, b.bin, b.missing_left, b.gain, list(b.left), list(b.all)))
            columns = list(zip(*out)) if out else [[]] * len(names)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        tasks = min(len(features) + auc, int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sums = self.rows.select("bins", "label", "margin", "part", "row_hash").mapInArrow(add_up, "feature int, sums binary")
        schema = "node int, feature int, bin int, missing_left boolean, gain double, left array<bigint>, every array<bigint>"
        best: dict[int, Split] = {}
        judged = None
        # A row per node from each task that decides.
        for r in sums.repartition(max(1, tasks), "feature").mapInArrow(decide, schema).collect():
            if r["node"] < 0:
                judged = r["gain"], r["left"][0] / UNIT
                continue
            new = Split(r["feature"], r["bin"], r["missing_left"], r["gain"], tuple(r["left"]), tuple(r["every"]))
            old = best.get(r["node"])
            # The larger gain, then the smaller feature; any split before none.
            rank = lambda x: (x.feature >= 0, x.gain, -x.feature)
            if old is None or rank(new) > rank(old):
                best[r["node"]] = new
        return best, judged

    def refreshed(self) -> DataFrame:
        """The rows with margins that hold all trees so far, written anew."""
        fresh, width = list(self.fresh), len(self.cuts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _bins(batch.column("bins"), width)
                margin = sum((t.margin(bins) for t in fresh), batch.column("margin").to_numpy())
                i = batch.schema.get_field_index("margin")
                yield batch.set_column(i, "margin", pa.array(margin, pa.float64()))

        return cut_lineage(self.rows.mapInArrow(run, self.rows.schema))


def _auc(scores: np.ndarray) -> tuple[float, list[int], list[int]]:
    """Share of (positive, negative) pairs in order, those of one bucket half; half the share of the latter is the error."""
    neg, pos = scores
    below = np.cumsum(neg) - neg
    pairs = float(pos.sum()) * float(neg.sum())
    if not pairs:
        return 0.0, [0], [0]
    within = float((pos.astype(np.float64) * neg).sum())
    return float((pos * (below + neg / 2.0)).sum() / pairs), [round(within / 2 / pairs * UNIT)], [0]


def _grow(fit: _Fit, features: Sequence[int], number: int, auc: bool):
    """One tree, by the largest gain first.

    A scan finds the splits of all children that the leaves waiting to be split would have, as far as the tree has room for
    them, so a tree takes about as many scans as it has levels, and grows as if it took one per split.
    """
    s = fit.settings
    tree = Tree()
    tree.add(0.0, 0)
    splits, judged = fit.scan(tree, [0], features, number, auc)
    sums = {0: splits[0].all}
    depth, children = {0: 0}, {}
    room = s.leaves or (1 << (s.depth or 30))

    def may_split(node: int) -> bool:
        too_deep = s.depth is not None and depth[node] >= s.depth
        _, h, n = sums[node]
        return not too_deep and n >= 2 * max(s.min_rows, 1) and h >= 2 * s.min_child_weight * UNIT

    while True:
        waiting, chosen, leaves = [], [], 1
        if 0 in splits and splits[0].feature >= 0:
            waiting.append((-splits[0].gain, 0))
        while waiting and leaves < room:
            node = waiting[0][1]
            if node not in children:
                break
            heapq.heappop(waiting)
            chosen.append(node)
            leaves += 1
            for child in children[node]:
                if child in splits and splits[child].feature >= 0:
                    heapq.heappush(waiting, (-splits[child].gain, child))
        else:
            break
        unknown = []
        for _, node in heapq.nsmallest(room - leaves, waiting):
            if node in children:
                continue
            split = splits[node]
            children[node] = tree.add(0.0, 0), tree.add(0.0, 0)
            tree.feature[node], tree.bin[node], tree.missing_left[node] = split.feature, split.bin, split.missing_left
            tree.left[node], tree.right[node] = children[node]
            for child, own in zip(children[node], (split.left, split.right)):
                sums[child], depth[child] = own, depth[node] + 1
                if may_split(child):
                    unknown.append(child)
        if unknown:
            splits.update(fit.scan(tree, unknown, features, number, False)[0])

    # The nodes that were split, and the leaves below them.
    grown = Tree()

    def copy(node: int) -> int:
        _, h, n = sums[node]
        at = grown.add(h / UNIT, n)
        if node in taken:
            grown.feature[at], grown.bin[at], grown.missing_left[at] = tree.feature[node], tree.bin[node], tree.missing_left[node]
            grown.gain[at] = splits[node].gain
            grown.left[at], grown.right[at] = copy(children[node][0]), copy(children[node][1])
        else:
            grown.value[at] = leaf_value(sums[node], s)
        return at

    taken = set(chosen)
    copy(0)
    return grown, judged


def fit(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray], settings: Settings, validation: str | None = None) -> Booster:
    """Train on binned rows (:func:`bin_rows`) with a label of 0 or 1; those where the column ``validation`` is true only
    decide when to stop. Rows without a label are left out.

    The trees up to the best round are kept. Without validation rows of both classes all rounds are run. Each scan reads the
    rows once; margins are written anew every REFRESH rounds, and the copy before is deleted.
    """
    s = settings
    part = F.when(F.coalesce(F.col(validation), F.lit(False)), 1).otherwise(0) if validation else F.lit(0)
    known = rows.filter(F.col("label").isNotNull()).select("label", "row_hash", "bins", part.cast("int").alias("part"))
    base = 0.0
    if s.from_average:
        mean = known.filter("part = 0").agg(F.avg("label")).first()[0]
        if mean is not None and 0 < mean < 1:
            base = float(np.log(mean / (1 - mean)))
    state = _Fit(cut_lineage(known.withColumn("margin", F.lit(base))), s, cuts, [])
    n_features = max(1, int(s.column_share * len(features)))
    trees: list[Tree] = []
    history: list[tuple[int, float, float]] = []
    best = (0, -1.0)

    def worse(judged) -> bool:
        """Notes the AUC of the trees so far; whether patience is at its end."""
        nonlocal best
        if validation and judged and trees:
            history.append((len(trees), *judged))
            if judged[0] > best[1]:
                best = (len(trees), judged[0])
            return judged[0] > 0 and len(trees) - best[0] >= s.patience
        return False

    for number in range(s.rounds):
        drawn = _draw(np.arange(len(features)), s.seed + 1, number)
        chosen = sorted(np.argsort(drawn, kind="stable")[:n_features].tolist())
        tree, judged = _grow(state, chosen, number, validation is not None)
        if worse(judged) or not tree.rows[0]:
            break
        trees.append(tree)
        state.fresh.append(tree)
        if len(state.fresh) == REFRESH:
            old, state.rows, state.fresh = state.rows, state.refreshed(), []
            release(old)
    else:
        if validation and trees:
            worse(state.scan(Tree([-1], [0], [False], [-1], [-1], [0.0], [0.0], [0.0], [0]), [0], [0], s.rounds, True)[1])
    release(state.rows)
    if validation and best[1] > 0:
        trees = trees[: best[0]]
    return Booster(list(features), cuts, base, trees, history)
