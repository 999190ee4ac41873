"""Boosted trees against a plain one-split-at-a-time version, and what each setting must do."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import coding, encode
from tallyframe.plans import boosting, model, train
from tallyframe.session import cut_lineage

NAMES = ["a", "b", "c", "d"]
PLAIN = replace(boosting.SHALLOW, rounds=3, row_share=1.0, column_share=1.0, from_average=False, patience=100)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.normal(size=n).round(1), rng.integers(0, 40, n)]).astype(float)
    y = ((x[:, 0] > 6) ^ (x[:, 1] > 2) | (rng.random(n) < 0.15)).astype(float)
    x[rng.random(n) < 0.2, 0] = np.nan
    rows = [(i, float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, y double, a double, b double, c double, d double")


@pytest.fixture(scope="module")
def binned(table):
    cuts = boosting.find_cuts(table, NAMES)
    return cuts, cut_lineage(boosting.bin_rows(table, "id", "y", NAMES, cuts).withColumn("held", F.col("id") % 5 == 0))


def arrays(rows):
    got = rows.orderBy("id").collect()
    return np.array([list(r.bins) for r in got], np.uint8), np.array([r.label for r in got])


def plain_tree(x, g, h, cuts, s):
    """Leaf-wise growth that looks at every leaf's rows again for each split; leaves as {rows: value}."""

    def best(rows):
        found = [
            boosting.best_split(f, sums(rows, f), len(cuts[f]), s) for f in range(x.shape[1])
        ]
        return max(found, key=lambda b: (b.feature >= 0, b.gain, -b.feature))

    def sums(rows, f):
        out = np.zeros((boosting.MISSING + 1, 3), np.int64)
        for r in rows:
            out[x[r, f]] += (int(g[r]), int(h[r]), 1)
        return out

    leaves = [(list(range(len(x))), 0)]
    while len(leaves) < (s.leaves or 10**9):
        options = [(best(rows), i) for i, (rows, depth) in enumerate(leaves) if s.depth is None or depth < s.depth]
        options = [(b, i) for b, i in options if b.feature >= 0]
        if not options:
            break
        b, i = max(options, key=lambda o: o[0].gain)
        rows, depth = leaves.pop(i)
        left = [r for r in rows if (b.missing_left if x[r, b.feature] == boosting.MISSING else x[r, b.feature] <= b.bin)]
        leaves += [(left, depth + 1), (sorted(set(rows) - set(left)), depth + 1)]
    value = np.zeros(len(x))
    for rows, _ in leaves:
        value[rows] = boosting.leaf_value((int(g[rows].sum()), int(h[rows].sum()), len(rows)), s)
    return value, len(leaves)


@pytest.mark.parametrize(
    "settings",
    [PLAIN, replace(PLAIN, leaves=None, depth=3, min_child_weight=5.0, reg_lambda=0.05), replace(PLAIN, reg_alpha=2.0, gamma=3.0)],
)
def test_fit_equals_the_plain_version(binned, settings):
    cuts, rows = binned
    got = boosting.fit(rows, NAMES, cuts, settings)
    x, y = arrays(rows)
    margin = np.zeros(len(x))
    for tree in got.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * boosting.UNIT), np.rint(p * (1 - p) * boosting.UNIT)
        value, leaves = plain_tree(x, g, h, cuts, settings)
        assert tree.feature.count(-1) == leaves
        assert tree.margin(x) == pytest.approx(value, abs=1e-12)
        margin += value
    assert len(got.trees) == 3
    again = boosting.fit(rows.repartition(3), NAMES, cuts, settings)
    assert [t.__dict__ for t in again.trees] == [t.__dict__ for t in got.trees]


def test_best_split_gain_by_hand():
    s = replace(PLAIN, reg_lambda=1.0, min_rows=1)
    sums = np.zeros((boosting.MISSING + 1, 3), np.int64)
    u = boosting.UNIT
    sums[0], sums[1], sums[boosting.MISSING] = (-2 * u, u, 4), (3 * u, 2 * u, 8), (-u, u, 4)
    got = boosting.best_split(7, sums, 1, s)
    # Missing left: 9 / 3 + 9 / 3 - 0 / 5; missing right: 4 / 2 + 4 / 4 - 0 / 5.
    assert (got.feature, got.bin, got.missing_left, got.gain) == (7, 0, True, 6.0)
    assert got.left == (-3 * u, 2 * u, 8) and got.right == (3 * u, 2 * u, 8)
    assert boosting.leaf_value(got.left, s) == pytest.approx(0.1)
    assert boosting.leaf_value(got.left, replace(s, reg_alpha=2.0)) == pytest.approx(0.1 / 3)
    for other in (replace(s, gamma=6.0), replace(s, min_child_weight=2.5), replace(s, min_rows=9), replace(s, reg_alpha=4.0)):
        assert boosting.best_split(7, sums, 1, other).feature == -1


def test_limits_of_size(binned):
    cuts, rows = binned
    wide = boosting.fit(rows, NAMES, cuts, PLAIN.with_rounds(1)).trees[0]
    assert wide.feature.count(-1) == 15
    assert all(n >= PLAIN.min_rows for n, f in zip(wide.rows, wide.feature) if f < 0)
    deep = boosting.fit(rows, NAMES, cuts, replace(boosting.DEEP, rounds=1, depth=2)).trees[0]
    assert deep.feature.count(-1) <= 4 and all(c >= 19 for c in deep.cover)
    assert [t.feature for t in boosting.fit(rows, NAMES, cuts, replace(PLAIN, gamma=1e9)).trees] == [[-1]] * 3


def test_patience_and_refreshed_margins(binned, monkeypatch):
    cuts, rows = binned
    monkeypatch.setattr(boosting, "REFRESH", 2)
    settings = replace(boosting.SHALLOW, rounds=40, step=0.9, patience=3)
    got = boosting.fit(rows, NAMES, cuts, settings, "held")
    rounds, aucs, errors = zip(*got.history)
    assert rounds == tuple(range(1, len(rounds) + 1)) and len(rounds) < 40
    assert got.best_round == int(np.argmax(aucs)) + 1 == len(rounds) - 3
    held = rows.filter("held")
    exact = model.auc(got.score(held).withColumn("label", F.col("label").cast("int")), "label", "score").first().auc
    assert abs(exact - max(aucs)) <= errors[got.best_round - 1] + 1e-12


def test_draws_follow_their_shares():
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 50_000)
    one, two = boosting._draw(h, 42, 0), boosting._draw(h, 42, 1)
    assert abs((one < 0.8).mean() - 0.8) < 0.01 and abs(np.corrcoef(one, two)[0, 1]) < 0.02
    assert (one == boosting._draw(h, 42, 0)).all()


def test_cuts(spark):
    df = spark.range(3000).select(
        (F.col("id") % 5).alias("few"),
        F.col("id").cast("double").alias("many"),
        F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(1.0).alias("one"),
    )
    few, many, none, one = boosting.find_cuts(df, ["few", "many", "none", "one"], 100)
    assert few.tolist() == [0, 1, 2, 3] and none.tolist() == [] and one.tolist() == []
    assert 90 <= len(many) <= 99 and max(np.diff(many)) < 50
    rows = boosting.bin_rows(df, "many", None, ["few", "none", "one"], [few, none, one]).orderBy("many").limit(6).collect()
    m = boosting.MISSING
    assert [list(r.bins) for r in rows] == [[0, m, m], [1, m, 0], [2, m, m], [3, m, 0], [4, m, m], [0, m, 0]]


def test_empty_and_one_class_inputs(spark, binned):
    cuts, rows = binned
    assert boosting.fit(rows.filter("id < 0"), NAMES, cuts, PLAIN, "held").trees == []
    one = boosting.fit(rows.filter("label = 1"), NAMES, cuts, replace(PLAIN, rounds=2), "held")
    assert [a for _, a, _ in one.history] == [0.0, 0.0] and one.trees[0].value[0] > 0


# ---- codes of text columns


def test_codes_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(coding, "RANGE_VALUES", 3)
    values = ["b", "a", "Z", "é", "", "aa", "漢", "b", None, "10", "9"]
    df = spark.createDataFrame([(i, v, v and v[:1]) for i, v in enumerate(values)], "id int, t string, u string")
    codes = coding.code_table(df, ["t", "u"])
    for c in ("t", "u"):
        known = sorted({r[c] for r in df.collect()} - {None})
        got = {r.value: r.code for r in codes.filter(F.col("variable") == c).collect()}
        assert got == {v: i for i, v in enumerate(known, 1)}
    other = spark.createDataFrame([(1, "aa", None), (2, "new", "a"), (3, None, "b")], "id int, t string, u string")
    got = coding.apply_codes(other, codes, ["t", "u"]).orderBy("id").collect()
    known = sorted(set(values) - {None})
    assert [r.t for r in got] == [known.index("aa") + 1, coding.UNSEEN, None] and got[0].u is None and got[1].u > 0
    assert coding.apply_codes(df, codes, ["t"]).count() == len(values)
    assert coding.code_table(df, []).count() == 0 and coding.code_table(df.filter("id < 0"), ["t"]).count() == 0


def test_text_columns_reach_the_model(spark, tmp_path):
    df = spark.range(900).select(
        "id",
        F.when(F.col("id") % 6 > 0, (F.col("id") % 10 > 7).cast("int")).alias("y"),
        F.element_at(F.array(*[F.lit(v) for v in "jihgfedcba"]), (F.col("id") % 10 + 1).cast("int")).alias("LETTER"),
        (F.col("id") % 7).alias("NOISE"),
    )
    done = train.train(df, "id", "y", boosting.SHALLOW.with_rounds(3))
    assert done.metric > 0.99 and done.features == ["LETTER", "NOISE"]
    ranked = done.importance().orderBy("rank").collect()
    assert ranked[0].feature == "LETTER" and sum(r.frequency for r in ranked) == pytest.approx(1)
    path = done.write(str(tmp_path), "id")
    back = spark.read.csv(path, header=True, inferSchema=True)
    assert back.count() == 150 and back.filter("TARGET <= 0 OR TARGET >= 1").count() == 0


def test_hashed_levels_reach_the_model(spark):
    """A level among thousands decides the target; indicators stand beside a dense feature."""
    df = spark.range(3000).select(
        "id",
        (F.col("id") % 50 == 7).cast("double").alias("y"),
        (F.col("id") % 9).alias("NOISE"),
        F.concat(F.lit("level"), F.when(F.col("id") % 50 == 7, 7).otherwise(F.col("id"))).alias("LEVEL"),
        F.when(F.col("id") % 2 == 0, "x").alias("GAP"),
    )
    size = 64
    sparse = encode.hashed_indicators(df, ["LEVEL", "GAP"], size)
    assert sparse.columns == ["id", "y", "NOISE", "hashed"]
    names = ["NOISE", *boosting.sparse_names("hashed", size)]
    cuts = [*boosting.find_cuts(df, ["NOISE"]), *boosting.sparse_cuts(size)]
    rows = boosting.bin_rows(sparse, "id", "y", names, cuts, sparse="hashed")
    first = {r.id: list(r.bins) for r in rows.filter("id < 20").collect()}
    places = {r.id: r.hashed for r in sparse.filter("id < 20").collect()}
    assert all([i - 1 for i, b in enumerate(first[k]) if b and i] == places[k] and first[k][0] == k % 9 for k in first)
    fitted = boosting.fit(rows, names, cuts, replace(PLAIN, rounds=8))
    at = df.filter("id = 7").select(encode.hash_bucket("LEVEL", F.col("LEVEL"), size)).first()[0]
    assert fitted.importance(spark).orderBy("rank").first().feature == f"hashed_{at}"
    scored = fitted.score(fitted.bin(sparse, "id", "y", sparse="hashed")).withColumn("label", F.col("label").cast("int"))
    assert model.auc(scored, "label", "score").first().auc > 0.95
    used = encode.hash_collisions(df, ["LEVEL", "GAP"], size).agg(F.sum("n_rows"), F.sum("n_levels"), F.count("*")).first()
    assert tuple(used) == (6000, df.select("LEVEL").distinct().count() + 2, size)
