"""Splits and rebalancing: exact sizes, disjoint and covering, independent of partitioning."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import sampling
from tallyframe.plans import rebalance

CLASSES = {0: 1100, 1: 90, 2: 11, 3: 2, 4: 1, None: 50}


@pytest.fixture(scope="module")
def keys(spark):
    rows, i = [], 0
    for label, n in CLASSES.items():
        rows += [(i + k, label) for k in range(n)]
        i += n
    return spark.createDataFrame(rows, "id long, y int").repartition(5).cache()


def draw(i, seed=42):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


def test_sizes_and_members_match_brute_force(keys):
    out = sampling.stratified_sample(keys, "id", "y").collect()
    assert len(out) == sum(CLASSES.values())
    for label, n in CLASSES.items():
        members = [r for r in out if r.y == label]
        if label is None:
            assert {r.in_sample for r in members} == {None}
            continue
        order = sorted(members, key=lambda r: (draw(r.id), r.id))
        take = round(0.8 * n)
        assert [r.in_sample for r in order] == [k < take for k in range(n)]


def test_split_is_disjoint_covers_and_ignores_partitioning(keys):
    a = {r.id: r.split for r in sampling.three_way_split(keys, "id", "y").collect()}
    b = {r.id: r.split for r in sampling.three_way_split(keys.repartition(2), "id", "y").collect()}
    assert a == b and len(a) == sum(CLASSES.values())
    assert set(a.values()) == {"train", "validation", "test"}
    other = {r.id: r.split for r in sampling.three_way_split(keys, "id", "y", seed=1).collect()}
    assert other != a


def test_empty_sample(keys):
    out = sampling.stratified_sample(keys.filter("y = 4"), "id", "y", fraction=0.2)
    assert [r.in_sample for r in out.collect()] == [False]


def test_positions_are_a_permutation(keys):
    ones = keys.filter("y = 1").select("id")
    got = {r.id: r.position for r in sampling.indexed_by_hash(ones, "id").collect()}
    order = sorted(got, key=lambda i: (draw(i), i))
    assert [got[i] for i in order] == list(range(90))


def test_upsample_reaches_the_share_and_keeps_class_0(keys):
    two = keys.filter("y IN (0, 1)")
    out = sampling.upsample(two, "id", "y", share=0.3)
    n = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert n[0] == 1100
    assert abs(n[1] / (n[0] + n[1]) - 0.3) < 1 / n[1]
    drawn = [r.id for r in out.filter("y = 1").collect()]
    brute = [int(draw(d)[:15], 16) % 90 for d in range(n[1])]
    order = sorted({r.id for r in keys.filter("y = 1").collect()}, key=lambda i: (draw(i), i))
    assert sorted(drawn) == sorted(order[p] for p in brute)


def test_upsample_needs_both_classes(keys):
    with pytest.raises(ValueError, match="both classes"):
        sampling.upsample(keys.filter("y = 0"), "id", "y")


def test_too_many_classes_is_an_error(spark):
    many = spark.range(1500).select("id", F.col("id").alias("y"))
    with pytest.raises(ValueError, match="classes"):
        sampling.stratified_sample(many, "id", "y")


def test_split_rebalance(keys):
    wide = keys.filter("y IS NULL OR y < 2").withColumn("x", F.col("id") * 2)
    parts = rebalance.split_rebalance(wide, "id", "y", keys=wide.select("id", "y"))
    train, validation, test = (p.collect() for p in (parts.train, parts.validation, parts.test))
    assert {r.y for r in test} == {None} and len(test) == 50
    assert len(validation) == 220 + 18
    assert sum(r.y == 0 for r in train) == 880
    assert sum(r.y == 1 for r in train) == round(72 * (0.3 * 880 / (72 * 0.7)))
    assert not {r.id for r in train} & {r.id for r in validation}
    assert all(r.x == r.id * 2 for r in train)
