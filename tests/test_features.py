"""Feature recipes on hand-made histories with missing parts."""

from pyspark.sql import functions as F

from tallyframe.operators.encode import LevelSpec
from tallyframe.plans import features

MONTHS = [
    (1, -1, "X"), (1, -2, "X"),
    (2, -5, "C"),
    (3, -12, "0"), (3, -13, "1"), (3, -48, "5"), (3, -49, "2"), (3, -50, "C"), (3, -1, "X"),
]


def monthly(spark):
    return spark.createDataFrame(MONTHS, "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")


def by_id(df):
    return {r[0]: r.asDict() for r in df.collect()}


def test_status_severity(spark):
    got = by_id(features.status_severity(monthly(spark)))
    cols = ("MAX_STATUS", "LAST_BAD_MONTH", "MONTHS_BAD_STATUS")
    assert {k: tuple(v[c] for c in cols) for k, v in got.items()} == {
        1: (None, None, 0),
        2: (0, None, 0),
        3: (5, -13, 3),
    }


def test_status_by_period(spark):
    got = by_id(features.status_by_period(monthly(spark)))
    cols = [f"MONTHS_BAD_STATUS_{p}" for p in ("SHORT", "MID", "LONG")]
    assert {k: tuple(v[c] for c in cols) for k, v in got.items()} == {
        1: (0, 0, 0),
        2: (0, 0, 0),
        3: (0, 2, 1),
    }


def test_pos_features(spark):
    rows = [
        (10, 1, -1, "Completed", 5.0, None, 1, None),
        (10, 1, -2, "Active", 6.0, 2.0, 0, None),
        (11, 1, -60, "Active", None, 1.0, 2, 3),
        (12, 2, -1, "Completed", 1.0, 1.0, 0, 0),
        (12, 2, -2, "Completed", 1.0, 1.0, 0, 0),
    ]
    schema = (
        "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, NAME_CONTRACT_STATUS string,"
        " CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double, SK_DPD int, SK_DPD_DEF int"
    )
    got = by_id(features.pos_features(spark.createDataFrame(rows, schema)))
    assert len(got[1]) == 41
    assert got[1]["CNT_INSTALMENT_MAX_SHORT_sum"] == 6.0
    assert got[1]["CNT_INSTALMENT_MAX_LONG_sum"] == 0.0
    assert got[1]["SK_DPD_DEF_MAX_LONG_sum"] == 3
    assert (got[1]["CONTRACT_COMPLETED_sum"], got[1]["CONTRACT_UNCOMPLETED_sum"]) == (1, 1)
    assert got[1]["CONTRACT_COMPLETED_n"] == 2
    # Two completed snapshots in one period do not count as completed.
    assert (got[2]["CONTRACT_COMPLETED_sum"], got[2]["CONTRACT_UNCOMPLETED_sum"]) == (0, 1)


def test_card_features_are_strict_per_period(spark):
    rows = [(1, 7, -1, 2.0), (1, 7, -2, None), (1, 7, -20, 4.0), (2, 7, -1, 6.0), (2, 7, -20, 8.0)]
    df = spark.createDataFrame(rows, "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double")
    got = by_id(features.card_features(df, measures=["AMT_BALANCE"]))[7]
    assert got == {
        "SK_ID_CURR": 7,
        "AMT_BALANCE_SHORT": 6.0,
        "AMT_BALANCE_MID": 12.0,
        "AMT_BALANCE_LONG": 0.0,
    }


def test_instalment_features_with_and_without_owners(spark):
    rows = [(7, 1, 1.0, 10.0, 10.0), (7, 1, 2.0, 20.0, None), (7, 2, 1.0, 30.0, 5.0)]
    df = spark.createDataFrame(
        rows,
        "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_VERSION double, AMT_INSTALMENT double,"
        " AMT_PAYMENT double",
    )
    got = features.instalment_features(df).first().asDict()
    assert got["AMT_INSTALMENT_SUM"] == 45.0 and got["AMT_PAYMENT_MEAN"] == 5.0
    assert got["CHANGES_INSTALMENT_VERSION_SUM"] == 3.0
    owners = df.select("SK_ID_PREV", "SK_ID_CURR").distinct()
    assert features.instalment_features(df.drop("SK_ID_CURR"), owners).first().asDict() == got


def test_previous_features(spark):
    rows = [(7, 1, "Cash-x by hand", 10.0, 5.0, 365243), (7, 2, " y", 10.0, 0.0, -3), (8, 3, None, 9.0, 3.0, -1)]
    df = spark.createDataFrame(
        rows,
        "SK_ID_CURR long, SK_ID_PREV long, NAME_PAYMENT_TYPE string, AMT_APPLICATION double,"
        " AMT_CREDIT double, DAYS_DECISION int",
    )
    got = by_id(features.previous_features(df, categories=["NAME_PAYMENT_TYPE"]))
    assert got[7]["NUMBER_PREVIOUS_APPLICATIONS"] == 2
    assert got[7]["DAYS_DECISION_SUM"] is None and got[8]["DAYS_DECISION_SUM"] == -1
    assert got[7]["APP_CREDIT_PERC_SUM"] is None and got[8]["APP_CREDIT_PERC_SUM"] == 3.0
    assert (got[7]["NAME_PAYMENT_TYPE_CASH_X_SUM"], got[7]["NAME_PAYMENT_TYPE_NA_SUM"]) == (1, 1)
    assert "SK_ID_PREV_SUM" not in got[7]


def derived_input(spark):
    return spark.range(1).select(
        F.lit(1).alias("SK_ID_CURR"),
        F.lit(None).cast("int").alias("TARGET"),
        F.lit(7).alias("X_SHORT_sum"),
        F.lit(3).alias("NAME_MIDDLE"),
        F.lit("t").alias("TEXT_LONG"),
        F.lit(1).alias("FLAG_DOCUMENT_2"),
        F.lit(None).cast("double").alias("EXT_SOURCE_1"),
        F.lit(0.5).alias("EXT_SOURCE_2"),
        F.lit(0.5).alias("EXT_SOURCE_3"),
        F.lit(10.0).alias("AMT_CREDIT_SUM"),
        F.lit(4.0).alias("AMT_ANNUITY"),
        F.lit(0.0).alias("AMT_GOODS_PRICE"),
        F.lit(-5).alias("DAYS_EMPLOYED"),
        F.lit(-10).alias("DAYS_BIRTH"),
    )


def test_derive_features(spark):
    got = features.derive_features(derived_input(spark)).first().asDict()
    assert got["TARGET"] is None and "FLAG_DOCUMENT_2" not in got
    assert (got["X_SHORT_sum"], got["NAME_MIDDLE"], got["TEXT_LONG"]) == (1, 1, "t")
    assert (got["EXT_SOURCES_MEAN"], got["EXT_SOURCE_1"]) == (0.0, 0.0)
    assert (got["CREDIT_ANNUITY_RATIO"], got["CREDIT_GOODS_RATIO"]) == (2.5, 0.0)
    assert got["DAYS_EMPLOYED_BIRTH_RATIO"] == 0.5
    exact = features.derive_features(derived_input(spark), exact_suffix=True).first()
    assert (exact["X_SHORT_sum"], exact["NAME_MIDDLE"]) == (1, 3)


def test_encode_subjects_uses_the_same_columns_for_both_parts(spark):
    train = spark.createDataFrame(
        [(1, 0, "a", 365243, 1.0, 2.0)],
        "SK_ID_CURR long, TARGET int, CODE_GENDER string, DAYS_X int, AMT_ANNUITY double, AMT_CREDIT double",
    )
    test = spark.createDataFrame(
        [(2, "b", -1, 1.0, 0.0)],
        "SK_ID_CURR long, CODE_GENDER string, DAYS_X int, AMT_ANNUITY double, AMT_CREDIT double",
    )
    got = by_id(features.encode_subjects(train, test, categories=["CODE_GENDER"]))
    assert got[1]["DAYS_X"] is None and got[1]["PAYMENT_RATE"] == 0.5
    assert got[2]["TARGET"] is None and got[2]["PAYMENT_RATE"] is None
    assert (got[1]["CODE_GENDER_A"], got[2]["CODE_GENDER_A"], got[2]["CODE_GENDER_B"]) == (1, 0, 1)
    spec = LevelSpec({"CODE_GENDER": {"CODE_GENDER_A": ["a"]}})
    assert "CODE_GENDER_B" not in features.encode_subjects(train, test, spec, ["CODE_GENDER"]).columns


def test_star_join_adds_no_shuffle_of_its_own(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.range(100).withColumnRenamed("id", "SK_ID_CURR")
        rollups = [
            base.groupBy("SK_ID_CURR").agg(F.count(F.lit(1)).alias(f"n{i}")) for i in range(3)
        ]
        plan = features.subject_wide(base, rollups)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
