"""Feature recipes: histories rolled up to one row per subject, and the wide table built from them.

Each rollup aggregates before it joins. Both levels of a two-level rollup combine on the map side,
so a subject or loan with very many rows costs its tasks one row per map task, not all its history.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import aggregates as A
from tallyframe.functions import scalar as S
from tallyframe.operators import aggregate, encode, joins, reshape, selectors
from tallyframe.operators.encode import LevelSpec
from tallyframe.sources.schemas import CARD_MEASURES, PREVIOUS_CATEGORIES, SUBJECT_CATEGORIES

SUBJECT = "SK_ID_CURR"
LOAN = "SK_ID_BUREAU"
PREVIOUS = "SK_ID_PREV"
TARGET = "TARGET"


def _periods(short_from: int, mid_from: int) -> dict:
    return {
        p: S.in_period(F.col("MONTHS_BALANCE"), p, short_from, mid_from) for p in S.PERIODS
    }


# ---- monthly status -> loan


def status_severity(monthly: DataFrame) -> DataFrame:
    """Per loan: worst status, most recent month with a bad status, number of bad months."""
    status = monthly.select(
        LOAN, "MONTHS_BALANCE", S.recode_status("STATUS").alias("STATUS")
    )
    bad = F.col("STATUS") > 0
    return status.groupBy(LOAN).agg(
        A.max_skip("STATUS").alias("MAX_STATUS"),
        A.max_where(bad, "MONTHS_BALANCE").alias("LAST_BAD_MONTH"),
        A.count_where(F.col("STATUS") != 0).alias("MONTHS_BAD_STATUS"),
    )


def status_by_period(
    monthly: DataFrame, short_from: int = S.SHORT_FROM, mid_from: int = S.MID_FROM
) -> DataFrame:
    """Per loan: bad months in each period, 0 where there are none."""
    status = monthly.select(LOAN, "MONTHS_BALANCE", S.recode_status("STATUS").alias("STATUS"))
    return reshape.period_pivot(
        status,
        [LOAN],
        _periods(short_from, mid_from),
        {"MONTHS_BAD_STATUS": lambda cond: A.count_where(cond & (F.col("STATUS") != 0))},
    )


# ---- external loans -> subject

LOAN_CHECKS = {
    "AMT_CREDIT_SUM_DEBT_GT_SUM": lambda: F.col("AMT_CREDIT_SUM_DEBT") > F.col("AMT_CREDIT_SUM"),
    "AMT_CREDIT_SUM_LIMIT_GT_SUM": lambda: F.col("AMT_CREDIT_SUM_LIMIT") > F.col("AMT_CREDIT_SUM"),
    "AMT_CREDIT_SUM_DEBT_LT_0": lambda: F.col("AMT_CREDIT_SUM_DEBT") < 0,
    "CREDIT_DAY_OVERDUE_GT_0": lambda: F.col("CREDIT_DAY_OVERDUE") > 0,
}


def with_loan_checks(loans: DataFrame) -> DataFrame:
    return loans.withColumns({name: S.flag(cond()) for name, cond in LOAN_CHECKS.items()})


def loan_quality(loans: DataFrame) -> DataFrame:
    return aggregate.quality_counts(loans, {n: cond() for n, cond in LOAN_CHECKS.items()})


def loan_summary(loans: DataFrame, severity: DataFrame) -> DataFrame:
    """Hand-picked summary of a subject's external loans (``severity`` from :func:`status_severity`)."""
    joined = joins.left_join(with_loan_checks(loans), severity, [LOAN])
    low_high = [
        "DAYS_CREDIT",
        "DAYS_CREDIT_ENDDATE",
        "DAYS_ENDDATE_FACT",
        "DAYS_CREDIT_UPDATE",
    ]
    totals = [
        "AMT_CREDIT_SUM",
        "AMT_CREDIT_SUM_DEBT",
        "AMT_CREDIT_SUM_LIMIT",
        "AMT_CREDIT_SUM_OVERDUE",
        "AMT_ANNUITY",
    ]
    aggs = {
        "NUMBER_CREDITS": A.row_count(),
        "MONTHS_BAD_STATUS_MEAN": A.mean_skip("MONTHS_BAD_STATUS"),
        "MONTHS_BAD_STATUS_MAX": A.max_skip("MONTHS_BAD_STATUS"),
        **{check: A.sum_skip(check) for check in LOAN_CHECKS},
        "MAX_STATUS": A.max_skip("MAX_STATUS"),
        "EARLIEST_MONTHS_BALANCE_MIN": A.min_skip("LAST_BAD_MONTH"),
        "EARLIEST_MONTHS_BALANCE_MAX": A.max_skip("LAST_BAD_MONTH"),
        "CREDIT_DAY_OVERDUE_MAX": A.max_skip("CREDIT_DAY_OVERDUE"),
        **{f"{c}_MIN": A.min_skip(c) for c in low_high},
        **{f"{c}_MAX": A.max_skip(c) for c in low_high},
        "AMT_CREDIT_MAX_OVERDUE_SUM": A.sum_skip("AMT_CREDIT_MAX_OVERDUE"),
        "CNT_CREDIT_PROLONG": A.sum_skip("CNT_CREDIT_PROLONG"),
        **{f"{c}_SUM": A.sum_skip(c) for c in totals},
    }
    return joined.groupBy(SUBJECT).agg(*[e.alias(f"{n}_BUREAU") for n, e in aggs.items()])


def loan_fan_out(loans: DataFrame, by_period: DataFrame) -> DataFrame:
    """Count, max, min, sum and mean of every number of a subject's external loans."""
    joined = joins.left_join(with_loan_checks(loans), by_period, [LOAN])
    return aggregate.fan_out_numeric(joined, [SUBJECT], aggregate.FIVE_FUNCTIONS, exclude=[LOAN])


def loan_types(
    loans: DataFrame, spec: LevelSpec | None = None, max_levels: int = encode.MAX_LEVELS
) -> DataFrame:
    """A subject's external loans counted per status and per type."""
    return encode.level_counts(loans, [SUBJECT], ["CREDIT_ACTIVE", "CREDIT_TYPE"], spec, max_levels)


# ---- snapshots and instalments -> previous loan -> subject


def pos_features(
    snapshots: DataFrame,
    short_from: int = S.SHORT_FROM,
    mid_from: int = S.MID_FROM,
    completed_count: int = 1,
) -> DataFrame:
    """Point-of-sale snapshots per loan and period, then sum and count per subject.

    A loan is completed when some period holds exactly ``completed_count`` completed snapshots.
    """

    def best(fn, column):
        return lambda cond: fn(F.when(cond, F.col(column)))

    per_loan = reshape.period_pivot(
        snapshots,
        [PREVIOUS, SUBJECT],
        _periods(short_from, mid_from),
        {
            "LAST_MONTHS_BALANCE": best(F.max, "MONTHS_BALANCE"),
            "CNT_INSTALMENT_MAX": best(F.max, "CNT_INSTALMENT"),
            "LAST_CNT_INSTALMENT_FUTURE": best(F.min, "CNT_INSTALMENT_FUTURE"),
            "SK_DPD_MAX": best(F.max, "SK_DPD"),
            "SK_DPD_DEF_MAX": best(F.max, "SK_DPD_DEF"),
            "CONTRACT_COMPLETED": lambda cond: A.count_where(
                cond & (F.col("NAME_CONTRACT_STATUS") == "Completed")
            ),
        },
        fill=0,
    )
    completed = F.lit(False)
    for p in S.PERIODS:
        completed = completed | (F.col(f"CONTRACT_COMPLETED_{p}") == completed_count)
    flagged = per_loan.withColumns(
        {
            "CONTRACT_COMPLETED": S.flag(completed),
            "CONTRACT_UNCOMPLETED": S.flag(~completed),
        }
    )
    return aggregate.fan_out_all(flagged, [SUBJECT], aggregate.SUM_COUNT, exclude=[PREVIOUS])


def instalments_per_loan(payments: DataFrame, keys: Iterable[str] = (SUBJECT, PREVIOUS)) -> DataFrame:
    """Strict statistics of each loan's instalments."""
    return payments.groupBy(*keys).agg(
        A.strict_max("NUM_INSTALMENT_VERSION").alias("CHANGES_INSTALMENT_VERSION"),
        A.strict_mean("AMT_INSTALMENT").alias("AMT_INSTALMENT"),
        A.strict_mean("AMT_PAYMENT").alias("AMT_PAYMENT"),
    )


def instalment_features(payments: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Strict statistics per loan, then sum and mean per subject.

    Payments that name only the loan take the subject from ``owners`` (one row per loan), after
    they are rolled up: a loan with very many payments never meets the join.
    """
    if owners is None:
        per_loan = instalments_per_loan(payments)
    else:
        per_loan = owners.select(PREVIOUS, SUBJECT).join(
            instalments_per_loan(payments, [PREVIOUS]), PREVIOUS
        )
    return aggregate.fan_out_all(per_loan, [SUBJECT], aggregate.SUM_MEAN, exclude=[PREVIOUS])


def card_features(
    snapshots: DataFrame,
    short_from: int = S.SHORT_FROM,
    mid_from: int = S.MID_FROM,
    measures: Iterable[str] = CARD_MEASURES,
) -> DataFrame:
    """Strict mean of every card measure per loan and period, summed per subject.

    A sum over a subject's loans does not need the loans in wide form, so only the second, much
    smaller aggregation has a cell per measure and period.
    """
    measures = list(measures)
    period = S.period_bucket("MONTHS_BALANCE", short_from, mid_from)
    per_loan = (
        snapshots.withColumn("period", period)
        .groupBy(PREVIOUS, SUBJECT, "period")
        .agg(*[A.strict_mean(m).alias(m) for m in measures])
    )
    cells = [
        A.sum_skip(F.when(F.col("period") == p, F.col(m))).alias(f"{m}_{p}")
        for m in measures
        for p in S.PERIODS
    ]
    return per_loan.groupBy(SUBJECT).agg(*cells)


def prepare_previous(applications: DataFrame) -> DataFrame:
    """Trim the payment type to its first token, add the ratio, blank the day sentinel."""
    days = selectors.starts_with(applications, "DAYS")
    return applications.withColumns(
        {
            "NAME_PAYMENT_TYPE": S.extract_prefix("NAME_PAYMENT_TYPE"),
            "APP_CREDIT_PERC": S.safe_ratio("AMT_APPLICATION", "AMT_CREDIT"),
            **{c: S.sentinel_to_null(c) for c in days},
        }
    )


def previous_features(
    applications: DataFrame,
    spec: LevelSpec | None = None,
    categories: Iterable[str] = PREVIOUS_CATEGORIES,
    max_levels: int = encode.MAX_LEVELS,
) -> DataFrame:
    """Previous applications: strict sums of every number and of every category level, and their count."""
    prepared = prepare_previous(applications)
    categories = list(categories)
    spec = spec or encode.resolve_levels(prepared, categories, max_levels)
    numbers = selectors.numeric(prepared, [SUBJECT, PREVIOUS])
    levels = {n: e for c in categories for n, e in spec.indicators(c).items()}
    return prepared.groupBy(SUBJECT).agg(
        A.row_count().alias("NUMBER_PREVIOUS_APPLICATIONS"),
        *[A.strict_sum(c).alias(f"{c}_SUM") for c in numbers],
        *[F.sum(e).alias(f"{n}_SUM") for n, e in levels.items()],
    )


# ---- the wide table


def encode_subjects(
    train: DataFrame,
    test: DataFrame | None = None,
    spec: LevelSpec | None = None,
    categories: Iterable[str] = SUBJECT_CATEGORIES,
    max_levels: int = encode.MAX_LEVELS,
) -> DataFrame:
    """Both subject tables as one, categories one-hot encoded, day sentinel blanked, payment rate added."""
    both = train if test is None else joins.bind_rows(train, test)
    categories = list(categories)
    # Levels are looked for in the input itself, before anything is derived from it.
    encoded = encode.one_hot_named(both, categories, spec, max_levels)
    days = selectors.starts_with(encoded, "DAYS")
    return selectors.map_columns(encoded, days, S.sentinel_to_null).withColumn(
        "PAYMENT_RATE", S.safe_ratio("AMT_ANNUITY", "AMT_CREDIT")
    )


def subject_wide(subjects: DataFrame, rollups: Iterable[DataFrame]) -> DataFrame:
    """Left-join every rollup onto the encoded subjects."""
    return joins.star_join(subjects, rollups, [SUBJECT])


def derive_features(wide: DataFrame, exact_suffix: bool = False) -> DataFrame:
    """Period cells to indicators, document flags dropped, scores and ratios added, missing numbers to 0.

    By default any column whose name contains a period mark becomes an indicator; ``exact_suffix``
    restricts that to names in which the mark ends a word.
    """
    marks = [f"_{p}" for p in S.PERIODS]
    cells = selectors.contains(wide, *marks)
    if exact_suffix:
        ends = tuple(m.lower() for m in marks)
        cells = [
            c for c in cells if c.lower().endswith(ends) or any(f"{m}_" in c.lower() for m in ends)
        ]
    cells = [c for c in selectors.numeric(wide) if c in set(cells)]
    kept = wide.drop(*selectors.contains(wide, "FLAG_DOCUMENT"))
    with_flags = selectors.map_columns(kept, cells, S.truthy)
    scores = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
    derived = with_flags.withColumns(
        {
            "EXT_SOURCES_MEAN": S.row_mean(*scores),
            "EXT_SOURCES_PROD": S.row_product(*scores),
            "CREDIT_ANNUITY_RATIO": S.safe_ratio("AMT_CREDIT_SUM", "AMT_ANNUITY"),
            "CREDIT_GOODS_RATIO": S.safe_ratio("AMT_CREDIT_SUM", "AMT_GOODS_PRICE"),
            "DAYS_EMPLOYED_BIRTH_RATIO": S.safe_ratio("DAYS_EMPLOYED", "DAYS_BIRTH"),
        }
    )
    return selectors.map_columns(derived, selectors.numeric(derived, [TARGET]), S.null_to_zero)
