"""Feature recipes, the wide table, derived features, split and rebalance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.operators import sampling, selectors
from tallyframe.plans import features, rebalance
from tallyframe.registry.basics import FIVE, PRIORITIES, RECODE_SQL, fan_sql, strict_sql
from tallyframe.registry.bindings import EVENT_MID, EVENT_SHORT, with_bound
from tallyframe.registry.core import query, rounded
from tallyframe.sources.schemas import CARD_MEASURES

# ---- monthly status and external loans

CODED = f"SELECT *, {RECODE_SQL.format('STATUS')} AS s FROM monthly_status"
SEVERITY = (
    "SELECT SK_ID_BUREAU, MAX(s) AS MAX_STATUS, MAX(CASE WHEN s > 0 THEN MONTHS_BALANCE END)"
    " AS LAST_BAD_MONTH, CAST(SUM(CASE WHEN s <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS MONTHS_BAD_STATUS"
    " FROM coded GROUP BY SK_ID_BUREAU"
)
IN_PERIOD = {
    "SHORT": "{m} >= -12",
    "MID": "{m} < -12 AND {m} >= -48",
    "LONG": "{m} < -48",
}
BY_PERIOD = (
    "SELECT SK_ID_BUREAU, "
    + ", ".join(
        f"CAST(SUM(CASE WHEN {cond.format(m='MONTHS_BALANCE')} AND s <> 0 THEN 1 ELSE 0 END) AS BIGINT)"
        f" AS MONTHS_BAD_STATUS_{p}"
        for p, cond in IN_PERIOD.items()
    )
    + " FROM coded GROUP BY SK_ID_BUREAU"
)
CHECKED = (
    "SELECT *, CAST(AMT_CREDIT_SUM_DEBT > AMT_CREDIT_SUM AS INT) AS AMT_CREDIT_SUM_DEBT_GT_SUM,"
    " CAST(AMT_CREDIT_SUM_LIMIT > AMT_CREDIT_SUM AS INT) AS AMT_CREDIT_SUM_LIMIT_GT_SUM,"
    " CAST(AMT_CREDIT_SUM_DEBT < 0 AS INT) AS AMT_CREDIT_SUM_DEBT_LT_0,"
    " CAST(CREDIT_DAY_OVERDUE > 0 AS INT) AS CREDIT_DAY_OVERDUE_GT_0 FROM external_loans"
)
CHECKS = (
    "AMT_CREDIT_SUM_DEBT_GT_SUM AMT_CREDIT_SUM_LIMIT_GT_SUM AMT_CREDIT_SUM_DEBT_LT_0"
    " CREDIT_DAY_OVERDUE_GT_0"
).split()


def _sum0(column: str, kind: str, name: str) -> str:
    return f"CAST(COALESCE(SUM({column}), 0) AS {kind}) AS {name}"


SUMMARY_V1 = (
    "SELECT SK_ID_CURR, COUNT(*) AS NUMBER_CREDITS_BUREAU,"
    " AVG(CAST(MONTHS_BAD_STATUS AS DOUBLE)) AS MONTHS_BAD_STATUS_MEAN_BUREAU,"
    " MAX(MONTHS_BAD_STATUS) AS MONTHS_BAD_STATUS_MAX_BUREAU,"
    " MAX(MAX_STATUS) AS MAX_STATUS_BUREAU,"
    " MIN(LAST_BAD_MONTH) AS EARLIEST_MONTHS_BALANCE_MIN_BUREAU,"
    " MAX(LAST_BAD_MONTH) AS EARLIEST_MONTHS_BALANCE_MAX_BUREAU,"
    " MAX(CREDIT_DAY_OVERDUE) AS CREDIT_DAY_OVERDUE_MAX_BUREAU, "
    + ", ".join(_sum0(c, "BIGINT", f"{c}_BUREAU") for c in CHECKS)
    + ", "
    + ", ".join(
        f"{fn}({c}) AS {c}_{fn}_BUREAU"
        for c in ("DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "DAYS_CREDIT_UPDATE")
        for fn in ("MIN", "MAX")
    )
    + ", "
    + _sum0("AMT_CREDIT_MAX_OVERDUE", "DOUBLE", "AMT_CREDIT_MAX_OVERDUE_SUM_BUREAU")
    + ", "
    + _sum0("CNT_CREDIT_PROLONG", "BIGINT", "CNT_CREDIT_PROLONG_BUREAU")
    + ", "
    + ", ".join(
        _sum0(f"AMT_{c}", "DOUBLE", f"AMT_{c}_SUM_BUREAU")
        for c in ("CREDIT_SUM", "CREDIT_SUM_DEBT", "CREDIT_SUM_LIMIT", "CREDIT_SUM_OVERDUE", "ANNUITY")
    )
    + " FROM checked LEFT JOIN severity USING (SK_ID_BUREAU) GROUP BY SK_ID_CURR"
)
LOAN_AMOUNTS = (
    "AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE"
    " AMT_CREDIT_MAX_OVERDUE AMT_ANNUITY"
).split()
LOAN_NUMBERS = (
    "CREDIT_DAY_OVERDUE CNT_CREDIT_PROLONG DAYS_CREDIT DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT"
    " DAYS_CREDIT_UPDATE MONTHS_BAD_STATUS_SHORT MONTHS_BAD_STATUS_MID MONTHS_BAD_STATUS_LONG"
).split()
SUMMARY_V2 = (
    "SELECT SK_ID_CURR, "
    + ", ".join(fan_sql(c, "DOUBLE", FIVE) for c in LOAN_AMOUNTS)
    + ", "
    + ", ".join(fan_sql(c, "BIGINT", FIVE) for c in [*LOAN_NUMBERS, *CHECKS])
    + " FROM checked LEFT JOIN by_period USING (SK_ID_BUREAU) GROUP BY SK_ID_CURR"
)


def _count(condition: str, name: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


TYPES = (
    "SELECT SK_ID_CURR, "
    + ", ".join(_count(f"CREDIT_ACTIVE = '{s}'", f"CREDIT_ACTIVE_{s}") for s in "FOP")
    + ", "
    + ", ".join(_count(f"CREDIT_TYPE = '{r}'", f"CREDIT_TYPE_{c}") for r, c in PRIORITIES.items())
    + " FROM external_loans GROUP BY SK_ID_CURR"
)


@query("bureau_rollup_v1", with_bound("monthly_status", coded=CODED, then=SEVERITY))
def _(t):
    return features.status_severity(t.bound("monthly_status"))


@query("bureau_rollup_v2", with_bound("monthly_status", coded=CODED, then=BY_PERIOD))
def _(t):
    return features.status_by_period(t.bound("monthly_status"))


@query(
    "subject_summary_v1",
    with_bound(
        "monthly_status",
        "external_loans",
        coded=CODED,
        severity=SEVERITY,
        checked=CHECKED,
        then=SUMMARY_V1,
    ),
)
def _(t):
    severity = features.status_severity(t.bound("monthly_status"))
    return features.loan_summary(t.bound("external_loans"), severity)


def summary_v2(t):
    by_period = features.status_by_period(t.bound("monthly_status"))
    return features.loan_fan_out(t.bound("external_loans"), by_period)


@query(
    "subject_summary_v2",
    with_bound(
        "monthly_status",
        "external_loans",
        coded=CODED,
        by_period=BY_PERIOD,
        checked=CHECKED,
        then=SUMMARY_V2,
    ),
)
def _(t):
    return summary_v2(t)


@query("subject_types", with_bound("external_loans", then=TYPES))
def _(t):
    return features.loan_types(t.bound("external_loans"))


# ---- snapshots, instalments, previous applications

EVENT_PERIODS = {
    "SHORT": f"MONTHS_BALANCE >= {EVENT_SHORT}",
    "MID": f"MONTHS_BALANCE < {EVENT_SHORT} AND MONTHS_BALANCE >= {EVENT_MID}",
    "LONG": f"MONTHS_BALANCE < {EVENT_MID}",
}
POS_CELLS = {
    "LAST_MONTHS_BALANCE": ("MAX", "MONTHS_BALANCE", "BIGINT"),
    "CNT_INSTALMENT_MAX": ("MAX", "CNT_INSTALMENT", "DOUBLE"),
    "LAST_CNT_INSTALMENT_FUTURE": ("MIN", "CNT_INSTALMENT_FUTURE", "DOUBLE"),
    "SK_DPD_MAX": ("MAX", "SK_DPD", "BIGINT"),
    "SK_DPD_DEF_MAX": ("MAX", "SK_DPD_DEF", "BIGINT"),
    "CONTRACT_COMPLETED": ("SUM", "CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END", "BIGINT"),
}
POS_LOANS = (
    "SELECT SK_ID_PREV, SK_ID_CURR, "
    + ", ".join(
        f"COALESCE({fn}(CASE WHEN {cond} THEN {x} END), 0) AS {name}_{p}"
        for name, (fn, x, _) in POS_CELLS.items()
        for p, cond in EVENT_PERIODS.items()
    )
    + " FROM pos_snapshots GROUP BY 1, 2"
)
POS_DONE = " OR ".join(f"CONTRACT_COMPLETED_{p} = 1" for p in S.PERIODS)
POS = (
    "SELECT SK_ID_CURR, "
    + ", ".join(
        fan_sql(f"{name}_{p}", kind, {"sum": "sum", "n": "n"})
        for name, (_, _, kind) in POS_CELLS.items()
        for p in S.PERIODS
    )
    + ", "
    + _count(POS_DONE, "CONTRACT_COMPLETED_sum")
    + ", COUNT(*) AS CONTRACT_COMPLETED_n, "
    + _count(f"NOT ({POS_DONE})", "CONTRACT_UNCOMPLETED_sum")
    + ", COUNT(*) AS CONTRACT_UNCOMPLETED_n FROM pos_loans GROUP BY SK_ID_CURR"
)


def pos(t):
    return features.pos_features(t.bound("pos_snapshots"), EVENT_SHORT, EVENT_MID)


@query("pos_features", with_bound("pos_snapshots", pos_loans=POS_LOANS, then=POS))
def _(t):
    return pos(t)


INSTALMENT_NAMES = ("CHANGES_INSTALMENT_VERSION", "AMT_INSTALMENT", "AMT_PAYMENT")
PAID_LOANS = (
    f"SELECT SK_ID_CURR, SK_ID_PREV, {strict_sql('MAX', 'NUM_INSTALMENT_VERSION')}"
    f" AS CHANGES_INSTALMENT_VERSION, {strict_sql('AVG', 'AMT_INSTALMENT')} AS AMT_INSTALMENT,"
    f" {strict_sql('AVG', 'AMT_PAYMENT')} AS AMT_PAYMENT FROM instalment_payments"
    " JOIN loan_owners USING (SK_ID_PREV) GROUP BY 1, 2"
)
INSTALMENTS = (
    "SELECT SK_ID_CURR, "
    + ", ".join(
        f"COALESCE(SUM({c}), 0) AS {c}_SUM, AVG({c}) AS {c}_MEAN"
        for c in INSTALMENT_NAMES
    )
    + " FROM paid_loans GROUP BY SK_ID_CURR"
)


def instalments(t):
    return features.instalment_features(t.bound("instalment_payments"), t.bound("loan_owners"))


@query(
    "instalment_features",
    with_bound("instalment_payments", "loan_owners", paid_loans=PAID_LOANS, then=INSTALMENTS),
)
def _(t):
    return instalments(t)


def _card_cell(measure: str, cond: str) -> str:
    cell = f"CASE WHEN {cond} THEN {measure} END"
    return f"CASE WHEN COUNT({cell}) = COUNT(CASE WHEN {cond} THEN 1 END) THEN AVG({cell}) END"


CARD_LOANS = (
    "SELECT SK_ID_PREV, SK_ID_CURR, "
    + ", ".join(
        f"{_card_cell(m, cond)} AS {m}_{p}" for m in CARD_MEASURES for p, cond in EVENT_PERIODS.items()
    )
    + " FROM card_snapshots GROUP BY 1, 2"
)
CARDS = (
    "SELECT SK_ID_CURR, "
    + ", ".join(
        f"COALESCE(SUM({m}_{p}), 0) AS {m}_{p}" for m in CARD_MEASURES for p in S.PERIODS
    )
    + " FROM card_loans GROUP BY SK_ID_CURR"
)


def cards(t):
    return features.card_features(t.bound("card_snapshots"), EVENT_SHORT, EVENT_MID)


@query("card_features", with_bound("card_snapshots", card_loans=CARD_LOANS, then=CARDS))
def _(t):
    return cards(t)


# Expected level columns, written out: variable -> column suffix -> raw level (None = missing).
PREVIOUS_LEVELS = {
    "NAME_CONTRACT_TYPE": {
        "CASH_LOANS": "Cash loans",
        "CONSUMER_LOANS": "Consumer loans",
        "REVOLVING_LOANS": "Revolving loans",
        "NA": None,
    },
    "NAME_CASH_LOAN_PURPOSE": {clean: raw for raw, clean in PRIORITIES.items()},
    "NAME_CONTRACT_STATUS": {s: s for s in "FOP"},
    "NAME_PAYMENT_TYPE": {
        "X1_URGENT": "1-URGENT",
        "X2_HIGH": "2-HIGH",
        "X3_MEDIUM": "3-MEDIUM",
        "X4_NOT": "4-NOT SPECIFIED",
        "X5_LOW": "5-LOW",
    },
    "NAME_PORTFOLIO": {"POS": "POS", "CASH": "Cash", "XNA": "XNA"},
    "NAME_PRODUCT_TYPE": {"X_SELL": "x-sell", "WALK_IN": "walk-in"},
    "NAME_SELLER_INDUSTRY": {
        "AUTO_TECHNOLOGY": "Auto technology",
        "MLM_PARTNERS": "MLM partners",
        "CONSTRUCTION": "Construction",
    },
    "NAME_YIELD_GROUP": {
        "LOW_NORMAL": ("low_normal", "low.normal"),
        "HIGH": "high",
        "X50PERCENT_OFF": " 50% off",
        "X_MIDDLE": "(middle)",
    },
    "PRODUCT_COMBINATION": {
        f"{clean}_{s}": f"{raw}: {s}" for raw, clean in PRIORITIES.items() for s in "FOP"
    },
}


def level_condition(column: str, raw) -> str:
    if raw is None:
        return f"{column} IS NULL"
    names = raw if isinstance(raw, tuple) else (raw,)
    return f"{column} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


PREPARED = (
    "SELECT * REPLACE (NULLIF(DAYS_DECISION, 365243) AS DAYS_DECISION,"
    " NULLIF(DAYS_TERMINATION, 365243) AS DAYS_TERMINATION),"
    " AMT_APPLICATION / NULLIF(AMT_CREDIT, 0) AS APP_CREDIT_PERC FROM previous_applications"
)
PREVIOUS = (
    "SELECT SK_ID_CURR, COUNT(*) AS NUMBER_PREVIOUS_APPLICATIONS, "
    + ", ".join(f"{strict_sql('SUM', c)} AS {c}_SUM" for c in ("AMT_APPLICATION", "AMT_CREDIT"))
    + ", "
    + ", ".join(
        f"{strict_sql('SUM', c, 'BIGINT')} AS {c}_SUM" for c in ("DAYS_DECISION", "DAYS_TERMINATION")
    )
    + f", ROUND({strict_sql('SUM', 'APP_CREDIT_PERC')}, 6) AS APP_CREDIT_PERC_SUM, "
    + ", ".join(
        _count(level_condition(v, raw), f"{v}_{clean}_SUM")
        for v, levels in PREVIOUS_LEVELS.items()
        for clean, raw in levels.items()
    )
    + " FROM prepared GROUP BY SK_ID_CURR"
)


def previous(t):
    out = features.previous_features(t.bound("previous_applications"))
    return rounded(out, ["APP_CREDIT_PERC_SUM"], 6)


@query("previous_features", with_bound("previous_applications", prepared=PREPARED, then=PREVIOUS))
def _(t):
    return previous(t)


# ---- the wide table

SUBJECT_LEVELS = {
    "NAME_CONTRACT_TYPE": {"CASH_LOANS": "Cash loans", "REVOLVING_LOANS": "Revolving loans"},
    "CODE_GENDER": {"M": "M", "F": "F", "XNA": "XNA"},
    "NAME_TYPE_SUITE": {
        "FAMILY": "Family",
        "SPOUSE_PARTNER": "Spouse, partner",
        "OTHER_A": "Other_A",
        "NA": None,
    },
    "NAME_INCOME_TYPE": {
        s: s for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    },
    "NAME_EDUCATION_TYPE": {
        "HIGHER_EDUCATION": "Higher education",
        "SECONDARY_SECONDARY_SPECIAL": "Secondary / secondary special",
    },
    "NAME_FAMILY_STATUS": {
        "MARRIED": "Married",
        "SINGLE_NOT_MARRIED": "Single / not married",
        "WIDOW": "Widow",
    },
    "NAME_HOUSING_TYPE": {f"X{i}": str(i) for i in range(25)},
    "OCCUPATION_TYPE": {
        "LABORERS": "Laborers",
        "HIGH_SKILL_TECH_STAFF": "High skill tech staff",
        "IT_STAFF": "IT staff",
        "COOKING_STAFF": "Cooking staff",
        "NA": None,
    },
}
SUBJECT_KEPT = (
    "SK_ID_CURR TARGET FONDKAPREMONT_MODE AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE EXT_SOURCE_1"
    " EXT_SOURCE_2 EXT_SOURCE_3 DAYS_BIRTH FLAG_DOCUMENT_2 FLAG_EMAIL FLAG_OWN_REALTY"
).split()
ENCODED = (
    "SELECT "
    + ", ".join(SUBJECT_KEPT)
    + ", NULLIF(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED,"
    " AMT_ANNUITY / NULLIF(AMT_CREDIT, 0) AS PAYMENT_RATE, "
    + ", ".join(
        f"CAST({level_condition(v, raw) if raw is None else f'COALESCE({level_condition(v, raw)}, FALSE)'}"
        f" AS INT) AS {v}_{clean}"
        for v, levels in SUBJECT_LEVELS.items()
        for clean, raw in levels.items()
    )
    + " FROM subject"
)
ROLLUPS = ("previous", "cards", "pos", "instalments", "summary", "types")
WIDE = "SELECT * FROM encoded " + " ".join(f"LEFT JOIN {r} USING (SK_ID_CURR)" for r in ROLLUPS)
WIDE_INPUTS = (
    "subject",
    "previous_applications",
    "card_snapshots",
    "pos_snapshots",
    "instalment_payments",
    "loan_owners",
    "monthly_status",
    "external_loans",
)
WIDE_TABLES = {
    "encoded": ENCODED,
    "prepared": PREPARED,
    "previous": PREVIOUS,
    "card_loans": CARD_LOANS,
    "cards": CARDS,
    "pos_loans": POS_LOANS,
    "pos": POS,
    "paid_loans": PAID_LOANS,
    "instalments": INSTALMENTS,
    "coded": CODED,
    "by_period": BY_PERIOD,
    "checked": CHECKED,
    "summary": SUMMARY_V2,
    "types": TYPES,
}


def encoded(t):
    """The subject table comes as a labelled and an unlabelled part, the latter without the label."""
    train = t.subject.filter(F.col("TARGET").isNotNull())
    test = t.subject.filter(F.col("TARGET").isNull()).drop("TARGET")
    return features.encode_subjects(train, test)


def wide(t):
    rollups = [
        previous(t),
        cards(t),
        pos(t),
        instalments(t),
        summary_v2(t),
        features.loan_types(t.bound("external_loans")),
    ]
    return features.subject_wide(encoded(t), rollups)


@query("subject_encoded", with_bound("subject", then=ENCODED))
def _(t):
    return encoded(t)


@query("subject_wide", with_bound(*WIDE_INPUTS, **WIDE_TABLES, then=WIDE))
def _(t):
    return wide(t)


# ---- derived features

PLAIN = [c for c in SUBJECT_KEPT if c not in ("SK_ID_CURR", "TARGET", "FONDKAPREMONT_MODE", "FLAG_DOCUMENT_2", "FLAG_OWN_REALTY")]
INDICATORS = [f"{v}_{c}" for v, levels in SUBJECT_LEVELS.items() for c in levels]
PREVIOUS_NAMES = [
    "NUMBER_PREVIOUS_APPLICATIONS",
    *[f"{c}_SUM" for c in ("AMT_APPLICATION", "AMT_CREDIT", "DAYS_DECISION", "DAYS_TERMINATION", "APP_CREDIT_PERC")],
    *[f"{v}_{c}_SUM" for v, levels in PREVIOUS_LEVELS.items() for c in levels],
]
CARD_NAMES = [f"{m}_{p}" for m in CARD_MEASURES for p in S.PERIODS]
POS_NAMES = [
    f"{name}_{fn}"
    for name in [
        *[f"{c}_{p}" for c in POS_CELLS for p in S.PERIODS],
        "CONTRACT_COMPLETED",
        "CONTRACT_UNCOMPLETED",
    ]
    for fn in ("sum", "n")
]
PAID_NAMES = [f"{c}_{fn}" for c in INSTALMENT_NAMES for fn in ("SUM", "MEAN")]
SUMMARY_NAMES = [f"{c}_{fn}" for c in [*LOAN_AMOUNTS, *LOAN_NUMBERS, *CHECKS] for fn in FIVE]
TYPE_NAMES = [
    *[f"CREDIT_ACTIVE_{s}" for s in "FOP"],
    *[f"CREDIT_TYPE_{c}" for c in PRIORITIES.values()],
]


def _derived_column(name: str) -> str:
    marked = any(mark in name for mark in ("_SHORT", "_MID", "_LONG"))
    value = f"CAST({name} <> 0 AS INT)" if marked else name
    return f"COALESCE({value}, 0) AS {name}"


DERIVED = (
    "SELECT SK_ID_CURR, TARGET, FONDKAPREMONT_MODE, FLAG_OWN_REALTY, "
    + ", ".join(
        _derived_column(c)
        for c in [
            *PLAIN,
            "DAYS_EMPLOYED",
            "PAYMENT_RATE",
            *INDICATORS,
            *PREVIOUS_NAMES,
            *CARD_NAMES,
            *POS_NAMES,
            *PAID_NAMES,
            *SUMMARY_NAMES,
            *TYPE_NAMES,
        ]
    )
    + ", COALESCE((EXT_SOURCE_1 + EXT_SOURCE_2 + EXT_SOURCE_3) / 3, 0) AS EXT_SOURCES_MEAN,"
    " COALESCE(EXT_SOURCE_1 * EXT_SOURCE_2 * EXT_SOURCE_3, 0) AS EXT_SOURCES_PROD,"
    " COALESCE(AMT_CREDIT_SUM / NULLIF(AMT_ANNUITY, 0), 0) AS CREDIT_ANNUITY_RATIO,"
    " COALESCE(AMT_CREDIT_SUM / NULLIF(AMT_GOODS_PRICE, 0), 0) AS CREDIT_GOODS_RATIO,"
    " COALESCE(CAST(DAYS_EMPLOYED AS DOUBLE) / NULLIF(DAYS_BIRTH, 0), 0) AS DAYS_EMPLOYED_BIRTH_RATIO"
    " FROM wide"
)


@query("derived_features", with_bound(*WIDE_INPUTS, **WIDE_TABLES, wide=WIDE, then=DERIVED))
def _(t):
    return features.derive_features(wide(t))


# ---- split and rebalance

SEED = sampling.SEED
RANKED = (
    f"SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY md5(SK_ID_CURR || ':{SEED}'), SK_ID_CURR)"
    " AS place, COUNT(*) OVER (PARTITION BY TARGET) AS n_class FROM (SELECT SK_ID_CURR, TARGET FROM subject)"
)
SPLIT = (
    "SELECT SK_ID_CURR, TARGET, place, CASE WHEN TARGET IS NULL THEN 'test'"
    " WHEN place <= round_even(0.8 * n_class, 0) THEN 'train' ELSE 'validation' END AS split FROM ranked"
)


def _keys(t):
    return t.subject.select("SK_ID_CURR", "TARGET")


@query(
    "stratified_split",
    with_bound(
        "subject",
        ranked=RANKED,
        then="SELECT SK_ID_CURR, TARGET, CASE WHEN TARGET IS NOT NULL"
        " THEN place <= round_even(0.8 * n_class, 0) END AS in_sample FROM ranked",
    ),
)
def _(t):
    return sampling.stratified_sample(_keys(t), "SK_ID_CURR", "TARGET")


@query(
    "three_way_split",
    with_bound("subject", ranked=RANKED, split=SPLIT, then="SELECT * EXCLUDE (place) FROM split"),
)
def _(t):
    return sampling.three_way_split(_keys(t), "SK_ID_CURR", "TARGET")


FACTOR = "CAST(0.3 AS DOUBLE) * {zeros} / ({ones} * CAST(0.7 AS DOUBLE))"


@query(
    "upsample_factor",
    with_bound(
        "subject",
        then=f"SELECT n_0, n_1, {FACTOR.format(zeros='n_0', ones='n_1')} AS factor FROM (SELECT"
        " COUNT(CASE WHEN TARGET = 0 THEN 1 END) AS n_0,"
        " COUNT(CASE WHEN TARGET = 1 THEN 1 END) AS n_1 FROM subject)",
    ),
)
def _(t):
    return sampling.upsample_factor(_keys(t), "TARGET")


def draws_sql(rows: str, ones: str) -> str:
    """Positions drawn, counted, for class-1 rows numbered from 0 in ``ones``."""
    zeros = f"(SELECT COUNT(*) FROM {rows} WHERE TARGET = 0)"
    n = f"(SELECT COUNT(*) FROM {ones})"
    total = f"CAST(round_even({n} * ({FACTOR.format(zeros=zeros, ones=n)}), 0) AS BIGINT)"
    return (
        f"SELECT CAST('0x' || substr(md5(d || ':{SEED}'), 1, 15) AS BIGINT) % {n} AS position,"
        f" COUNT(*) AS copies FROM (SELECT unnest(range({total})) AS d) GROUP BY 1"
    )


@query(
    "upsample",
    with_bound(
        "subject",
        ranked=RANKED,
        ones="SELECT SK_ID_CURR, place - 1 AS position FROM ranked WHERE TARGET = 1",
        drawn=draws_sql("subject", "ones"),
        then="SELECT SK_ID_CURR, TARGET FROM subject WHERE TARGET = 0 UNION ALL SELECT SK_ID_CURR, 1"
        " FROM (SELECT SK_ID_CURR, unnest(range(copies)) FROM ones JOIN drawn USING (position))",
    ),
)
def _(t):
    return sampling.upsample(_keys(t), "SK_ID_CURR", "TARGET")


PLAN_TABLES = {
    "ranked": RANKED,
    "split": SPLIT,
    "trained": "SELECT * FROM split WHERE split = 'train'",
    "ones": "SELECT SK_ID_CURR, place - 1 AS position FROM trained WHERE TARGET = 1",
    "drawn": draws_sql("trained", "ones"),
    "plan": "SELECT SK_ID_CURR, split, CASE WHEN split = 'train' AND TARGET = 1"
    " THEN COALESCE(copies, 0) ELSE 1 END AS copies FROM split LEFT JOIN ones USING (SK_ID_CURR)"
    " LEFT JOIN drawn USING (position)",
}


@query(
    "split_rebalance",
    with_bound(
        *WIDE_INPUTS,
        **WIDE_TABLES,
        wide=WIDE,
        derived=DERIVED,
        **PLAN_TABLES,
        then="SELECT derived.*, split, copy FROM derived JOIN (SELECT SK_ID_CURR, split,"
        " unnest(range(copies)) + 1 AS copy FROM plan) USING (SK_ID_CURR)",
    ),
)
def _(t):
    derived = features.derive_features(wide(t))
    return rebalance.split_rebalance(derived, "SK_ID_CURR", "TARGET", keys=_keys(t)).rows


@query(
    "text_columns",
    with_bound(
        "subject",
        then="SELECT NAME_CONTRACT_TYPE, CODE_GENDER, NAME_TYPE_SUITE, NAME_INCOME_TYPE,"
        " NAME_EDUCATION_TYPE, NAME_FAMILY_STATUS, NAME_HOUSING_TYPE, OCCUPATION_TYPE,"
        " FONDKAPREMONT_MODE, FLAG_OWN_REALTY FROM subject",
    ),
)
def _(t):
    return t.subject.select(*selectors.character(t.subject))
