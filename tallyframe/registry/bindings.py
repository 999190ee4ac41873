"""The history tables of the workload, derived column by column from the given tables.

The formulas use only syntax common to Spark SQL and DuckDB, so one text feeds the query and its
check. Amounts are whole numbers held as doubles, so their sums are exact in any order; where means
are summed again, they are multiples of a common step, so that the means are whole too. NULLs, zero
divisors and the day sentinel are put in on purpose, since the given tables have none.
"""

from __future__ import annotations

from tallyframe.sources.schemas import CARD_MEASURES


def cents(x: str) -> str:
    return f"CAST(FLOOR(({x}) * 100 + 0.5) AS DOUBLE)"


STEP = 12252240  # divisible by every number up to 18
CARD_STEP = 5354228880  # divisible by every number up to 24


def steps(x: str, step: int = STEP) -> str:
    """The amount in whole units, in multiples of ``step``, so that means over not too many rows are exact."""
    return f"CAST(FLOOR({x}) * {step} AS DOUBLE)"


def real(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def whole(x: str) -> str:
    return f"CAST({x} AS INT)"


def pick(by: str, *texts: str) -> str:
    """One text per remainder; an empty one stands for a missing value."""
    cases = " ".join(
        f"WHEN ({by}) % {len(texts)} = {i} THEN " + (f"'{t}'" if t else "NULL")
        for i, t in enumerate(texts)
    )
    return f"CASE {cases} END"


SHIP_MONTH = whole("year(l_shipdate) * 12 + month(l_shipdate) - (2001 * 12 + 11)")
ORDER_MONTH = whole("year(o_orderdate) * 12 + month(o_orderdate) - (2001 * 12 + 8)")
EVENT_DAY = whole("(year(ts) - 2024) * 366 + dayofyear(ts) - 30")
EVENT_SHORT, EVENT_MID = -7, -21
STATUS = (
    "CASE l_returnflag WHEN 'N' THEN 'C' WHEN 'R' THEN 'X'"
    " ELSE CAST(l_linenumber % 6 AS STRING) END"
)
EVENT_LOAN = (
    "CAST(user_id * 10 + CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1"
    " WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS BIGINT)"
)

MONTHLY_STATUS = {
    "SK_ID_BUREAU": "l_orderkey",
    "MONTHS_BALANCE": SHIP_MONTH,
    "STATUS": STATUS,
}

EXTERNAL_LOANS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_BUREAU": "o_orderkey",
    "CREDIT_ACTIVE": "o_orderstatus",
    "CREDIT_CURRENCY": pick("o_orderkey", "currency 1", "currency 2", "currency 3"),
    "CREDIT_TYPE": "o_orderpriority",
    "AMT_CREDIT_SUM": cents("o_totalprice"),
    "AMT_CREDIT_SUM_DEBT": real(
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -o_orderkey"
        " ELSE (o_orderkey % 400) * 100000 END"
    ),
    "AMT_CREDIT_SUM_LIMIT": real(
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 300) * 100000 END"
    ),
    "AMT_CREDIT_SUM_OVERDUE": real("(o_orderkey % 5) * 10"),
    "AMT_CREDIT_MAX_OVERDUE": real(
        "CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE (o_orderkey % 8) * 25 END"
    ),
    "AMT_ANNUITY": real("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 97 END"),
    "CREDIT_DAY_OVERDUE": whole("CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey % 50 ELSE 0 END"),
    "CNT_CREDIT_PROLONG": whole("o_orderkey % 3"),
    "DAYS_CREDIT": f"{ORDER_MONTH} * 30",
    "DAYS_CREDIT_ENDDATE": whole(
        f"CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE {ORDER_MONTH} * 30 + o_orderkey % 700 END"
    ),
    "DAYS_ENDDATE_FACT": whole(
        f"CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {ORDER_MONTH} * 30 + o_orderkey % 500 END"
    ),
    "DAYS_CREDIT_UPDATE": whole(f"{ORDER_MONTH} * 30 + o_orderkey % 30"),
}

PREVIOUS_APPLICATIONS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_PREV": "o_orderkey",
    "NAME_CONTRACT_TYPE": pick(
        "o_orderkey", "Cash loans", "Consumer loans", "Revolving loans", ""
    ),
    "NAME_CASH_LOAN_PURPOSE": "o_orderpriority",
    "NAME_CONTRACT_STATUS": "o_orderstatus",
    "NAME_PAYMENT_TYPE": "o_orderpriority",
    "NAME_PORTFOLIO": pick("o_custkey", "POS", "Cash", "XNA"),
    "NAME_PRODUCT_TYPE": pick("o_orderkey", "x-sell", "walk-in"),
    "NAME_SELLER_INDUSTRY": pick("o_custkey", "Auto technology", "MLM partners", "Construction"),
    "NAME_YIELD_GROUP": pick("o_orderkey", "low_normal", "high", " 50% off", "(middle)", "low.normal"),
    "PRODUCT_COMBINATION": "o_orderpriority || ': ' || o_orderstatus",
    "AMT_APPLICATION": cents("o_totalprice"),
    "AMT_CREDIT": real(
        f"CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE {cents('o_totalprice')} - o_orderkey % 1000 END"
    ),
    "DAYS_DECISION": whole(
        f"CASE WHEN o_orderkey % 7 = 0 THEN 365243 ELSE {ORDER_MONTH} * 30 END"
    ),
    "DAYS_TERMINATION": whole(
        f"CASE WHEN o_custkey % 17 = 0 THEN 365243 ELSE {ORDER_MONTH} * 30 + o_orderkey % 90 END"
    ),
}

POS_SNAPSHOTS = {
    "SK_ID_PREV": EVENT_LOAN,
    "SK_ID_CURR": "user_id",
    "MONTHS_BALANCE": EVENT_DAY,
    "NAME_CONTRACT_STATUS": "CASE WHEN event_type = 'purchase' THEN 'Completed' ELSE 'Active' END",
    "CNT_INSTALMENT": real("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 24 END"),
    "CNT_INSTALMENT_FUTURE": real("CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 12 END"),
    "SK_DPD": whole("event_id % 5"),
    "SK_DPD_DEF": whole("CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id % 3 END"),
}

CARD_SNAPSHOTS = {
    "SK_ID_PREV": EVENT_LOAN,
    "SK_ID_CURR": "user_id",
    "MONTHS_BALANCE": EVENT_DAY,
    **{
        m: real(
            f"CASE WHEN event_id % {41 + i} = 0 THEN NULL"
            f" ELSE {steps('value', CARD_STEP)} + {i * CARD_STEP} * (event_id % 7) END"
        )
        for i, m in enumerate(CARD_MEASURES)
    },
}

LOAN_OWNERS = {"SK_ID_PREV": "o_orderkey", "SK_ID_CURR": "o_custkey"}

INSTALMENT_PAYMENTS = {
    "SK_ID_PREV": "l_orderkey",
    "NUM_INSTALMENT_NUMBER": real("l_linenumber"),
    "NUM_INSTALMENT_VERSION": real("CASE WHEN l_quantity = 50 THEN NULL ELSE l_linenumber END"),
    "AMT_INSTALMENT": steps("l_extendedprice"),
    "AMT_PAYMENT": f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {steps('l_extendedprice * (1 - l_discount)')} END",
}

SUBJECT = {
    "SK_ID_CURR": "c_custkey",
    "TARGET": whole("CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END"),
    "NAME_CONTRACT_TYPE": pick("c_custkey", "Cash loans", "Revolving loans"),
    "CODE_GENDER": pick("c_nationkey", "M", "F", "XNA"),
    "NAME_TYPE_SUITE": pick("c_custkey", "Family", "Spouse, partner", "", "Other_A"),
    "NAME_INCOME_TYPE": "c_mktsegment",
    "NAME_EDUCATION_TYPE": pick("c_nationkey", "Higher education", "Secondary / secondary special"),
    "NAME_FAMILY_STATUS": pick("c_custkey", "Married", "Single / not married", "Widow"),
    "NAME_HOUSING_TYPE": "CAST(c_nationkey AS STRING)",
    "OCCUPATION_TYPE": pick("c_custkey", "Laborers", "", "High skill tech staff", "IT staff", "Cooking staff"),
    "FONDKAPREMONT_MODE": pick("c_custkey", "reg oper account", "", "not specified"),
    "AMT_CREDIT": real("(c_custkey % 1000) * 10"),
    "AMT_ANNUITY": real("c_custkey % 97"),
    "AMT_GOODS_PRICE": real("c_custkey % 89"),
    "EXT_SOURCE_1": f"{real('c_custkey * 7 % 100')} / 100",
    "EXT_SOURCE_2": f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {real('c_custkey * 13 % 100')} / 100 END",
    "EXT_SOURCE_3": f"{real('c_nationkey')} / 25",
    "DAYS_BIRTH": whole("-(7000 + c_custkey % 15000)"),
    "DAYS_EMPLOYED": whole("CASE WHEN c_custkey % 9 = 0 THEN 365243 ELSE -(c_custkey % 5000) END"),
    "FLAG_DOCUMENT_2": whole("c_custkey % 2"),
    "FLAG_EMAIL": whole("CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END"),
    "FLAG_OWN_REALTY": pick("c_nationkey", "Y", "N"),
}

# name -> (source table, columns)
BOUND = {
    "monthly_status": ("lineitem", MONTHLY_STATUS),
    "external_loans": ("orders", EXTERNAL_LOANS),
    "previous_applications": ("orders", PREVIOUS_APPLICATIONS),
    "pos_snapshots": ("events", POS_SNAPSHOTS),
    "card_snapshots": ("events", CARD_SNAPSHOTS),
    "instalment_payments": ("lineitem", INSTALMENT_PAYMENTS),
    "loan_owners": ("orders", LOAN_OWNERS),
    "subject": ("customer", SUBJECT),
}


def bound_sql(name: str) -> str:
    """The binding as a SELECT over the given tables."""
    source, columns = BOUND[name]
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def with_bound(*names: str, then: str, **more: str) -> str:
    """``then`` with the named bindings, and any further named SELECTs, as common tables."""
    tables = {**{n: bound_sql(n) for n in names}, **more}
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in tables.items()) + " " + then
