"""Column kinds, target rates, outliers, histograms, densities and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import aggregates as A
from tallyframe.operators import aggregate, ordered, profile, sampling
from tallyframe.plans import features
from tallyframe.registry.bindings import SUBJECT, with_bound
from tallyframe.registry.core import query, rounded

LINE_NUMERIC = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
).split()
LINE_TEXT = ("l_returnflag", "l_linestatus")
SUBJECT_TEXT = (
    "NAME_CONTRACT_TYPE CODE_GENDER NAME_TYPE_SUITE NAME_INCOME_TYPE NAME_EDUCATION_TYPE"
    " NAME_FAMILY_STATUS NAME_HOUSING_TYPE OCCUPATION_TYPE FONDKAPREMONT_MODE FLAG_OWN_REALTY"
).split()


def distinct_sql(c: str) -> str:
    return f"COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"


def dummy_sql(c: str, text: bool) -> str:
    zero_one = "('0', '1')" if text else "(0, 1)"
    return f"BOOL_AND(COALESCE({c} IN {zero_one}, FALSE))"


def kinds_sql(table: str, numeric, text, others=()) -> str:
    rows = [
        f"SELECT '{c}' AS variable_name, {dummy_sql(c, False)} AS dummy,"
        f" {distinct_sql(c)} < 100 AS discrete, FALSE AS character FROM {table}"
        for c in numeric
    ]
    rows += [
        f"SELECT '{c}', {dummy_sql(c, True)}, FALSE, TRUE FROM {table}" for c in text
    ]
    rows += [f"SELECT '{c}', FALSE, FALSE, FALSE" for c in others]
    return " UNION ALL ".join(rows)


@query("column_kinds", kinds_sql("lineitem", LINE_NUMERIC, LINE_TEXT, ["l_shipdate"]))
def _(t):
    kinds = profile.column_kinds(t.lineitem)
    rows = [(c, k["dummy"], k["discrete"], k["character"]) for c, k in kinds.items()]
    return t.spark.createDataFrame(
        rows, "variable_name string, dummy boolean, discrete boolean, character boolean"
    )


@query(
    "select_kind",
    "SELECT l_linenumber, l_quantity, l_discount, l_tax FROM lineitem",
)
def _(t):
    # The number of suppliers depends on the scale.
    return profile.select_kind(t.lineitem.drop("l_suppkey"), "discrete")


SUBJECT_NUMERIC = [c for c in SUBJECT if c not in SUBJECT_TEXT]


@query(
    "variable_catalogue",
    with_bound(
        "subject",
        kinds=kinds_sql("subject", SUBJECT_NUMERIC, SUBJECT_TEXT),
        then="SELECT variable_name, variable_name = 'SK_ID_CURR' AS id, variable_name = 'TARGET' AS"
        " target, dummy, discrete, character, NOT (variable_name IN ('SK_ID_CURR', 'TARGET') OR dummy"
        " OR discrete OR character) AS continuous FROM kinds",
    ),
)
def _(t):
    return profile.variable_catalogue(t.subject, "SK_ID_CURR", "TARGET")


# ---- target rates

OVERALL = "(SELECT AVG(CAST(TARGET AS DOUBLE)) FROM labelled)"
LABELLED = "SELECT * FROM subject WHERE TARGET IS NOT NULL"
RATE = "CAST(SUM(TARGET) AS DOUBLE) / COUNT(*)"


def _labelled(t):
    return t.subject.filter(F.col("TARGET").isNotNull())


@query(
    "target_rate",
    with_bound(
        "subject",
        labelled=LABELLED,
        then=f"SELECT NAME_TYPE_SUITE, {OVERALL} AS prop, COUNT(*) AS n, {RATE} AS rate,"
        f" round_even({RATE} * 100, 0) AS label FROM labelled GROUP BY NAME_TYPE_SUITE",
    ),
)
def _(t):
    return aggregate.rate_by_level(_labelled(t), "TARGET", "NAME_TYPE_SUITE")


STRICT_RATE = "CASE WHEN COUNT(TARGET) = COUNT(*) THEN CAST(SUM(TARGET) AS DOUBLE) / COUNT(*) END"


@query(
    "rate_missing_target",
    with_bound(
        "subject",
        rates=f"SELECT NAME_FAMILY_STATUS, COUNT(*) AS n, {STRICT_RATE} AS rate FROM"
        " (SELECT * FROM subject WHERE TARGET IS NOT NULL OR NAME_FAMILY_STATUS = 'Widow') GROUP BY 1",
        then=f"SELECT NAME_FAMILY_STATUS, (SELECT {STRICT_RATE} FROM subject) AS prop, n, rate,"
        " round_even(rate * 100, 0) AS label FROM rates",
    ),
)
def _(t):
    some = t.subject.filter("TARGET IS NOT NULL OR NAME_FAMILY_STATUS = 'Widow'")
    return aggregate.rate_by_level(some, "TARGET", "NAME_FAMILY_STATUS")


@query(
    "count_and_rate",
    with_bound(
        "subject",
        labelled=LABELLED,
        levels=f"SELECT OCCUPATION_TYPE AS valor, CAST(COUNT(*) AS DOUBLE) AS n, {RATE} AS rate"
        " FROM labelled GROUP BY 1",
        then="SELECT 'OCCUPATION_TYPE' AS variable, valor, 'COUNT' AS measure, n AS value, n AS label,"
        " CAST(NULL AS DOUBLE) AS prop FROM levels UNION ALL SELECT 'OCCUPATION_TYPE', valor,"
        f" 'PROPORTION', rate, round_even(rate * 100, 0), {OVERALL} FROM levels",
    ),
)
def _(t):
    return profile.count_and_rate(_labelled(t), "TARGET", ["OCCUPATION_TYPE"])


def rates_sql(columns) -> str:
    parts = [
        f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS valor, COUNT(*) AS n, {OVERALL} AS prop,"
        f" {RATE} AS rate, round_even({RATE} * 100, 0) AS label FROM labelled GROUP BY 2"
        for c in columns
    ]
    return with_bound("subject", labelled=LABELLED, then=" UNION ALL ".join(parts))


@query("rate_all_dummy", rates_sql(["FLAG_DOCUMENT_2", "FLAG_EMAIL"]))
def _(t):
    df = _labelled(t)
    dummies = profile.columns_of_kind(profile.column_kinds(df), "dummy", exclude=["TARGET"])
    return profile.level_rates(df, "TARGET", dummies)


@query("rate_all_discrete", rates_sql(["AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]))
def _(t):
    df = _labelled(t)
    discrete = profile.columns_of_kind(profile.column_kinds(df), "discrete", exclude=["TARGET"])
    return profile.level_rates(df, "TARGET", discrete)


# ---- continuous variables

PRICE_GAP = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END"
DONE = "CAST(o_orderstatus = 'F' AS INT)"
PRICES = f"SELECT o_orderkey, {DONE} AS target, {PRICE_GAP} AS price FROM orders"
FENCES = (
    "SELECT greatest(MIN(price), quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75)"
    " - quantile_cont(price, 0.25))) AS lower, least(MAX(price), quantile_cont(price, {anchor}) + 1.5 *"
    " (quantile_cont(price, 0.75) - quantile_cont(price, 0.25))) AS upper FROM prices"
)


def _prices(t):
    return t.orders.selectExpr("o_orderkey", f"{DONE} AS target", f"{PRICE_GAP} AS price")


@query(
    "iqr_trim",
    f"WITH prices AS ({PRICES}), fences AS ({FENCES.format(anchor=0.25)}) SELECT o_orderkey,"
    " CASE WHEN price BETWEEN lower AND upper THEN price END AS price FROM prices, fences",
)
def _(t):
    return profile.trim_outliers(_prices(t), "price").select("o_orderkey", "price")


@query(
    "iqr_trim_textbook",
    f"WITH prices AS ({PRICES}), fences AS ({FENCES.format(anchor=0.75)}) SELECT o_orderkey,"
    " CASE WHEN price BETWEEN lower AND upper THEN price END AS price FROM prices, fences",
)
def _(t):
    return profile.trim_outliers(_prices(t), "price", "q3").select("o_orderkey", "price")


NA_SHARE = "round_even((SELECT AVG(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM prices), 0)"


@query(
    "continuous_views",
    f"""WITH prices AS ({PRICES}), fences AS ({FENCES.format(anchor=0.25)}),
    rows AS (SELECT * FROM prices, fences)
    SELECT o_orderkey, target, 'price' AS variable, 'ORIGINAL' AS view, price AS value,
           {NA_SHARE} AS na_prop FROM rows
    UNION ALL SELECT o_orderkey, target, 'price', 'IQR',
           CASE WHEN price BETWEEN lower AND upper THEN price END, {NA_SHARE} FROM rows
    UNION ALL SELECT o_orderkey, target, 'price', 'LOG', ROUND(ln(1 + price), 6), {NA_SHARE} FROM rows""",
)
def _(t):
    views = profile.continuous_views(_prices(t), "target", ["price"], keep=["o_orderkey"])
    logged = F.when(F.col("view") == "LOG", F.round("value", 6)).otherwise(F.col("value"))
    return views.withColumn("value", logged)


BINS = 64
HISTOGRAM = (
    f"SELECT target, CAST(least(floor((price - low) / ((high - low) / {BINS}.0)), {BINS - 1}) AS INT)"
    " AS bin, COUNT(*) AS n, low, high FROM prices, (SELECT MIN(price) AS low, MAX(price) AS high"
    " FROM prices) WHERE price IS NOT NULL GROUP BY target, bin, low, high"
)


@query(
    "class_histogram",
    f"WITH prices AS ({PRICES}) SELECT 'price' AS variable, target, bin, n, low, high FROM ({HISTOGRAM})",
)
def _(t):
    return profile.class_histogram(_prices(t), "target", ["price"], bins=BINS)


def density_sql(prices: str, extra: str = "") -> str:
    return f"""SELECT * FROM (WITH prices AS ({prices}), bars AS ({HISTOGRAM}),
    widths AS (SELECT target, 0.9 * least(stddev_samp(price),
        (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / 1.34)
        * power(COUNT(price), -0.2) AS bw, COUNT(price) AS total FROM prices GROUP BY target)
    SELECT 'price' AS variable, {extra} target, ROUND(bw, 6) AS bw, CAST(point AS INT) AS point, ROUND(x, 6) AS x,
        ROUND(SUM(n * exp(-0.5 * power((x - mid) / bw, 2))) / (total * bw * sqrt(2 * pi())), 14) AS density
    FROM (SELECT bars.target, n, bw, total, point, low + point * (high - low) / {BINS - 1}.0 AS x,
            low + (bin + 0.5) * ((high - low) / {BINS}.0) AS mid
          FROM bars JOIN widths USING (target), range({BINS}) g(point))
    GROUP BY target, bw, total, point, x)"""


@query("class_density", density_sql(PRICES))
def _(t):
    out = profile.class_density(_prices(t), "target", ["price"], points=BINS, bins=BINS)
    return rounded(rounded(out, ["bw", "x"], 6), ["density"], 14)


TRIMMED = (
    f"WITH prices AS ({PRICES}), fences AS ({FENCES.format(anchor=0.25)}) SELECT o_orderkey, target,"
    " CASE WHEN price BETWEEN lower AND upper THEN price END AS price FROM prices, fences"
)


@query(
    "view_density",
    density_sql(PRICES, "'ORIGINAL' AS view,") + " UNION ALL " + density_sql(TRIMMED, "'IQR' AS view,"),
)
def _(t):
    out = profile.view_density(_prices(t), "target", ["price"], points=BINS, bins=BINS)
    # Logarithms differ in their last bits between engines and so move values between bars.
    out = out.filter("view <> 'LOG'")
    return rounded(rounded(out, ["bw", "x"], 6), ["density"], 14)


@query(
    "quality_checks",
    with_bound(
        "external_loans",
        then="SELECT "
        + ", ".join(
            f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"
            for name, cond in {
                "AMT_CREDIT_SUM_DEBT_GT_SUM": "AMT_CREDIT_SUM_DEBT > AMT_CREDIT_SUM",
                "AMT_CREDIT_SUM_LIMIT_GT_SUM": "AMT_CREDIT_SUM_LIMIT > AMT_CREDIT_SUM",
                "AMT_CREDIT_SUM_DEBT_LT_0": "AMT_CREDIT_SUM_DEBT < 0",
                "CREDIT_DAY_OVERDUE_GT_0": "CREDIT_DAY_OVERDUE > 0",
            }.items()
        )
        + " FROM external_loans",
    ),
)
def _(t):
    return features.loan_quality(t.bound("external_loans"))


@query(
    "quantile_empty",
    "SELECT COUNT(price) AS n, MIN(price) AS lowest, MAX(price) AS highest,"
    f" quantile_cont(price, 0.25) AS q0, quantile_cont(price, 0.75) AS q1 FROM ({PRICES}) WHERE price < 0",
)
def _(t):
    return ordered.exact_quantiles(_prices(t).filter("price < 0"), [], "price", [0.25, 0.75])


@query(
    "quantile_overall",
    "SELECT COUNT(price) AS n, MIN(price) AS lowest, MAX(price) AS highest,"
    " ROUND(quantile_cont(price, 0.25), 6) AS q0, ROUND(quantile_cont(price, 0.5), 6) AS q1,"
    f" ROUND(quantile_cont(price, 0.75), 6) AS q2 FROM ({PRICES})",
)
def _(t):
    q = ordered.exact_quantiles(_prices(t), [], "price", [0.25, 0.5, 0.75])
    return rounded(q, ["q0", "q1", "q2"], 6)


@query(
    "missing_share_all",
    "SELECT 'price' AS variable, CAST(SUM(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS DOUBLE)"
    f" / COUNT(*) * 100 AS na_prop FROM ({PRICES})",
)
def _(t):
    return profile.missing_shares(_prices(t), ["price"])


@query(
    "class_balance",
    with_bound("subject", then="SELECT TARGET, COUNT(*) AS n FROM subject GROUP BY TARGET"),
)
def _(t):
    return sampling.class_balance(t.subject, "TARGET")


# ---- every variable of a kind

LEVEL_COLUMNS = [
    *[c for c in SUBJECT_TEXT],
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "FLAG_DOCUMENT_2",
    "FLAG_EMAIL",
]


def levels_sql() -> str:
    parts = [
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS valor, CAST(COUNT(*) AS DOUBLE) AS n,"
        f" {RATE} AS rate FROM labelled GROUP BY 2"
        for c in LEVEL_COLUMNS
    ]
    return with_bound(
        "subject",
        labelled=LABELLED,
        levels=" UNION ALL ".join(parts),
        then="SELECT variable, valor, 'COUNT' AS measure, n AS value, n AS label,"
        " CAST(NULL AS DOUBLE) AS prop FROM levels UNION ALL SELECT variable, valor,"
        f" 'PROPORTION', rate, round_even(rate * 100, 0), {OVERALL} FROM levels",
    )


@query("profile_levels", levels_sql())
def _(t):
    return profile.profile_levels(_labelled(t), "SK_ID_CURR", "TARGET")


CONTINUOUS_COLUMNS = ("AMT_CREDIT", "DAYS_BIRTH", "DAYS_EMPLOYED")


def views_sql() -> str:
    parts = []
    for c in CONTINUOUS_COLUMNS:
        spread = f"1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
        parts.append(
            f"SELECT SK_ID_CURR, TARGET, '{c}' AS variable, CAST({c} AS DOUBLE) AS v, lower, upper,"
            f" na_prop FROM labelled, (SELECT greatest(MIN({c}), quantile_cont({c}, 0.25) - {spread})"
            f" AS lower, least(MAX({c}), quantile_cont({c}, 0.25) + {spread}) AS upper, round_even("
            f"AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 0) AS na_prop FROM labelled)"
        )
    return with_bound(
        "subject",
        labelled=LABELLED,
        rows=" UNION ALL ".join(parts),
        then="SELECT SK_ID_CURR, TARGET, variable, 'ORIGINAL' AS view, v AS value, na_prop FROM rows"
        " UNION ALL SELECT SK_ID_CURR, TARGET, variable, 'IQR',"
        " CASE WHEN v BETWEEN lower AND upper THEN v END, na_prop FROM rows"
        " UNION ALL SELECT SK_ID_CURR, TARGET, variable, 'LOG',"
        " CASE WHEN v > -1 THEN ROUND(ln(1 + v), 6) END, na_prop FROM rows",
    )


@query("profile_continuous", views_sql())
def _(t):
    views = profile.profile_continuous(_labelled(t), "SK_ID_CURR", "TARGET")
    logged = F.when(F.col("view") == "LOG", F.round("value", 6)).otherwise(F.col("value"))
    return views.withColumn("value", logged)
