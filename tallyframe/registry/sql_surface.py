"""The library's functions as a user of ``spark.sql`` calls them."""

from __future__ import annotations

from tallyframe.functions import sql
from tallyframe.operators import profile, sampling
from tallyframe.registry import basics, profiling
from tallyframe.registry.core import ORACLES, query


def _ask(t, text: str, **tables):
    sql.register_functions(t.spark)
    return t.spark.sql(text, **tables)


@query("sql_clean_str", ORACLES["clean_levels"])
def _(t):
    raw = t.orders.selectExpr("o_orderkey", f"{basics.AWKWARD} AS raw")
    return _ask(t, "SELECT o_orderkey, raw, 'PRIO_' || clean_str(raw) AS level FROM {raw}", raw=raw)


@query("sql_period_bucket", ORACLES["period_bucket"])
def _(t):
    months = t.orders.selectExpr("o_orderkey", f"{basics.ORDER_MONTH} AS m")
    return _ask(t, "SELECT o_orderkey, m, period_bucket(m) AS period FROM {months}", months=months)


@query("sql_recode_status", ORACLES["status_recode"])
def _(t):
    raw = t.lineitem.selectExpr("l_orderkey", "l_partkey", f"{basics.STATUS} AS raw")
    return _ask(
        t,
        "SELECT l_orderkey, l_partkey, status, CAST(status <> 0 AS INT) AS bad"
        " FROM (SELECT *, recode_status(raw) AS status FROM {raw})",
        raw=raw,
    )


@query("sql_one_hot", ORACLES["one_hot_named"])
def _(t):
    """The levels are given, as a stored dictionary would give them."""
    columns = {"o_orderpriority": list(basics.PRIORITIES), "o_orderstatus": list("FOP")}
    sides = []
    for c, levels in columns.items():
        quoted = ", ".join(f"'{v}'" for v in levels)
        sides.append(f"one_hot({c}, '{c}', array({quoted})) AS {c}_map")
    made = [
        f"{c}_map['{c}_{basics.PRIORITIES.get(v, v)}'] AS {c}_{basics.PRIORITIES.get(v, v)}"
        for c, levels in columns.items()
        for v in levels
    ]
    return _ask(
        t,
        f"SELECT o_orderkey, {', '.join(made)} FROM (SELECT o_orderkey, {', '.join(sides)} FROM {{orders}})",
        orders=t.orders,
    )


@query("sql_remove_outliers", ORACLES["iqr_trim"])
def _(t):
    prices = profiling._prices(t)
    ends = profile.fences(prices, ["price"]).select("quartile_1", "quartile_3")
    ends = "(SELECT struct(quartile_1, quartile_3) FROM {ends})", ends
    return _ask(
        t,
        "SELECT o_orderkey, remove_outliers_iqr(price, q.quartile_1, q.quartile_3) AS price"
        f" FROM (SELECT o_orderkey, CAST(price AS DOUBLE) AS price, {ends[0]} AS q FROM {{prices}})",
        prices=prices,
        ends=ends[1],
    )


@query("sql_proportion_sampling", ORACLES["poisson_upsample"])
def _(t):
    t.subject.select("SK_ID_CURR", "TARGET").createOrReplaceTempView("sampled_subject")
    sql.register_sampling(
        t.spark, "sampled_subject", "SK_ID_CURR", "TARGET", sampling.MINORITY_SHARE, sampling.SEED + 1, "sampled_subject_rows"
    )
    return t.spark.sql("SELECT * FROM sampled_subject_rows()")
