"""Filters, projections, scalars, joins, aggregates, reshaping, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import aggregates as A
from tallyframe.functions import scalar as S
from tallyframe.operators import aggregate, encode, joins, ordered, reshape, selectors
from tallyframe.registry.bindings import (
    EVENT_DAY,
    EVENT_MID,
    EVENT_SHORT,
    ORDER_MONTH,
    STATUS,
    cents,
    steps,
    with_bound,
)
from tallyframe.registry.core import query, rounded
from tallyframe.sources.readers import dictionary_lookup

PRIORITIES = {
    "1-URGENT": "X1_URGENT",
    "2-HIGH": "X2_HIGH",
    "3-MEDIUM": "X3_MEDIUM",
    "4-NOT SPECIFIED": "X4_NOT_SPECIFIED",
    "5-LOW": "X5_LOW",
}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


# ---- filters and projections


@query(
    "dictionary_lookup",
    "SELECT p_partkey, p_name FROM part"
    " WHERE regexp_matches(p_type, '^(SMALL|STANDARD)') AND p_brand = 'Brand#7'",
)
def _(t):
    found = dictionary_lookup(t.part, "^(SMALL|STANDARD)", "Brand#7", "p_type", "p_brand", None)
    return found.select("p_partkey", "p_name")


@query(
    "filter_compare",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000",
)
def _(t):
    return t.orders.filter(F.col("o_totalprice") > 400000).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "filter_missing",
    with_bound("subject", then="SELECT SK_ID_CURR FROM subject WHERE TARGET IS NULL"),
)
def _(t):
    return t.subject.filter(S.is_missing("TARGET")).select("SK_ID_CURR")


@query(
    "select_pattern",
    "SELECT l_extendedprice, l_orderkey, l_partkey, l_suppkey AS supplier, l_shipdate FROM lineitem",
)
def _(t):
    df = t.lineitem
    chosen = [
        *selectors.starts_with(df, "L_EXT"),
        *selectors.ends_with(df, "KEY"),
        *selectors.contains(df, "SHIP"),
    ]
    return df.select(*chosen).withColumnRenamed("l_suppkey", "supplier")


@query("select_type", "SELECT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select(*selectors.character(t.lineitem))


@query(
    "sentinel_to_null",
    "SELECT p_partkey, NULLIF(p_size, 50) AS p_size FROM part",
)
def _(t):
    part = t.part.select("p_partkey", "p_size")
    days = selectors.starts_with(part, "P_SIZE")
    return selectors.map_columns(part, days, lambda c: S.sentinel_to_null(c, 50))


# ---- scalars


def clean_sql(x: str) -> str:
    """The level-cleaning steps, one nested call each."""
    x = f"COALESCE({x}, 'NA')"
    x = f"replace(replace({x}, '''', ''), '\"', '')"
    x = f"replace({x}, '%', 'percent')"
    x = f"regexp_replace({x}, '^ +', '')"
    x = f"CASE WHEN {x} = '' THEN 'X' ELSE regexp_replace({x}, '^([^A-Za-z.]|[.][0-9])', 'X\\1') END"
    for pattern, by in (("[^A-Za-z0-9._]", "."), ("[.]+", "_"), ("_+", "_")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"upper(regexp_replace({x}, '_$', ''))"


AWKWARD = (
    "CASE o_orderkey % 8 WHEN 0 THEN o_orderpriority WHEN 1 THEN '  ' || o_orderpriority"
    " WHEN 2 THEN o_orderpriority || ' 50% off' WHEN 3 THEN '_' || o_orderstatus || '..'"
    " WHEN 4 THEN '.5' || o_orderstatus WHEN 5 THEN '(' || o_orderstatus || ') \"q\"'"
    " WHEN 6 THEN replace(o_orderstatus, 'F', '') ELSE NULL END"
)


@query(
    "clean_levels",
    f"SELECT o_orderkey, raw, 'PRIO_' || {clean_sql('raw')} AS level"
    f" FROM (SELECT o_orderkey, {AWKWARD} AS raw FROM orders)",
)
def _(t):
    raw = t.orders.selectExpr("o_orderkey", f"{AWKWARD} AS raw")
    return raw.withColumn("level", S.level_name("PRIO", "raw"))


SPACED_NAME = "CASE WHEN p_size = 50 THEN ' ' || p_name ELSE replace(p_name, ' ', '-x ') END"


@query(
    "extract_prefix",
    "SELECT p_partkey, NULLIF(regexp_extract(t, '^[\\w\\-]+', 0), '') AS token"
    f" FROM (SELECT p_partkey, {SPACED_NAME} AS t FROM part)",
)
def _(t):
    text = t.part.selectExpr("p_partkey", f"{SPACED_NAME} AS t")
    return text.select("p_partkey", S.extract_prefix("t").alias("token"))


@query(
    "period_bucket",
    "SELECT o_orderkey, m, CASE WHEN m >= -12 THEN 'SHORT' WHEN m >= -48 THEN 'MID' ELSE 'LONG' END"
    f" AS period FROM (SELECT o_orderkey, {ORDER_MONTH} AS m FROM orders)",
)
def _(t):
    months = t.orders.selectExpr("o_orderkey", f"{ORDER_MONTH} AS m")
    return months.withColumn("period", S.period_bucket("m"))


RECODE_SQL = "CASE {0} WHEN 'C' THEN 0 WHEN 'X' THEN NULL ELSE TRY_CAST({0} AS INT) END"


@query(
    "status_recode",
    "SELECT l_orderkey, l_partkey, s AS status, CAST(s <> 0 AS INT) AS bad FROM (SELECT l_orderkey,"
    f" l_partkey, {RECODE_SQL.format('raw')} AS s FROM (SELECT *, {STATUS} AS raw FROM lineitem))",
)
def _(t):
    raw = t.lineitem.selectExpr("l_orderkey", "l_partkey", f"{STATUS} AS raw")
    coded = raw.withColumn("status", S.recode_status("raw"))
    return coded.select("l_orderkey", "l_partkey", "status", S.truthy("status").alias("bad"))


GAP = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"


@query(
    "ratio_features",
    "SELECT l_orderkey, l_partkey, l_quantity / NULLIF(l_tax, 0) AS tax_ratio,"
    " (l_tax + l_discount + q) / 3 AS mean_3, l_tax * l_discount * q AS prod_3,"
    " COALESCE((l_tax + l_discount + q) / 3, 0) AS mean_3_filled"
    f" FROM (SELECT *, {GAP} AS q FROM lineitem)",
)
def _(t):
    three = ("l_tax", "l_discount", "q")
    df = t.lineitem.withColumn("q", F.expr(GAP))
    return df.select(
        "l_orderkey",
        "l_partkey",
        S.safe_ratio("l_quantity", "l_tax").alias("tax_ratio"),
        S.row_mean(*three).alias("mean_3"),
        S.row_product(*three).alias("prod_3"),
        S.null_to_zero(S.row_mean(*three)).alias("mean_3_filled"),
    )


@query(
    "comparison_flags",
    "SELECT l_orderkey, l_partkey, CAST(q > 25 AS INT) AS q_gt_25,"
    " CAST(l_discount > l_tax AS INT) AS discount_gt_tax"
    f" FROM (SELECT *, {GAP} AS q FROM lineitem)",
)
def _(t):
    df = t.lineitem.withColumn("q", F.expr(GAP))
    return df.select(
        "l_orderkey",
        "l_partkey",
        S.flag(F.col("q") > 25).alias("q_gt_25"),
        S.flag(F.col("l_discount") > F.col("l_tax")).alias("discount_gt_tax"),
    )


# ---- one-hot


@query(
    "one_hot_plain",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderstatus = '{s}' AS INT) AS {s}" for s in "FOP")
    + " FROM orders",
)
def _(t):
    return encode.one_hot_plain(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query(
    "one_hot_named",
    "SELECT o_orderkey, "
    + ", ".join(
        f"CAST(o_orderpriority = '{raw}' AS INT) AS o_orderpriority_{clean}"
        for raw, clean in PRIORITIES.items()
    )
    + ", "
    + ", ".join(f"CAST(o_orderstatus = '{s}' AS INT) AS o_orderstatus_{s}" for s in "FOP")
    + " FROM orders",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.one_hot_named(df, ["o_orderpriority", "o_orderstatus"])


# ---- joins

LINES_BY_ORDER = (
    "SELECT l_orderkey, COUNT(*) AS n_lines, CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)"
    " AS BIGINT) AS n_returned FROM lineitem GROUP BY l_orderkey"
)


def _lines_by_order(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        A.row_count().alias("n_lines"),
        A.count_where(F.col("l_returnflag") == "A").alias("n_returned"),
    )


@query(
    "left_join_rollup",
    f"SELECT o_orderkey, o_custkey, n_lines, n_returned FROM orders LEFT JOIN ({LINES_BY_ORDER})"
    " ON o_orderkey = l_orderkey",
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_custkey")
    rollup = _lines_by_order(t).withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.left_join(orders, rollup, ["o_orderkey"])


@query(
    "star_join",
    f"""SELECT c_custkey, c_mktsegment, n_orders, top_price, n_lines, n_events, top_value
    FROM customer
    LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders, MAX(o_totalprice) AS top_price
               FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey
    LEFT JOIN (SELECT o_custkey, CAST(SUM(n_lines) AS BIGINT) AS n_lines FROM orders
               JOIN ({LINES_BY_ORDER}) ON o_orderkey = l_orderkey GROUP BY 1) l
           ON c_custkey = l.o_custkey
    LEFT JOIN (SELECT user_id, COUNT(*) AS n_events, MAX(value) AS top_value
               FROM events GROUP BY 1) e ON c_custkey = user_id""",
)
def _(t):
    by_order = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        A.row_count().alias("n_orders"), F.max("o_totalprice").alias("top_price")
    )
    lines = _lines_by_order(t).withColumnRenamed("l_orderkey", "o_orderkey")
    by_line = (
        t.orders.join(lines, "o_orderkey")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum("n_lines").alias("n_lines"))
    )
    by_event = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        A.row_count().alias("n_events"), F.max("value").alias("top_value")
    )
    subjects = t.customer.select("c_custkey", "c_mktsegment")
    return joins.star_join(subjects, [by_order, by_line, by_event], ["c_custkey"])


@query(
    "semi_join_coverage",
    "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.semi_join(t.orders.select("o_orderkey"), lines, ["o_orderkey"])


# ---- aggregates

PRICE_GAP = f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {cents('l_extendedprice')} END"
ALL_GAP = "CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_linenumber END"
GAPS = f"SELECT l_orderkey, l_suppkey, {PRICE_GAP} AS price, {ALL_GAP} AS line FROM lineitem"


def _gaps(t):
    return t.lineitem.selectExpr(
        "l_orderkey", "l_suppkey", f"{PRICE_GAP} AS price", f"{ALL_GAP} AS line"
    )


@query("group_count", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(A.row_count().alias("n"))


@query(
    "group_nullskip",
    "SELECT l_suppkey, MAX(price) AS top, MIN(price) AS low, COALESCE(SUM(price), 0) AS total,"
    " AVG(price) AS mean, MAX(line) AS top_line, CAST(COALESCE(SUM(line), 0) AS BIGINT) AS lines,"
    f" AVG(CAST(line AS DOUBLE)) AS mean_line FROM ({GAPS}) GROUP BY l_suppkey",
)
def _(t):
    return _gaps(t).groupBy("l_suppkey").agg(
        A.max_skip("price").alias("top"),
        A.min_skip("price").alias("low"),
        A.sum_skip("price").alias("total"),
        A.mean_skip("price").alias("mean"),
        A.max_skip("line").alias("top_line"),
        A.sum_skip("line").alias("lines"),
        A.mean_skip("line").alias("mean_line"),
    )


def strict_sql(fn: str, column: str, cast: str = "") -> str:
    call = f"{fn}({column})"
    call = f"CAST({call} AS {cast})" if cast else call
    return f"CASE WHEN COUNT({column}) = COUNT(*) THEN {call} END"


@query(
    "group_strict",
    f"SELECT l_orderkey, {strict_sql('AVG', 'price')} AS mean, {strict_sql('MAX', 'price')} AS top,"
    f" {strict_sql('MIN', 'price')} AS low, {strict_sql('SUM', 'price')} AS total"
    f" FROM ({GAPS}) GROUP BY l_orderkey",
)
def _(t):
    return _gaps(t).groupBy("l_orderkey").agg(
        A.strict_mean("price").alias("mean"),
        A.strict_max("price").alias("top"),
        A.strict_min("price").alias("low"),
        A.strict_sum("price").alias("total"),
    )


@query(
    "sum_selected",
    "SELECT o_custkey, "
    + ", ".join(
        f"CAST(SUM(CASE WHEN o_orderpriority = '{raw}' THEN 1 ELSE 0 END) AS BIGINT)"
        f" AS o_orderpriority_{clean}"
        for raw, clean in PRIORITIES.items()
    )
    + " FROM orders GROUP BY o_custkey",
)
def _(t):
    wide = encode.one_hot_named(t.orders.select("o_custkey", "o_orderpriority"), ["o_orderpriority"])
    chosen = selectors.starts_with(wide, "O_ORDERPRIORITY_")
    return aggregate.fan_out(wide, ["o_custkey"], chosen, {"": A.strict_sum})


MEASURES = (
    f"SELECT user_id, event_id, {cents('value')} AS amount,"
    f" CASE WHEN event_id % 3 = 0 THEN NULL ELSE {EVENT_DAY} END AS day FROM events"
)


def _measures(t):
    return t.events.selectExpr(
        "user_id",
        "event_id",
        f"{cents('value')} AS amount",
        f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE {EVENT_DAY} END AS day",
    )


def fan_sql(column: str, kind: str, spec: dict[str, str], strict: bool = False) -> str:
    """``<column>_<name>`` per function; sums are of ``kind``."""
    out = []
    for name, fn in spec.items():
        call = {
            "n": "COUNT(*)",
            "max": f"MAX({column})",
            "min": f"MIN({column})",
            "mean": f"AVG(CAST({column} AS DOUBLE))",
            "sum": strict_sql("SUM", column, kind)
            if strict
            else f"CAST(COALESCE(SUM({column}), 0) AS {kind})",
        }[fn]
        out.append(f"{call} AS {column}{'_' + name if name else ''}")
    return ", ".join(out)


FIVE = {"N": "n", "MAX_BUREAU": "max", "MIN_BUREAU": "min", "SUM_BUREAU": "sum", "MEAN_BUREAU": "mean"}


@query(
    "fanout_5",
    f"SELECT user_id, {fan_sql('amount', 'DOUBLE', FIVE)}, {fan_sql('day', 'BIGINT', FIVE)}"
    f" FROM ({MEASURES}) GROUP BY user_id",
)
def _(t):
    return aggregate.fan_out_numeric(
        _measures(t), ["user_id"], aggregate.FIVE_FUNCTIONS, exclude=["event_id"]
    )


@query(
    "fanout_strict",
    f"SELECT l_orderkey, {fan_sql('price', 'DOUBLE', {'SUM': 'sum', 'N': 'n'}, True)},"
    f" {fan_sql('line', 'BIGINT', {'SUM': 'sum', 'N': 'n'}, True)}"
    f" FROM ({GAPS}) GROUP BY l_orderkey",
)
def _(t):
    return aggregate.fan_out_numeric(
        _gaps(t), ["l_orderkey"], aggregate.STRICT_SUM_COUNT, exclude=["l_suppkey"]
    )


@query(
    "fanout_all",
    f"SELECT user_id, {fan_sql('amount', 'DOUBLE', {'sum': 'sum', 'n': 'n'})},"
    f" {fan_sql('day', 'BIGINT', {'sum': 'sum', 'n': 'n'})} FROM ({MEASURES}) GROUP BY user_id",
)
def _(t):
    return aggregate.fan_out_all(
        _measures(t), ["user_id"], aggregate.SUM_COUNT, exclude=["event_id"]
    )


@query(
    "fanout_sum",
    f"SELECT user_id, {fan_sql('amount', 'DOUBLE', {'': 'sum'})},"
    f" {fan_sql('day', 'BIGINT', {'': 'sum'})} FROM ({MEASURES}) GROUP BY user_id",
)
def _(t):
    return aggregate.sum_all(_measures(t), ["user_id"], exclude=["event_id"])


@query(
    "fanout_sum_mean",
    f"SELECT user_id, {fan_sql('amount', 'DOUBLE', {'SUM': 'sum', 'MEAN': 'mean'})},"
    f" {fan_sql('day', 'BIGINT', {'SUM': 'sum', 'MEAN': 'mean'})} FROM ({MEASURES}) GROUP BY user_id",
)
def _(t):
    return aggregate.fan_out(_measures(t), ["user_id"], ["amount", "day"], aggregate.SUM_MEAN)


STEP_GAP = f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {steps('l_extendedprice')} END"


@query(
    "two_level_agg",
    "SELECT o_custkey, SUM(m) AS price_sum, AVG(m) AS price_mean,"
    " CAST(SUM(n) AS BIGINT) AS lines FROM (SELECT o_custkey, l_orderkey,"
    f" {strict_sql('AVG', 'price')} AS m, COUNT(*) AS n FROM (SELECT o_custkey, l_orderkey,"
    f" {STEP_GAP} AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2)"
    " GROUP BY o_custkey",
)
def _(t):
    # Lines are rolled up to orders before they meet the orders table.
    lines = t.lineitem.selectExpr("l_orderkey", f"{STEP_GAP} AS price")
    per_order = lines.groupBy("l_orderkey").agg(
        A.strict_mean("price").alias("m"), A.row_count().alias("n")
    )
    return (
        t.orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(
            F.sum("m").alias("price_sum"),
            A.mean_skip("m").alias("price_mean"),
            F.sum("n").alias("lines"),
        )
    )


@query(
    "conditional_count_max",
    with_bound(
        "monthly_status",
        then="SELECT SK_ID_BUREAU, CAST(SUM(CASE WHEN s <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad,"
        " MAX(CASE WHEN s > 0 THEN MONTHS_BALANCE END) AS last_bad FROM (SELECT *,"
        f" {RECODE_SQL.format('STATUS')} AS s FROM monthly_status) GROUP BY SK_ID_BUREAU",
    ),
)
def _(t):
    coded = t.bound("monthly_status").withColumn("s", S.recode_status("STATUS"))
    return coded.groupBy("SK_ID_BUREAU").agg(
        A.count_where(F.col("s") != 0).alias("bad"),
        A.max_where(F.col("s") > 0, "MONTHS_BALANCE").alias("last_bad"),
    )


TYPE_GAP = "CASE WHEN p_size = 50 THEN NULL ELSE p_type END"


@query(
    "tabyl",
    f"""WITH f AS (SELECT {TYPE_GAP} AS p_type, COUNT(*) AS n FROM part GROUP BY 1)
    SELECT p_type, n, round_even(n / (SELECT SUM(n) FROM f), 2) AS percent,
    CASE WHEN p_type IS NOT NULL
         THEN round_even(n / (SELECT SUM(n) FROM f WHERE p_type IS NOT NULL), 2) END AS valid_percent
    FROM f""",
)
def _(t):
    return aggregate.frequency_table(t.part.selectExpr(f"{TYPE_GAP} AS p_type"), "p_type", digits=2)


@query("distinct_values", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def _(t):
    return t.orders.select("o_orderpriority", "o_orderstatus").distinct()


@query(
    "distinct_count",
    f"SELECT COUNT(DISTINCT v) + MAX(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n_distinct"
    f" FROM (SELECT {GAP} AS v FROM lineitem)",
)
def _(t):
    return aggregate.distinct_count(t.lineitem.selectExpr(f"{GAP} AS v"), "v")


@query(
    "quantile_iqr",
    "SELECT l_suppkey, COUNT(l_extendedprice) AS n, MIN(l_extendedprice) AS lowest,"
    " MAX(l_extendedprice) AS highest, ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS q1,"
    " ROUND(quantile_cont(l_extendedprice, 0.75), 6) AS q3,"
    " ROUND(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr"
    " FROM lineitem GROUP BY l_suppkey",
)
def _(t):
    q = ordered.exact_quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", [0.25, 0.75])
    out = q.select(
        "l_suppkey",
        "n",
        "lowest",
        "highest",
        F.col("q0").alias("q1"),
        F.col("q1").alias("q3"),
        (F.col("q1") - F.col("q0")).alias("iqr"),
    )
    return rounded(out, ["q1", "q3", "iqr"], 6)


@query(
    "missing_share",
    f"SELECT l_suppkey, CAST(SUM(CASE WHEN q IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) * 100"
    f" AS na_prop FROM (SELECT l_suppkey, {GAP} AS q FROM lineitem) GROUP BY l_suppkey",
)
def _(t):
    gaps = t.lineitem.selectExpr("l_suppkey", f"{GAP} AS q")
    return gaps.groupBy("l_suppkey").agg(A.missing_share("q").alias("na_prop"))


# ---- window-like


@query(
    "row_number",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS row_number FROM customer",
)
def _(t):
    df = t.customer.select("c_acctbal", "c_custkey")
    return ordered.with_row_number(df, ["c_acctbal", "c_custkey"]).select("c_custkey", "row_number")


AMOUNT_TIES = (
    "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1000 WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END"
    " AS DECIMAL(12,2))"
)


@query(
    "row_number_ties",
    f"SELECT o_orderkey, row_number() OVER (ORDER BY {AMOUNT_TIES} NULLS LAST, o_orderkey) AS row_number FROM orders",
)
def _(t):
    df = t.orders.selectExpr("o_orderkey", f"{AMOUNT_TIES} AS amount")
    return ordered.with_row_number(df, ["amount", "o_orderkey"]).select("o_orderkey", "row_number")


@query(
    "row_number_dates",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders",
)
def _(t):
    df = t.orders.select("o_orderdate", "o_orderkey")
    return ordered.with_row_number(df, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_number")


NEGATIVE = "CAST(c_acctbal < 0 AS INT)"


@query(
    "overall_mean",
    f"SELECT c_custkey, (SELECT AVG(CAST({NEGATIVE} AS DOUBLE)) FROM customer) AS prop FROM customer",
)
def _(t):
    df = t.customer.selectExpr("c_custkey", f"{NEGATIVE} AS target")
    return aggregate.with_overall_mean(df, "target").select("c_custkey", "prop")


@query(
    "group_first",
    f"SELECT c_mktsegment, (SELECT AVG(CAST({NEGATIVE} AS DOUBLE)) FROM customer) AS prop,"
    f" CAST(SUM({NEGATIVE}) AS DOUBLE) / COUNT(*) AS rate FROM customer GROUP BY c_mktsegment",
)
def _(t):
    df = t.customer.selectExpr("c_mktsegment", f"{NEGATIVE} AS target")
    return (
        aggregate.with_overall_mean(df, "target")
        .groupBy("c_mktsegment")
        .agg(F.first("prop").alias("prop"), A.rate("target").alias("rate"))
    )


# ---- reshaping


@query(
    "unpivot",
    f"""SELECT event_id, user_id, 'amount' AS variable, {cents('value')} AS valor FROM events
    UNION ALL SELECT event_id, user_id, 'day',
    CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE {EVENT_DAY} END AS DOUBLE) FROM events""",
)
def _(t):
    return reshape.gather(_measures(t), ["amount", "day"])


@query(
    "unite_key",
    "SELECT event_id, CAST(user_id AS VARCHAR) || '_' || COALESCE(NULLIF(event_type, 'view'), 'NA')"
    " AS user_type FROM events",
)
def _(t):
    df = t.events.selectExpr("event_id", "user_id", "nullif(event_type, 'view') AS kind")
    return reshape.unite(df, "user_type", ["user_id", "kind"])


CELLS = (
    f"SELECT user_id, {EVENT_DAY} AS day, event_type, MAX(value) AS top, COUNT(*) AS n"
    " FROM events GROUP BY 1, 2, 3"
)


def _cells(t):
    return (
        t.events.withColumn("day", F.expr(EVENT_DAY))
        .groupBy("user_id", "day", "event_type")
        .agg(F.max("value").alias("top"), A.row_count().alias("n"))
    )


@query(
    "pivot_null",
    "SELECT user_id, day, "
    + ", ".join(f"MAX(CASE WHEN event_type = '{e}' THEN top END) AS {e}" for e in EVENT_TYPES)
    + f" FROM ({CELLS}) GROUP BY 1, 2",
)
def _(t):
    return reshape.spread(_cells(t).drop("n"), "event_type", "top", EVENT_TYPES)


@query(
    "pivot_fill",
    "SELECT user_id, day, "
    + ", ".join(f"COALESCE(MAX(CASE WHEN event_type = '{e}' THEN n END), 0) AS {e}" for e in EVENT_TYPES)
    + f" FROM ({CELLS}) GROUP BY 1, 2",
)
def _(t):
    return reshape.spread(_cells(t).drop("top"), "event_type", "n", fill=0)


def _period_sql(day: str) -> str:
    return f"CASE WHEN {day} >= {EVENT_SHORT} THEN 'SHORT' WHEN {day} >= {EVENT_MID} THEN 'MID' ELSE 'LONG' END"


@query(
    "pivot_multi",
    "SELECT user_id, "
    + ", ".join(
        f"MAX(CASE WHEN event_type = '{e}' AND period = '{p}' THEN {v} END) AS {e}_{p}_{v}"
        for e in EVENT_TYPES
        for p in S.PERIODS
        for v in ("top", "n")
    )
    + f" FROM (SELECT user_id, event_type, {_period_sql(EVENT_DAY)} AS period, MAX(value) AS top,"
    " COUNT(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY user_id",
)
def _(t):
    period = S.period_bucket(F.expr(EVENT_DAY), EVENT_SHORT, EVENT_MID)
    cells = (
        t.events.withColumn("period", period)
        .groupBy("user_id", "event_type", "period")
        .agg(F.max("value").alias("top"), A.row_count().alias("n"))
    )
    combos = [f"{e}_{p}" for e in EVENT_TYPES for p in S.PERIODS]
    return reshape.spread_multiple(cells, ["event_type", "period"], ["top", "n"], combos)


@query(
    "period_pivot",
    "SELECT user_id, "
    + ", ".join(
        f"COALESCE(SUM(CASE WHEN period = '{p}' THEN amount END), 0) AS TOTAL_{p},"
        f" COALESCE(MAX(CASE WHEN period = '{p}' THEN day END), 0) AS LAST_{p}"
        for p in S.PERIODS
    )
    + f" FROM (SELECT user_id, {cents('value')} AS amount, {EVENT_DAY} AS day,"
    f" {_period_sql(EVENT_DAY)} AS period FROM events) GROUP BY user_id",
)
def _(t):
    df = t.events.selectExpr("user_id", f"{cents('value')} AS amount", f"{EVENT_DAY} AS day")
    periods = {p: S.in_period("day", p, EVENT_SHORT, EVENT_MID) for p in S.PERIODS}
    measures = {
        "TOTAL": lambda cond: F.sum(F.when(cond, F.col("amount"))),
        "LAST": lambda cond: F.max(F.when(cond, F.col("day"))),
    }
    return reshape.period_pivot(df, ["user_id"], periods, measures, fill=0)


# ---- ordering and set operations


@query(
    "sort_limit",
    "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderdate")
    return ordered.top_k(df, ["o_orderdate", "o_orderkey"], 100)


@query(
    "top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return ordered.top_k(df, [F.desc("o_totalprice"), "o_orderkey"], 30)


@query(
    "union_missing_cols",
    "SELECT c_custkey AS id, c_mktsegment AS grp, CAST(c_acctbal < 0 AS INT) AS target FROM customer"
    " UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier",
)
def _(t):
    known = t.customer.selectExpr("c_custkey AS id", "c_mktsegment AS grp", f"{NEGATIVE} AS target")
    return joins.bind_rows(known, t.supplier.selectExpr("s_suppkey AS id"))


@query(
    "set_difference",
    "SELECT l_suppkey, l_quantity FROM lineitem EXCEPT"
    " SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'",
)
def _(t):
    every = t.lineitem.select("l_suppkey", "l_quantity")
    returned = t.lineitem.filter(F.col("l_returnflag") == "A").select("l_suppkey", "l_quantity")
    return joins.set_difference(every, returned)


@query(
    "set_difference_keyed",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.set_difference(t.orders.select("o_orderkey", "o_custkey"), lines, ["o_orderkey"])
