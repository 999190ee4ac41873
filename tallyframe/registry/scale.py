"""Forms of the operators for tables that are read rarely or grow load by load: ledgers, stores, one-pass draws."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyframe.operators import encode, joins, ledgers, profile, sampling
from tallyframe.plans import incremental, model
from tallyframe.registry import recipes
from tallyframe.registry.basics import _lines_by_order
from tallyframe.registry.bindings import SUBJECT, with_bound
from tallyframe.registry.core import ORACLES, query
from tallyframe.registry.scoring import SCORED, _scored
from tallyframe.session import cut_lineage, ensure_checkpoint_dir

# ---- sketch ledgers

LEDGER_COLUMNS = ["l_extendedprice", "l_quantity", "l_partkey"]
PROBS = (0.25, 0.5, 0.75)


def _line_ledger(t):
    """Per return flag, line status and line number; every answer below is a merge of these rows."""
    return cut_lineage(ledgers.sketch_ledger(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], LEDGER_COLUMNS))


@query(
    "quantile_ledger",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS variable, COUNT({c}) AS n, CAST(0 AS BIGINT) AS n_missing, CAST(MIN({c}) AS DOUBLE) AS lowest,"
        f" CAST(MAX({c}) AS DOUBLE) AS highest, TRUE AS distinct_near, TRUE AS ranks_near FROM lineitem GROUP BY 1"
        for c in LEDGER_COLUMNS
    ),
)
def _(t):
    """Quantiles and distinct counts per return flag from the stored ledger, held against the rows: a quantile's rank is within
    1.5 % of all rows, a distinct count within 4 %."""
    found = ledgers.ledger_quantiles(_line_ledger(t), ["l_returnflag"], PROBS)
    sides = []
    for c in LEDGER_COLUMNS:
        own = found.filter(F.col("variable") == c).select("l_returnflag", *[F.col(f"q{i}").alias(f"{c}_q{i}") for i in range(len(PROBS))])
        sides.append(own)
    rows = t.lineitem
    for own in sides:
        rows = rows.join(F.broadcast(own), "l_returnflag")  # a row per return flag
    exact = []
    for c in LEDGER_COLUMNS:
        below = [F.avg((F.col(c) < F.col(f"{c}_q{i}")).cast("int")) for i in range(len(PROBS))]
        upto = [F.avg((F.col(c) <= F.col(f"{c}_q{i}")).cast("int")) for i in range(len(PROBS))]
        near = F.lit(True)
        for p, lo, hi in zip(PROBS, below, upto):
            near = near & (lo <= p + 0.015) & (hi >= p - 0.015)
        exact.append(F.struct(F.lit(c).alias("variable"), near.alias("ranks_near"), F.count_distinct(c).alias("d")).alias(f"s_{c}"))
    held = rows.groupBy("l_returnflag").agg(*exact).select("l_returnflag", F.inline(F.array(*[f"s_{c}" for c in LEDGER_COLUMNS])))
    near = F.abs(F.col("n_distinct") - F.col("d")) <= 0.04 * F.col("d") + 1
    return found.join(held, ["l_returnflag", "variable"]).select(
        "l_returnflag", "variable", "n", "n_missing", "lowest", "highest", near.alias("distinct_near"), "ranks_near"
    )


@query(
    "coverage_ledger",
    "SELECT c_mktsegment, COUNT(DISTINCT c_custkey) AS n_left, COUNT(DISTINCT o_custkey) AS n_both,"
    " COUNT(DISTINCT CASE WHEN o_custkey IS NULL THEN c_custkey END) AS n_left_only,"
    " CAST(COUNT(DISTINCT o_custkey) AS DOUBLE) / COUNT(DISTINCT c_custkey) AS covered"
    " FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)"
    " ON c_custkey = o_custkey GROUP BY 1",
)
def _(t):
    """Customers per segment with an urgent, dear order, from theta sketches: exact up to 65,536 customers per sketch."""
    left = cut_lineage(ledgers.sketch_ledger(t.customer, ["c_mktsegment", "c_nationkey"], keys=["c_custkey"]))
    dear = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
    right = cut_lineage(ledgers.sketch_ledger(dear, ["o_orderstatus"], keys=["o_custkey"]))
    return ledgers.ledger_coverage(left, "c_custkey", right, "o_custkey", ["c_mktsegment"])


# ---- incremental rollups

MEASURES = ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY", "AMT_CREDIT_MAX_OVERDUE"]
LOADS = {"old": "DAYS_CREDIT < -1500", "middle": "DAYS_CREDIT >= -1500 AND DAYS_CREDIT < -600", "new": "DAYS_CREDIT >= -600"}


@query(
    "incremental_rollup",
    with_bound(
        "external_loans",
        then="SELECT SK_ID_CURR, COUNT(*) AS n_rows, "
        + ", ".join(
            f"MAX({m}) AS {m}_max, MIN({m}) AS {m}_min, CAST(SUM({m}) AS DOUBLE) / COUNT({m}) AS {m}_mean,"
            f" COALESCE(CAST(SUM({m}) AS DOUBLE), 0) AS {m}_sum"
            for m in MEASURES
        )
        + " FROM external_loans GROUP BY 1",
    ),
)
def _(t):
    """Three loads one after the other, the second one twice: the same rows as one aggregate over everything."""
    loans = t.bound("external_loans")
    store = incremental.RollupStore(t.spark, f"{ensure_checkpoint_dir(t.spark)}/rollup-{uuid.uuid4().hex}", ["SK_ID_CURR"], MEASURES)
    for load in ("old", "middle", "middle", "new"):
        store.add(load, loans.filter(LOADS[load]))
    return store.rollup()


# ---- Poisson draws

POISSON_CDF = (
    "WITH RECURSIVE factor AS (SELECT {factor} AS rate FROM (SELECT COUNT(CASE WHEN TARGET = 0 THEN 1 END) AS n_0,"
    " COUNT(CASE WHEN TARGET = 1 THEN 1 END) AS n_1 FROM subject)),"
    " terms AS (SELECT 0 AS k, exp(-rate) AS p, exp(-rate) AS total, rate FROM factor UNION ALL"
    " SELECT k + 1, p * rate / (k + 1), total + p * rate / (k + 1), rate FROM terms WHERE k < 60 AND total < 1 - pow(2, -50))"
)


@query(
    "poisson_upsample",
    POISSON_CDF.format(factor=recipes.FACTOR.format(zeros="n_0", ones="n_1")).replace(
        "WITH RECURSIVE", "WITH RECURSIVE " + with_bound("subject", then="").removeprefix("WITH ").rstrip() + ","
    )
    + f", drawn AS (SELECT SK_ID_CURR, CAST('0x' || substr(md5(SK_ID_CURR || ':{sampling.SEED + 1}'), 1, 13) AS BIGINT)::DOUBLE"
    " / 4503599627370496 AS u FROM subject WHERE TARGET = 1),"
    " copies AS (SELECT SK_ID_CURR, CAST(COUNT(*) AS BIGINT) AS copies FROM drawn JOIN terms ON total <= u GROUP BY 1)"
    " SELECT SK_ID_CURR, TARGET FROM subject WHERE TARGET = 0 UNION ALL"
    " SELECT SK_ID_CURR, 1 FROM (SELECT SK_ID_CURR, unnest(range(copies)) FROM copies)",
)
def _(t):
    return sampling.poisson_upsample(t.subject.select("SK_ID_CURR", "TARGET"), "SK_ID_CURR", "TARGET")


REPLICATES = 20


@query(
    "poisson_intervals",
    "WITH RECURSIVE terms AS (SELECT 0 AS k, exp(-1.0::DOUBLE) AS p, exp(-1.0::DOUBLE) AS total UNION ALL"
    " SELECT k + 1, p * 1.0::DOUBLE / (k + 1), total + p * 1.0::DOUBLE / (k + 1) FROM terms WHERE k < 60 AND total < 1 - pow(2, -50)),"
    f" scored AS ({SCORED}), each AS (SELECT doc_id, CAST(r AS INTEGER) AS replicate, quality AS label,"
    f" CAST({' + '.join(f'(score >= {i} / 10.0::DOUBLE)::INT' for i in range(1, 10))} AS INT) AS interval,"
    " CAST('0x' || substr(md5(doc_id || '-' || r || ':42'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS u"
    f" FROM scored, range({REPLICATES}) t(r)),"
    " counted AS (SELECT replicate, label, interval, (SELECT COUNT(*) FROM terms WHERE total <= u) AS n FROM each)"
    " SELECT replicate, label, interval, CAST(SUM(n) AS BIGINT) AS n FROM counted GROUP BY ALL",
)
def _(t):
    return model.poisson_intervals(_scored(t), "doc_id", "quality", "score", replicates=REPLICATES)


@query(
    "poisson_ci_checks",
    "SELECT CAST(i AS DOUBLE) / 10 AS threshold, TRUE AS is_ordered, TRUE AS is_near FROM range(1, 10) r(i)",
)
def _(t):
    """Poisson intervals against the exact bootstrap's: in order, and medians within two standard errors of the estimate."""
    scored = _scored(t)
    ci = model.poisson_threshold_ci(scored, "doc_id", "quality", "score")
    sizes = scored.agg(*[F.count(F.when(F.col("quality") == c, 1)).alias(f"n{c}") for c in (1, 0)])
    both = ci.join(model.roc_thresholds(scored, "quality", "score"), "threshold").join(F.broadcast(sizes))
    in_order = near = F.lit(True)
    for m, name, n in (("se", "sensitivity", "n1"), ("sp", "specificity", "n0")):
        low, mid, high = (F.col(f"{m}_{x}") for x in ("low", "median", "high"))
        p = F.col(name)
        in_order = in_order & (low <= mid) & (mid <= high)
        near = near & (F.abs(mid - p) <= 2 * F.sqrt(p * (1 - p) / F.col(n)) + 1e-9)
    return both.select("threshold", in_order.alias("is_ordered"), near.alias("is_near"))


# ---- profiles observed while writing

CHECKS = {"young": "DAYS_BIRTH > -10000", "never_employed": "DAYS_EMPLOYED = 365243"}


@query(
    "observed_profile",
    with_bound(
        "subject",
        then=" UNION ALL ".join(
            f"SELECT '{c}' AS variable, COUNT(*) AS n_rows, 100 * CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) AS na_prop,"
            + ", ".join(f" COUNT(CASE WHEN {cond} THEN 1 END) AS {name}" for name, cond in CHECKS.items())
            + ", TRUE AS same_kind FROM subject"
            for c in SUBJECT
        ),
    ),
)
def _(t):
    """Missing shares, checks and kinds seen while the table is written, kinds held against a pass of their own."""
    path = f"{ensure_checkpoint_dir(t.spark)}/observed-{uuid.uuid4().hex}"
    seen = profile.write_observed(t.subject, path, {name: F.expr(cond) for name, cond in CHECKS.items()})
    kinds = profile.column_kinds(t.subject)
    rows = [(c, seen.n_rows, seen.missing[c], *seen.checks.values(), seen.kinds[c] == kinds[c]) for c in seen.table.columns]
    schema = "variable string, n_rows bigint, na_prop double, " + ", ".join(f"{c} bigint" for c in CHECKS) + ", same_kind boolean"
    return t.spark.createDataFrame(rows, schema)  # one row per column


# ---- stored partitioning

BUCKETS = 8


def stored_star(t):
    """The sides of ``star_join`` as bucketed tables, and their join."""

    def stored(df, stem):
        name = f"{stem}_{uuid.uuid4().hex}"
        return joins.store_bucketed(df, ["c_custkey"], name, f"{ensure_checkpoint_dir(t.spark)}/{name}", BUCKETS)

    by_order = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price")
    )
    lines = t.orders.join(_lines_by_order(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    by_line = lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("n_lines").alias("n_lines"))
    by_event = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("value").alias("top_value")
    )
    subjects = stored(t.customer.select("c_custkey", "c_mktsegment"), "subjects")
    sides = [stored(df, stem) for df, stem in ((by_order, "orders"), (by_line, "lines"), (by_event, "events"))]
    return joins.star_join(subjects, sides, ["c_custkey"])


query("star_join_stored", ORACLES["star_join"])(stored_star)


# ---- indicators by hash

MANY_LEVELS = ["p_name", "p_brand", "p_type", "p_missing"]
PARTS = "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 10 THEN p_type END AS p_missing FROM part"


def _bucket_sql(c: str) -> str:
    text = f"md5('{c}:' || coalesce('=' || {c}, ''))"
    return f"CAST(CAST('0x' || substr({text}, 1, 8) AS BIGINT) % {encode.HASH_BUCKETS} AS INTEGER)"


def _parts(t):
    return t.part.selectExpr("p_partkey", "p_name", "p_brand", "p_type", "CASE WHEN p_size > 10 THEN p_type END AS p_missing")


@query(
    "hashed_levels",
    f"SELECT p_partkey, array_to_string(list_sort(list_distinct([{', '.join(_bucket_sql(c) for c in MANY_LEVELS)}])), ',') AS places"
    f" FROM ({PARTS})",
)
def _(t):
    sparse = encode.hashed_indicators(_parts(t), MANY_LEVELS)
    return sparse.select("p_partkey", F.array_join(F.col("hashed").cast("array<string>"), ",").alias("places"))


@query(
    "hash_collisions",
    "SELECT bucket, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_levels FROM ("
    + " UNION ALL ".join(
        f"SELECT {_bucket_sql(c)} AS bucket, '{c}' AS variable, {c} AS level, COUNT(*) AS n FROM ({PARTS}) GROUP BY ALL" for c in MANY_LEVELS
    )
    + ") GROUP BY 1",
)
def _(t):
    return encode.hash_collisions(_parts(t), MANY_LEVELS)
