"""The library's functions for ``spark.sql``: temporary SQL functions, whose bodies Catalyst takes into the query.

Scalar functions are for any table. A SQL function takes no table as an argument, so those that return rows are
made for a named table or view.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyframe.functions.scalar import CLOSED_STATUS, MID_FROM, MISSING_DAY, SHORT_FROM, UNKNOWN_STATUS

FENCE_FACTOR = 1.5


def _clean(level: str) -> str:
    """SQL text of ``scalar.clean_level``; inside a lambda no SQL function can be called."""
    bare = rf"""regexp_replace(replace(regexp_replace(coalesce({level}, 'NA'), r'[\x27"]', ''), '%', 'percent'), '^ +', '')"""
    led = rf"CASE WHEN {bare} = '' OR {bare} RLIKE r'^([^\p{{L}}.]|[.][0-9])' THEN 'X' || {bare} ELSE {bare} END"
    return rf"upper(regexp_replace(regexp_replace(regexp_replace({led}, r'[^\p{{L}}0-9._]', '.'), '[._]+', '_'), '_$', ''))"


def _factor(zeros: str, ones: str, share: str) -> str:
    return f"try_divide({share} * {zeros}, {ones} * (1D - {share}))"


def _draw(key: str, seed: str) -> str:
    """A number from 0 to below 1, from the hash of key and seed."""
    hashed = f"md5(concat_ws(':', {key}, CAST({seed} AS STRING)))"
    return f"CAST(CAST(conv(substring({hashed}, 1, 13), 16, 10) AS BIGINT) AS DOUBLE) / pow(2D, 52D)"


# P(count <= 0), P(count <= 1), ... of a Poisson count of mean ``rate``, as far as doubles tell them from 1.
_LIMITS = (
    "aggregate(sequence(1, CAST(10 * rate AS INT) + 100), named_struct('p', exp(-rate), 'limits', array(exp(-rate))),"
    " (s, k) -> IF(element_at(s.limits, -1) < 1D - pow(2D, -50D), named_struct('p', s.p * rate / k,"
    " 'limits', concat(s.limits, array(element_at(s.limits, -1) + s.p * rate / k))), s), s -> s.limits)"
)
_SPREAD = f"{FENCE_FACTOR}D * (q3 - q1)"

# Name: arguments, type, body. Missing values count as in the functions of ``scalar``.
SCALARS = {
    "clean_str": ("level STRING", "STRING", _clean("level")),
    "one_hot_names": (
        "variable STRING, levels ARRAY<STRING>",
        "ARRAY<STRING>",
        f"transform(levels, l -> variable || '_' || {_clean('l')})",
    ),
    "one_hot": (
        "level STRING, variable STRING, levels ARRAY<STRING>",
        "MAP<STRING, INT>",
        "map_from_arrays(one_hot_names(variable, levels), transform(levels, l -> CAST(l <=> level AS INT)))",
    ),
    "period_bucket": (
        "months INT",
        "STRING",
        f"CASE WHEN months >= {SHORT_FROM} THEN 'SHORT' WHEN months >= {MID_FROM} THEN 'MID' WHEN months IS NOT NULL THEN 'LONG' END",
    ),
    "sentinel_to_null": ("days BIGINT", "BIGINT", f"nullif(days, {MISSING_DAY})"),
    "recode_status": (
        "status STRING",
        "INT",
        f"CASE WHEN status = '{CLOSED_STATUS}' THEN 0 WHEN status <> '{UNKNOWN_STATUS}' THEN try_cast(status AS INT) END",
    ),
    "safe_ratio": ("numerator DOUBLE, denominator DOUBLE", "DOUBLE", "try_divide(numerator, denominator)"),
    "remove_outliers_iqr": (
        "value DOUBLE, q1 DOUBLE, q3 DOUBLE",
        "DOUBLE",
        f"CASE WHEN value BETWEEN q1 - {_SPREAD} AND q1 + {_SPREAD} THEN value END",
    ),
    "remove_outliers_textbook": (
        "value DOUBLE, q1 DOUBLE, q3 DOUBLE",
        "DOUBLE",
        f"CASE WHEN value BETWEEN q1 - {_SPREAD} AND q3 + {_SPREAD} THEN value END",
    ),
    "upsample_factor": ("zeros BIGINT, ones BIGINT, share DOUBLE", "DOUBLE", _factor("zeros", "ones", "share")),
    "poisson_limits": ("rate DOUBLE", "ARRAY<DOUBLE>", _LIMITS),
    "hash_draw": ("id STRING, seed INT", "DOUBLE", _draw("id", "seed")),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the scalar functions known to the session, those of these names anew, and returns their names."""
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(SCALARS)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def register_sampling(
    spark: SparkSession, table: str, id_col: str, target: str, share: float, seed: int, name: str = "proportion_sampling"
) -> None:
    """Makes ``name()`` a table function: the rows of ``table`` of class 0, and each of class 1 as often as its own Poisson
    draw says, so that class 1 makes up ``share`` on average.

    Rows of neither class stay out, and all of class 1 where class 0 has no rows. One pass after the two counts: no
    table of draws, no join, no shuffle of rows. Columns may have any names."""
    held = spark.table(table)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in held.schema)
    names = ", ".join(f"r.{_quoted(c)}" for c in held.columns)
    t, key = _quoted(target), _quoted(id_col)
    # A SQL function that calls others cannot return rows in Spark 4.1, so their bodies stand here.
    rate = _factor(f"count_if({t} = 0)", f"count_if({t} = 1)", f"{float(share)!r}D")
    limits = f"(SELECT {_LIMITS} FROM (SELECT {rate} AS rate FROM {table}))"
    draw = _draw(f"CAST({key} AS STRING)", f"{int(seed)}")
    drawn = f"SELECT struct(*) AS r, {t} AS class, {draw} AS u, {limits} AS limits FROM {table}"
    times = "CASE class WHEN 0 THEN 1 WHEN 1 THEN size(filter(limits, x -> x <= u)) ELSE 0 END"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE({columns}) RETURN"
        f" SELECT {names} FROM ({drawn}) LATERAL VIEW explode(array_repeat(1, {times})) AS again"
    )
