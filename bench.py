"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds per query.

Each query is built and run to a no-op sink: one warm-up, then the median of the timed runs.
With BENCH_COMPARE=1 the same results are also timed in DuckDB, into Arrow.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyframe import build_session  # noqa: E402
from tallyframe.registry import ORACLES, QUERIES  # noqa: E402

HEADLINE = (
    "left_join_rollup",
    "star_join",
    "group_strict",
    "two_level_agg",
    "tabyl",
    "quantile_iqr",
    "row_number",
    "pivot_multi",
    "one_hot_named",
    "column_kinds",
    "profile_levels",
    "continuous_views",
    "class_density",
    "subject_summary_v1",
    "subject_summary_v2",
    "subject_types",
    "pos_features",
    "instalment_features",
    "card_features",
    "previous_features",
    "subject_wide",
    "derived_features",
    "three_way_split",
    "upsample",
    "split_rebalance",
    "profile_continuous",
    "iqr_trim",
    "model_path_checks",
    "auc",
    "roc_threshold_ci",
)


LONG_SECONDS = 20  # a query is timed no more often once its runs have taken this long


def timed(run, repeats: int) -> float:
    run()
    seconds = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
        if sum(seconds) > LONG_SECONDS:
            break
    return round(statistics.median(seconds), 3)


def duckdb_connection(folder: str, threads: int):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    con.execute(f"SET threads = {threads}")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def run_spark(name: str) -> None:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {n: timed(lambda n=n: run_spark(n), repeats) for n in names}
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    if os.environ.get("BENCH_COMPARE") == "1":
        con = duckdb_connection(folder, cpus)
        result["duckdb"] = {
            n: timed(lambda n=n: con.execute(ORACLES[n]).to_arrow_table(), repeats)
            for n in names
            if n in ORACLES
        }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
