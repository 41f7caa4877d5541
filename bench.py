"""Seconds per headline query, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
threads. Each query runs to a sink that takes every row; the better of two runs counts, the
first of which also pays for code generation.
"""

from __future__ import annotations

import json
import os
import time

from tsforge.plans.catalog import QUERIES
from tsforge.session import session

HEADLINE = [
    "assemble_market",
    "typed_tables",
    "keyed_append",
    "gap_report",
    "zone_effective",
    "fx_convert",
    "filter_years",
    "resample_mean",
    "resample_grid",
    "pivot_entity",
    "pivot_pairs",
    "pairs_touching",
    "month_lookup",
    "ffill_bfill",
    "fill_prior_week",
    "dedupe_first",
    "clean_full",
    "step_report",
    "time_lags",
    "segments",
    "make_windows",
    "request_window",
    "split_fraction_rows",
    "split_fraction_gap",
    "folds_expanding",
    "shuffle_across",
    "standard_fit",
    "standard_apply",
    "robust_scale",
    "score_windows",
    "mean_ablation",
    "rmse_mae",
    "stream_resample",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    run("table_scan")
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
