"""What the plans must look like to hold at scale."""

import re
from pathlib import Path

import pytest

from tsforge.plans import views as v
from tsforge.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Reports of one row in all, or a report of the whole table that ends in one small row.
GLOBAL = {
    "step_report", "null_profile", "feature_manifest", "feature_roles", "delete_by_entity",
    "split_report", "impute_mean", "standard_fit_parts", "scale_passthrough", "anti_months", "drop_high_months", "shuffle_across", "random_split",
}
# Run jobs of their own before a plan exists.
EAGER = {"gbt_fit_predict", "ar_mimo", "ar_mimo_one_lag", "window_sink", "export_parquet_stats",
         "stream_resample", "stream_dedupe", "stream_first", "standard_apply", "delete_all_types",
          "stream_ingest", "csv_scan", "csv_sink", "scaler_reload", "robust_scale"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER - GLOBAL))
def test_no_row_set_is_gathered_in_one_task(spark, name):
    """A single-partition exchange may only carry the partial rows of a global aggregate."""
    plan = _plan(QUERIES[name](spark, FOLDER)).split("\n")
    for above, line in zip(plan, plan[1:]):
        if "Exchange SinglePartition" in line:
            assert re.search(r"Aggregate\(keys?=\[\]", above), above
    assert not any("CartesianProduct" in line or "BroadcastNestedLoopJoin" in line for line in plan)


def test_no_driver_side_data_and_no_local_checkpoint():
    root = Path(__file__).resolve().parent.parent / "tsforge"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        text = path.read_text()
        assert "localCheckpoint" not in text and "toPandas" not in text and "crossJoin" not in text, path
        # The one collect is the (lags + 1)-row moment matrix of a fit.
        assert len(re.findall(r"\.collect\(\)", text)) <= (1 if path.name == "models.py" else 0), path


def test_filters_reach_the_scan(spark):
    plan = _plan(QUERIES["filtered_scan"](spark, FOLDER))
    assert "In(event_type" in plan or "Or(EqualTo(event_type" in plan or "event_type IN" in plan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan


def test_scans_read_only_what_is_used(spark):
    plan = _plan(v.daily(spark, FOLDER))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp,o_orderpriority:string>" in plan


def test_partial_aggregation_before_the_shuffle(spark):
    plan = _plan(v.hourly(spark, FOLDER))
    assert plan.index("functions=[avg") < plan.index("Exchange hashpartitioning") < plan.index("functions=[partial_avg")


@pytest.mark.parametrize("name, exchanges, scans", [("segments", 3, 2), ("split_fraction_gap", 4, 2), ("folds_expanding", 4, 2)])
def test_few_exchanges_beyond_the_input(spark, name, exchanges, scans):
    """The input of each is one exchange (hourly means, daily sums), reused where it is read twice."""
    plan = _plan(QUERIES[name](spark, FOLDER))
    assert len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", plan)) <= exchanges + plan.count("FileScan")
    assert plan.count("FileScan") <= scans


@pytest.mark.parametrize("name", ["pivot_pairs", "keyed_append", "segments", "kfold_scores"])
def test_raw_rows_are_hashed_and_not_sorted(spark, name):
    assert "SortAggregate" not in _plan(QUERIES[name](spark, FOLDER))


def test_one_pass_over_the_windows_fits_all_parts(spark):
    """As many scans as the windows themselves, and one exchange more."""
    windows, fitted = (_plan(QUERIES[name](spark, FOLDER)) for name in ("make_windows", "standard_fit_parts"))
    assert fitted.count("FileScan") == windows.count("FileScan") and "Exchange SinglePartition" in fitted
