"""Plan shape: no Python on the data path, no global window, filters and columns reach the scan."""

import re
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as entry  # noqa: E402

from __spark_entry__ import ORACLE, QUERIES  # noqa: E402
from catalog import fitted, spark_queries  # noqa: E402
from tidegrid.session import in_utc  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MODELS = ("quantile_boost", "candidate_table", "boost_horizon_report", "boost_weather", "seasonal_arma", "arma_candidates")
#: Invariants of whole searches, too long for this table's few rows or failing on them: compared at a larger scale.
LONG = ("boost_checks", "arma_checks")
#: Small systems, trees or recursions in Arrow batches.
PYTHON = ("least_squares_fit", "walk_forward_fitted", "walk_forward_fitted_folds", "boost_stump", "arma_path")
NAMES = [n for n in QUERIES if n not in MODELS + LONG]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def oracle():
    return connect(SMALL)


def test_every_query_but_the_models_has_sql():
    assert set(ORACLE) == {*NAMES, *LONG}
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SMALL)
    text = plan(df)
    assert name in PYTHON or ("Python" not in text and "Pandas" not in text)
    assert "CartesianProduct" not in text
    assert differences(df.toPandas(), oracle.execute(entry.oracle_sql()[name]).df()) == []


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 9


@pytest.mark.parametrize("name", ["lag_features", "interpolate_time", "seasonal_naive", "supplier_history"])
def test_data_windows_are_chunked(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "_chunk" in text and "SinglePartition" not in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(entry.queries()["grouped_resample"](spark, SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(ts)]" in text


def test_fixed_range_reaches_the_scan(spark):
    text = plan(entry.queries()["half_hour_resample"](spark, SMALL))
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in text and "LessThan(ts,2024-" in text


def test_rank_limit_runs_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["last_n"](spark, SMALL))


@pytest.mark.parametrize("name", ["hourly_resample", "grouped_resample", "user_resample"])
def test_a_resample_reads_its_input_once(spark, name):
    df = entry.queries()[name](spark, SMALL)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or final.count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["interpolate_columns", "row_position", "train_median", "conformal_rank", "train_median_impute"])
def test_no_single_partition_grows_with_the_rows(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    lines = text.splitlines()
    for k, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # Partial results of one aggregate, or the super-chunks of a series without a key.
            assert re.search(r"Aggregate\(keys?=\[(\]|_super)", lines[k + 1]), text


def test_boost_table_doesn_t_read_the_events_again(spark):
    assert "FileScan" not in plan(spark_queries.boost_table(in_utc(spark), SMALL))


def test_boost_checks_builds_its_table_once(spark, monkeypatch):
    built = []

    def table(spark, sf_dir):
        built.append(sf_dir)
        return spark_queries.S.add_split(spark_queries.supervised(spark, sf_dir), spark_queries.split_label())

    def searched(df, **options):
        rows = df.where("split <> 'train' AND load_target_t_plus_1 IS NOT NULL").selectExpr(
            "'t_plus_1' AS horizon", "'plain' AS feature_set", "split", "load_target_t_plus_1 AS actual_target_mw",
            *[f"CAST(1 AS DOUBLE) AS pred_{q}" for q in ("q10", "q50", "q90")],
        )
        return rows, df.selectExpr("'t_plus_1' AS horizon", "'plain' AS feature_set", "TRUE AS selected", "CAST(1 AS DOUBLE) AS pinball_q50")

    monkeypatch.setattr(spark_queries, "boost_table", table)
    monkeypatch.setattr(fitted.B, "score_horizons", searched)
    assert fitted.boost_checks(in_utc(spark), SMALL).count() == 1 and len(built) == 1


def test_supplier_history_does_not_shuffle_the_grid(spark):
    text = plan(entry.queries()["supplier_history"](spark, SMALL))
    assert text.index("posexplode") < text.index("Exchange") and text.count("Sort [") == 1
