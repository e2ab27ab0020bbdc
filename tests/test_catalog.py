"""A cross-section of the registered queries next to DuckDB, and checks on the catalog itself."""

from pathlib import Path

import pytest
from oracle_compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables are not here")

SAMPLE = """area_mean_anomaly anomaly_raw_baseline global_detrend_field heldout_anomaly detrend_cells_quadratic pure_phases tercile_panels
bootstrap_composites ensemble_band mode_correlations lag_correlation_by_month cell_regression joint_histogram histogram_agreement kernel_density
regrid_field nearest_states encode decode variance_shares recursive_residuals basin_dataset fold_anomalies index_text write_missing_only complete_features
whole_table_quantiles smoothed_spectrum overlap_score windowed_spectrum low_pass wave_events""".split()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_catalog_is_consistent():
    runs, sql = queries(), oracle_sql()
    assert set(sql) <= set(runs) and len(runs) > 100
    assert set(SAMPLE) <= set(sql)


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(queries()[name](spark, SMALL), con, oracle_sql()[name])
    assert ok, note


@needs_data
def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["area_mean_anomaly", "detrend_cells_quadratic", "phase_composites", "nearest_states", "kernel_density", "regrid_field"])
def test_plans_have_no_cartesian_product(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
