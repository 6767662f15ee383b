"""Registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.compare import check

# One or more of every theme; tools/compare.py runs all of them.
NAMES = (
    "features_full features_long features_forecast median_impute_centered duplicate_weather aqi_pct_change align_features "
    "null_profile daily_avg_aqi describe histogram50 lag_crosscorr lag_mutual_info regression_metrics health_advice "
    "aqi_to_pm25 json_props forecast_table decode_air feature_upsert range_scan training_read prediction_cache time_split "
    "scale_features linear_shap select_best_model registry_upsert nearest_match evaluate_forecast forecast_ar current_aqi "
    "alerts stream_dedupe stream_error_monitor forecast_job"
).split()


def test_every_query_has_a_name_of_its_own():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    why = check(spark, SMALL, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert why is None, why


def test_entry(spark):
    assert entry.entry(spark).count() > 0
