"""What the plans do: shuffles, pruning, and no join without keys."""

import re

import pytest
from pyspark.sql import functions as F

from aerolith import catalog
from aerolith.catalog.base import order_series
from aerolith.operators import series as S
from aerolith.plans import chains
from aerolith.sources import store
from aerolith.sources.event_feed import table
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_series_need_one_shuffle(spark):
    """Two exchanges: the aggregation that makes the rows, and the windows."""
    text = plan(chains.features_full(order_series(spark, SMALL), layout=S.Layout()))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert len(re.findall(r"\bSort \[station_id", text)) == 1


def test_scans_read_only_what_is_used(spark):
    text = plan(catalog.queries()["daily_avg_aqi"](spark, SMALL))
    assert "event_type" not in text.split("ReadSchema")[-1]


def test_filters_reach_the_scan(spark, tmp_path):
    df = order_series(spark, SMALL)
    store.append(df, str(tmp_path / "t"), shards=2)
    at = lambda x: F.expr(f"timestamp_ntz '{x}'")
    text = plan(store.range_scan(store.read_table(spark, str(tmp_path / "t")), at("2000-01-05 00:00:00"), at("2000-01-09 00:00:00")))
    assert re.search(r"PartitionFilters: \[[^\]]*part_month", text)
    assert re.search(r"PushedFilters: \[[^\]]*time", text)


@pytest.mark.parametrize("name", ["features_full", "nearest_match", "lag_crosscorr", "histogram50", "outliers_iqr", "health_advice", "forecast_ar", "model_metrics_table"])
def test_no_join_without_keys(spark, name):
    text = plan(catalog.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_last_rows_are_trimmed_before_the_shuffle(spark):
    text = plan(S.tail(table(spark, SMALL, "events").withColumnRenamed("user_id", "station_id"), 3, time="ts"))
    assert "WindowGroupLimit" in text


def test_upsert_moves_rows_once(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(store, "_write", lambda df, path, mode: seen.append(plan(df)))
    df = table(spark, SMALL, "events").selectExpr("cast(user_id as int) station_id", "ts as time", "event_id as ingest_seq", "value")
    store.upsert(df, str(tmp_path / "t"), shards=2)
    assert len(re.findall("Exchange", seen[0])) == 1
