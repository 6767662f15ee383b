"""Series cut by time give the rows of whole series, whatever gaps they have."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aerolith.operators import buckets as B, series as S
from aerolith.plans import chains
from aerolith.schema import RAW, RAW_OBS
from tests.conftest import SMALL
from tests.test_layout import rows

T0 = datetime(2023, 12, 30)


def hours(station, seed, n, holes=0.1, gaps=(), without=()):
    """Rows of random weather; ``gaps`` are stretches without rows, ``without`` stretches without some columns."""
    rng, out = random.Random(seed), []
    for i in range(n):
        if any(a <= i < b for a, b in gaps):
            continue
        v = {c: rng.uniform(0, 40) for c in RAW}
        v["pm10"] += 40
        for c in RAW:
            if rng.random() < holes or any(a <= i < b and c in cols for a, b, cols in without):
                v[c] = None
        out.append((station, T0 + timedelta(hours=i), *(v[c] for c in RAW)))
    return out


@pytest.fixture(scope="module")
def series(spark):
    data = hours(1, 1, 2000, holes=0.02)
    data += hours(2, 2, 1500, holes=0.02, gaps=[(300, 320), (600, 1100)])
    data += hours(3, 3, 900, holes=0.3)  # hardly a complete row
    data += hours(4, 4, 800, holes=0.02, without=[(200, 500, ("temperature_2m",)), (400, 800, ("wind_speed_10m",)), (0, 300, ("aqi",))])
    data += hours(5, 5, 700, holes=0.02, without=[(0, 700, ("pressure_msl",))])  # a column that is never known
    data += hours(6, 6, 30, holes=0.0) + hours(7, 7, 2000, holes=0.02, gaps=[(i, i + 5) for i in range(0, 2000, 6)])
    return spark.createDataFrame(data, RAW_OBS).repartition(5).cache()


@pytest.mark.parametrize("size", [(48, 48, 10), (100, 60, 20), (500, 100, 1), (24 * 365, 24 * 14, 72)])
def test_buckets_equal_whole_series(series, size):
    got = rows(chains.features_bucketed(series, B.TimeBuckets(*size)))
    assert got == rows(chains.features_full(series, layout=S.Layout())) and len(got) > 2000


@pytest.mark.parametrize("options", [{"pct_change": True}, {"interpolated": False}])
def test_options_reach_the_chain(series, options):
    got = rows(chains.features_bucketed(series, B.TimeBuckets(200, 60, 20), **options))
    assert got == rows(chains.features_full(series, layout=S.Layout(), **options))


def test_only_buckets_that_need_it_are_joined(series):
    cut = B.TimeBuckets(200, 100, 24)
    weather = ["temperature_2m", "pressure_msl", "wind_speed_10m"]
    found = B.joined(B.summary(series, cut), weather, cut).groupBy("station_id").count().collect()
    joined = {r["station_id"]: r["count"] for r in found}
    assert 1 not in joined and 6 not in joined and joined[3] >= 3


def test_every_row_is_in_its_bucket_once(series):
    cut = B.TimeBuckets(100, 60, 20)
    table = B.summary(series, cut)
    together = B.joined(table, ["temperature_2m"], cut)
    for t in (None, together):
        placed = B.spread(series, cut, t)
        assert placed.filter(B.OWN).count() == series.count()
        twice = placed.groupBy("station_id", B.BUCKET, "time").count().filter("count > 1")
        assert twice.count() == 0


def test_no_more_than_two_passes_and_one_shuffle_for_the_windows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(hours(1, 1, 600, holes=0.0) + hours(2, 2, 600, holes=0.0), RAW_OBS).write.parquet(path)
    df = chains.features_bucketed(spark.read.parquet(path), B.TimeBuckets(100, 60, 20))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet [^\n]*" + re.escape(path), text)) == 1  # the first pass is written
    assert len(re.findall(r"Exchange hashpartitioning\(station_id#\d+, _bucket_no", text)) == 1


def test_a_halo_longer_than_a_bucket_is_refused():
    with pytest.raises(ValueError, match="around a bucket"):
        B.TimeBuckets(24, 48, 1)
