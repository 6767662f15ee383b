"""Chunked and keyed windows give the same rows, whatever the partitioning."""

import pytest
from pyspark.sql import functions as F

from aerolith.catalog.base import observations, order_series
from aerolith.operators import features, impute, quality, series as S, stats
from aerolith.plans import chains
from aerolith.schema import WEATHER
from tests.conftest import SMALL

KEYED, CHUNKED = S.Layout(), S.Layout(chunk_rows=60)

OPERATORS = {
    "fill": lambda d, l: impute.fill_gaps(d, l),
    "repair": lambda d, l: impute.handle_missing(d, l),
    "explore": lambda d, l: impute.explore_clean(d, l),
    "duplicates": lambda d, l: quality.duplicate_weather(d, WEATHER, layout=l),
    "lags": lambda d, l: features.lag_features(d, l),
    "changes": lambda d, l: features.change_rates(d, l),
    "pct_change": lambda d, l: features.pct_change(d, layout=l),
    "features": lambda d, l: chains.features_full(d, layout=l),
}


def rows(df, digits=9):
    cols = sorted(df.columns)
    out = [tuple(round(v, digits) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """Ten small stations, and one with as many rows as the rest together."""
    small = order_series(spark, SMALL).filter("station_id % 2 = 0")
    big = observations(spark, SMALL).withColumn("station_id", F.lit(99))
    filled = big.withColumns({c: F.coalesce(c, (F.hour("time") + F.dayofmonth("time")).cast("double")) for c in ("pm2_5", "aqi")})
    return small.unionByName(filled).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_equal_keyed_windows(hot, name):
    op = OPERATORS[name]
    assert rows(op(hot, CHUNKED)) == rows(op(hot, KEYED))


def test_crosscorr_in_chunks(hot):
    assert rows(stats.lag_crosscorr(hot, layout=CHUNKED), 6) == rows(stats.lag_crosscorr(hot, layout=KEYED), 6)


def test_hot_station_is_cut(hot):
    longest = S.longest_series(hot)
    assert S.choose_layout(hot).chunk_rows is None
    layout = S.choose_layout(hot, max_series_rows=longest - 1, chunk_rows=60)
    assert layout.chunk_rows == 60
    sizes = S.into_chunks(hot, layout, before=25).groupBy("station_id", S.CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 60 + 25


def test_row_numbers_are_exact(hot):
    numbered = S.number_rows(hot, CHUNKED).groupBy("station_id").agg(
        F.count("*").alias("n"), F.countDistinct(S.POS).alias("d"), F.max(S.POS).alias("m")
    )
    assert all(r.n == r.d == r.m + 1 for r in numbered.collect())


def test_independent_of_partitions_and_order(spark, hot):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = rows(chains.features_full(hot, layout=KEYED))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(chains.features_full(hot.orderBy(F.rand(7)), layout=KEYED)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_future_does_not_leak(hot):
    """Without interpolation, features up to an hour do not depend on what follows."""
    cut = F.expr("timestamp_ntz '2024-01-20 00:00:00'")
    one = hot.filter("station_id = 99")
    ranges = quality.feature_range(one)
    past = F.col("time") <= cut
    whole = chains.features_full(one, layout=KEYED, ranges=ranges, interpolated=False).filter(past)
    known = chains.features_full(one.filter(past), layout=KEYED, ranges=ranges, interpolated=False)
    assert rows(whole) == rows(known)
