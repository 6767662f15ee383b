"""Hand-written inputs with literal results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from aerolith.functions import bands as B, text as X
from aerolith.operators import features, impute, match, models, quality, series as S, split
from aerolith.sources import landing

KEYED = S.Layout()
LAYOUTS = [KEYED, S.Layout(chunk_rows=30)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_forward_fill_stops_at_its_limit(series, values, layout):
    df = series(temperature_2m=[None, 1, None, None, None, None, 2, None], aqi=[None, 1, None, None, None, 5, None, None])
    out = impute.fill_gaps(df, layout)
    assert values(out, "temperature_2m") == [None, 1, 1, 1, 1, None, 2, 2]
    assert values(out, "aqi") == [None, 1, 1, 1, None, 5, 5, 5]


@pytest.mark.parametrize("layout", [KEYED, S.Layout(chunk_rows=2)])
def test_interpolation(series, values, layout):
    out = impute.interpolate(series(x=[None, 1, None, 4, None, None]), ["x"], layout)
    assert values(out, "x") == [None, 1, 2.5, 4, 4, 4]


@pytest.mark.parametrize("layout", [KEYED, S.Layout(chunk_rows=2)])
def test_interpolation_across_many_chunks(series, values, layout):
    out = impute.interpolate(series(x=[0, None, None, None, None, None, None, None, 8]), ["x"], layout)
    assert values(out, "x") == list(range(9))


def test_median_uses_the_last_twelve_rows(series, values):
    x = [1, 2, 3, 10] + [None] * 14
    out = values(impute.median_impute(series(aqi=x), ["aqi"], layout=KEYED), "aqi")
    assert out[4] == 2.5
    assert out[11] == 2.5
    assert out[12] == 3  # the first value has left the frame
    assert out[14] == 10
    assert out[15] is None


def test_centered_median(series, values):
    x = [None, 2, 4, 6, 8, 10, 12, 14]
    out = values(impute.median_impute(series(aqi=x), ["aqi"], centered=True, layout=KEYED), "aqi")
    assert out[0] == 6  # itself and five rows ahead


@pytest.mark.parametrize("layout", LAYOUTS)
def test_percent_change(series, values, layout):
    out = features.pct_change(series(aqi=[0, 5, None, 10, 0, 0, 7]), layout=layout)
    # one row behind: the change that ends at the row before
    assert values(out, "aqi_pct_change_1h") == [0, 0, 1, 0, 1, -1, 0]


def test_change_rates_are_clamped(series, values):
    out = features.change_rates(series(aqi=[0, 100, 0, 0]), KEYED)
    assert values(out, "aqi_change_1h") == [None, None, 100, -100]
    assert values(out, "aqi_rate_1h") == [0, 0, 10, -10]


@pytest.mark.parametrize(
    "aqi, pm",
    [(50, 12.0), (50.01, 11.6292), (50.5, 11.8622), (51, 12.1), (100.5, 35.2969), (150.5, 54.5316), (200.5, 149.9955), (300.5, 249.8721), (900, 500.4), (-5, 0.0)],
)
def test_pm25_of_aqi(spark, aqi, pm):
    got = spark.range(1).select(B.aqi_to_pm25(F.lit(float(aqi)))).first()[0]
    assert got == pytest.approx(pm, abs=1e-4)


def test_band_and_alert_differ_on_fractions(spark):
    row = spark.range(1).select(
        B.aqi_category(F.lit(50.5)).alias("c"), B.alert_level(F.lit(50.5)).alias("a"),
        B.affected_groups(F.lit(151.0)).alias("g"), B.aqi_label(F.lit(None).cast("double")).alias("n"),
    ).first()
    assert (row.c, row.a, row.g, row.n) == ("moderate", "Good", ["children", "elderly", "asthma patients"], None)


def test_near_duplicates(series, values):
    df = series(
        temperature_2m=[0, 0.001, 10, 10.05, None, 10],
        pressure_msl=[5] * 6,  # no range: skipped
        wind_speed_10m=[1, 1, 2, 2, 2, 2],
    )
    out = quality.duplicate_weather(df, layout=KEYED)
    assert values(out, "is_duplicate") == [False, True, False, True, False, False]


def test_no_range_means_no_duplicates(series, values):
    out = quality.duplicate_weather(series(temperature_2m=[5, 5, 5]), layout=KEYED)
    assert values(out, "is_duplicate") == [False] * 3


def test_validation_drops_missing_and_implausible(series, values):
    df = series(aqi=[-1, 0, 600, 601, 50, 50], temperature_2m=[0, -40, 60, 0, None, 10], pm2_5=[1, 1, 1, 1, 1, 3], pm10=[2, 2, 2, 2, 2, 2])
    assert values(quality.validate_ranges(df), "aqi") == [0, 600]


def test_split_of_a_hundred_rows(series):
    out = split.time_split(series(aqi=list(range(100))))
    counts = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 75, "val": 15, "test": 10}
    assert out.filter("split = 'val'").agg(F.min("aqi"), F.max("aqi")).first()[:] == (75, 89)


def test_split_crosses_months(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("station_id"),
        (F.expr("timestamp_ntz '2024-01-01'") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("time"),
    )
    counts = {r["split"]: r["count"] for r in split.time_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 2250, "val": 450, "test": 300}


def test_scaling_uses_population_deviation(series, values):
    out = split.scale(series(x=[1, 3], y=[2, 2]), ["x", "y"])
    assert values(out, "x") == [-1, 1]
    assert values(out, "y") == [0, 0]


def test_nearest_match(spark):
    at = datetime
    actual = spark.createDataFrame(
        [(1, at(2024, 1, 1, 23), 50.0), (1, at(2024, 1, 2, 6), 60.0), (1, at(2024, 1, 2, 9), 70.0), (2, at(2024, 1, 1, 23), 80.0)],
        "station_id int, time timestamp_ntz, aqi double",
    )
    predicted = spark.createDataFrame(
        [
            (1, at(2024, 1, 1, 22, 30), 1.0), (1, at(2024, 1, 1, 23, 30), 2.0),  # a tie: the earlier
            (1, at(2024, 1, 2, 7), 3.0),  # exactly one hour off
            (1, at(2024, 1, 2, 10, 1), 4.0),  # too far
            (2, at(2024, 1, 2, 0, 0), 5.0),  # across midnight
        ],
        "station_id int, timestamp timestamp_ntz, predicted_aqi double",
    )
    out = match.nearest_match(actual, predicted).orderBy("station_id", "time").collect()
    assert [r.predicted_aqi for r in out] == [1.0, 3.0, None, 5.0]
    assert [r.offset_seconds for r in out] == [1800.0, 3600.0, None, 3600.0]


def test_forecast_error_of_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 5.0), (50.0, 50.0), (None, 5.0)], "aqi double, predicted_aqi double")
    rows = match.forecast_error(df).collect()
    assert [(r.pct_error, r.direction, r.verdict) for r in rows] == [(None, "over", "POOR"), (0.0, "under", "EXCELLENT"), (None, None, None)]


def test_best_model_is_not_a_leaky_one(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0, 1.0), ("b", 2.0, 1.0, 0.9), ("c", 2.0, 0.5, 0.8)], "model string, val_rmse double, val_mae double, val_r2 double"
    )
    assert [r.model for r in models.select_best(df).orderBy("rank").collect()] == ["c", "b"]
    only = df.filter("model = 'a'")
    assert models.select_best(only).first().best_model


def test_backfill_batches_share_their_boundary(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 7, 1)), (2, date(2024, 1, 1), date(2024, 1, 1))], "station_id int, start date, end date")
    got = [(r.batch, r.batch_start, r.batch_end) for r in landing.backfill_batches(df).collect()]
    assert got == [(1, date(2024, 1, 1), date(2024, 3, 31)), (2, date(2024, 3, 31), date(2024, 6, 29)), (3, date(2024, 6, 29), date(2024, 7, 1))]


@pytest.mark.parametrize(
    "name, label",
    [
        ("pm2_5_lag_12h", "PM2.5 (Lag 12h)"), ("pressure_msl_lag_12", "Pressure Msl (Lag 12h)"), ("hour_sin", "Time of Day"),
        ("aqi_rate_24h", "Aqi Rate 24H"), ("temp_humidity_interaction", "Temp Humidity Interaction"), ("is_weekend", "Weekend Effect"),
    ],
)
def test_labels(spark, name, label):
    assert spark.range(1).select(X.feature_label(F.lit(name))).first()[0] == label


def test_summaries(spark):
    say = lambda *x: spark.range(1).select(X.driver_summary(F.array(*[F.lit(v) for v in x]))).first()[0]
    assert say("PM2.5 Levels", "Wind Speed", "Time of Day") == "Today's AQI is primarily driven by PM2.5 Levels with Wind Speed playing a secondary role."
    assert say("Time of Day", "Season", "Weekend Effect") == "The top factors affecting AQI are Time of Day, Season."
    assert say("PM10 Levels", "Season", "Weekend Effect") == "Today's AQI is primarily influenced by PM10 Levels."
    assert say("PM10 Levels") == "Insufficient data for explanation."


def test_landing_turns_nan_into_null(spark):
    rec = spark.createDataFrame([(1, 1704067200, *[[1.0, float("nan")]] * 6)], landing.landing_record(landing.WEATHER))
    rows = landing.decode_weather(rec).orderBy("time").collect()
    assert rows[0].time == datetime(2024, 1, 1) and rows[1].time == datetime(2024, 1, 1, 1)
    assert (rows[0].temperature_2m, rows[1].temperature_2m) == (1.0, None)
