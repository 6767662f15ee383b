"""Window semantics against pandas on one station."""

import numpy as np
import pandas as pd
import pytest

from aerolith.operators import forecast, impute, models, quantiles, series as S
from aerolith.plans import chains
from aerolith.schema import INTERPOLATED, MEDIAN_FILLED, RAW


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({c: rng.uniform(1, 50, n) for c in RAW})
    pdf["pm10"] += 30
    for c in (*INTERPOLATED, *MEDIAN_FILLED):
        pdf.loc[rng.random(n) < 0.3, c] = np.nan
    pdf.loc[100:120, [*INTERPOLATED, *MEDIAN_FILLED]] = np.nan  # longer than any frame
    pdf.insert(0, "time", pd.date_range("2024-01-01", periods=n, freq="h"))
    pdf.insert(0, "station_id", np.int32(1))
    rows = [
        (int(r[0]), r[1].to_pydatetime(), *[None if np.isnan(v) else v for v in r[2:]])
        for r in pdf.itertuples(index=False)
    ]
    schema = "station_id int, time timestamp_ntz, " + ", ".join(f"{c} double" for c in RAW)
    df = spark.createDataFrame(rows, schema)
    return pdf, df


def _repaired(pdf):
    want = pdf.copy()
    for c in INTERPOLATED:
        want[c] = want[c].ffill(limit=3).interpolate(method="linear")
    for c in MEDIAN_FILLED:
        filled = want[c].ffill(limit=2)
        want[c] = filled.fillna(filled.rolling(12, min_periods=1).median())
    return want


def _sorted(df):
    return df.toPandas().sort_values("time").reset_index(drop=True)


def test_repair_equals_pandas(table):
    pdf, df = table
    want, got = _repaired(pdf), _sorted(impute.handle_missing(df, S.Layout()))
    for c in RAW:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-12, equal_nan=True, err_msg=c)


@pytest.mark.parametrize("layout", [S.Layout(), S.Layout(chunk_rows=40)])
def test_lags_count_the_valid_rows(table, layout):
    """Rows that fail validation leave no gap; rows dropped at the end do."""
    pdf, df = table
    want = _repaired(pdf)
    want = want[(want.aqi.between(0, 600)) & want.temperature_2m.between(-40, 60) & (want.pm2_5 <= want.pm10)]
    want["pm2_5_lag_24h"] = want["pm2_5"].shift(24)
    want["aqi_change_24h"] = want["aqi"].shift(1) - want["aqi"].shift(25)
    want = want.dropna().reset_index(drop=True)
    got = _sorted(chains.features_full(df, layout=layout))
    assert 50 < len(want) == len(got) < len(pdf)
    for c in (*RAW, "pm2_5_lag_24h", "aqi_change_24h"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-12, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("small", [1_000_000, 40])
def test_quantiles_are_exact(spark, small):
    rng = np.random.default_rng(3)
    ties = np.repeat([1.0, 2.0, 7.0], [4000, 3000, 500])
    v = np.concatenate([rng.normal(100, 20, 3000).round(3), ties, [1e6, -1e6]])
    rng.shuffle(v)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": np.arange(len(v)) * 0.5}))
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = quantiles.exact_quantiles(df, ["v", "w"], probs, small=small)
    np.testing.assert_allclose(got["v"], np.quantile(v, probs))
    np.testing.assert_allclose(got["w"], np.quantile(np.arange(len(v)) * 0.5, probs))


def test_models_beat_the_mean(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(aqi=80 + 20 * x[:, 0] + 5 * x[:, 1])
    pdf["split"] = np.where(np.arange(600) < 400, "train", np.where(np.arange(600) < 500, "val", "test"))
    df = spark.createDataFrame(pdf).cache()
    quick = {"forest": {"numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 5}, "boost_shallow": {"maxIter": 20, "stepSize": 0.2},
             "boost_leafy": {"maxIter": 20, "stepSize": 0.2, "minInstancesPerNode": 10}, "elastic_net": {}}
    for kind, extra in quick.items():
        scored = models.fit(df, kind, list("abc"), **extra).transform(df).selectExpr("*", f"'{kind}' as model")
        assert models.metrics_table(scored).first().test_r2 > 0.5, kind
