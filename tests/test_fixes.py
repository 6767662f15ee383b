"""Cases off the tables that queries read: wide tolerances, several runs, corrections, penalties."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.operators import forecast, match, models as M, registry as R, split as P
from aerolith.plans import jobs
from aerolith.streaming import jobs as streams

T0 = datetime(2024, 1, 10)


def at(hours):
    return T0 + timedelta(hours=hours)


def predicted(spark, rows):
    return spark.createDataFrame(rows, "station_id int, timestamp timestamp_ntz, predicted_aqi double, generated_at timestamp_ntz")


@pytest.mark.parametrize("tolerance", [24, 30, 48, 72, 200])
def test_nearest_match_within_any_tolerance(spark, tolerance):
    actual = spark.createDataFrame([(1, at(h), float(h)) for h in range(0, 200, 7)], "station_id int, time timestamp_ntz, aqi double")
    hours = [-60, 25, 90, 91, 260]
    p = predicted(spark, [(1, at(h), float(h), at(0)) for h in hours])
    got = {r["time"]: r["predicted_aqi"] for r in match.nearest_match(actual, p, tolerance).collect()}
    for h in range(0, 200, 7):
        off, best = min((abs(h - x), x) for x in hours)
        assert got[at(h)] == (best if off <= tolerance else None)


def test_nearest_match_takes_the_last_run(spark):
    actual = spark.createDataFrame([(1, at(0), 5.0)], "station_id int, time timestamp_ntz, aqi double")
    p = predicted(spark, [(1, at(0), 1.0, at(-3)), (1, at(0), 2.0, at(-1)), (1, at(0), 3.0, at(-2))])
    assert match.nearest_match(actual, p).first()["predicted_aqi"] == 2.0


def test_error_monitor_matches_as_evaluation_does(spark):
    actual = spark.createDataFrame([(1, at(h), 50.0) for h in range(30)], "station_id int, time timestamp_ntz, aqi double")
    minutes = [-1, 30, 60, 185, 240, 299, 301, 800, 830, 860]
    p = predicted(spark, [(1, T0 + timedelta(minutes=m), float(m), at(0)) for m in minutes])
    keys = ("time", "timestamp", "predicted_aqi")
    want = match.nearest_match(actual, p).filter("timestamp is not null").select(*keys).collect()
    got = streams.error_monitor(actual, p).select(*keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


class _Map:
    """A map state without a store."""

    def __init__(self):
        self.rows = {}
        self.keys = lambda: iter(list(self.rows))
        self.getValue = lambda k: self.rows[k]
        self.updateValue = self.rows.__setitem__
        self.removeKey = self.rows.__delitem__

    def getMapState(self, *_):
        return self


def _lags(state, hours, seq=0, piece=10**6):
    """Output rows of a trigger whose rows come in pieces of so many."""
    processor = streams.LagProcessor()
    processor.init(state)
    frame = pd.DataFrame({"station_id": 1, "time": [at(h) for h, _ in hours], "ingest_seq": seq})
    for c in streams._BUFFERED:
        frame[c] = [v for _, v in hours]
    pieces = [frame.iloc[i : i + piece] for i in range(0, len(frame), piece)]
    return [r for out in processor.handleInputRows((1,), iter(pieces), None) for r in out.to_dict("records")]


@pytest.mark.parametrize("piece", [1, 10])
def test_lag_state_replaces_corrected_hours(piece):
    state, table = _Map(), {}
    for hours in ([(0, 0.0), (1, 1.0), (2, 2.0)], [(2, 20.0)], [(3, 3.0)], [(5, 5.0)], [(4, 4.0)]):
        for r in _lags(state, hours, piece=piece):
            table[r["time"]] = r
    assert sorted(table) == [pd.Timestamp(at(h)) for h in range(6)]
    assert table[pd.Timestamp(at(3))]["pm2_5_lag_1h"] == 20.0 and table[pd.Timestamp(at(3))]["pm2_5_lag_3h"] == 0.0
    assert table[pd.Timestamp(at(5))]["pm2_5_lag_1h"] == 4.0


def test_lag_state_keeps_the_row_of_highest_sequence():
    state = _Map()
    _lags(state, [(0, 1.0)], seq=5)
    assert _lags(state, [(0, 2.0)], seq=4) == []
    (row,) = _lags(state, [(1, 3.0)], seq=0)
    assert row["pm2_5_lag_1h"] == 1.0


@pytest.mark.parametrize("piece, parts", [(1, 60), (7, 60), (1, 1), (400, 400)])
def test_lag_state_over_a_long_stream_equals_the_whole_series(piece, parts, monkeypatch):
    monkeypatch.setattr(streams, "SENT_ROWS", 11)
    rng = np.random.default_rng(0)
    values = rng.normal(size=400)
    state, table = _Map(), {}
    order = np.argsort(np.arange(400) + rng.uniform(0, 12, 400))
    for part in np.array_split(order, parts):
        for r in _lags(state, [(int(h), float(values[h])) for h in part], piece=piece):
            table[r["time"]] = r
        assert len(state.rows) <= streams.KEPT_ROWS
    for h in range(30, 400):
        r = table[pd.Timestamp(at(h))]
        assert r["pm2_5_lag_24h"] == values[h - 24] and r["aqi_change_6h"] == values[h - 1] - values[h - 7]


def test_elastic_net_has_the_stated_penalty(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = x @ [30.0, -8.0, 0.4] + rng.normal(size=400) * 5 + 40
    rows = [(1, at(i), float(y[i]), *map(float, x[i]), "train") for i in range(400)]
    df = spark.createDataFrame(rows, "station_id int, time timestamp_ntz, aqi double, a double, b double, c double, split string")
    for alpha, ratio in ((1.0, 0.0), (0.1, 0.5), (2.0, 0.9), (0.5, 1.0)):
        model = M.train(df, "elastic_net", list("abc"), regParam=alpha, elasticNetParam=ratio)
        z = (x - x.mean(0)) / x.std(0)
        w = model.coefficients.toArray()
        slope = z.T @ (y - z @ w - model.intercept) / len(y)
        for g, v in zip(slope, w):
            if abs(v) > 1e-9:
                assert abs(g - alpha * ratio * np.sign(v) - alpha * (1 - ratio) * v) < 1e-3
            else:
                assert abs(g) <= alpha * ratio + 1e-3


def test_linear_model_on_raw_features_equals_the_scaled_one(spark):
    rng = np.random.default_rng(4)
    rows = [(1, at(i), float(v[0] * 3 + 60), *map(float, v), "train") for i, v in enumerate(rng.normal(5, 3, (200, 2)))]
    df = spark.createDataFrame(rows, "station_id int, time timestamp_ntz, aqi double, a double, b double, split string")
    model = M.fit(df, "elastic_net", ["a", "b"])
    linear = M.linear_of(model)
    want = {r["time"]: r["predicted_aqi"] for r in model.transform(df).collect()}
    for r in M.score(df, linear).collect():
        assert abs(r["predicted_aqi"] - want[r["time"]]) < 1e-9


def test_permutation_groups_do_not_depend_on_the_table(spark):
    rng = np.random.default_rng(5)
    rows = [(s, at(h), float(v * 10), float(v), float(rng.normal())) for s in (1, 2) for h, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "station_id int, time timestamp_ntz, aqi double, a double, b double").withColumn("split", F.lit("train"))
    model = M.train(df, "forest", ["a", "b"], numTrees=5, maxDepth=4)
    got = {r["feature_name"]: r["importance_score"] for r in M.permutation_importance(df, model, ["a", "b"]).collect()}
    assert got["a"] > 5 > abs(got["b"])


def test_registry_versions_and_nan(spark):
    ranked = spark.createDataFrame([("Random Forest", 1.0, True), ("ElasticNet", 2.0, False)], "model string, val_rmse double, best_model boolean")
    first = R.entries(ranked, ["a"], "p", F.lit(T0))
    second = R.entries(ranked, ["a"], "p", F.lit(T0), first.filter("name = 'elasticnet'"))
    assert {(r["name"], r["version"]) for r in second.collect()} == {("random_forest", 1), ("elasticnet", 2)}
    runs = spark.createDataFrame([("m", 1, {"r2": float("nan")}), ("m", 2, {"r2": 0.5})], "name string, version int, metrics map<string,double>")
    assert R.best(runs, "r2", "max").first()["version"] == 2


def test_alert_without_a_current_value_uses_the_first_prediction(spark):
    pred = spark.createDataFrame([(s, at(h), 40.0 + 60 * s + h) for s in (1, 2) for h in range(3)], "station_id int, timestamp timestamp_ntz, predicted_aqi double")
    current = spark.createDataFrame([(1, 30.0)], "station_id int, aqi double")
    got = {r["station_id"]: r["current_aqi"] for r in forecast.alerts(current, pred).collect()}
    assert got == {1: 30.0, 2: 160.0}


def test_the_response_that_arrived_last_counts(spark):
    from aerolith.schema import AIR, FEED_TARGET, WEATHER
    from aerolith.sources import landing

    hours = [(1, at(h), *[float(h)] * len(WEATHER)) for h in range(3)]
    table = spark.createDataFrame(hours, "station_id int, time timestamp_ntz, " + ", ".join(f"{c} double" for c in WEATHER))
    air = spark.createDataFrame([(1, at(h), *[1.0] * len(AIR)) for h in range(3)], "station_id int, time timestamp_ntz, " + ", ".join(f"{c} double" for c in AIR))
    for first, last in ((0, 1), (1, 0)):
        sent = [landing.to_landing(t, WEATHER, 7).withColumn("ingest_seq", F.lit(i)) for t, i in ((table, first), (table.withColumns({c: F.col(c) + 100 for c in WEATHER}), last))]
        airs = landing.to_landing(air, AIR, 7, {"aqi": FEED_TARGET})
        got = jobs.observed(sent[0].unionByName(sent[1]), airs).select("time", WEATHER[0]).collect()
        assert {r[WEATHER[0]] for r in got} == ({100.0, 101.0, 102.0} if last else {0.0, 1.0, 2.0})


def test_quantiles_are_exact_in_few_passes(spark):
    from aerolith.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(8)
    columns = [rng.normal(size=30_000), rng.integers(0, 9, 30_000).astype(float), np.repeat(5.0, 30_000)]
    rows = [tuple(None if i % 50 == 0 else float(c[i]) for c in columns) + (None,) for i in range(30_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4).cache()
    df.count()
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    kept = [i for i in range(30_000) if i % 50]
    for small in (200_000, 20):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"q{small}", "")
        got = exact_quantiles(df, "abcd", probs, small)
        for c, values in zip("abc", columns):
            assert np.allclose(got[c], np.quantile(values[kept], probs))
        assert got["d"] == [None] * len(probs)
        assert len(tracker.getJobIdsForGroup(f"q{small}")) < 40
    tiny = spark.createDataFrame([(3.0,), (1.0,), (None,)], "a double")
    assert exact_quantiles(tiny, ["a"], [0.0, 0.5, 1.0])["a"] == [1.0, 2.0, 3.0]


def test_a_forest_is_grown_by_all_tasks(spark):
    """A table that one task reads is dealt to all, row for row, before its trees are grown."""
    rows = spark.range(500).selectExpr(
        "cast(id % 3 as int) as station_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) as time", "cast(id as double) as x"
    ).coalesce(1)
    parts = M.dealt(rows)
    assert rows.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(parts.collect()) == sorted(rows.collect())
    assert M.dealt(rows.select("x")).count() == 500
