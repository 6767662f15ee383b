"""Roll-outs of fitted models, and the way from features to cached predictions."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aerolith.catalog.base import ID, observations, split_forecast
from aerolith.operators import features as X, forecast as G, models as M
from aerolith.operators.pipelines import Clamp
from aerolith.plans import chains, jobs
from aerolith.schema import MODEL_FEATURES
from aerolith.sources import store
from tests.conftest import SMALL

SMALLER = {
    "forest": {"numTrees": 5, "maxDepth": 4},
    "boost_shallow": {"maxIter": 3, "stepSize": 0.3},
    "boost_leafy": {"maxIter": 3, "stepSize": 0.3},
    "elastic_net": {},
}


@pytest.fixture(scope="module")
def obs(spark):
    return observations(spark, SMALL).cache()


@pytest.fixture(scope="module")
def features(obs):
    return chains.features_full(obs).cache()


@pytest.fixture(scope="module")
def parts(obs):
    history, future = split_forecast(obs)
    return history.cache(), future.cache()


def by_hour(df):
    return {(r["station_id"], r["timestamp"]): r["predicted_aqi"] for r in df.collect()}


def test_written_steps_equal_the_fold(features, parts):
    """A linear model gives the same hours by its own transform and as a fold over its weights."""
    rows = M.assemble(X.season_onehot(features).select(*ID, "aqi", *MODEL_FEATURES).na.fill(0.0)).filter("aqi is not null")
    model = LinearRegression(labelCol="aqi", predictionCol="predicted_aqi", regParam=0.1, solver="normal").fit(rows)
    linear = M.LinearModel(dict(zip(MODEL_FEATURES, model.coefficients.toArray().tolist())), float(model.intercept))
    want = by_hour(G.forecast_linear(*parts, linear, steps=30))
    got = by_hour(G.forecast_model(*parts, model, steps=30))
    assert got.keys() == want.keys() and len(want) > 0
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-6)


def test_steps_end_with_the_weather(parts, features):
    rows = M.assemble(X.season_onehot(features).select("aqi", *MODEL_FEATURES).na.fill(0.0)).filter("aqi is not null")
    model = LinearRegression(labelCol="aqi", predictionCol="predicted_aqi", solver="normal").fit(rows)
    history, future = parts
    last = future.groupBy("station_id").agg(F.max("time").alias("last"))
    short = future.join(last, "station_id").filter("time > last - interval 2 hours or (station_id = 0 and time > last - interval 3 hours)")
    got = by_hour(G.forecast_model(history, short.drop("last"), model))
    assert len(got) == short.count()
    assert G.forecast_model(history, future.limit(0), model).count() == 0


def test_every_trained_kind_rolls_out(spark, obs, parts, features, tmp_path):
    trained = jobs.training_job(features, SMALLER)
    history, _ = parts
    for name in trained.models:
        path = str(tmp_path / name.replace(" ", "_"))
        jobs.daily_forecast(*parts, trained.models[name], None, F.lit("2024-02-01").cast("timestamp_ntz"), path, 4, trained.features)
        got = store.read_predictions(spark, path)
        per = got.groupBy("station_id").agg(F.count("*").alias("n"), F.min("predicted_aqi").alias("lo"), F.max("predicted_aqi").alias("hi")).collect()
        assert len(per) == history.select("station_id").distinct().count()
        assert all(r["n"] == 4 and 0 <= r["lo"] <= r["hi"] <= 500 for r in per), name


def test_training_takes_the_kinds_that_are_named(features):
    trained = jobs.training_job(features, SMALLER, kinds=("elastic_net",))
    assert list(trained.models) == ["ElasticNet"] and trained.best == "ElasticNet"


def test_a_forest_rolls_out_in_one_pass_as_by_its_own_transform(spark, parts, features):
    """A job for each hour took over a second, whatever the stations; the steps by arrays give the same hours."""
    history, future = parts
    rows = X.season_onehot(features).select(*ID, "aqi", *MODEL_FEATURES).withColumn("split", F.lit("train"))
    pipeline = M.fit(rows, "forest", numTrees=5, maxDepth=4)
    cut = history.agg(F.max("time")).first()[0]
    twice = lambda df: df.unionByName(df.withColumn("station_id", F.lit(7)))
    few = twice(history).filter(F.col("station_id").eqNullSafe(0) | (F.col("time") > F.lit(cut) - F.expr("interval 5 hours")))
    few = few.withColumn("carbon_monoxide", F.when((F.col("station_id") == 0) | (F.hour("time") % 2 == 0), F.col("carbon_monoxide"))).cache()
    short = twice(future).withColumn("pressure_msl", F.when(F.hour("time") % 7 != 0, F.col("pressure_msl")))
    short = short.filter(F.col("station_id").eqNullSafe(0) | (F.col("time") <= F.lit(cut) + F.expr("interval 6 hours"))).cache()
    stepped = PipelineModel([*pipeline.stages, Clamp(inputCol="predicted_aqi", low=0.0, high=500.0)])
    for model, steps in ((pipeline, stepped), (M.model_of(pipeline), PipelineModel([pipeline.stages[0], M.model_of(pipeline)]))):
        tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
        context.setJobGroup("one-pass", "roll-out of a forest")
        got = by_hour(G.forecast_model(few, short, model, steps=10))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert len(tracker.getJobIdsForGroup("one-pass")) < 25
        want = by_hour(G.forecast_model(few, short, steps, steps=10))
        assert got.keys() == want.keys() and len(want) == 16
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)
    assert G.forecast_model(history, future.limit(0), pipeline).count() == 0
