"""Models that are saved, registered, loaded by name and served."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from aerolith.catalog.base import observations
from aerolith.operators import features as X, pipelines, registry as R
from aerolith.plans import chains, jobs
from aerolith.schema import MODEL_FEATURES
from tests.conftest import SMALL
from tests.test_rollout import SMALLER

SAVED = "timestamp_ntz '2024-02-01 00:00:00'"


@pytest.fixture(scope="module")
def features(spark):
    return chains.features_full(observations(spark, SMALL)).cache()


@pytest.fixture(scope="module")
def trained(features):
    return jobs.training_job(features, SMALLER)


def predictions(df):
    return {(r["station_id"], r["time"]): r["predicted_aqi"] for r in df.collect()}


def test_every_kind_predicts_the_same_once_loaded(spark, features, trained, tmp_path):
    models, table = str(tmp_path / "models"), str(tmp_path / "registry")
    rows = jobs.register(trained, models, table, F.expr(SAVED))
    registry = R.read(spark, table)
    assert sorted(registry.collect(), key=str) == sorted(rows.collect(), key=str)
    for r in rows.collect():
        loaded = R.load(registry, r["name"])
        assert isinstance(loaded, PipelineModel) and r["filesystem_path"] == f"{models}/{r['name']}/v1"
        want = predictions(trained.models[r["display_name"]].transform(features))
        assert predictions(loaded.transform(features)) == want and len(want) > 100


def test_versions_go_on_and_are_found(spark, trained, tmp_path):
    models, table = str(tmp_path / "models"), str(tmp_path / "registry")
    for hour in ("00", "01"):
        jobs.register(trained, models, table, F.expr(f"timestamp_ntz '2024-02-01 {hour}:00:00'"))
    registry = R.read(spark, table)
    assert sorted(r["version"] for r in registry.collect()) == [1] * 4 + [2] * 4
    assert R.find(registry, "elasticnet")["version"] == 2
    assert R.find(registry, "elasticnet", version=1)["filesystem_path"].endswith("/elasticnet/v1")
    assert R.find(registry, "elasticnet", metric="val_rmse")["version"] == 2  # as good as the first, and later
    assert R.find(registry, "unknown") is None
    with pytest.raises(ValueError, match="no model unknown of version 3"):
        R.load(registry, "unknown", 3)


def test_rows_saved_again_replace_those_on_file(spark, trained, tmp_path):
    table = str(tmp_path / "registry")
    rows = jobs.register(trained, str(tmp_path / "models"), table, F.expr(SAVED))
    R.add(rows.withColumns({"saved_at": F.expr(SAVED) + F.expr("interval 1 hour"), "registry_source": F.lit("again")}), table)
    assert {r["registry_source"] for r in R.read(spark, table).collect()} == {"again"} and R.read(spark, table).count() == 4


def test_feature_vector_takes_what_rows_have(spark, features, tmp_path):
    """Seasons by name or as flags, missing columns and NULLs as 0; parameters outlive a save."""
    stage = pipelines.FeatureVector(names=["season_0", "hour", "absent", "pm2_5_lag_1h"], means=[0.0, 1.0, 0.0, 0.0], deviations=[1.0, 2.0, 1.0, 0.0])
    few = features.select("season", "hour", "pm2_5_lag_1h").limit(50).cache()
    hot = X.season_onehot(few)
    want = [[float(r["season"] == "winter"), (r["hour"] - 1) / 2, 0.0, r["pm2_5_lag_1h"]] for r in few.collect()]
    pipelines.save(PipelineModel([stage]), str(tmp_path / "stage"))
    loaded = pipelines.load(str(tmp_path / "stage"))
    for df in (few, hot):
        assert [list(r["features"]) for r in loaded.transform(df).collect()] == want
    empty = spark.createDataFrame([(None, None)], "season string, hour int")
    assert list(loaded.transform(empty).first()["features"]) == [0.0, -0.5, 0.0, 0.0]


def test_serving_scores_the_last_hour_of_each_station(features, trained):
    got = predictions(jobs.serve(features, trained.models[trained.best]))
    last = {(r["station_id"], r["time"]) for r in features.groupBy("station_id").agg(F.max("time").alias("time")).collect()}
    assert set(got) == last and all(0 <= v <= 500 for v in got.values())
    assert set(trained.features) <= set(MODEL_FEATURES)
