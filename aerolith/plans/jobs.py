"""The jobs around the feature chain: hourly, backfill, training, forecast."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolith.operators import features as X, forecast, match, models as M, pipelines, registry as R, series as S, split as P
from aerolith.plans import chains
from aerolith.schema import AIR, FEED_TARGET, KEYS, MODEL_FEATURES, REGISTRY, TIME, WEATHER
from aerolith.session import drop_dir, shared_dir
from aerolith.sources import landing, store


def observed(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Decoded feed responses, one row per hour known to both feeds.

    Where responses of a feed overlap, the one that arrived last counts
    (``ingest_seq``); without that column, and at equal arrival, the one that
    starts last.
    """

    def hours(records, decode):
        arrival = ["ingest_seq"] if "ingest_seq" in records.columns else []
        rows = decode(records, *arrival, "start_epoch")
        rows = rows.withColumn("_order", F.struct(*arrival, "start_epoch"))
        return S.dedupe_last(rows, "_order").drop("_order", "start_epoch", *arrival)

    return match.join_feeds(hours(weather, landing.decode_weather), hours(air, landing.decode_air))


def read_feeds(spark: SparkSession, weather_path: str, air_path: str):
    feed = [*AIR[:-1], FEED_TARGET]
    return (
        landing.read_landing(spark, weather_path, WEATHER),
        landing.read_landing(spark, air_path, feed),
    )


def store_features(table: DataFrame, path: str, sequence: int, shards: int = store.SHARDS) -> None:
    """Upsert feature rows in the precision of the feature table."""
    store.upsert(X.to_single_precision(table).withColumn(store.ORDER, F.lit(sequence)), path, shards)


def feature_job(weather: DataFrame, air: DataFrame, path: str, sequence: int, tz: str = "UTC", shards: int = store.SHARDS):
    """Hourly job and backfill: responses to feature rows, upserted by hour.

    ``sequence`` orders runs; a later run replaces the rows it recomputes.
    """
    store_features(chains.features_full(observed(weather, air), tz), path, sequence, shards)


def forecast_job(records: DataFrame, as_of: Column, path: str, sequence: int, tz: str = "UTC", shards: int = store.SHARDS):
    """Forecast weather after ``as_of`` to forecast features, upserted by hour."""
    future = landing.decode_weather(records).filter(F.col(TIME) > as_of)
    table = chains.features_forecast(future, tz).withColumn(store.ORDER, F.lit(sequence))
    store.upsert(table, path, shards)


# Names under which the trained kinds are registered.
MODEL_NAMES = {
    "forest": "Random Forest",
    "boost_shallow": "Shallow Boost",
    "boost_leafy": "Leafy Boost",
    "elastic_net": "ElasticNet",
}


@dataclass
class Trained:
    models: dict  # fitted pipelines by name, from feature rows to predictions
    metrics: DataFrame
    ranked: DataFrame
    best: str
    features: list


def training_job(features: DataFrame, params: dict | None = None, names=MODEL_FEATURES, kinds=tuple(MODEL_NAMES)) -> Trained:
    """Split, train every kind of ``kinds``, measure on all splits and rank on validation."""
    params = params or {}
    matrix = X.numeric_only(X.leakage_guard(X.model_matrix(features))).columns
    used = [n for n in names if n in matrix]
    kept = M.dealt(X.season_onehot(features).select(*KEYS, TIME, "aqi", *used)).persist()
    rows = P.time_split(kept)
    fitted, scored = {}, None
    for kind in kinds:
        name = MODEL_NAMES[kind]
        fitted[name] = M.fit(rows, kind, used, **params.get(kind, {}))
        part = fitted[name].transform(rows).select("split", "aqi", "predicted_aqi", F.lit(name).alias("model"))
        scored = part if scored is None else scored.unionByName(part)
    table = M.metrics_table(scored)
    metrics = features.sparkSession.createDataFrame(table.collect(), table.schema)  # one row per model
    kept.unpersist()
    ranked = M.select_best(metrics)
    best = ranked.filter("best_model").first()["model"]
    return Trained(fitted, metrics, ranked, best, used)


def register(trained: Trained, models_path: str, registry_path: str, saved_at: Column) -> DataFrame:
    """Save the ranked models of a training run and add their rows to the registry table; returns those rows.

    Versions go on from those on file. Models are written first, so that no row points at a model that is not there.
    """
    spark = trained.ranked.sparkSession
    known = R.read(spark, registry_path) if store.exists(spark, registry_path) else None
    rows = R.entries(trained.ranked.drop("rank"), trained.features, models_path, saved_at, known)
    found = rows.collect()  # one row per model
    for r in found:
        pipelines.save(trained.models[r["display_name"]], r["filesystem_path"])
    rows = spark.createDataFrame(found, REGISTRY)
    R.add(rows, registry_path)
    return rows


def serve(features: DataFrame, model: PipelineModel, rows: int = 1) -> DataFrame:
    """Predictions of a loaded model for the last hours of each station."""
    return model.transform(S.tail(features, rows)).select(*KEYS, TIME, "predicted_aqi")


def daily_forecast(
    history: DataFrame,
    future: DataFrame,
    model,
    start: Column,
    generated_at: Column,
    path: str,
    steps: int = forecast.STEPS,
    names=MODEL_FEATURES,
):
    """Roll the chosen model ahead and cache the predictions as nested records.

    ``model`` is a LinearModel, a pipeline as ``training_job`` fits it or the registry loads it, or the bare model of one
    on the features ``names``. Linear pipelines are rolled out as one expression.
    """
    if isinstance(model, PipelineModel):
        model = M.linear_of(model) or model
    if isinstance(model, M.LinearModel):
        pred = forecast.forecast_linear(history, future, model, start, steps)
        store.write_predictions(store.prediction_records(pred, generated_at), path)
        return
    spark = history.sparkSession
    work = shared_dir(spark, "roll-out")
    pred = forecast.forecast_model(history, future, model, start, steps, names=names, path=work)
    store.write_predictions(store.prediction_records(pred, generated_at), path)
    drop_dir(spark, work)
