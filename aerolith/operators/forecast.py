"""Autoregressive roll-out, current conditions, alerts and evaluation."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from aerolith.functions.bands import (
    MAX_AQI,
    affected_groups,
    alert_level,
    aqi_category,
    aqi_to_pm25,
    aqi_to_pm25_array,
    clip,
)
from aerolith.operators import features as X, lookup, match, series as S
from aerolith.operators.forest import RandomForestModel
from aerolith.operators.models import LinearModel, dealt, score
from aerolith.operators.pipelines import Clamp, FeatureVector
from aerolith.operators.stats import forecast_kpis, metric_columns
from aerolith.plans import chains
from aerolith.schema import (
    CALENDAR,
    CHANGE_HOURS,
    CYCLICAL,
    INTERACTIONS,
    KEYS,
    LAGS,
    MODEL_FEATURES,
    RATE_HOURS,
    SEASON_FLAGS,
    TIME,
    WEATHER,
)
from aerolith.session import shared_dir, written

STEPS = 72
BUFFER_ROWS = 26

# What a step looks back on, and the raw column it starts from.
BUFFERS = ("aqi", *LAGS)
FUTURE = WEATHER + CALENDAR + CYCLICAL + INTERACTIONS + SEASON_FLAGS


def _inputs(history: DataFrame, future: DataFrame, start: Column, steps: int, tz: str) -> DataFrame:
    """One row per station: the last rows of each buffer and the hours to come.

    Both arrays have a fixed length, so a station's row is small.
    """
    past = S.tail(history, BUFFER_ROWS).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct(TIME, *BUFFERS))).alias("past")
    )
    hours = S.head_from(future, start, steps).select(*KEYS, TIME, *WEATHER)
    ahead = X.season_onehot(chains.features_forecast(hours, tz, S.Layout())).groupBy(*KEYS).agg(
        F.array_sort(
            F.collect_list(F.struct(TIME, *[F.col(c).cast("double").alias(c) for c in FUTURE]))
        ).alias("ahead")
    )
    return past.join(ahead, list(KEYS))


def _back(buffer: Column, n: int) -> Column:
    """The value ``n`` steps ago, or the oldest known."""
    return F.when(F.size(buffer) >= n, F.try_element_at(buffer, F.lit(-n))).otherwise(F.get(buffer, F.lit(0)))


def _step_features(state: Column, hour: Column) -> dict[str, Column]:
    out = {c: hour[c] for c in FUTURE}
    out |= {f"{c}_lag_{n}h": _back(state[c], n) for c, ns in LAGS.items() for n in ns}
    last = _back(state["aqi"], 1)
    for n in CHANGE_HOURS:
        out[f"aqi_change_{n}h"] = last - _back(state["aqi"], 1 + n)
    for n in RATE_HOURS:
        out[f"aqi_rate_{n}h"] = clip(out[f"aqi_change_{n}h"] / F.lit(float(n)), -10.0, 10.0)
    return out


def _first_columns() -> list[Column]:
    """What the first step looks back on, from ``past`` of ``_inputs``."""
    last_co = F.col("past.carbon_monoxide")[F.size("past") - 1]
    return [*[F.col(f"past.{c}").alias(c) for c in BUFFERS], last_co.alias("last_co")]


def _push(buffer: Column, value: Column) -> Column:
    grown = F.concat(buffer, F.array(value))
    return F.when(F.size(grown) > BUFFER_ROWS, F.slice(grown, -BUFFER_ROWS, BUFFER_ROWS)).otherwise(grown)


def _next_state(state: Column, hour: Column, y: Column) -> list[Column]:
    """What the step after a prediction ``y`` looks back on."""
    pushed = {
        "aqi": y,
        "pm2_5": aqi_to_pm25(y),
        "carbon_monoxide": F.greatest(F.lit(0.0), state["last_co"]),
        "temperature_2m": hour["temperature_2m"],
        "pressure_msl": hour["pressure_msl"],
    }
    return [*[_push(state[c], v).alias(c) for c, v in pushed.items()], state["last_co"].alias("last_co")]


def forecast_linear(
    history: DataFrame,
    future: DataFrame,
    model: LinearModel,
    start: Column = None,
    steps: int = STEPS,
    tz: str = "UTC",
) -> DataFrame:
    """Roll a linear model ``steps`` hours ahead, feeding predictions back.

    The roll-out is a fold over the hours to come, inside one expression per
    station; stations run in parallel.
    """
    begin = start if start is not None else F.lit("1900-01-01").cast("timestamp_ntz")
    rows = _inputs(history, future, begin, steps, tz)

    def advance(state, hour):
        known = _step_features(state, hour)
        # transform over a one-element array evaluates the prediction once
        return F.transform(
            F.array(model.predict(lambda c: known[c])),
            lambda y: F.struct(
                *_next_state(state, hour, y),
                F.concat(
                    state["out"],
                    F.array(F.struct(hour[TIME].alias("timestamp"), y.alias("predicted_aqi"))),
                ).alias("out"),
            ),
        )[0]

    begin_state = F.struct(
        *_first_columns(),
        F.array().cast("array<struct<timestamp:timestamp_ntz,predicted_aqi:double>>").alias("out"),
    )
    rolled = F.aggregate("ahead", begin_state, advance, lambda s: s["out"])
    out = rows.select(*KEYS, F.inline(rolled))
    return out.withColumn("aqi_category", aqi_category(F.col("predicted_aqi")))


def forecast_model(
    history: DataFrame,
    future: DataFrame,
    model,
    start: Column = None,
    steps: int = STEPS,
    tz: str = "UTC",
    names=MODEL_FEATURES,
    path: str | None = None,
) -> DataFrame:
    """Roll any fitted model ahead, one hour of all stations at a time.

    ``model`` is a pipeline that takes feature columns, or a model on a vector of the features ``names``.

    A forest rolls batches of stations through all hours in one pass, each in one task: its trees are sent once. Other
    models predict by their own ``transform``. Each hour's predictions and buffers are a table below ``path`` (a fresh shared folder by default), which the next
    hour reads: a row per station, joined with the weather of that hour. The result reads these tables, so the caller
    drops ``path`` once the result is no longer needed.
    """
    spark = history.sparkSession
    path = path or shared_dir(spark, "roll-out")
    begin = start if start is not None else F.lit("1900-01-01").cast("timestamp_ntz")
    rows = written(_inputs(history, future, begin, steps, tz), f"{path}/inputs")
    if found := _forest_in(model, names):
        out = written(_rolled_by_forest(rows, *found), f"{path}/rolled")
        return out.withColumn("aqi_category", aqi_category(F.col("predicted_aqi")))
    ahead = rows.select(*KEYS, F.posexplode("ahead").alias("step", "_at"))
    ahead.write.partitionBy("step").parquet(f"{path}/ahead")
    state = rows.select(*KEYS, F.struct(*_first_columns()).alias("_state"))
    longest = rows.agg(F.max(F.size("ahead"))).first()[0] or 0
    known = _step_features(F.col("_state"), F.col("_at"))
    if isinstance(model, PipelineModel):  # makes its own vector
        inputs = {c: v.cast("double") for c, v in known.items()}
    else:
        inputs = {"features": array_to_vector(F.array(*[F.coalesce(known[c].cast("double"), F.lit(0.0)) for c in names]))}
    y = clip(F.col("predicted_aqi"), 0.0, MAX_AQI)
    after = F.struct(*_next_state(F.col("_state"), F.col("_at"), F.col("predicted_aqi"))).alias("_state")
    schema, done = ahead.drop("step").schema, []
    for step in range(longest):
        hours = spark.read.schema(schema).parquet(f"{path}/ahead/step={step}")
        now = hours.join(state.select(*KEYS, "_state"), list(KEYS)).withColumns(inputs)
        rolled = model.transform(now).withColumn("predicted_aqi", y).select(
            *KEYS, F.col(f"_at.{TIME}").alias("timestamp"), "predicted_aqi", after
        )
        done.append(f"{path}/rolled-{step}")
        state = written(rolled, done[-1])
    if done:
        out = spark.read.schema(state.schema).parquet(*done)
    else:
        out = spark.createDataFrame([], "station_id int, timestamp timestamp_ntz, predicted_aqi double")
    return out.select(*KEYS, "timestamp", "predicted_aqi").withColumn("aqi_category", aqi_category(F.col("predicted_aqi")))


def _forest_in(model, names) -> tuple[RandomForestModel, FeatureVector, list[Clamp]] | None:
    """The forest of a model, what makes its vector and what follows; None for other models."""
    if isinstance(model, RandomForestModel):
        return model, FeatureVector(names=list(names)), []
    if isinstance(model, PipelineModel) and [type(s) for s in model.stages] == [FeatureVector, RandomForestModel, Clamp]:
        vector, forest, clamp = model.stages
        return forest, vector, [clamp]
    return None


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of one width, NaN where they are short or null; and their lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), sizes.max(initial=0)), np.nan)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out, sizes


def _rolled(past: dict, sizes: np.ndarray, ahead: dict, steps: int, predict: Callable[[dict], np.ndarray]) -> np.ndarray:
    """Predictions by station and hour, as ``_step_features`` and ``_next_state`` define the steps: ``past`` has the last
    rows of each buffer (``sizes`` of them), ``ahead`` what is known of the hours to come; NaN is NULL."""
    rows = np.arange(len(sizes))
    last_co = past["carbon_monoxide"][rows, sizes - 1]
    state = {c: np.pad(v, ((0, 0), (0, steps)), constant_values=np.nan) for c, v in past.items()}
    out = np.empty((len(sizes), steps))
    for t in range(steps):
        back = lambda c, n: state[c][rows, np.maximum(sizes + t - n, 0)]
        known = {c: v[:, t] for c, v in ahead.items()}
        known |= {f"{c}_lag_{n}h": back(c, n) for c, ns in LAGS.items() for n in ns}
        known |= {f"aqi_change_{n}h": back("aqi", 1) - back("aqi", 1 + n) for n in CHANGE_HOURS}
        known |= {f"aqi_rate_{n}h": np.clip(known[f"aqi_change_{n}h"] / float(n), -10.0, 10.0) for n in RATE_HOURS}
        out[:, t] = y = predict(known)
        pushed = {"aqi": y, "pm2_5": aqi_to_pm25_array(y), "carbon_monoxide": np.fmax(0.0, last_co)}
        for c in state:
            state[c][rows, sizes + t] = pushed[c] if c in pushed else ahead[c][:, t]
    return out


def _rolled_by_forest(rows: DataFrame, model: RandomForestModel, vector: FeatureVector, clamps: list[Clamp]) -> DataFrame:
    """``KEYS, timestamp, predicted_aqi`` for the rows of ``_inputs``."""
    names = vector.getOrDefault(vector.names)
    means, spreads = (np.array(vector.getOrDefault(p), float) for p in (vector.means, vector.deviations))
    bounds = [(c.getOrDefault(c.low), c.getOrDefault(c.high)) for c in clamps] + [(0.0, MAX_AQI)]
    forest = model.sent(rows.sparkSession)
    keys = len(KEYS)

    def predict(known):
        none = np.zeros(len(known["aqi_change_1h"]))
        x = np.nan_to_num(np.column_stack([known.get(n, none) for n in names]), nan=0.0, posinf=np.inf, neginf=-np.inf)
        if len(means):
            x = (x - means) / np.where(spreads == 0, 1.0, spreads)
        y = forest.value.predict(x)
        for low, high in bounds:
            y = np.clip(y, low, high)
        return y

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            at, lists = b.column(keys), [_ragged(c) for c in b.columns[keys + 1 :]]
            hours, sizes = np.diff(at.offsets.to_numpy()), lists[0][1]
            past, ahead = (dict(zip(c, (v for v, _ in part))) for c, part in ((BUFFERS, lists), (FUTURE, lists[len(BUFFERS) :])))
            y = _rolled(past, sizes, ahead, int(hours.max(initial=0)), predict)
            station = pa.array(np.repeat(np.arange(b.num_rows), hours))
            kept = y[np.arange(y.shape[1]) < hours[:, None]]
            yield pa.RecordBatch.from_arrays([*[c.take(station) for c in b.columns[:keys]], at.flatten(), pa.array(kept)], [*KEYS, "timestamp", "predicted_aqi"])

    lists = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side, of in (("past", BUFFERS), ("ahead", FUTURE)) for c in of]
    inputs = dealt(rows).select(*KEYS, F.col(f"ahead.{TIME}").alias("at"), *lists)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in KEYS)
    return inputs.mapInArrow(run, f"{schema}, timestamp timestamp_ntz, predicted_aqi double")


# Names under which current conditions are shown.
CONDITIONS = {
    "pm2_5": "pm2_5",
    "pm10": "pm10",
    "nitrogen_dioxide": "nitrogen_dioxide",
    "sulphur_dioxide": "sulphur_dioxide",
    "carbon_monoxide": "carbon_monoxide",
    "temperature": "temperature_2m",
    "humidity": "relative_humidity_2m",
    "wind_speed": "wind_speed_10m",
    "wind_direction": "wind_direction_10m",
    "pressure": "pressure_msl",
    "precipitation": "precipitation",
}


def current_aqi(raw: DataFrame, model: LinearModel, tz: str = "UTC", layout=None) -> DataFrame:
    """Per station the prediction of its last complete hour, conditions and advice."""
    table = X.season_onehot(chains.features_full(raw, tz, layout))
    last = score(S.tail(table, 1), model).select(*KEYS, TIME, "predicted_aqi")
    conditions = raw.select(*KEYS, TIME, *[F.col(c).alias(n) for n, c in CONDITIONS.items()])
    shown = last.join(conditions, [*KEYS, TIME])
    return lookup.health_advice(shown, "predicted_aqi").withColumnRenamed("predicted_aqi", "aqi")


def alerts(current: DataFrame, pred: DataFrame, value: str = "aqi") -> DataFrame:
    """Alert level, groups and advice of the current AQI, with the forecast's peak.

    Where the current AQI is unknown, the first prediction stands for it.
    """
    peak = forecast_kpis(pred).select(
        *KEYS, F.col("peak_aqi").alias("peak_aqi_predicted"), "peak_time"
    )
    first = pred.groupBy(*KEYS).agg(F.min_by("predicted_aqi", "timestamp").alias("_first"))
    known = first.join(current.select(*KEYS, F.col(value).alias("_now")), list(KEYS), "left").select(
        *KEYS, F.coalesce("_now", "_first").alias("current_aqi")
    )
    advised = lookup.health_advice(known, "current_aqi")
    v = F.col("current_aqi")
    return advised.join(peak, list(KEYS)).select(
        *KEYS,
        alert_level(v).alias("alert_level"),
        "current_aqi",
        "peak_aqi_predicted",
        "peak_time",
        F.col("description").alias("recommendation"),
        affected_groups(v).alias("affected_groups"),
    )


def evaluate(actual: DataFrame, pred: DataFrame, tolerance_hours: int = 1, by=KEYS) -> DataFrame:
    """Error metrics of matched hours, category hits and verdict shares."""
    matched = match.forecast_error(match.nearest_match(actual, pred, tolerance_hours))
    both = matched.filter(F.col("aqi").isNotNull() & F.col("predicted_aqi").isNotNull())
    return both.groupBy(*by).agg(
        *[v.alias(n) for n, v in metric_columns("aqi", "predicted_aqi").items()],
        F.count(F.lit(1)).alias("matched"),
        F.sum(F.col("category_match").cast("long")).alias("category_hits"),
        *[
            F.sum((F.col("verdict") == v.upper()).cast("long")).alias(v)
            for v in ("excellent", "good", "fair", "poor")
        ],
    )
