"""Column names and table schemas shared by all operators.

Missing values are NULL, never NaN.  ``time`` is a naive UTC timestamp
(``timestamp_ntz``) on the hour; ``(station_id, time)`` identifies a row.
"""

from pyspark.sql import types as T

KEYS = ("station_id",)
TIME = "time"

# The variables of the two hourly feeds, in feed order.
WEATHER = (
    "temperature_2m",
    "relative_humidity_2m",
    "pressure_msl",
    "wind_speed_10m",
    "wind_direction_10m",
    "precipitation",
)
POLLUTANTS = ("pm10", "pm2_5", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide")
TARGET = "aqi"
AIR = POLLUTANTS + (TARGET,)
RAW = WEATHER + AIR

# The feed calls the target by another name.
FEED_TARGET = "us_aqi"

# Which variables are repaired how.
INTERPOLATED = ("temperature_2m", "pressure_msl", "wind_speed_10m")
MEDIAN_FILLED = AIR
WEATHER_FILL_LIMIT = 3
AIR_FILL_LIMIT = 2
MEDIAN_ROWS = 12

# Lags, momentum steps and rates of the feature table.
LAGS = {
    "pm2_5": (1, 3, 6, 12, 24),
    "carbon_monoxide": (1, 3, 6, 12, 24),
    "temperature_2m": (12,),
    "pressure_msl": (12,),
}
CHANGE_HOURS = (1, 3, 6, 24)
RATE_HOURS = (1, 3, 24)

CALENDAR = (
    "hour",
    "day_of_week",
    "day_of_month",
    "month",
    "quarter",
    "week_of_year",
    "is_weekend",
    "is_daytime",
)
CYCLICAL = (
    "hour_sin",
    "hour_cos",
    "day_of_week_sin",
    "day_of_week_cos",
    "month_sin",
    "month_cos",
)
SEASONS = ("winter", "spring", "summer", "fall")
LAG_COLUMNS = tuple(f"{c}_lag_{n}h" for c, ns in LAGS.items() for n in ns)
CHANGE_COLUMNS = tuple(f"aqi_change_{n}h" for n in CHANGE_HOURS)
RATE_COLUMNS = tuple(f"aqi_rate_{n}h" for n in RATE_HOURS)
INTERACTIONS = ("temp_humidity_interaction", "wind_pressure_interaction")
SEASON_FLAGS = tuple(f"season_{i}" for i in range(len(SEASONS)))

MODEL_FEATURES = (
    WEATHER
    + CALENDAR
    + CYCLICAL
    + LAG_COLUMNS
    + CHANGE_COLUMNS
    + RATE_COLUMNS
    + INTERACTIONS
    + SEASON_FLAGS
)

# Same-hour values that would leak the target into a model.
LEAKING = POLLUTANTS + ("pm2_5_pm10_ratio", "is_duplicate")

# Columns the hourly job stores in single precision.
SINGLE_PRECISION = (
    ("pm10", "pm2_5", "nitrogen_dioxide", "sulphur_dioxide", "aqi")
    + tuple(f"pm2_5_lag_{n}h" for n in LAGS["pm2_5"])
    + CHANGE_COLUMNS
    + RATE_COLUMNS
)


def _hourly(variables):
    return T.StructType(
        [
            T.StructField("station_id", T.IntegerType()),
            T.StructField(TIME, T.TimestampNTZType()),
        ]
        + [T.StructField(v, T.DoubleType()) for v in variables]
    )


WEATHER_OBS = _hourly(WEATHER)
AIR_OBS = _hourly(AIR)
RAW_OBS = _hourly(RAW)


def landing_record(variables) -> T.StructType:
    """One feed response: start epoch and one value array per variable."""
    return T.StructType(
        [
            T.StructField("station_id", T.IntegerType()),
            T.StructField("start_epoch", T.LongType()),
        ]
        + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    )


PREDICTION_ITEM = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("predicted_aqi", T.DoubleType()),
        T.StructField("aqi_category", T.StringType()),
    ]
)
PREDICTION_RECORD = T.StructType(
    [
        T.StructField("station_id", T.IntegerType()),
        T.StructField("generated_at", T.TimestampNTZType()),
        T.StructField("predictions", T.ArrayType(PREDICTION_ITEM)),
    ]
)
REGISTRY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("best_model", T.BooleanType()),
        T.StructField("filesystem_path", T.StringType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("registry_source", T.StringType()),
        T.StructField("saved_at", T.TimestampNTZType()),
    ]
)
