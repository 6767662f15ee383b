"""Readable names, summaries and metric picks."""

from pyspark.sql import Column, functions as F

# Labels of lagged variables.
LAG_LABELS = {
    "pm2_5": "PM2.5",
    "pm10": "PM10",
    "carbon_monoxide": "Carbon Monoxide",
    "nitrogen_dioxide": "Nitrogen Dioxide",
    "sulphur_dioxide": "Sulphur Dioxide",
    "temperature_2m": "Temperature",
    "pressure_msl": "Pressure Msl",
}

# Labels by the first fragment found in a feature name.
FRAGMENT_LABELS = (
    ("pm2_5", "PM2.5 Levels"),
    ("pm10", "PM10 Levels"),
    ("temperature_2m", "Temperature"),
    ("relative_humidity_2m", "Humidity"),
    ("wind_speed_10m", "Wind Speed"),
    ("wind_direction_10m", "Wind Direction"),
    ("precipitation", "Rainfall"),
    ("surface_pressure", "Air Pressure"),
    ("cloud_cover", "Cloud Cover"),
    ("hour", "Time of Day"),
    ("day_of_week", "Day of Week"),
    ("month", "Season"),
    ("is_weekend", "Weekend Effect"),
    ("aqi_lag_", "Past AQI "),
    ("aqi_change_rate", "AQI Trend"),
    ("temp_pm_interaction", "Temperature-PM Interaction"),
    ("wind_pm_interaction", "Wind-PM Interaction"),
)

# Words that mark a label as pollutant or weather.
POLLUTANT_WORDS = ("PM2.5", "PM10", "AQI")
WEATHER_WORDS = ("Wind", "Temperature", "Humidity", "Rain")


def normalize_key(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def _title(name: Column) -> Column:
    """Title case that also starts a word after a digit: ``24h`` becomes ``24H``."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    marked = F.regexp_replace(spaced, "([^A-Za-z ])([A-Za-z])", "$1\u0001 $2")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def feature_label(name: Column) -> Column:
    lower = F.lower(name)
    parts = F.split(lower, "_lag_")
    base, lag = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    labels = F.create_map(*[F.lit(x) for kv in LAG_LABELS.items() for x in kv])
    base_label = F.coalesce(F.try_element_at(labels, base), _title(base))
    lag_label = F.when(lag.rlike("^[0-9]+$"), F.concat(lag, F.lit("h"))).otherwise(lag)
    out = F.when(
        lower.contains("_lag_"), F.concat(base_label, F.lit(" (Lag "), lag_label, F.lit(")"))
    )
    for fragment, label in FRAGMENT_LABELS:
        out = out.when(lower.contains(fragment), label)
    return out.otherwise(_title(name))


def _naming_any(labels: Column, words) -> Column:
    def hit(label):
        cond = F.lit(False)
        for w in words:
            cond = cond | label.contains(w)
        return cond

    return F.filter(labels, hit)


def driver_summary(labels: Column) -> Column:
    """A sentence from the labels of the top features, best first."""
    top = F.slice(labels, 1, 3)
    two = lambda words: F.array_join(F.slice(_naming_any(top, words), 1, 2), ", ")
    pollutants, weather = two(POLLUTANT_WORDS), two(WEATHER_WORDS)
    only = F.concat(pollutants, weather)
    return (
        F.when(F.size(labels) < 3, "Insufficient data for explanation.")
        .when(
            (pollutants != "") & (weather != ""),
            F.concat(
                F.lit("Today's AQI is primarily driven by "),
                pollutants,
                F.lit(" with "),
                weather,
                F.lit(" playing a secondary role."),
            ),
        )
        .when(only != "", F.concat(F.lit("Today's AQI is primarily influenced by "), only, F.lit(".")))
        .otherwise(
            F.concat(
                F.lit("The top factors affecting AQI are "),
                F.array_join(F.slice(top, 1, 2), ", "),
                F.lit("."),
            )
        )
    )


def metric_pick(metrics: Column, names) -> Column:
    """First metric present among ``names``, three decimals; empty if none."""
    found = F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])
    return F.when(found.isNull(), "").otherwise(F.format_string("%.3f", found))
