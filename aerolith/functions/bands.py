"""AQI bands: categories, alerts, advice and the inverse PM2.5 curve."""

import numpy as np
from pyspark.sql import Column, functions as F

# Upper bound, key, label, colour of each AQI band.
BANDS = (
    (50.0, "good", "Good", "green"),
    (100.0, "moderate", "Moderate", "yellow"),
    (150.0, "unhealthy_for_sensitive", "Unhealthy for Sensitive Groups", "orange"),
    (200.0, "unhealthy", "Unhealthy", "red"),
    (300.0, "very_unhealthy", "Very Unhealthy", "purple"),
    (500.0, "hazardous", "Hazardous", "maroon"),
)

# Integer range printed for each band.
RANGES = ("0-50", "51-100", "101-150", "151-200", "201-300", "301-500")

# Dashboard slug, hex colour and short label of each band.
SLUGS = (
    "good",
    "moderate",
    "unhealthy-for-sensitive-groups",
    "unhealthy",
    "very-unhealthy",
    "hazardous",
)
HEX_COLOURS = ("#00cc00", "#ffcc00", "#ff6600", "#ff0000", "#9933cc", "#660000")

# Alert thresholds, highest first.
ALERTS = (
    (301, "Hazardous"),
    (201, "Very Unhealthy"),
    (151, "Unhealthy"),
    (101, "Unhealthy for Sensitive Groups"),
    (51, "Moderate"),
)

# Groups affected from an AQI upwards.
GROUPS = ((101, "children"), (101, "elderly"), (151, "asthma patients"), (201, "general public"))

# Outdoor and indoor advice above an AQI.
ACTIVITY = (
    (300, "Avoid all outdoor activities", "Stay indoors with air purifiers running"),
    (200, "Avoid outdoor activities", "Keep indoors with good ventilation"),
    (150, "Limit outdoor activities", "Indoor activities are safe"),
    (100, "Sensitive groups should limit outdoor activities", "All indoor activities are safe"),
)
ACTIVITY_ELSE = ("Outdoor activities are safe for all", "Indoor activities are safe")

# AQI low, AQI high, PM2.5 low, PM2.5 high.
PM25_BREAKPOINTS = (
    (0, 50, 0.0, 12.0),
    (51, 100, 12.1, 35.4),
    (101, 150, 35.5, 55.4),
    (151, 200, 55.5, 150.4),
    (201, 300, 150.5, 250.4),
    (301, 500, 250.5, 500.4),
)

# Health advice by band key
# (description, general_public, sensitive_groups, children_elderly).
HEALTH_ADVICE = {
    "good": (
        "Air quality is satisfactory and air pollution poses little or no risk.",
        "No activity restrictions.",
        "Enjoy outdoor activities normally.",
        "No precautions needed.",
    ),
    "moderate": (
        "Air quality is acceptable, but there may be a risk for some people.",
        "No activity restrictions for most people.",
        "Consider reducing prolonged outdoor exertion.",
        "Limit prolonged outdoor activities.",
    ),
    "unhealthy_for_sensitive": (
        "Members of sensitive groups (children, elderly, and people with respiratory/heart diseases) may experience health effects.",
        "General public is not affected.",
        "Reduce outdoor activities. If you must go out, wear N95/P100 masks.",
        "Keep indoors and avoid strenuous activities.",
    ),
    "unhealthy": (
        "Some members of general public may begin to experience health effects.",
        "Reduce outdoor activities and keep indoors.",
        "Avoid all outdoor activities.",
        "Stay indoors, keep windows closed, use air purifiers.",
    ),
    "very_unhealthy": (
        "Health warnings of emergency conditions exist.",
        "Avoid outdoor activities. Minimize outdoor movement.",
        "Remain indoors and keep activity levels low.",
        "Stay indoors with air filtration, use N95 masks if outdoors.",
    ),
    "hazardous": (
        "The entire population is more likely to be affected.",
        "Stay indoors and keep activities at minimum levels.",
        "Take all precautions to remain indoors.",
        "Avoid all outdoor activities. Seek air-filtered environments.",
    ),
}

# Dashboard advice by band key (general, sensitive, activity, precautions).
UI_ADVICE = {
    "good": (
        "Air quality is satisfactory. Enjoy outdoor activities!",
        "No restrictions. Safe for all outdoor activities.",
        "All outdoor activities are recommended.",
        "No precautions needed.",
    ),
    "moderate": (
        "Air quality is acceptable. Slight risk for sensitive groups.",
        "Sensitive individuals should consider limiting prolonged outdoor activities.",
        "Outdoor activities are generally safe.",
        "Sensitive groups: monitor air quality and symptoms.",
    ),
    "unhealthy_for_sensitive": (
        "Unhealthy for sensitive groups.",
        "Sensitive individuals should limit outdoor activities.",
        "Outdoor activities should be limited for sensitive groups.",
        "N95 masks recommended for sensitive groups.",
    ),
    "unhealthy": (
        "Everyone may experience health effects.",
        "Avoid outdoor activities. Stay indoors.",
        "Everyone should limit outdoor activities.",
        "Wear N95 masks. Use air purifiers indoors.",
    ),
    "very_unhealthy": (
        "Very unhealthy. Health warnings.",
        "Remain indoors. Use air purifiers.",
        "Avoid outdoor activities completely.",
        "Stay indoors. Close windows and doors. Use air purifiers.",
    ),
    "hazardous": (
        "Hazardous air quality. Health emergency.",
        "Remain indoors. Seek medical help if symptoms.",
        "No outdoor activities permitted.",
        "Emergency level. Everyone should remain indoors.",
    ),
}


MAX_AQI = 500.0


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def by_band(aqi: Column, values) -> Column:
    """The value of the band an AQI falls in; beyond the last bound, the last."""
    out = F.when(aqi.isNull(), None)
    for (upper, *_), value in list(zip(BANDS, values))[:-1]:
        out = out.when(aqi <= upper, value)
    return out.otherwise(values[-1])


def aqi_category(aqi: Column) -> Column:
    return by_band(aqi, [key for _, key, _, _ in BANDS])


def aqi_label(aqi: Column) -> Column:
    return by_band(aqi, [label for _, _, label, _ in BANDS])


def aqi_colour(aqi: Column) -> Column:
    return by_band(aqi, HEX_COLOURS)


def aqi_slug(aqi: Column) -> Column:
    return by_band(aqi, SLUGS)


def alert_level(aqi: Column) -> Column:
    """Alert by whole-number thresholds, which differ from the bands on fractions."""
    out = F.when(aqi.isNull(), None)
    for low, name in ALERTS:
        out = out.when(aqi >= low, name)
    return out.otherwise("Good")


def affected_groups(aqi: Column) -> Column:
    named = F.array(*[F.when(aqi >= low, name) for low, name in GROUPS])
    return F.when(aqi.isNotNull(), F.array_compact(named))


def activity_advice(aqi: Column) -> dict[str, Column]:
    out = {}
    for i, name in enumerate(("outdoor", "indoor")):
        text = F.when(aqi.isNull(), None)
        for above, *texts in ACTIVITY:
            text = text.when(aqi > above, texts[i])
        out[name] = text.otherwise(ACTIVITY_ELSE[i])
    return out


def aqi_to_pm25(aqi: Column) -> Column:
    """PM2.5 of an AQI by the inverse breakpoints, clamped to 0..500.

    Band edges are whole numbers, so the curve dips just above each edge.
    """
    a = clip(aqi, 0.0, 500.0)
    out = F.when(a.isNull(), None)
    for lo, hi, pm_lo, pm_hi in PM25_BREAKPOINTS:
        out = out.when(
            a <= hi,
            F.lit(pm_lo) + (a - F.lit(float(lo))) * F.lit(pm_hi - pm_lo) / F.lit(float(hi - lo)),
        )
    return out


def aqi_to_pm25_array(aqi: np.ndarray) -> np.ndarray:
    """``aqi_to_pm25`` of an array; NaN stays NaN."""
    a = np.clip(aqi, 0.0, 500.0)
    bands = [(a <= hi, pm_lo + (a - float(lo)) * (pm_hi - pm_lo) / float(hi - lo)) for lo, hi, pm_lo, pm_hi in PM25_BREAKPOINTS]
    return np.select(*zip(*bands), np.nan)
