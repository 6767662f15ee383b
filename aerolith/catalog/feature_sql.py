"""SQL of gap repair and the feature chain, from ``obs``."""

from aerolith.catalog.base import rs
from aerolith.schema import (
    AIR,
    CALENDAR,
    CHANGE_COLUMNS,
    CHANGE_HOURS,
    CYCLICAL,
    INTERACTIONS,
    INTERPOLATED,
    LAG_COLUMNS,
    LAGS,
    RATE_COLUMNS,
    RATE_HOURS,
    RAW,
    WEATHER,
)

W = "partition by station_id order by time"


def fill(c: str, limit: int) -> str:
    return f"last_value({c} ignore nulls) over ({W} rows between {limit} preceding and current row)"


def filled_cte(src="obs", name="filled", weather=INTERPOLATED, air=AIR, cols=RAW) -> str:
    out = []
    for c in cols:
        if c in weather:
            out.append(f"{fill(c, 3)} as {c}")
        elif c in air:
            out.append(f"{fill(c, 2)} as {c}")
        else:
            out.append(c)
    return f"{name} as (select station_id, time, {', '.join(out)}, row_number() over ({W}) as rn from {src})"


def median(c: str, before=11, after=0) -> str:
    end = f"{after} following" if after else "current row"
    return f"coalesce({c}, quantile_cont({c}, 0.5) over ({W} rows between {before} preceding and {end}))"


def interpolation_ctes(src, name, weather=INTERPOLATED, rest=()) -> str:
    """Two steps: known neighbours, then the line between them."""
    near = []
    for c in weather:
        p = f"case when {c} is not null then rn end"
        near += [
            f"last_value({c} ignore nulls) over ({W} rows between unbounded preceding and current row) as pv_{c}",
            f"last_value({p} ignore nulls) over ({W} rows between unbounded preceding and current row) as pp_{c}",
            f"first_value({c} ignore nulls) over ({W} rows between current row and unbounded following) as nv_{c}",
            f"first_value({p} ignore nulls) over ({W} rows between current row and unbounded following) as np_{c}",
        ]
    line = [
        f"""case when {c} is not null then {c} when pv_{c} is null then null when nv_{c} is null then pv_{c}
            else pv_{c} + (nv_{c} - pv_{c}) * (rn - pp_{c}) / (np_{c} - pp_{c}) end as {c}"""
        for c in weather
    ]
    return f"""{name}_near as (select *, {', '.join(near)} from {src}),
    {name} as (select station_id, time, rn, {', '.join(line + list(rest))} from {name}_near)"""


def repaired_ctes(src="obs", name="repaired", weather=INTERPOLATED, air=AIR, cols=RAW) -> str:
    med = [f"{median(c)} as {c}" if c in air else c for c in cols]
    rest = [c for c in cols if c not in weather]
    return f"""{filled_cte(src, 'filled', weather, air, cols)},
    medianed as (select station_id, time, rn, {', '.join(med)} from filled),
    {interpolation_ctes('medianed', name, weather, rest)}"""


def duplicate_expr(cols=INTERPOLATED) -> str:
    every = " and ".join(
        f"(not coalesce(rg_{c} > 0, false) or coalesce(abs({c} - lag({c}) over ({W})) / nullif(rg_{c}, 0) < 0.01, false))"
        for c in cols
    )
    some = " or ".join(f"coalesce(rg_{c} > 0, false)" for c in cols)
    return f"({every}) and ({some})"


def flagged_ctes(src="repaired", name="flagged", cols=INTERPOLATED) -> str:
    spread = ", ".join(f"max({c}) over (partition by station_id) - min({c}) over (partition by station_id) as rg_{c}" for c in cols)
    return f"""ranged as (select *, {spread} from {src}),
    {name} as (select * exclude ({', '.join('rg_' + c for c in cols)}), {duplicate_expr(cols)} as is_duplicate from ranged)"""


VALID = "aqi between 0 and 600 and temperature_2m between -40 and 60 and pm2_5 <= pm10"

CALENDAR_EXPRS = {
    "hour": "hour(time)",
    "day_of_week": "isodow(time) - 1",
    "day_of_month": "day(time)",
    "month": "month(time)",
    "quarter": "quarter(time)",
    "week_of_year": "week(time)",
    "is_weekend": "case when isodow(time) >= 6 then 1 else 0 end",
    "is_daytime": "case when hour(time) >= 6 and hour(time) < 18 then 1 else 0 end",
}
SEASON = """case when month(time) in (12, 1, 2) then 'winter' when month(time) in (3, 4, 5) then 'spring'
    when month(time) in (6, 7, 8) then 'summer' else 'fall' end"""
CALENDAR_SQL = ", ".join(f"cast({e} as int) as {n}" for n, e in CALENDAR_EXPRS.items()) + f", {SEASON} as season"


def cyclical_exprs() -> dict:
    out = {}
    for n, period in (("hour", 24), ("day_of_week", 7), ("month", 12)):
        for f in ("sin", "cos"):
            out[f"{n}_{f}"] = f"{f}(2 * pi() * ({CALENDAR_EXPRS[n]}) / {period})"
    return out


CYCLICAL_SQL = ", ".join(f"{e} as {n}" for n, e in cyclical_exprs().items())
LAG_SQL = ", ".join(
    f"lag({c}, {n}) over ({W}) as {c}_lag_{n}h" for c, ns in LAGS.items() for n in ns
)
CHANGE_SQL = ", ".join(
    f"lag(aqi, 1) over ({W}) - lag(aqi, {1 + n}) over ({W}) as aqi_change_{n}h" for n in CHANGE_HOURS
)
RATE_SQL = ", ".join(
    f"greatest(-10e0, least(10e0, coalesce(aqi_change_{n}h / {n}e0, 0e0))) as aqi_rate_{n}h" for n in RATE_HOURS
)
INTERACTION_SQL = """temperature_2m * relative_humidity_2m as temp_humidity_interaction,
    wind_speed_10m * pressure_msl as wind_pressure_interaction"""

FEATURE_DOUBLES = RAW + CYCLICAL + LAG_COLUMNS + CHANGE_COLUMNS + RATE_COLUMNS + INTERACTIONS
FEATURE_OTHERS = ("station_id", "time", "is_duplicate", *CALENDAR, "season")


def features_ctes(src="obs") -> str:
    """CTEs ending in ``features``: the full chain with complete rows only."""
    complete = " and ".join(f"{c} is not null" for c in FEATURE_DOUBLES)
    return f"""{repaired_ctes(src)},
    {flagged_ctes()},
    valid as (select * from flagged where {VALID}),
    lagged as (select *, {LAG_SQL}, {CHANGE_SQL} from valid),
    enriched as (select * exclude (rn), {RATE_SQL}, {CALENDAR_SQL}, {CYCLICAL_SQL}, {INTERACTION_SQL} from lagged),
    features as (select * from enriched where {complete})"""


def features_select(src="features") -> str:
    return f"select {', '.join(FEATURE_OTHERS)}, {rs(FEATURE_DOUBLES)} from {src}"


FORECAST_DOUBLES = WEATHER + CYCLICAL + INTERACTIONS


def forecast_features_ctes(src="future", name="forecast_features") -> str:
    """The forecast chain on weather columns only."""
    return f"""{repaired_ctes(src, 'repaired_weather', INTERPOLATED, (), WEATHER)},
    {name} as (select station_id, time, {', '.join(WEATHER)}, {CALENDAR_SQL}, {CYCLICAL_SQL}, {INTERACTION_SQL}
      from repaired_weather)"""


ONEHOT_SQL = ", ".join(
    f"cast(season = '{s}' as int) as season_{i}" for i, s in enumerate(("winter", "spring", "summer", "fall"))
)
