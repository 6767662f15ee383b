"""Gap repair, quality and feature queries."""

from pyspark.sql import functions as F

from aerolith.catalog import feature_sql as Q
from aerolith.catalog.base import (
    COPIES,
    ID,
    OBS,
    ORDER_SERIES,
    SPLIT_FORECAST,
    layout_of,
    observations,
    order_layout,
    order_series,
    r,
    rounded,
    rs,
    split_forecast,
    with_,
    with_copies,
)
from aerolith.functions.calendar import hour_ceil
from aerolith.operators import features as X, impute, quality, series as S
from aerolith.operators.buckets import TimeBuckets
from aerolith.plans import chains
from aerolith.schema import AIR, CALENDAR, CYCLICAL, INTERPOLATED, MODEL_FEATURES, POLLUTANTS, RAW, WEATHER
from aerolith.sources import event_feed

AS_OF = "2024-01-20 07:30:00"


def _as_of():
    return F.expr(f"timestamp_ntz '{AS_OF}'")


def _on_obs(make, *cols):
    """A query over observations, narrowed to the columns it shows."""

    def run(spark, sf_dir):
        out = make(observations(spark, sf_dir))
        return rounded(out.select(*ID, *cols) if cols else out)

    return run


def _on_series(make, *cols):
    """The same, for operators that take the layout of the series."""

    def run(spark, sf_dir):
        return _on_obs(lambda o: make(o, layout_of(spark, sf_dir)), *cols)(spark, sf_dir)

    return run


CLEANED = tuple(c for c in WEATHER if c != "precipitation")
LAGGED = tuple(Q.LAG_COLUMNS)
CHANGED = tuple(Q.CHANGE_COLUMNS) + tuple(Q.RATE_COLUMNS)
PCT = ("aqi_pct_change_1h", "aqi_pct_change_24h")


def _features(spark, sf_dir):
    return chains.features_full(observations(spark, sf_dir), layout=layout_of(spark, sf_dir))


def _model_matrix(spark, sf_dir):
    return rounded(X.model_matrix(_features(spark, sf_dir), keep=ID))


def _forecast_features(spark, sf_dir):
    _, future = split_forecast(observations(spark, sf_dir))
    return chains.features_forecast(future, layout=layout_of(spark, sf_dir))


def _aligned(spark, sf_dir):
    forecast = X.season_onehot(_forecast_features(spark, sf_dir))
    return rounded(X.align_features(forecast, keep=ID))


def _freshness(spark, sf_dir):
    return quality.forecast_freshness(observations(spark, sf_dir), _as_of())


QUERIES = {
    "ffill_limit": _on_series(lambda o, l: impute.fill_gaps(o, l), *INTERPOLATED, *AIR),
    "interpolate_linear": _on_series(lambda o, l: impute.interpolate(impute.fill_gaps(o, l), layout=l), *INTERPOLATED),
    "median_impute": _on_series(lambda o, l: impute.median_impute(impute.fill_gaps(o, l), layout=l), *AIR),
    "median_impute_centered": _on_series(lambda o, l: impute.explore_clean(o, l), *RAW),
    "duplicate_weather": _on_series(
        lambda o, l: quality.duplicate_weather(impute.handle_missing(o, l), layout=l), *INTERPOLATED, "is_duplicate"
    ),
    "duplicate_count": _on_series(lambda o, l: quality.duplicate_count(impute.explore_clean(o, l), WEATHER, l)),
    "validate_ranges": _on_obs(quality.validate_ranges, "aqi", "temperature_2m", "pm2_5", "pm10"),
    "drop_incomplete": _on_obs(quality.drop_incomplete, *RAW),
    "dedupe_keep_last": lambda s, d: rounded(S.dedupe_last(with_copies(observations(s, d)))),
    "rename_target": _on_obs(
        lambda o: X.rename_target(o.withColumnRenamed("aqi", "us_aqi")), "aqi", "pm2_5"
    ),
    "time_features": _on_obs(X.time_features, *CALENDAR, "season"),
    "cyclical": _on_obs(lambda o: X.cyclical(X.time_features(o)), *CYCLICAL),
    "interactions": _on_obs(X.interactions, *Q.INTERACTIONS),
    "lag_features": _on_series(lambda o, l: X.lag_features(o, l), *LAGGED),
    "aqi_change_rates": _on_series(lambda o, l: X.change_rates(o, l), *CHANGED),
    "aqi_pct_change": _on_series(lambda o, l: X.pct_change(o, layout=l), *PCT),
    "features_full": lambda s, d: rounded(_features(s, d)),
    # Two stations with a row every few hours for years, cut into years; a month is looked back on.
    "features_long_bucketed": lambda s, d: rounded(
        chains.features_bucketed(event_feed.order_series(s, d, 2), TimeBuckets(365 * 24, 45 * 24, 10 * 24))
    ),
    "features_long": lambda s, d: rounded(chains.features_full(order_series(s, d), layout=order_layout(s, d))),
    "features_forecast": lambda s, d: rounded(_forecast_features(s, d)),
    "season_onehot": _on_obs(
        lambda o: X.season_onehot(X.time_features(o)), "season_0", "season_1", "season_2", "season_3"
    ),
    "model_matrix": _model_matrix,
    "leakage_guard": lambda s, d: rounded(X.leakage_guard(_features(s, d))),
    "numeric_only": lambda s, d: rounded(X.numeric_only(_features(s, d))),
    "cast_float32": lambda s, d: rounded(X.to_single_precision(_features(s, d)).select(*ID, *X.SINGLE_PRECISION), 3),
    "align_features": _aligned,
    "future_only": _on_obs(lambda o: o.filter(F.col("time") > _as_of()), *WEATHER),
    "next_n_hours": _on_obs(lambda o: S.head_from(o, hour_ceil(_as_of()), 72), *WEATHER),
    "tail_per_series": _on_obs(lambda o: S.tail(o, 26), *RAW),
    "sorted_series": _on_obs(lambda o: o.orderBy(*ID), *RAW),
    "preview": _on_obs(lambda o: o.orderBy(*ID).limit(5), *RAW),
    "forecast_freshness": _freshness,
    "null_profile": lambda s, d: quality.null_profile(observations(s, d)),
    "table_profile": lambda s, d: rounded(quality.table_profile(observations(s, d))),
    "range_report": lambda s, d: rounded(quality.range_report(observations(s, d))),
}


_pad = f"last_value(aqi ignore nulls) over ({Q.W} rows between unbounded preceding and current row)"


def _pct(n):
    return f"""greatest(-1e0, least(1e0, coalesce(case when b{n} = 0 then cast(sign(b0) as double)
        else b0 / b{n} - 1 end, 0e0))) as aqi_pct_change_{n}h"""


_explored = f"""
{Q.filled_cte(weather=CLEANED)},
{Q.interpolation_ctes('filled', 'smooth', CLEANED, ('coalesce(precipitation, 0e0) as precipitation', *AIR))},
explored as (select station_id, time, rn, {', '.join(WEATHER)},
  {', '.join(f'{Q.median(c, 6, 5)} as {c}' for c in AIR)} from smooth)
"""

_matrix_doubles = [c for c in Q.FEATURE_DOUBLES if c not in POLLUTANTS]
_guarded = [c for c in Q.FEATURE_DOUBLES if "lag" in c or not any(p in c for p in POLLUTANTS)]


def _f32(c):
    return r(f"cast(cast({c} as real) as double)", c, 3)


def _zero(c):
    return r(f"coalesce(cast({c} as double), 0e0)", c)


_forecast_known = set(Q.FORECAST_DOUBLES) | set(CALENDAR) | {f"season_{i}" for i in range(4)}

ORACLES = {
    "ffill_limit": f"{with_(OBS, Q.filled_cte())} select station_id, time, {rs(INTERPOLATED + AIR)} from filled",
    "interpolate_linear": f"""{with_(OBS, Q.filled_cte(), Q.interpolation_ctes('filled', 'smooth'))}
        select station_id, time, {rs(INTERPOLATED)} from smooth""",
    "median_impute": f"""{with_(OBS, Q.filled_cte())}
        select station_id, time, {', '.join(r(Q.median(c), c) for c in AIR)} from filled""",
    "median_impute_centered": f"{with_(OBS, _explored)} select station_id, time, {rs(RAW)} from explored",
    "duplicate_weather": f"""{with_(OBS, Q.repaired_ctes(), Q.flagged_ctes())}
        select station_id, time, {rs(INTERPOLATED)}, is_duplicate from flagged""",
    "duplicate_count": f"""{with_(OBS, _explored, Q.flagged_ctes('explored', 'flagged', WEATHER))}
        select station_id, count(*) filter (where is_duplicate) as duplicates from flagged group by station_id""",
    "validate_ranges": f"""{with_(OBS)} select station_id, time, {rs(('aqi', 'temperature_2m', 'pm2_5', 'pm10'))}
        from obs where {Q.VALID}""",
    "drop_incomplete": f"""{with_(OBS)} select station_id, time, {rs(RAW)} from obs
        where {' and '.join(f'{c} is not null' for c in RAW)}""",
    "dedupe_keep_last": f"""{with_(OBS, COPIES)} select station_id, time, {rs(RAW)}, ingest_seq from copies
        qualify row_number() over (partition by station_id, time order by ingest_seq desc) = 1""",
    "rename_target": f"{with_(OBS)} select station_id, time, {rs(('aqi', 'pm2_5'))} from obs",
    "time_features": f"{with_(OBS)} select station_id, time, {Q.CALENDAR_SQL} from obs",
    "cyclical": f"""{with_(OBS)} select station_id, time,
        {', '.join(r(e, n) for n, e in Q.cyclical_exprs().items())} from obs""",
    "interactions": f"""{with_(OBS)} select station_id, time,
        {r('temperature_2m * relative_humidity_2m', 'temp_humidity_interaction')},
        {r('wind_speed_10m * pressure_msl', 'wind_pressure_interaction')} from obs""",
    "lag_features": f"{with_(OBS, f'lagged as (select station_id, time, {Q.LAG_SQL} from obs)')} select station_id, time, {rs(LAGGED)} from lagged",
    "aqi_change_rates": f"""{with_(OBS, f'changed as (select station_id, time, {Q.CHANGE_SQL} from obs)',
        f'rated as (select *, {Q.RATE_SQL} from changed)')} select station_id, time, {rs(CHANGED)} from rated""",
    "aqi_pct_change": f"""{with_(OBS, f'padded as (select station_id, time, {_pad} as p from obs)',
        f'''back as (select station_id, time, lag(p, 1) over ({Q.W}) as b0, lag(p, 2) over ({Q.W}) as b1,
            lag(p, 25) over ({Q.W}) as b24 from padded)''',
        f'pct as (select station_id, time, {_pct(1)}, {_pct(24)} from back)')}
        select station_id, time, {rs(PCT)} from pct""",
    "features_full": f"{with_(OBS, Q.features_ctes())} {Q.features_select()}",
    "features_long_bucketed": f"{with_(ORDER_SERIES.replace('cast(l_suppkey as int)', 'cast(l_suppkey % 2 as int)'), Q.features_ctes())} {Q.features_select()}",
    "features_long": f"{with_(ORDER_SERIES, Q.features_ctes())} {Q.features_select()}",
    "features_forecast": f"""{with_(OBS, SPLIT_FORECAST, Q.forecast_features_ctes())}
        select station_id, time, {rs(Q.FORECAST_DOUBLES)}, {', '.join(CALENDAR)}, season from forecast_features""",
    "season_onehot": f"""{with_(OBS, f'seasoned as (select station_id, time, {Q.SEASON} as season from obs)')}
        select station_id, time, {Q.ONEHOT_SQL} from seasoned""",
    "model_matrix": f"""{with_(OBS, Q.features_ctes())} select station_id, time, {rs(_matrix_doubles)},
        {', '.join(CALENDAR)}, {Q.ONEHOT_SQL} from features""",
    "leakage_guard": f"""{with_(OBS, Q.features_ctes())} select station_id, time, is_duplicate, {rs(_guarded)},
        {', '.join(CALENDAR)}, season from features""",
    "numeric_only": f"""{with_(OBS, Q.features_ctes())} select station_id, is_duplicate, {rs(Q.FEATURE_DOUBLES)},
        {', '.join(CALENDAR)} from features""",
    "cast_float32": f"""{with_(OBS, Q.features_ctes())} select station_id, time,
        {', '.join(_f32(c) for c in X.SINGLE_PRECISION)} from features""",
    "align_features": f"""{with_(OBS, SPLIT_FORECAST, Q.forecast_features_ctes(),
        f'hot as (select *, {Q.ONEHOT_SQL} from forecast_features)')}
        select station_id, time,
        {', '.join(_zero(c) if c in _forecast_known else f'0e0 as {c}' for c in MODEL_FEATURES)} from hot""",
    "future_only": f"{with_(OBS)} select station_id, time, {rs(WEATHER)} from obs where time > timestamp '{AS_OF}'",
    "next_n_hours": f"""{with_(OBS)} select station_id, time, {rs(WEATHER)} from obs
        where time >= timestamp '2024-01-20 08:00:00'
        qualify row_number() over ({Q.W}) <= 72""",
    "tail_per_series": f"""{with_(OBS)} select station_id, time, {rs(RAW)} from obs
        qualify row_number() over (partition by station_id order by time desc) <= 26""",
    "sorted_series": f"{with_(OBS)} select station_id, time, {rs(RAW)} from obs order by station_id, time",
    "preview": f"{with_(OBS)} select station_id, time, {rs(RAW)} from obs order by station_id, time limit 5",
    "forecast_freshness": f"""{with_(OBS)} select station_id, count(*) as row_count,
        count(*) filter (where time <= timestamp '{AS_OF}') as past_rows from obs group by station_id""",
    "null_profile": f"""{with_(OBS, f'''counted as (select {', '.join(f'count(*) - count({c}) as "{c}"' for c in ('station_id', 'time', *RAW))} from obs)''',
        'tall as (unpivot counted on columns(*) into name column_name value null_count)')}
        select column_name, null_count from tall
        union all select '(all)', cast(sum(null_count) as bigint) from tall""",
    "table_profile": f"""{with_(OBS)} select count(*) as row_count, 14 as column_count, min(time) as min_time,
        max(time) as max_time, {r('epoch(max(time) - min(time)) / 3600e0', 'duration_hours')} from obs""",
    "range_report": f"""{with_(OBS)}
        select 'AQI' as variable, {r('min(aqi)', 'min_value')}, {r('max(aqi)', 'max_value')}, '0-600' as expected from obs
        union all select 'Temperature', {r('min(temperature_2m)', 'a')}, {r('max(temperature_2m)', 'b')}, '-40 to 60°C' from obs
        union all select 'Humidity', {r('min(relative_humidity_2m)', 'a')}, {r('max(relative_humidity_2m)', 'b')}, '0-100%' from obs""",
}
