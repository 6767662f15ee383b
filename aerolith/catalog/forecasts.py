"""Joins, matching, roll-outs, current conditions, alerts and evaluation."""

from pyspark.sql import functions as F

from aerolith.catalog import feature_sql as Q
from aerolith.catalog.base import (
    ID,
    OBS,
    PREDICTIONS,
    SPLIT_FORECAST,
    WEIGHTS,
    layout_of,
    observations,
    predictions,
    r,
    rounded,
    rs,
    split_forecast,
    with_,
)
from aerolith.catalog.models import LINEAR, QUICK, matrix, predict_sql
from aerolith.catalog.rules import advice_sql, alert_sql, band_keys, bands_sql, groups_sql, pm25_sql
from aerolith.catalog.statistics import label_sql
from aerolith.functions import bands as B
from aerolith.operators import forecast as G, match, models as M
from aerolith.plans import chains
from aerolith.schema import CHANGE_HOURS, LAGS, RATE_HOURS, RAW
from aerolith.sources.event_feed import air_observations, weather_observations

AT = "2024-01-15 09:25:00"


def _join(spark, sf_dir):
    obs = observations(spark, sf_dir)
    air = air_observations(obs).filter(F.hour("time") % 6 != 1)
    return match.join_feeds(weather_observations(obs), air)


def _matched(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return match.nearest_match(obs.select(*ID, "aqi"), predictions(obs))


def _closest(spark, sf_dir):
    known = observations(spark, sf_dir).filter("aqi is not null").select(*ID, "aqi")
    return match.closest_row(known, F.expr(f"timestamp_ntz '{AT}'"))


def _conditions(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return match.rows_of(chains.features_full(obs, layout=layout_of(spark, sf_dir)), obs)


def _forecast(spark, sf_dir):
    history, future = split_forecast(observations(spark, sf_dir))
    return G.forecast_linear(history, future, LINEAR)


def _forecast_trees(spark, sf_dir):
    model = M.train(matrix(spark, sf_dir), "forest", **QUICK["forest"])
    history, future = split_forecast(observations(spark, sf_dir))
    return G.forecast_model(history, future, model)


def _current(spark, sf_dir):
    return G.current_aqi(observations(spark, sf_dir), LINEAR, layout=layout_of(spark, sf_dir))


def _alerts(spark, sf_dir):
    obs = observations(spark, sf_dir)
    out = G.alerts(G.current_aqi(obs, LINEAR, layout=layout_of(spark, sf_dir)), predictions(obs))
    return out.withColumn("affected_groups", F.array_join("affected_groups", ","))


def _evaluated(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return G.evaluate(obs.select(*ID, "aqi"), predictions(obs))


QUERIES = {
    "join_weather_air": lambda s, d: rounded(_join(s, d)),
    "nearest_match": lambda s, d: rounded(_matched(s, d)),
    "closest_row": lambda s, d: rounded(_closest(s, d)),
    "current_conditions": lambda s, d: rounded(_conditions(s, d)),
    "forecast_error": lambda s, d: rounded(match.forecast_error(_matched(s, d))),
    "evaluate_forecast": lambda s, d: rounded(_evaluated(s, d)),
    "forecast_ar": lambda s, d: rounded(_forecast(s, d)),
    "forecast_ar_trees": _forecast_trees,
    "current_aqi": lambda s, d: rounded(_current(s, d)),
    "alerts": lambda s, d: rounded(_alerts(s, d)),
}

MATCHED = f"""
{PREDICTIONS.strip()},
pairs as (select o.station_id, o.time, o.aqi, p.timestamp, p.predicted_aqi,
    row_number() over (partition by o.station_id, o.time order by abs(epoch_us(p.timestamp) - epoch_us(o.time)), p.timestamp) as rk
  from obs o left join pred p on p.station_id = o.station_id
    and p.timestamp between o.time - interval 1 hour and o.time + interval 1 hour),
matched as (select station_id, time, aqi, timestamp, predicted_aqi,
    abs(epoch_us(timestamp) - epoch_us(time)) / 1e6 as offset_seconds from pairs where rk = 1)
"""

_pct = "abs(predicted_aqi - aqi) / nullif(aqi, 0) * 100"
ERRORS = f"""
{MATCHED.strip()},
errors as (select *, predicted_aqi - aqi as error, abs(predicted_aqi - aqi) as abs_error, {_pct} as pct_error,
    case when predicted_aqi - aqi > 0 then 'over' when predicted_aqi - aqi <= 0 then 'under' end as direction,
    {label_sql('aqi')} = {label_sql('predicted_aqi')} as category_match,
    case when aqi is null or predicted_aqi is null then null when {_pct} < 10 then 'EXCELLENT' when {_pct} < 20 then 'GOOD'
      when {_pct} < 30 then 'FAIR' else 'POOR' end as verdict from matched)
"""


def _back(c, n):
    return f"case when len({c}) >= {n} then {c}[-{n}] else {c}[1] end"


def _buf(c):
    return {"aqi": "b_aqi", "pm2_5": "b_pm", "carbon_monoxide": "b_co", "temperature_2m": "b_temp", "pressure_msl": "b_pres"}[c]


_known = {f"{c}_lag_{n}h": _back(_buf(c), n) for c, ns in LAGS.items() for n in ns}
_known |= {f"aqi_change_{n}h": f"({_back('b_aqi', 1)} - {_back('b_aqi', n + 1)})" for n in CHANGE_HOURS}
_known |= {f"aqi_rate_{n}h": f"case when {_known[f'aqi_change_{n}h']} is not null then greatest(-10e0, least(10e0, {_known[f'aqi_change_{n}h']} / {n}e0)) end" for n in RATE_HOURS}
_lists = ", ".join(f"list({c} order by time) as {_buf(c)}" for c in ("aqi", *LAGS))


def _push(c, v):
    return f"list_append({c}, {v})[-26:] as {c}"


ROLLED = f"""
{Q.forecast_features_ctes()},
ahead as (select *, {Q.ONEHOT_SQL}, row_number() over (partition by station_id order by time) as k from forecast_features),
tails as (select * from history qualify row_number() over (partition by station_id order by time desc) <= 26),
past as (select station_id, {_lists} from tails group by station_id),
roll as (
  select station_id, cast(0 as bigint) as k, b_aqi, b_pm, b_co, b_temp, b_pres, b_co[-1] as last_co,
    cast(null as timestamp) as timestamp, cast(null as double) as predicted_aqi from past
  union all
  select station_id, k, {_push('b_aqi', 'y')}, {_push('b_pm', pm25_sql('y'))},
    {_push('b_co', 'greatest(0e0, coalesce(last_co, 0e0))')}, {_push('b_temp', 'temperature_2m')},
    {_push('b_pres', 'pressure_msl')}, last_co, time, y
  from (select r.b_aqi, r.b_pm, r.b_co, r.b_temp, r.b_pres, r.last_co, a.*, {predict_sql(WEIGHTS, _known)} as y
        from roll r join ahead a on a.station_id = r.station_id and a.k = r.k + 1) s)
"""

_last = f"""
hot as (select *, {Q.ONEHOT_SQL} from features),
scored as (select station_id, time, {predict_sql()} as cur from hot
  qualify row_number() over (partition by station_id order by time desc) = 1)
"""

ORACLES = {
    "join_weather_air": f"{with_(OBS)} select station_id, time, {rs(RAW)} from obs where hour(time) % 6 <> 1",
    "nearest_match": f"{with_(OBS, MATCHED)} select station_id, time, timestamp, {rs(('aqi', 'predicted_aqi', 'offset_seconds'))} from matched",
    "closest_row": f"""{with_(OBS)} select station_id, time, {r('aqi')} from obs where aqi is not null
        qualify row_number() over (partition by station_id order by abs(epoch_us(time) - epoch_us(timestamp '{AT}')), time) = 1""",
    "current_conditions": f"""{with_(OBS, Q.features_ctes())} select o.station_id, o.time, {', '.join(r('o.' + c, c) for c in RAW)}
        from obs o join features f on o.station_id = f.station_id and o.time = f.time""",
    "forecast_error": f"""{with_(OBS, ERRORS)} select station_id, time, timestamp, direction, category_match, verdict,
        {rs(('aqi', 'predicted_aqi', 'offset_seconds', 'error', 'abs_error', 'pct_error'))} from errors""",
    "evaluate_forecast": f"""{with_(OBS, ERRORS, '''m as (select station_id, sqrt(avg(error * error)) as rmse, avg(abs_error) as mae,
            1 - sum(error * error) / (var_pop(aqi) * count(*)) as r2, count(*) as matched,
            count(*) filter (where category_match) as category_hits, count(*) filter (where verdict = 'EXCELLENT') as excellent,
            count(*) filter (where verdict = 'GOOD') as good, count(*) filter (where verdict = 'FAIR') as fair,
            count(*) filter (where verdict = 'POOR') as poor
          from errors where aqi is not null and predicted_aqi is not null group by station_id)''')}
        select station_id, {rs(('rmse', 'mae', 'r2'))}, matched, category_hits, excellent, good, fair, poor from m""",
    "forecast_ar": f"""{with_(OBS, SPLIT_FORECAST, ROLLED).replace('with ', 'with recursive ', 1)}
        select station_id, timestamp, {r('predicted_aqi')}, {bands_sql('predicted_aqi', band_keys(1))} as aqi_category
        from roll where k > 0""",
    "current_aqi": f"""{with_(OBS, Q.features_ctes(), _last)} select o.station_id, o.time, {r('cur', 'aqi')},
        {', '.join(r('o.' + c, n) for n, c in G.CONDITIONS.items())},
        {bands_sql('cur', band_keys(1))} as category_key, {bands_sql('cur', band_keys(2))} as category,
        {bands_sql('cur', B.RANGES)} as aqi_range, {bands_sql('cur', band_keys(3))} as colour,
        {', '.join(f"{advice_sql('cur', B.HEALTH_ADVICE, i)} as {n}" for i, n in
            enumerate(('description', 'general_public', 'sensitive_groups', 'children_elderly')))}
        from scored s join obs o on o.station_id = s.station_id and o.time = s.time""",
    "alerts": f"""{with_(OBS, Q.features_ctes(), _last, PREDICTIONS,
        '''peaks as (select station_id, predicted_aqi, timestamp from pred
            qualify row_number() over (partition by station_id order by predicted_aqi desc, timestamp) = 1)''')}
        select s.station_id, {alert_sql('cur')} as alert_level, {r('cur', 'current_aqi')}, {r('predicted_aqi', 'peak_aqi_predicted')},
        timestamp as peak_time, {advice_sql('cur', B.HEALTH_ADVICE, 0)} as recommendation, {groups_sql('cur')} as affected_groups
        from scored s join peaks p on s.station_id = p.station_id""",
}
