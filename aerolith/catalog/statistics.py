"""Exploratory statistics and their SQL."""

from pyspark.sql import functions as F

from aerolith.catalog import feature_sql as Q
from aerolith.catalog.base import (
    ID,
    OBS,
    PREDICTIONS,
    layout_of,
    observations,
    predictions,
    r,
    rounded,
    with_,
)
from aerolith.operators import features as X, series as S, stats as A
from aerolith.plans import chains
from aerolith.schema import MODEL_FEATURES, RAW

AS_OF = "2024-01-20 07:30:00"
SUMMARY_DAYS = 7


def _on_obs(make):
    return lambda spark, sf_dir: rounded(make(observations(spark, sf_dir)))


def _on_series(make):
    return lambda spark, sf_dir: rounded(make(observations(spark, sf_dir), layout_of(spark, sf_dir)))


def _on_predictions(make):
    return lambda spark, sf_dir: rounded(make(predictions(observations(spark, sf_dir))))


def naive_predictions(obs, layout):
    """The last hour's value as the forecast of the next."""
    return S.with_series(obs, {"predicted_aqi": lambda w: F.lag("aqi", 1).over(w)}, 1, layout)


def scores(spark, sf_dir):
    """Correlation scores of all model features, per station."""
    table = X.season_onehot(chains.features_full(observations(spark, sf_dir), layout=layout_of(spark, sf_dir)))
    return A.feature_scores(table, MODEL_FEATURES)


QUERIES = {
    "daily_avg_aqi": _on_obs(A.daily_avg),
    "historical_summary": _on_obs(
        lambda o: A.historical_summary(o, F.expr(f"timestamp_ntz '{AS_OF}'"), SUMMARY_DAYS)
    ),
    "avg_by_hour": _on_obs(lambda o: A.seasonal_avg(o, "hour")),
    "avg_by_weekday": _on_obs(lambda o: A.seasonal_avg(o, "day_of_week")),
    "avg_by_month": _on_obs(lambda o: A.seasonal_avg(o, "month")),
    "describe": _on_obs(lambda o: A.describe(o, RAW)),
    "target_stats": _on_obs(A.target_stats),
    "corr_matrix": _on_obs(lambda o: A.corr_matrix(o, RAW)),
    "histogram50": _on_obs(A.histogram),
    "category_counts": _on_obs(A.category_counts),
    "outliers_iqr": _on_obs(lambda o: A.outliers_iqr(o).select(*ID, "aqi")),
    "outliers_zscore": _on_obs(lambda o: A.outliers_zscore(o, "pm10").select(*ID, "pm10")),
    "outlier_report": _on_obs(A.outlier_report),
    "lag_crosscorr": _on_series(lambda o, l: A.lag_crosscorr(o, layout=l)),
    "lag_mutual_info": _on_series(lambda o, l: A.lag_mutual_info(o, layout=l)),
    "forecast_daily": _on_predictions(A.forecast_daily),
    "forecast_kpis": _on_predictions(A.forecast_kpis),
    "regression_metrics": _on_series(
        lambda o, l: A.regression_metrics(naive_predictions(o, l), by=["station_id"])
    ),
    "feature_scores": lambda s, d: rounded(scores(s, d)),
    "top_features": lambda s, d: rounded(A.top_features(rounded(scores(s, d)).drop("station_id"))),
}

_label = """case when {0} is null then null when {0} <= 50 then 'Good' when {0} <= 100 then 'Moderate'
    when {0} <= 150 then 'Unhealthy for Sensitive Groups' when {0} <= 200 then 'Unhealthy'
    when {0} <= 300 then 'Very Unhealthy' else 'Hazardous' end"""


def label_sql(c):
    return _label.format(c)


def _describe(c):
    q = lambda p, n: r(f"quantile_cont({c}, {p})", n)
    return f"""select '{c}' as column_name, count({c}) as n, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')},
        {r(f'min({c})', 'min')}, {q(0.25, 'q25')}, {q(0.5, 'q50')}, {q(0.75, 'q75')}, {r(f'max({c})', 'max')} from obs"""


def corr_sql(a, b):
    """Pearson correlation written out, NULL where a side does not vary."""
    both = f"filter (where {a} is not null and {b} is not null)"
    return f"""case when stddev_pop({a}) {both} > 0 and stddev_pop({b}) {both} > 0
        then corr({a}, {b}) {both} end"""


def _xcorr():
    lags = ", ".join(
        f"lag({f}, {n}) over ({Q.W}) as {f}_{n}" for f in A.LAG_CANDIDATES for n in A.CORRELATION_LAGS
    )
    cells = "\nunion all ".join(
        f"select station_id, '{f}' as feature, {n} as lag, {r(corr_sql(f'{f}_{n}', 'aqi'), 'corr')} from shifted group by station_id"
        for f in A.LAG_CANDIDATES
        for n in A.CORRELATION_LAGS
    )
    return f"{with_(OBS, f'shifted as (select station_id, time, aqi, {lags} from obs)')} {cells}"


def _mutual_info(bins=16):
    cols = [*A.LAG_CANDIDATES, "aqi"]
    edges = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in cols)
    place = lambda c: f"cast(least(floor({bins}e0 * ({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0)), {bins - 1}) as int)"
    binned = ", ".join(f"case when {c} is not null then coalesce({place(c)}, 0) end as {c}" for c in cols)
    lags = ", ".join(
        f"lag({f}, {n}) over ({Q.W}) as {f}_{n}" for f in A.LAG_CANDIDATES for n in A.INFORMATION_LAGS
    )
    pairs = " union all ".join(
        f"select '{f}' as feature, {n} as lag, {f}_{n} as x, aqi as y from shifted where {f}_{n} is not null and aqi is not null"
        for f in A.LAG_CANDIDATES
        for n in A.INFORMATION_LAGS
    )
    return f"""{with_(
        OBS,
        f'edges as (select {edges} from obs)',
        f'binned as (select station_id, time, {binned} from obs cross join edges)',
        f'shifted as (select station_id, time, aqi, {lags} from binned)',
        f'pairs as ({pairs})',
        'joint as (select feature, lag, x, y, count(*) as n from pairs group by all)',
        '''parts as (select feature, lag, n, sum(n) over (partition by feature, lag, x) as nx,
             sum(n) over (partition by feature, lag, y) as ny, sum(n) over (partition by feature, lag) as total from joint)''')}
        select feature, lag, {r('sum(n / cast(total as double) * ln(n * cast(total as double) / (cast(nx as double) * ny)))', 'mutual_info')}
        from parts group by feature, lag"""


SCORES = f"""{Q.features_ctes()},
hot as (select *, {Q.ONEHOT_SQL} from features),
scores as ({' union all '.join(
    f"select station_id, '{f}' as feature_name, coalesce(abs({corr_sql(f, 'aqi')}), 0e0) as importance_score from hot group by station_id"
    for f in MODEL_FEATURES)})
"""

ORACLES = {
    "daily_avg_aqi": f"""{with_(OBS)} select station_id, cast(time as date) as date, {r('avg(aqi)', 'avg_aqi')}
        from obs group by 1, 2""",
    "historical_summary": f"""{with_(OBS)} select station_id, {r('avg(aqi)', 'avg_aqi')}, {r('max(aqi)', 'max_aqi')},
        {r('min(aqi)', 'min_aqi')}, count(*) as row_count, {r('max(aqi) - min(aqi)', 'aqi_range')}
        from obs where time >= timestamp '2024-01-12 00:00:00' and time < timestamp '2024-01-20 00:00:00'
        group by station_id""",
    "avg_by_hour": f"{with_(OBS)} select cast(hour(time) as int) as hour, {r('avg(aqi)', 'avg_aqi')} from obs group by 1",
    "avg_by_weekday": f"{with_(OBS)} select cast(isodow(time) - 1 as int) as day_of_week, {r('avg(aqi)', 'avg_aqi')} from obs group by 1",
    "avg_by_month": f"{with_(OBS)} select cast(month(time) as int) as month, {r('avg(aqi)', 'avg_aqi')} from obs group by 1",
    "describe": f"{with_(OBS)} {' union all '.join(_describe(c) for c in RAW)}",
    "target_stats": f"""{with_(OBS)} select {r('avg(aqi)', 'mean')}, {r('quantile_cont(aqi, 0.5)', 'median')},
        {r('stddev_samp(aqi)', 'std')} from obs""",
    "corr_matrix": f"""{with_(OBS)} {' union all '.join(
        f"select '{a}' as feature, '{b}' as other, {r(corr_sql(a, b), 'corr')} from obs" for a in RAW for b in RAW)}""",
    "histogram50": f"""{with_(OBS, 'e as (select min(aqi) as lo, max(aqi) as hi from obs)',
        '''b as (select least(cast(floor(50e0 * (aqi - lo) / (hi - lo)) as int), 49) as bin, count(*) as n
             from obs cross join e where aqi is not null group by 1)''',
        's as (select cast(unnest(range(50)) as int) as bin)')}
        select s.bin, {r('lo + s.bin * ((hi - lo) / 50e0)', 'bin_start')}, {r('lo + (s.bin + 1) * ((hi - lo) / 50e0)', 'bin_end')},
        coalesce(n, 0) as n from s cross join e left join b on s.bin = b.bin""",
    "category_counts": f"""{with_(OBS, f'c as (select {label_sql("aqi")} as category, count(*) as n from obs where aqi is not null group by 1)')}
        select category, n, {r('n * 100e0 / (select sum(n) from c)', 'share_pct')} from c""",
    "outliers_iqr": f"""{with_(OBS, 'q as (select quantile_cont(aqi, 0.25) as q1, quantile_cont(aqi, 0.75) as q3 from obs)')}
        select station_id, time, {r('aqi', 'aqi')} from obs cross join q
        where aqi < q1 - 1.5 * (q3 - q1) or aqi > q3 + 1.5 * (q3 - q1)""",
    "outliers_zscore": f"""{with_(OBS, 's as (select avg(pm10) as m, stddev_pop(pm10) as sd from obs)')}
        select station_id, time, {r('pm10', 'pm10')} from obs cross join s where abs(pm10 - m) / sd > 3""",
    "outlier_report": f"""{with_(OBS, 'q as (select quantile_cont(aqi, 0.25) as q1, quantile_cont(aqi, 0.75) as q3, avg(aqi) as m, stddev_pop(aqi) as sd from obs)',
        '''c as (select count(*) filter (where aqi < q1 - 1.5 * (q3 - q1) or aqi > q3 + 1.5 * (q3 - q1)) as iqr_outliers,
            count(*) filter (where abs(aqi - m) / sd > 3) as zscore_outliers, count(*) as row_count from obs cross join q)''')}
        select *, {r('iqr_outliers * 100e0 / row_count', 'iqr_pct')}, {r('zscore_outliers * 100e0 / row_count', 'zscore_pct')} from c""",
    "lag_crosscorr": _xcorr(),
    "lag_mutual_info": _mutual_info(),
    "forecast_daily": f"""{with_(OBS, PREDICTIONS)} select station_id, cast(timestamp as date) as date,
        {r('min(predicted_aqi)', 'min_aqi')}, {r('max(predicted_aqi)', 'max_aqi')}, {r('avg(predicted_aqi)', 'avg_aqi')},
        count(*) as hours from pred group by 1, 2""",
    "forecast_kpis": f"""{with_(OBS, PREDICTIONS,
        '''ranked as (select *, row_number() over (partition by station_id order by predicted_aqi desc, timestamp) as hi,
            row_number() over (partition by station_id order by predicted_aqi, timestamp) as lo from pred)''',
        '''k as (select station_id, max(predicted_aqi) filter (where hi = 1) as peak_aqi, max(timestamp) filter (where hi = 1) as peak_time,
            max(predicted_aqi) filter (where lo = 1) as low_aqi, max(timestamp) filter (where lo = 1) as low_time,
            avg(predicted_aqi) as avg_aqi, count(*) as forecast_hours from ranked group by station_id)''')}
        select station_id, {r('peak_aqi')}, peak_time, {label_sql('peak_aqi')} as peak_category, {r('low_aqi')}, low_time,
        {label_sql('low_aqi')} as low_category, {r('avg_aqi')}, {label_sql('avg_aqi')} as avg_category, forecast_hours from k""",
    "regression_metrics": f"""{with_(OBS, f'scored as (select station_id, aqi, lag(aqi) over ({Q.W}) as p from obs)',
        '''m as (select station_id, avg((p - aqi) * (p - aqi)) as mse, avg(abs(p - aqi)) as mae, sum((p - aqi) * (p - aqi)) as sse,
            var_pop(aqi) * count(*) as sst from scored where aqi is not null and p is not null group by station_id)''')}
        select station_id, {r('sqrt(mse)', 'rmse')}, {r('mae')}, {r('1 - sse / sst', 'r2')} from m""",
    "feature_scores": f"{with_(OBS, SCORES)} select station_id, feature_name, {r('importance_score')} from scores",
    "top_features": f"""{with_(OBS, SCORES, f"tidy as (select feature_name, {r('importance_score')} from scores)")}
        select feature_name, {r('importance_score')} from tidy order by importance_score desc, feature_name limit 20""",
}
