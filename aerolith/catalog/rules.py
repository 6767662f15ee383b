"""Scalar rules: bands, advice, labels, text and time."""

from pyspark.sql import functions as F

from aerolith.catalog.base import (
    ID,
    OBS,
    PREDICTIONS,
    observations,
    predictions,
    r,
    rounded,
    with_,
)
from aerolith.catalog.statistics import SCORES, label_sql, scores
from aerolith.functions import bands as B, calendar as C, text as X
from aerolith.operators import lookup, stats as A
from aerolith.schema import KEYS
from aerolith.sources.event_feed import table

ZONE = "Asia/Tashkent"


def _aqi(make):
    """Rules of the observed target; ``make`` gives the columns to show for a value."""

    def run(spark, sf_dir):
        shown = [c.alias(n) for n, c in make(F.col("aqi")).items()]
        return rounded(observations(spark, sf_dir).select(*ID, "aqi", *shown))

    return run


def _ranked_labels(spark, sf_dir):
    """Per station the labels of its features, best first, from rounded scores.

    A station has as many entries as the model has features.
    """
    item = F.struct((-F.col("importance_score")).alias("s"), F.col("feature_name").alias("f"))
    ranked = rounded(scores(spark, sf_dir)).groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    return ranked.select(*KEYS, F.transform("ranked", lambda x: X.feature_label(x["f"])).alias("labels"))


def _map_topk(spark, sf_dir):
    pair = F.struct("feature_name", "importance_score")
    maps = rounded(scores(spark, sf_dir)).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(pair)).alias("m"))
    return maps.select(*KEYS, F.posexplode(A.top_of_map(F.col("m"), 3)).alias("rank", "feature_name"))


def _metric_pick(spark, sf_dir):
    """Stations report their mean under different names."""
    kind = F.col("station_id") % 3
    name = F.when(kind == 0, "val_rmse").when(kind == 1, "rmse").otherwise("score")
    per = observations(spark, sf_dir).groupBy(*KEYS).agg(F.avg("aqi").alias("v"))
    metrics = F.create_map(name, F.col("v"))
    return per.select(*KEYS, X.metric_pick(metrics, ("test_rmse", "val_rmse", "rmse")).alias("picked"))


def _forecast_table(spark, sf_dir):
    pred = predictions(observations(spark, sf_dir))
    whole = F.format_string("%.0f", F.bround("predicted_aqi"))
    return pred.select(
        *KEYS,
        "timestamp",
        F.date_format("timestamp", "EEE MM/dd hh:mm a").alias("time_text"),
        whole.alias("aqi_text"),
        B.aqi_label(F.col("predicted_aqi")).alias("category"),
    )


def _rain(spark, sf_dir):
    o = observations(spark, sf_dir)
    return rounded(
        o.select(
            *ID,
            F.when(F.col("precipitation") > 0.1, "Yes").when(F.col("precipitation").isNotNull(), "No").alias("rain"),
            F.when(
                F.col("relative_humidity_2m").isNotNull(), F.format_string("%.0f%%", "relative_humidity_2m")
            ).alias("humidity_text"),
        )
    )


def _hours(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", C.hour_floor(ts).alias("hour_floor"), C.hour_ceil(ts).alias("hour_ceil")
    )


def _zones(spark, sf_dir):
    o = observations(spark, sf_dir).select(*ID)
    return o.select(*ID, C.to_local(F.col("time"), ZONE).alias("local_time"), C.to_utc(F.col("time"), ZONE).alias("utc_time"))


def _json_props(spark, sf_dir):
    parsed = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        F.to_json(F.struct("event_id", parsed["k"].alias("k"), "event_type")).alias("payload"),
    )


QUERIES = {
    "aqi_category": _aqi(
        lambda v: {
            "category_key": B.aqi_category(v),
            "category": B.aqi_label(v),
            "colour": B.aqi_colour(v),
            "slug": B.aqi_slug(v),
        }
    ),
    "alert_level": _aqi(lambda v: {"alert_level": B.alert_level(v)}),
    "affected_groups": _aqi(lambda v: {"affected_groups": F.array_join(B.affected_groups(v), ",")}),
    "activity_advice": _aqi(lambda v: B.activity_advice(v)),
    "aqi_to_pm25": _aqi(lambda v: {"pm25": B.aqi_to_pm25(v * 3 - 50)}),
    "ui_advice": lambda s, d: rounded(
        lookup.ui_advice(observations(s, d).select(*ID, "aqi")).select(
            *ID, "aqi", "general", "sensitive", "activity", "precautions"
        )
    ),
    "category_lookup": lambda s, d: rounded(
        lookup.category_lookup(observations(s, d).select(*ID, "aqi"))
    ),
    "health_advice": lambda s, d: rounded(lookup.health_advice(observations(s, d).select(*ID, "aqi"))),
    "tz_convert": _zones,
    "hour_floor_ceil": _hours,
    "feature_labels": lambda s, d: rounded(
        scores(s, d).withColumn("label", X.feature_label(F.col("feature_name")))
    ),
    "driver_summary": lambda s, d: _ranked_labels(s, d).select(
        *KEYS, X.driver_summary(F.col("labels")).alias("summary")
    ),
    "map_topk": _map_topk,
    "metric_pick": _metric_pick,
    "normalize_key": lambda s, d: table(s, d, "part").select(
        "p_partkey", X.normalize_key(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("key")
    ),
    "forecast_table": _forecast_table,
    "current_display": _rain,
    "json_props": _json_props,
}


def bands_sql(column, values):
    text = lambda v: "'" + v.replace("'", "''") + "'"
    whens = " ".join(f"when {column} <= {b[0]} then {text(v)}" for b, v in list(zip(B.BANDS, values))[:-1])
    return f"case when {column} is null then null {whens} else {text(values[-1])} end"


def band_keys(i):
    return [b[i] for b in B.BANDS]


def alert_sql(column):
    whens = " ".join(f"when {column} >= {low} then '{name}'" for low, name in B.ALERTS)
    return f"case when {column} is null then null {whens} else 'Good' end"


def groups_sql(column):
    parts = ", ".join(f"case when {column} >= {low} then '{name}' end" for low, name in B.GROUPS)
    return f"case when {column} is not null then concat_ws(',', {parts}) end"


def _activity(i):
    whens = " ".join(f"when aqi > {above} then '{texts[i]}'" for above, *texts in B.ACTIVITY)
    return f"case when aqi is null then null {whens} else '{B.ACTIVITY_ELSE[i]}' end"


def pm25_sql(column):
    a = f"greatest(0e0, least(500e0, {column}))"
    whens = " ".join(
        f"when {a} <= {hi} then {lo_pm}e0 + ({a} - {lo}e0) * {hi_pm - lo_pm!r} / {hi - lo}e0"
        for lo, hi, lo_pm, hi_pm in B.PM25_BREAKPOINTS
    )
    return f"case when {column} is null then null {whens} end"


def advice_sql(column, table_, i):
    return bands_sql(column, [table_[k][i] for k in band_keys(1)])


_aqi_sql = f"{with_(OBS)} select station_id, time, {r('aqi')}"


def _title_sql(x):
    """Words start after a space or a digit."""
    marked = f"regexp_replace(replace({x}, '_', ' '), '([^A-Za-z ])([A-Za-z])', '\\1~ \\2', 'g')"
    words = f"list_transform(string_split({marked}, ' '), lambda w: upper(w[1]) || lower(w[2:]))"
    return f"replace(array_to_string({words}, ' '), '~ ', '')"


def _feature_label_sql(n):
    base = f"string_split(lower({n}), '_lag_')[1]"
    lag = f"string_split(lower({n}), '_lag_')[2]"
    labels = " ".join(f"when {base} = '{k}' then '{v}'" for k, v in X.LAG_LABELS.items())
    fragments = " ".join(f"when contains(lower({n}), '{k}') then '{v}'" for k, v in X.FRAGMENT_LABELS)
    return f"""case when contains(lower({n}), '_lag_') then (case {labels} else {_title_sql(base)} end) || ' (Lag ' ||
        (case when regexp_full_match({lag}, '[0-9]+') then {lag} || 'h' else {lag} end) || ')'
        {fragments} else {_title_sql(n)} end"""


_tidy_scores = f"tidy as (select station_id, feature_name, {r('importance_score')} from scores)"
_labels = f"""{_tidy_scores},
labelled as (select station_id, {_feature_label_sql('feature_name')} as label,
  row_number() over (partition by station_id order by importance_score desc, feature_name) as rk from tidy),
tops as (select station_id, list(label order by rk) filter (where rk <= 3) as top from labelled group by station_id)"""


def _naming(words):
    cond = " or ".join(f"contains(l, '{w}')" for w in words)
    return f"array_to_string(list_filter(top, lambda l: {cond})[1:2], ', ')"


ORACLES = {
    "aqi_category": f"""{_aqi_sql}, {bands_sql('aqi', band_keys(1))} as category_key, {bands_sql('aqi', band_keys(2))} as category,
        {bands_sql('aqi', B.HEX_COLOURS)} as colour, {bands_sql('aqi', B.SLUGS)} as slug from obs""",
    "alert_level": f"{_aqi_sql}, {alert_sql('aqi')} as alert_level from obs",
    "affected_groups": f"{_aqi_sql}, {groups_sql('aqi')} as affected_groups from obs",
    "activity_advice": f"{_aqi_sql}, {_activity(0)} as outdoor, {_activity(1)} as indoor from obs",
    "aqi_to_pm25": f"{_aqi_sql}, {r(pm25_sql('(aqi * 3 - 50)'), 'pm25')} from obs",
    "ui_advice": f"""{_aqi_sql}, {', '.join(f'{advice_sql('aqi', B.UI_ADVICE, i)} as {n}' for i, n in
        enumerate(('general', 'sensitive', 'activity', 'precautions')))} from obs""",
    "category_lookup": f"""{_aqi_sql}, {bands_sql('aqi', band_keys(1))} as category_key, {bands_sql('aqi', band_keys(2))} as category,
        {bands_sql('aqi', B.RANGES)} as aqi_range, {bands_sql('aqi', band_keys(3))} as colour from obs""",
    "health_advice": f"""{_aqi_sql}, {bands_sql('aqi', band_keys(1))} as category_key, {bands_sql('aqi', band_keys(2))} as category,
        {bands_sql('aqi', B.RANGES)} as aqi_range, {bands_sql('aqi', band_keys(3))} as colour,
        {', '.join(f'{advice_sql('aqi', B.HEALTH_ADVICE, i)} as {n}' for i, n in
        enumerate(('description', 'general_public', 'sensitive_groups', 'children_elderly')))} from obs""",
    "tz_convert": f"""{with_(OBS)} select station_id, time, time + interval 5 hour as local_time,
        time - interval 5 hour as utc_time from obs""",
    "hour_floor_ceil": """select event_id, date_trunc('hour', ts) as hour_floor,
        case when date_trunc('hour', ts) = ts then ts else date_trunc('hour', ts) + interval 1 hour end as hour_ceil
        from events""",
    "feature_labels": f"""{with_(OBS, SCORES)} select station_id, feature_name, {r('importance_score')},
        {_feature_label_sql('feature_name')} as label from scores""",
    "driver_summary": f"""{with_(OBS, SCORES, _labels, f'''named as (select station_id, top,
            {_naming(X.POLLUTANT_WORDS)} as p, {_naming(X.WEATHER_WORDS)} as w from tops)''')}
        select station_id, case when p <> '' and w <> '' then
            'Today''s AQI is primarily driven by ' || p || ' with ' || w || ' playing a secondary role.'
          when p <> '' or w <> '' then 'Today''s AQI is primarily influenced by ' || p || w || '.'
          else 'The top factors affecting AQI are ' || array_to_string(top[1:2], ', ') || '.' end as summary from named""",
    "map_topk": f"""{with_(OBS, SCORES, _tidy_scores)} select station_id,
        cast(row_number() over (partition by station_id order by importance_score desc, feature_name) - 1 as int) as rank,
        feature_name from tidy
        qualify row_number() over (partition by station_id order by importance_score desc, feature_name) <= 3""",
    "metric_pick": f"""{with_(OBS)} select station_id,
        case when station_id % 3 = 2 then '' else printf('%.3f', avg(aqi)) end as picked from obs group by station_id""",
    "normalize_key": "select p_partkey, replace(lower(trim(' ' || p_type || ' ')), ' ', '_') as key from part",
    "forecast_table": f"""{with_(OBS, PREDICTIONS)} select station_id, timestamp,
        strftime(timestamp, '%a %m/%d %I:%M %p') as time_text, printf('%.0f', round_even(predicted_aqi, 0)) as aqi_text,
        {label_sql('predicted_aqi')} as category from pred""",
    "current_display": f"""{with_(OBS)} select station_id, time,
        case when precipitation > 0.1 then 'Yes' when precipitation is not null then 'No' end as rain,
        case when relative_humidity_2m is not null then printf('%.0f%%', relative_humidity_2m) end as humidity_text
        from obs""",
    "json_props": """select event_id, k,
        '{"event_id":' || event_id || ',"k":' || k || ',"event_type":"' || event_type || '"}' as payload
        from (select *, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int) as k from events)""",
}
