"""Splits, training, scoring, ranking and the registry."""

from pyspark.sql import functions as F

from aerolith.catalog import feature_sql as Q
from aerolith.catalog.base import (
    ID,
    INTERCEPT,
    OBS,
    WEIGHTS,
    layout_of,
    observations,
    r,
    rounded,
    rs,
    with_,
)
from aerolith.catalog.tables import split_sql
from aerolith.functions.text import normalize_key
from aerolith.operators import features as X, models as M, registry as R, series as S, split as P, tree_shap as T
from aerolith.plans import chains
from aerolith.schema import KEYS, MODEL_FEATURES, TIME
from aerolith.session import shared_dir, written

LINEAR = M.LinearModel(WEIGHTS, INTERCEPT)

# Simple forecasts that stand for models where metrics are compared with SQL.
NAIVE = {
    "Last Hour": "l1",
    "Two Hours Ago": "l2",
    "Mean Of Two": "(l1 + l2) / 2e0",
    "Yesterday": "l24",
    "Damped Trend": "l1 + (l1 - l2) / 2e0",
    "Leaky Copy": "aqi",
}


def naive_scores(obs, layout):
    """One row per hour and naive model."""
    lagged = S.with_series(
        obs.select(*ID, "aqi"), {f"l{n}": lambda w, n=n: F.lag("aqi", n).over(w) for n in (1, 2, 24)}, 24, layout
    )
    models = F.array(
        *[F.struct(F.lit(n).alias("model"), F.expr(e.replace("e0", "D")).alias("predicted_aqi")) for n, e in NAIVE.items()]
    )
    return lagged.select(*ID, "aqi", F.inline(models))


def _metrics(spark, sf_dir):
    return M.metrics_table(P.time_split(naive_scores(observations(spark, sf_dir), layout_of(spark, sf_dir))))


def matrix(spark, sf_dir):
    """The split model matrix of all stations."""
    table = X.season_onehot(chains.features_full(observations(spark, sf_dir), layout=layout_of(spark, sf_dir)))
    return P.time_split(written(table.select(*ID, "aqi", *MODEL_FEATURES), shared_dir(spark, "matrix")))


# The forest and the elastic net have their full sizes. The boosters run fewer, longer steps here: a round takes about
# 0.3 s of scheduling whatever the rows are, so that 1000 and 800 of them take minutes.
QUICK = {
    "forest": {},
    "boost_shallow": {"maxIter": 12, "stepSize": 0.2},
    "boost_leafy": {"maxIter": 8, "stepSize": 0.2},
    "elastic_net": {},
}


def _trained(kind):
    """Train one model and report its metrics per split."""

    def run(spark, sf_dir):
        rows = matrix(spark, sf_dir)
        scored = M.scored(M.fit(rows, kind, **QUICK[kind]), rows).withColumn("model", F.lit(kind))
        return M.metrics_table(scored)

    return run


def _forest(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    return rows, M.train(rows, "forest", **QUICK["forest"])


def _importance(spark, sf_dir):
    return M.feature_importance(spark, _forest(spark, sf_dir)[1])


def _permutation(spark, sf_dir):
    rows, model = _forest(spark, sf_dir)
    return M.permutation_importance(rows.filter("split = 'val'"), model)


def _explained(spark, sf_dir):
    """Shapley values of the forest for the validation rows."""
    rows = matrix(spark, sf_dir)
    pipeline = M.fit(rows, "forest", **QUICK["forest"])
    held = rows.filter("split = 'val'")
    return pipeline, held, T.tree_shap(held, pipeline)


def _tree_shap_sums(spark, sf_dir):
    """Whether the values of each row add up to its prediction."""
    pipeline, held, explained = _explained(spark, sf_dir)
    total = F.aggregate(F.map_values("shap"), F.col("base_value"), lambda a, x: a + x)
    both = explained.select(*ID, total.alias("total")).join(pipeline.transform(held).select(*ID, "predicted_aqi"), list(ID))
    return both.select(*ID, (F.abs(F.col("total") - F.col("predicted_aqi")) < 1e-6).alias("adds_up"))


SCALED = ("temperature_2m", "pm2_5", "aqi")


def _scaled(spark, sf_dir):
    table = P.time_split(chains.features_full(observations(spark, sf_dir), layout=layout_of(spark, sf_dir)))
    return P.scale(table, SCALED, F.col("split") == "train").select(*ID, "split", *SCALED)


def _score_batch(spark, sf_dir):
    table = X.season_onehot(chains.features_full(observations(spark, sf_dir), layout=layout_of(spark, sf_dir)))
    return M.score(table, LINEAR).select(*ID, "aqi", "predicted_aqi")


RUN_START = "2023-12-31"


def _runs(spark, sf_dir):
    """Registry rows: every station and day trains every naive model once; versions count days."""
    scored = naive_scores(observations(spark, sf_dir), layout_of(spark, sf_dir)).filter("aqi is not null and predicted_aqi is not null")
    error = F.col("predicted_aqi") - F.col("aqi")
    per = scored.groupBy("model", *KEYS, F.to_date(TIME).alias("d")).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.max(TIME).alias("saved_at")
    )
    full = F.create_map(F.lit("rmse"), F.col("rmse"), F.lit("mae"), F.col("mae"))
    short = F.create_map(F.lit("mae"), F.col("mae"))
    shown = F.concat("model", F.lit(" "), F.col("station_id").cast("string"))
    return per.select(
        normalize_key(shown).alias("name"),
        shown.alias("display_name"),
        F.datediff("d", F.lit(RUN_START).cast("date")).alias("version"),
        F.lit(False).alias("best_model"),
        F.lit("models").alias("filesystem_path"),
        F.array(F.lit("aqi")).alias("feature_names"),
        F.when(F.col("model") == "Two Hours Ago", short).otherwise(full).alias("metrics"),
        F.lit("training").alias("registry_source"),
        "saved_at",
    )


def _upserted(spark, sf_dir):
    """Days from the 25th on are saved again an hour later, half a point worse."""
    old = _runs(spark, sf_dir)
    new = old.filter("version >= 25").withColumns(
        {
            "metrics": F.transform_values("metrics", lambda k, v: v + 0.5),
            "saved_at": F.col("saved_at") + F.expr("interval 1 hour"),
        }
    )
    return R.upsert(old, new)


def _merged(spark, sf_dir):
    """Metrics on file, with those of the registry on top."""
    on_file = F.create_map(F.lit("mae"), F.lit(0.0), F.lit("r2"), F.lit(0.5))
    rows = _runs(spark, sf_dir).withColumn("metrics", R.metrics_merge(on_file, F.col("metrics")))
    return R.metric_rows(rows)


QUERIES = {
    "time_split": lambda s, d: P.time_split(observations(s, d).select(*ID)),
    "scale_features": lambda s, d: rounded(_scaled(s, d)),
    "score_batch": lambda s, d: rounded(_score_batch(s, d)),
    "linear_shap": lambda s, d: rounded(
        M.linear_shap(X.season_onehot(chains.features_full(observations(s, d), layout=layout_of(s, d))), LINEAR)
    ),
    "model_metrics_table": lambda s, d: rounded(_metrics(s, d)),
    "select_best_model": lambda s, d: rounded(M.select_best(_metrics(s, d))),
    "train_rf": _trained("forest"),
    "train_gbt3": _trained("boost_shallow"),
    "train_gbt5": _trained("boost_leafy"),
    "train_elasticnet": _trained("elastic_net"),
    "feature_importance": _importance,
    "perm_importance": _permutation,
    "tree_shap": lambda s, d: T.mean_shap(_explained(s, d)[2]),
    "tree_shap_sums": _tree_shap_sums,
    "registry_upsert": lambda s, d: rounded(R.metric_rows(_upserted(s, d), "saved_at")),
    "registry_best": lambda s, d: R.best(_runs(s, d), "rmse").select("name", "display_name", "version", "saved_at"),
    "registry_latest": lambda s, d: rounded(R.metric_rows(R.latest(_runs(s, d)), "display_name")),
    "metrics_merge": lambda s, d: rounded(_merged(s, d)),
    "registry_purge": lambda s, d: R.purge(_runs(s, d), ["last_hour_0", "yesterday_1"]).select("name", "version"),
}


def predict_sql(weights=WEIGHTS, known=None):
    """The linear model as SQL; ``known`` maps features to expressions."""
    known = known or {}
    terms = " + ".join(f"{w!r}e0 * coalesce(cast({known.get(n, n)} as double), 0e0)" for n, w in weights.items())
    return f"greatest(0e0, least(500e0, {INTERCEPT!r}e0 + {terms}))"


NAIVE_SQL = f"""
lagged_aqi as (select station_id, time, aqi, {', '.join(f'lag(aqi, {n}) over ({Q.W}) as l{n}' for n in (1, 2, 24))} from obs),
naive as ({' union all '.join(f"select station_id, time, aqi, '{n}' as model, {e} as predicted_aqi from lagged_aqi" for n, e in NAIVE.items())})
"""

_nine = ", ".join(f"{s}_{m}" for s in ("train", "val", "test") for m in ("rmse", "mae", "r2"))
_METRICS_SQL = f"""
{split_sql('naive').strip()},
err as (select n.model, c.split, n.aqi, n.predicted_aqi - n.aqi as e from naive n join cuts c on n.time = c.time
  where n.aqi is not null and n.predicted_aqi is not null),
per as (select model, split, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae, 1 - sum(e * e) / (var_pop(aqi) * count(*)) as r2
  from err group by 1, 2),
wide as (select model, {', '.join(f"max({m}) filter (where split = '{s}') as {s}_{m}" for s in ('train', 'val', 'test') for m in ('rmse', 'mae', 'r2'))}
  from per group by model)
"""

RUNS = f"""
{NAIVE_SQL.strip()},
runs as (select replace(lower(model || ' ' || station_id), ' ', '_') as name, model || ' ' || station_id as display_name,
  cast(date_diff('day', date '{RUN_START}', cast(time as date)) as int) as version, max(time) as saved_at,
  case when model <> 'Two Hours Ago' then sqrt(avg((predicted_aqi - aqi) * (predicted_aqi - aqi))) end as rmse,
  avg(abs(predicted_aqi - aqi)) as mae
  from naive where aqi is not null and predicted_aqi is not null group by model, station_id, cast(time as date))
"""


def _metric_rows(source, *more):
    cols = "".join(f", {c}" for c in more)
    return f"""select name, version{cols}, 'mae' as metric, {r('mae', 'value')} from {source}
        union all select name, version{cols}, 'rmse', {r('rmse', 'value')} from {source} where rmse is not null"""


_shap_sum = ", ".join(f"avg(coalesce(cast({n} as double), 0e0)) as m_{n}" for n in WEIGHTS)
_shap_base = " + ".join(f"{w!r}e0 * m_{n}" for n, w in WEIGHTS.items())
_shap_rows = " union all ".join(
    f"select '{n}' as feature_name, avg(abs({w!r}e0 * (coalesce(cast({n} as double), 0e0) - m_{n}))) as importance_score from hot cross join means"
    for n, w in WEIGHTS.items()
)
_hot = f"hot as (select *, {Q.ONEHOT_SQL} from features)"

ORACLES = {
    "time_split": f"""{with_(OBS, split_sql())} select o.station_id, o.time, split
        from obs o join cuts c on o.time = c.time""",
    "scale_features": f"""{with_(OBS, Q.features_ctes(), split_sql('features'),
        'parted as (select f.*, split from features f join cuts c on f.time = c.time)',
        f'''fit as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in SCALED)} from parted where split = 'train')''')}
        select station_id, time, split, {', '.join(r(f'({c} - m_{c}) / case when s_{c} > 0 then s_{c} else 1 end', c) for c in SCALED)}
        from parted cross join fit""",
    "score_batch": f"""{with_(OBS, Q.features_ctes(), _hot)}
        select station_id, time, {r('aqi')}, {r(predict_sql(), 'predicted_aqi')} from hot""",
    # The values depend on the trained forest; SQL states the rows, and that the values of each add up.
    "tree_shap_sums": f"""{with_(OBS, Q.features_ctes(), split_sql('features'))}
        select f.station_id, f.time, true as adds_up from features f join cuts c on f.time = c.time where split = 'val'""",
    "linear_shap": f"""{with_(OBS, Q.features_ctes(), _hot, f'means as (select {_shap_sum} from hot)', f'shap as ({_shap_rows})')}
        select feature_name, {r('importance_score')}, {r(f'{INTERCEPT!r}e0 + {_shap_base}', 'base_value')}
        from shap cross join means""",
    "model_metrics_table": f"{with_(OBS, NAIVE_SQL, _METRICS_SQL)} select model, {rs(_nine.split(', '))} from wide",
    "select_best_model": f"""{with_(OBS, NAIVE_SQL, _METRICS_SQL,
        '''kept as (select *, row_number() over (order by val_rmse, val_mae, -val_r2, model) as rk from wide
            where abs(val_r2 - 1) > 1e-8 + 1e-5)''')}
        select model, {rs(_nine.split(', '))}, cast(rk as int) as rank, rk = 1 as best_model from kept""",
    "registry_upsert": f"""{with_(OBS, RUNS, '''saved as (select * exclude (rmse, mae, saved_at),
            case when version >= 25 then rmse + 0.5 else rmse end as rmse, case when version >= 25 then mae + 0.5 else mae end as mae,
            case when version >= 25 then saved_at + interval 1 hour else saved_at end as saved_at from runs)''')}
        {_metric_rows('saved', 'saved_at')}""",
    "registry_best": f"""{with_(OBS, RUNS)} select name, display_name, version, saved_at from runs
        qualify row_number() over (partition by name order by rmse asc nulls last, version desc) = 1""",
    "registry_latest": f"""{with_(OBS, RUNS, 'top as (select * from runs qualify row_number() over (partition by name order by version desc) = 1)')}
        {_metric_rows('top', 'display_name')}""",
    "metrics_merge": f"""{with_(OBS, RUNS)} {_metric_rows('runs')}
        union all select name, version, 'r2', 0.5e0 from runs""",
    "registry_purge": f"""{with_(OBS, RUNS)} select name, version from runs where name not in ('last_hour_0', 'yesterday_1')""",
}
