"""Training, scoring, ranking and explaining regression models."""

from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aerolith.functions.bands import clip
from aerolith.operators.forest import RandomForestModel, fit_forest
from aerolith.operators.pipelines import Clamp, FeatureVector
from aerolith.operators.split import TRAIN, VALIDATION, fit_scaler
from aerolith.operators.stats import metric_columns, regression_metrics
from aerolith.schema import KEYS, MODEL_FEATURES, TARGET, TIME

MAX_PREDICTION = 500.0

# Hyperparameters of the model family.
FOREST = dict(
    numTrees=600, maxDepth=12, minInstancesPerNode=20, featureSubsetStrategy="sqrt", subsamplingRate=1.0, seed=42
)
SHALLOW_BOOST = dict(
    maxIter=1000, stepSize=0.02, maxDepth=3, minInstancesPerNode=20, subsamplingRate=0.6,
    featureSubsetStrategy="0.6", seed=42,
)
LEAFY_BOOST = dict(
    maxIter=800, stepSize=0.02, maxDepth=5, minInstancesPerNode=60, subsamplingRate=0.6,
    featureSubsetStrategy="0.6", seed=42,
)
ELASTIC_NET = dict(regParam=0.1, elasticNetParam=0.5, maxIter=5000, standardization=False)
# One pass over the data: the penalty is then solved on the small normal matrix.
ELASTIC_NET_SOLVER = "normal"


@dataclass(frozen=True)
class LinearModel:
    """Weights by feature name; features without a weight count 0."""

    weights: dict = field(default_factory=dict)
    intercept: float = 0.0

    def predict(self, value) -> Column:
        """``value`` gives the column of a feature; NULL counts as 0."""
        out = F.lit(float(self.intercept))
        for name, w in self.weights.items():
            out = out + F.lit(float(w)) * F.coalesce(value(name).cast("double"), F.lit(0.0))
        return clip(out, 0.0, MAX_PREDICTION)


def score(df: DataFrame, model: LinearModel, name: str = "predicted_aqi") -> DataFrame:
    """Predictions of a linear model, missing columns counting as 0."""
    value = lambda c: F.col(c) if c in df.columns else F.lit(0.0)
    return df.withColumn(name, model.predict(value))


def assemble(df: DataFrame, features=MODEL_FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def feature_vector(df: DataFrame, kind: str, features=MODEL_FEATURES) -> FeatureVector:
    """How rows of a split table become a model's features; elastic net standardises by the training rows."""
    if kind != "elastic_net":
        return FeatureVector(names=list(features))
    scaler = fit_scaler(df.filter(F.col("split") == TRAIN), features)
    spread = [scaler.deviations[n] or 1.0 for n in features]
    return FeatureVector(names=list(features), means=[scaler.means[n] or 0.0 for n in features], deviations=spread)


def fit(df: DataFrame, kind: str, features=MODEL_FEATURES, label: str = TARGET, **overrides) -> PipelineModel:
    """Fit one model on the training rows of a split table: from feature rows to clamped ``predicted_aqi``.

    ``kind`` is forest, boost_shallow, boost_leafy or elastic_net.  The leafy booster stops early on the validation
    rows.
    """
    vector = feature_vector(df, kind, features)
    model = _estimated(vector.transform(df), kind, label, overrides)
    return PipelineModel([vector, model, Clamp(inputCol="predicted_aqi", low=0.0, high=MAX_PREDICTION)])


def train(df: DataFrame, kind: str, features=MODEL_FEATURES, label: str = TARGET, **overrides) -> Model:
    """The model of ``fit`` alone, without the stages around it."""
    return model_of(fit(df, kind, features, label, **overrides))


def model_of(pipeline: PipelineModel) -> Model:
    return pipeline.stages[1]


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows, dealt to as many tasks as run at once and in one order within each.

    A small table is read by one task, which would do all the work of each row alone; the order makes every run draw the
    same rows.
    """
    spark, order = rows.sparkSession, [c for c in (*KEYS, TIME) if c in rows.columns]
    parts = rows.repartition(spark.sparkContext.defaultParallelism, *order)
    return parts.sortWithinPartitions(*order) if order else parts


def scored(pipeline: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with predictions, made by all tasks."""
    return pipeline.transform(dealt(rows))


def _estimated(rows: DataFrame, kind: str, label: str, overrides: dict) -> Model:
    common = dict(featuresCol="features", labelCol=label, predictionCol="predicted_aqi")
    fit_on = rows.filter(F.col("split") == TRAIN)
    if kind == "elastic_net":
        params = {**ELASTIC_NET, **overrides}
        spread = fit_on.agg(F.stddev_pop(label)).first()[0] or 1.0
        params |= penalties(params["regParam"], params["elasticNetParam"], spread)
        return LinearRegression(solver=ELASTIC_NET_SOLVER, **common, **params).fit(fit_on)
    if kind == "forest":
        return RandomForestModel(fit_forest(dealt(fit_on), "features", label, **{**FOREST, **overrides}), **common)
    if kind == "boost_shallow":
        return GBTRegressor(**common, **{**SHALLOW_BOOST, **overrides}).fit(fit_on)
    if kind == "boost_leafy":
        held = rows.filter(F.col("split").isin(TRAIN, VALIDATION)).withColumn(
            "held_out", F.col("split") == VALIDATION
        )
        params = {**common, **LEAFY_BOOST, "validationIndicatorCol": "held_out", **overrides}
        return GBTRegressor(**params).fit(held)
    raise ValueError(f"unknown model kind {kind}")


def penalties(alpha: float, l1_ratio: float, spread: float) -> dict:
    """Parameters under which the solver's L1 and L2 penalties are ``alpha`` times the ratio and times the rest.

    The solver standardises the label, which divides the L2 penalty by its
    deviation ``spread`` and leaves the L1 penalty.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * spread
    return {"regParam": l1 + l2, "elasticNetParam": l1 / (l1 + l2) if l1 + l2 else 0.0}


def linear_of(pipeline: PipelineModel) -> LinearModel | None:
    """A fitted or loaded linear pipeline as weights of the raw features, to score and roll out as one expression;
    None for other models."""
    vector, model = pipeline.stages[:2]
    if not hasattr(model, "coefficients"):
        return None
    names = vector.getOrDefault(vector.names)
    means = vector.getOrDefault(vector.means) or [0.0] * len(names)
    spreads = vector.getOrDefault(vector.deviations) or [1.0] * len(names)
    weights, intercept = {}, float(model.intercept)
    for name, w, mean, spread in zip(names, model.coefficients.toArray().tolist(), means, spreads):
        weights[name] = w / spread
        intercept -= w * mean / spread
    return LinearModel(weights, intercept)


def metrics_table(scored: DataFrame, by=("model",), actual: str = TARGET) -> DataFrame:
    """Nine metrics per model: train, val and test by rmse, mae and r2."""
    cols = [v.alias(n) for n, v in metric_columns(actual, "predicted_aqi").items()]
    return scored.groupBy(*by).pivot("split", ["train", "val", "test"]).agg(*cols)


def select_best(metrics: DataFrame, prefix: str = "val_", by=()) -> DataFrame:
    """Models in order of RMSE, MAE, -R² and name, without those of R² close to 1.

    If all are that close, all stay.  Adds ``rank`` and ``best_model``.
    """
    m = lambda n: F.col(f"{prefix}{n}")
    leaky = F.abs(m("r2") - 1.0) <= 1e-8 + 1e-5
    group = Window.partitionBy(*by)  # one row per model
    kept = metrics.withColumn("_leaky", leaky).withColumn("_any", F.min("_leaky").over(group))
    kept = kept.filter(~F.col("_leaky") | F.col("_any")).drop("_leaky", "_any")
    order = Window.partitionBy(*by).orderBy(m("rmse"), m("mae"), -m("r2"), "model")
    return kept.withColumn("rank", F.row_number().over(order)).withColumn("best_model", F.col("rank") == 1)


def feature_importance(spark: SparkSession, model: Model, features=MODEL_FEATURES) -> DataFrame:
    """Tree importances, else absolute coefficients, highest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray())
    rows = [(n, float(v)) for n, v in zip(features, values)]
    table = spark.createDataFrame(rows, "feature_name string, importance_score double")
    return table.orderBy(F.desc("importance_score"), "feature_name")


def linear_shap(df: DataFrame, model: LinearModel) -> DataFrame:
    """Mean absolute SHAP value of each feature of a linear model, and the base value.

    For a linear model the SHAP value is weight x (value - mean), exactly.
    """
    names = [n for n in model.weights if n in df.columns]
    value = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    means = df.agg(*[F.avg(value(n)).alias(n) for n in names]).first()
    base = model.intercept + sum(model.weights[n] * (means[n] or 0.0) for n in names)
    shap = lambda n: F.lit(float(model.weights[n])) * (value(n) - F.lit(means[n]))
    row = df.agg(*[F.avg(F.abs(shap(n))).alias(n) for n in names])
    cells = [F.struct(F.lit(n).alias("feature_name"), F.col(n).alias("importance_score")) for n in names]
    return row.select(F.inline(F.array(*cells))).withColumn("base_value", F.lit(base))


def permutation_importance(
    df: DataFrame, model: Model, features=MODEL_FEATURES, actual: str = TARGET
) -> DataFrame:
    """Rise of the RMSE when one feature is exchanged between rows.

    Rows of a station and month are put in hash order; each takes the feature
    value of the row before it, the first one that of the last.  Groups are as
    long as a month has hours, whatever the size of the table, and every row is
    scored once per feature.
    """
    mix = F.xxhash64(*KEYS, TIME)
    values = F.array(*[F.col(f).cast("double") for f in features])
    spread = df.select(*KEYS, TIME, actual, values.alias("x"), mix.alias("h")).withColumn(
        "g", F.date_trunc("month", TIME)
    )
    group = Window.partitionBy(*KEYS, "g").orderBy("h", TIME)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shuffled = spread.withColumn("other", F.coalesce(F.lag("x", 1).over(group), F.last("x").over(whole)))
    each = shuffled.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = F.transform(
        "x", lambda v, j: F.when(j == F.col("i"), F.get(F.col("other"), j)).otherwise(v)
    )
    scored = model.transform(each.withColumn("features", array_to_vector(swapped)))
    rmse = regression_metrics(scored, ["i"], actual).select("i", "rmse")
    base = rmse.filter("i = -1").select("rmse").scalar()
    names = F.array(*[F.lit(f) for f in features])
    return rmse.filter("i >= 0").select(
        F.get(names, F.col("i")).alias("feature_name"), (F.col("rmse") - base).alias("importance_score")
    )
