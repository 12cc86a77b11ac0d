"""Spark ML pipelines: imputation and scaling fitted on the train fold, estimators, grids, search."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.split import percentile_choice, train_medians, train_moments
from cohortloom.operators.weights import balanced_label_weights, severity_weights
from cohortloom.session import scratch_path

#: Deepest tree that the engine grows; `None` in a grid means this, and a tree that gets there is an error.
_TREE_DEPTH_LIMIT = 30
#: Bound of the logistic iterations; a fit that needs all of them is an error.
MAX_ITERATIONS = 6000


class TablePreparer(Estimator):
    """Exact train medians for NULLs, optional scaling by the population std, one vector column out."""

    def __init__(self, columns: Sequence[str], scale: bool = True, output: str = "prepared"):
        super().__init__()
        self.columns, self.scale, self.output = list(columns), scale, output

    def _fit(self, df: DataFrame) -> "TablePreparerModel":
        medians = {r.feature_name: r["median"] for r in train_medians(df, self.columns).collect()}
        fills = {c: medians.get(c, 0.0) for c in self.columns}
        means, stds = dict.fromkeys(self.columns, 0.0), dict.fromkeys(self.columns, 1.0)
        if self.scale:
            m = train_moments(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in self.columns]), self.columns).first()
            means = {c: m[f"{c}__mean"] for c in self.columns}
            stds = {c: m[f"{c}__std"] or 1.0 for c in self.columns}
        return TablePreparerModel(self.columns, fills, means, stds, self.output)


class TablePreparerModel(Model):
    def __init__(self, columns, fills, means, stds, output):
        super().__init__()
        self.columns, self.fills, self.means, self.stds, self.output = columns, fills, means, stds, output

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [f"_prep_{i}" for i in range(len(self.columns))]
        ready = df.withColumns(
            {
                n: (F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c])) - self.means[c]) / self.stds[c]
                for n, c in zip(names, self.columns)
            }
        )
        return VectorAssembler(inputCols=names, outputCol=self.output).transform(ready).drop(*names)


class AnovaPercentile(Estimator):
    """Keep the top percent of vector positions by one-way F; one aggregation per fit."""

    percentile = Param(Params._dummy(), "percentile", "percent of features kept", typeConverter=TypeConverters.toInt)

    def __init__(self, label: str = "label", inputs: str = "prepared", output: str = "features", percentile: int = 50):
        super().__init__()
        self.label, self.inputs, self.output = label, inputs, output
        self._setDefault(percentile=percentile)

    def f_values(self, df: DataFrame) -> list[float]:
        metrics = Summarizer.metrics("count", "mean", "variance")
        rows = df.groupBy(self.label).agg(metrics.summary(F.col(self.inputs)).alias("s")).collect()
        n = sum(r.s["count"] for r in rows)
        out = []
        for j in range(rows[0].s["mean"].size):
            grand = sum(r.s["count"] * r.s["mean"][j] for r in rows) / n
            between = sum(r.s["count"] * (r.s["mean"][j] - grand) ** 2 for r in rows)
            within = sum((r.s["count"] - 1) * r.s["variance"][j] for r in rows if r.s["count"] > 1)
            spare = n - len(rows)
            ok = within > 0 and len(rows) > 1 and spare > 0
            out.append((between / (len(rows) - 1)) / (within / spare) if ok else float("nan"))
        return out

    def _fit(self, df: DataFrame) -> VectorSlicer:
        keep = percentile_choice(self.f_values(df), self.getOrDefault(self.percentile))
        return VectorSlicer(inputCol=self.inputs, outputCol=self.output, indices=keep)


class _Detached:
    """Estimator whose model is written and read back, which leaves its training summary behind.

    A summary holds the session, and a model is part of every scoring task: what the session has gathered in a long
    process would have to be serializable. The number of iterations is kept as `iterations`.
    """

    def _fit(self, df: DataFrame):
        model = super()._fit(df)
        iterations = model.summary.totalIterations if model.hasSummary and isinstance(model, LogisticRegressionModel) else None
        path = scratch_path(df.sparkSession, "classifier")
        model.write().save(path)
        bare = type(model).load(path)
        bare.iterations = iterations
        return bare


class DetachedLogistic(_Detached, LogisticRegression):
    pass


class DetachedForest(_Detached, RandomForestClassifier):
    pass


@dataclass
class ModelConfig:
    """One model of a comparison. `grid` maps parameter names to values; `C` means inverse L2 strength."""

    name: str
    estimator: str
    grid: dict[str, list] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    scale: bool = True
    select: bool = True
    takes_weights: bool = True
    balanced: bool = True


# Hyper-parameter grids. Depth None means as deep as trees may grow.
COMPARISON_MODELS = [
    ModelConfig("LogisticRegression", "logistic", {"percentile": [30, 50, 70], "C": [0.01, 0.1, 1, 10]}),
    ModelConfig(
        "RandomForest", "forest", {"percentile": [30, 50, 70], "numTrees": [100, 300], "maxDepth": [None, 5, 10]}
    ),
    ModelConfig(
        "GradientBoosting", "boosting",
        {"percentile": [30, 50, 70], "maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 5]},
        balanced=False,
    ),
]
SEARCH_MODELS = [
    ModelConfig("LogisticRegression_L2", "logistic", {"C": [0.01, 0.1, 1.0, 10.0, 30.0]}, select=False),
    ModelConfig(
        "LogisticRegression_EN", "logistic", {"C": [0.01, 0.1, 1.0, 10.0], "elasticNetParam": [0.2, 0.5, 0.8]},
        select=False,
    ),
    ModelConfig(
        "RandomForest", "forest",
        {"numTrees": [200, 500], "maxDepth": [None, 4, 8], "minInstancesPerNode": [1, 3, 5]}, scale=False, select=False,
    ),
    ModelConfig(
        "GradientBoosting", "boosting", {"maxIter": [100, 200], "stepSize": [0.03, 0.1], "maxDepth": [2, 3]},
        scale=False, select=False, balanced=False,
    ),
    ModelConfig("GaussianNB", "bayes", {}, scale=False, select=False, takes_weights=False, balanced=False),
]


def _classifier(kind: str, label: str, weight: str | None, seed: int):
    common = {"featuresCol": "features", "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if kind == "logistic":
        return DetachedLogistic(maxIter=MAX_ITERATIONS, standardization=False, elasticNetParam=0.0, **common)
    if kind == "forest":
        return DetachedForest(numTrees=100, maxDepth=10, seed=seed, **common)
    if kind == "boosting":
        return GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed, **common)
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=2, seed=seed, **common)
    if kind == "bayes":
        return NaiveBayes(modelType="gaussian", **common)
    raise ValueError(f"Unknown model: {kind}")


def _param_value(name: str, value, weight_sum: float):
    if name == "C":
        # Spark averages the weighted loss, so its penalty is 1 / (C * sum of weights).
        return "regParam", 1.0 / (float(value) * weight_sum)
    if name == "maxDepth" and value is None:
        return name, _TREE_DEPTH_LIMIT
    return name, value


def pipeline_for(
    config: ModelConfig, features: Sequence[str], label: str = "label", weight: str | None = None, seed: int = 42
) -> Pipeline:
    output = "prepared" if config.select else "features"
    stages = [TablePreparer(features, config.scale, output)]
    if config.select:
        stages.append(AnovaPercentile(label=label))
    return Pipeline(stages=[*stages, _classifier(config.estimator, label, weight, seed)])


@dataclass
class Fitted:
    model: PipelineModel
    params: dict[str, str]
    cv_auc: float | None


def with_training_weight(
    train: DataFrame, config: ModelConfig, strategy: str, label: str = "label", severity: str = "severity"
) -> DataFrame:
    """Train rows with a `weight` column for the strategy: class-balanced, severity-weighted or flat."""
    if strategy == "severity_weighted":
        if not config.takes_weights:
            raise ValueError(f"Model {config.name} does not support strategy={strategy}")
        return severity_weights(train, label, severity)
    if config.balanced:
        return balanced_label_weights(train, label)
    return train.withColumn("weight", F.lit(1.0))


def whole_fit(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline, once its classifier is known to have stopped by itself and not at a limit."""
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel) and (last.iterations or 0) >= MAX_ITERATIONS:
        raise ArithmeticError(f"no convergence in {MAX_ITERATIONS} iterations")
    if isinstance(last, RandomForestClassificationModel) and last.getMaxDepth() == _TREE_DEPTH_LIMIT:
        if max(t.depth for t in last.trees) == _TREE_DEPTH_LIMIT:
            raise ArithmeticError(f"a tree without a depth limit reached the engine's limit of {_TREE_DEPTH_LIMIT}")
    return model


def fit_model(
    config: ModelConfig,
    train: DataFrame,
    features: Sequence[str],
    strategy: str = "standard",
    label: str = "label",
    severity: str = "severity",
    search: bool = True,
    folds: int = 5,
    parallelism: int = 2,
    seed: int = 42,
) -> Fitted:
    """Fit one model, with a grid search over the ready-made `fold` column when asked.

    Folds hold whole entities (see `stratified_group_folds`); selection is by mean fold ROC AUC and the
    best setting is fitted again on all train rows.
    """
    keep = [label, *features] + (["fold"] if "fold" in train.columns else [])
    weighted = with_training_weight(train, config, strategy, label, severity).select(*keep, "weight")
    rows = weighted.withColumn(label, F.col(label).cast("double")).persist()
    try:
        pipe = pipeline_for(config, features, label, "weight", seed)
        clf = pipe.getStages()[-1]
        weight_sum = rows.agg(F.sum("weight")).first()[0] if config.estimator == "logistic" else 1.0
        settings = dict(config.defaults)
        if config.estimator == "logistic":
            settings.setdefault("C", 1.0)
        for name, value in settings.items():
            spark_name, v = _param_value(name, value, weight_sum)
            clf.set(clf.getParam(spark_name), v)
        if not search or not config.grid:
            return Fitted(whole_fit(pipe.fit(rows)), {}, None)
        share = (folds - 1) / folds
        builder = ParamGridBuilder()
        for name, values in config.grid.items():
            if name == "percentile":
                builder = builder.addGrid(pipe.getStages()[1].percentile, values)
                continue
            pairs = [_param_value(name, v, weight_sum * share) for v in values]
            builder = builder.addGrid(clf.getParam(pairs[0][0]), [v for _, v in pairs])
        # numBins=0: the exact curve, not the binned default.
        scorer = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0)
        cv = CrossValidator(
            estimator=pipe, estimatorParamMaps=builder.build(), evaluator=scorer, numFolds=folds, foldCol="fold",
            parallelism=parallelism, seed=seed,
        )
        fitted = cv.fit(rows)
        best = max(range(len(fitted.avgMetrics)), key=lambda i: fitted.avgMetrics[i])
        chosen = {p.name: str(v) for p, v in builder.build()[best].items()}
        return Fitted(whole_fit(fitted.bestModel), chosen, float(fitted.avgMetrics[best]))
    finally:
        rows.unpersist()


def predict_prob(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    """Class-1 probability, or the hard prediction as a float when a model has none; inputs kept."""
    kept = df.columns
    out = model.transform(df)
    if "probability" in out.columns:
        return out.select(*kept, vector_to_array("probability")[1].alias(name))
    return out.select(*kept, F.col("prediction").cast("double").alias(name))


def vector_columns(df: DataFrame, vector: str, width: int, prefix: str) -> DataFrame:
    """array<float> to `<prefix>_000` columns for export; a vector of another length fails, a NULL one gives NULLs."""
    rest = [c for c in df.columns if c != vector]
    wrong = F.concat(F.lit(f"{vector}: not {width} but "), F.size(vector).cast("string"), F.lit(" values"))
    checked = F.when(F.col(vector).isNotNull() & (F.size(vector) != width), F.raise_error(wrong)).otherwise(F.col(vector))
    ready = df.select(*rest, checked.alias(vector))
    return ready.select(*rest, *[F.get(vector, F.lit(i)).cast("double").alias(f"{prefix}_{i:03d}") for i in range(width)])


def columns_vector(df: DataFrame, prefix: str, name: str = "vec") -> DataFrame:
    cols = sorted(c for c in df.columns if c.startswith(f"{prefix}_"))
    return df.select(*[c for c in df.columns if c not in cols], F.array(*cols).alias(name))


def params_text(params: dict[str, str]) -> str:
    return json.dumps(params, ensure_ascii=False, sort_keys=True)
